"""Study views over the test tables, and the registered queries with their oracle SQL."""
