"""Column-level building blocks: scalars, names, random draws, distributions."""
