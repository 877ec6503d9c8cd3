import duckdb
import pytest

from cohortloom.llm import catalog


@pytest.fixture
def oracle():
    """``oracle(name, **tables)``: sorted rows of a query's SQL over small tables given as (columns, rows)."""

    def run(name, columns, **tables):
        con = duckdb.connect()
        for table, (types, rows) in tables.items():
            con.execute(f"create table {table} ({types})")
            if rows:
                con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
        return sorted(con.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall(), key=repr)

    return run


@pytest.fixture(scope="session")
def odd_docs():
    """Documents with missing values, blanks, repeats, long texts and ties."""
    words = [f"w{i % 97}x{i}" for i in range(30_000)]
    line = "The quick brown fox jumps over the lazy dog near the river bank"
    return [
        (1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \n\t ", "en", None),
        (5, " ".join(words), "en", "s2"), (6, " ".join(words[:-40]), "en", "s2"), (7, " ".join(words), "en", "s2"),
        (8, f"{line}. {line}.\n{line}.", "en", "s1"), (9, f"{line}. {line}.\n{line}.", "en", "s1"), (9, f"{line}. {line}.\n{line}.", "en", "s1"),
        (10, "A B  C", "en", "s3"), (11, "a b d", "en", "s3"), (12, "#*$ %& |<> ok", "en", "s3"), (13, "é ü 中 😀 É", "xx", "é"),
        *[(100 + i, f"{line} number {i}", "en", f"s{i % 4}") for i in range(12)],
    ]
