import re
from pathlib import Path

import __spark_entry__ as entry_point


def test_entry_returns_one_row_per_group(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 5 and all(0 <= r.rising <= 1 for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_coverage_table_names_registered_queries():
    text = (Path(__file__).resolve().parents[1] / "COVERAGE.md").read_text()
    listed = set()
    for line in text.splitlines():
        cells = line.split("|")
        if len(cells) == 6 and not line.startswith("|---"):
            listed |= set(re.findall(r"`([a-z0-9_]+)`", cells[3]))
    assert listed <= set(entry_point.queries())
    own = {name for name in entry_point.queries() if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own - listed <= {"repeatable_draws"}
