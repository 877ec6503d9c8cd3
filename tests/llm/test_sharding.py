import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortloom.llm import sharding

TYPE = "doc_id long, text string, shard string, record string, range int, size long"


def _run(spark, docs, shards=6, parts=3):
    df = spark.createDataFrame([(*d, "x", "y", 1, 5) for d in docs], TYPE).repartition(parts)
    path = sharding.default_path(spark)
    sharding.write(df, path, shards)
    return sharding.read(spark, path, df.schema)


def _sizes(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r.shard] += len((r.text or "").encode()) + 8
    return out


def _slots_are_gapless(rows):
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_whole_records_in_near_equal_shards(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 999, rng.integers(0, 60)))) for i in range(3000)]
    docs += [(5000 + i, "one text that is everywhere, " * 3) for i in range(1500)] + [(None, "no id")] * 300 + [(7, None), (7, ""), (None, None)]
    rows = _run(spark, docs).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(docs, key=repr)
    assert all(r.record == "y" and r.range == 1 and r.size == 5 for r in rows)
    _slots_are_gapless(rows)
    sizes = _sizes(rows, 6)
    assert max(sizes) - min(sizes) <= 2 * (max(len(t or "") for _, t in docs) + 8) + 0.05 * sum(sizes) / 6
    # only the large groups of equal texts are divided
    divided = {t for t in {r.text for r in rows} if len({r.shard for r in rows if r.text == t}) > 1}
    assert divided <= {"one text that is everywhere, " * 3, "no id"}


def test_same_shards_for_any_partitioning(spark):
    docs = [(i, f"text {i % 700} " * (1 + i % 13)) for i in range(2000)]
    both = [sorted((r.doc_id, r.shard, r.slot) for r in _run(spark, docs, 5, p).collect()) for p in (1, 8)]
    assert both[0] == both[1]


def test_long_records_equal_rows_and_empty_tables(spark):
    docs = [(1, "x" * 500_000), (2, "y" * 400_000)] + [(9, "same")] * 50
    rows = _run(spark, docs, 4).collect()
    assert len(rows) == 52
    _slots_are_gapless(rows)
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 2
    assert _run(spark, [], 4).collect() == []
    assert len(_run(spark, [(None, None)], 4).collect()) == 1


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    # one draw for each range misses many rows, so ranges of uneven size come first
    monkeypatch.setattr(sharding, "DRAWS", 1)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 40)
    rows = spark.range(4000).select(
        F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.xxhash64("id")).alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"),
        F.col("id").alias("k3"), F.when(F.col("id") % 500 == 0, 3000).otherwise(10).cast("long").alias("size"))
    cuts, measured = sharding.splitters(rows, 4, 20)
    assert cuts == sorted(set(cuts))
    share = (4000 * 10 + 8 * 2990) / 200  # 200 ranges, as a range holds 40 rows at most
    found = measured.collect()
    assert sum(r["n"] for r in found) == 4000
    assert all(r["n"] == 1 or r["n"] <= 40 and r["bytes"] <= 2 * share + r["longest"] for r in found)


def test_ranges_are_those_of_the_sorted_keys(spark):
    rng = np.random.default_rng(2)
    keys = [tuple(int(v) for v in rng.choice([-(2**63), -1, 0, 1, 255, 256, 2**63 - 1], 3)) for _ in range(300)]
    cuts = sorted({sharding._start(*k) for k in keys[:40]} | {sharding._start(0), sharding._start(1)})
    rows = spark.createDataFrame([(*k, 1) for k in keys], "k1 long, k2 long, k3 long, size long")
    for r in sharding._ranged(rows, cuts).collect():
        assert r["range"] == sum(c <= sharding._start(r.k1, r.k2, r.k3) for c in cuts)


def test_query_reads_the_shards(spark):
    from cohortloom.llm import catalog

    folder = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["op12_shards"](spark, folder).collect()
    known = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(known) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(r["size"] == len(known[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(known[r.doc_id].encode()) for r in rows)
    assert {r.shard for r in rows} <= set(range(24))
    _slots_are_gapless(rows)
