"""Native operators against their oracle SQL on odd rows."""

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import common, host_rules, source_mix, url_reputation
from cohortloom.llm.common import word_count

DOCS = "doc_id bigint, text varchar, lang varchar, source varchar"
TEN = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
FIVE = ["doc_id", "size", "source_size", "target", "taken"]
THREE = ["page_id", "host", "path", "rule", "verdict"]


def frame(spark, rows, extra="clash string, _text string, _words int, host string, n string"):
    schema = DOCS.replace("bigint", "long").replace("varchar", "string")
    return spark.createDataFrame([(*r, "c", "t", 1, "h", "n") for r in rows], f"{schema}, {extra}")


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(params=["broadcast", "salted"])
def join_way(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)


def test_host_rules_on_odd_rows(spark, oracle, odd_docs, join_way):
    repeated = [(200 + i, "one two three four five six seven " * n + tail, "en", "s9") for i, (n, tail) in enumerate(
        [(1, ""), (2, ""), (3, "x"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (1, "one two three four five")])]
    rows = [*odd_docs, *repeated]
    got = host_rules.judge(frame(spark, rows))
    assert rows_of(got, TEN) == oracle("op10_host_rules", TEN, documents=(DOCS, rows))
    assert host_rules.judge(frame(spark, [])).count() == 0


def test_a_host_that_fails_is_rejected_whole(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "few words", "en", "bad") for i in range(200)] + [(900 + i, good, "en", "bad") for i in range(3)]
    rows += [(1000 + i, good, "en", f"fine{i % 5}") for i in range(300)] + [(5000, "few words", "en", "fine1"), (6000, good, "en", None)]
    got = {r.doc_id: r for r in host_rules.judge(frame(spark, rows)).collect()}
    assert not any(got[900 + i].kept for i in range(3)) and not got[900].base_failed
    assert all(got[1000 + i].kept for i in range(300)) and got[6000].kept and not got[5000].kept


def test_mix_on_odd_rows(spark, oracle, odd_docs, join_way):
    sized = frame(spark, odd_docs).withColumn("size", word_count(F.col("text")))
    got = source_mix.plan_copies(sized, ["doc_id"]).withColumn("taken", F.col("copies") * F.col("size"))
    ours, theirs = rows_of(got, FIVE), oracle("op5_source_mix", FIVE, documents=(DOCS, odd_docs))
    assert [r[:4] for r in ours] == [r[:4] for r in theirs]
    assert source_mix.plan_copies(sized.where("false"), ["doc_id"]).count() == 0


def test_mix_targets_caps_and_reruns(spark):
    rows = [(i, "w " * (1 + i * 7919 % 400), "en", s) for i, s in enumerate(["big"] * 900 + ["mid"] * 250 + ["small"] * 60 + ["tiny"] * 8)]
    sized = frame(spark, rows).withColumn("size", word_count(F.col("text")))
    first = source_mix.plan_copies(sized.repartition(7), ["doc_id"]).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    again = source_mix.plan_copies(sized.repartition(2), ["doc_id"]).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(first) == sorted(again)
    by = {}
    for r in first:
        t = by.setdefault(r.source, [r.source_size, r.target, 0])
        t[2] += r.copies * r.size
        assert 0 <= r.copies <= 3
    total = sum(t[0] for t in by.values())
    assert sum(t[1] for t in by.values()) == pytest.approx(total)
    for size, target, taken in by.values():
        assert target <= 3 * size and abs(taken - target) <= 800
    assert by["tiny"][1] == 3 * by["tiny"][0] and by["tiny"][2] == 3 * by["tiny"][0]
    emitted = source_mix.emit(source_mix.plan_copies(sized, ["doc_id"])).count()
    assert emitted == sum(r.copies for r in first)


def test_mix_slices_many_sources(spark, tiny_slices):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 50:02d}") for i in range(400)]
    sized = frame(spark, rows).withColumn("size", word_count(F.col("text")))
    got = source_mix.plan_copies(sized, ["doc_id"]).groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    assert sum(r.t for r in got) == pytest.approx(sum(r.s for r in got)) and all(r.t <= 3 * r.s for r in got)


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/en", "http://badexample.net/en/x", "http://x.net?q=/en/",
    "http://x.net", "http://x.net/", "http://example.com/de/1?x", "http://example.com/DE/1", "ftp://w.example.org/fr/#a", "http://org/fr/a/b?c#d",
    None, "", "no scheme", "http://", "http://user@h.co.uk:80/a", "http://10.0.0.1:8080/z", "://x/y", "http://É.example.org/fr/", "a://b://c/d", "http://h/\n/x",
]


def test_url_filters_on_odd_rows(spark, oracle, join_way):
    pages = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://q.org/", None)]
    labels = [(i, i % 2, 0) for i in range(0, 30, 3)] + [(3, 1, 0), (6, None, None), (None, 0, 0)]
    frames = (spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string"),
              spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    bad = frames[1].where("quality is not null").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    got = rows_of(url_reputation.judge(frames[0], bad, long_suffixes=()), THREE)
    assert got == oracle("op3_url_filters", THREE, pages=("page_id bigint, url varchar, html varchar", pages),
                         labels=("doc_id bigint, quality int, toxic int", labels))
    assert url_reputation.judge(frames[0].where("false"), bad).count() == 0
    assert {r.verdict for r in url_reputation.judge(frames[0], bad.where("false")).where("rule is null").collect()} == {"allow"}


def test_reputation_shrinks_towards_the_domain(spark):
    pages, bad = [], []
    for i in range(400):
        host = ["spam.example.org", "fine.example.org", "new.spam.info", "old.spam.info"][i % 4]
        pages.append((i, f"http://{host}/{i}"))
        if host != "new.spam.info" or i < 8:
            bad.append((i, int("spam" in host)))
    got = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"))
    verdicts = {r.host: r.verdict for r in got.collect()}
    assert verdicts == {"spam.example.org": "block", "fine.example.org": "allow", "new.spam.info": "block", "old.spam.info": "block"}


def test_registered_domains_by_the_longest_suffix_of_a_table(spark):
    from cohortloom.llm import url_reputation

    table = spark.createDataFrame([("com",), ("UK",), ("co.uk",), ("city.kawasaki.jp",), ("jp",), (None,), ("co.uk",), ("",)], "suffix string")
    want = {
        "a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "u@www.one.city.kawasaki.jp:80": ("one.city.kawasaki.jp", "city.kawasaki.jp"), "kawasaki.jp": ("kawasaki.jp", "jp"),
        "a.b.unknown": ("b.unknown", "unknown"), "10.0.0.1": ("10.0.0.1", "#"), "": ("", ""), "single": ("single", "single"),
        "com": ("com", "com"), ".".join("l" * 500) + ".com": ("l.com", "com"),
    }
    hosts = spark.createDataFrame([(h, 1, 0, "c") for h in want], "host string, n long, f long, extra string")
    got = {r.host: (r._domain, r._suffix) for r in url_reputation.suffix_domains(hosts, table).collect()}
    assert got == want
    assert url_reputation.suffix_domains(hosts, table.where("false")).count() == len(want)
    pages = spark.createDataFrame([(i, f"http://p{i % 4}.bad.co.uk/x", "c") for i in range(40)] + [(100 + i, f"http://p{i}.good.co.uk/", "c") for i in range(20)], "page_id long, url string, host string")
    bad = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)], "page_id long, bad int")
    rates = {r.host: r.bad_rate for r in url_reputation.judge(pages, bad, rules=(), suffixes=table).collect()}
    assert rates["p0.bad.co.uk"] > 0.9 and rates["p3.good.co.uk"] < 0.1
