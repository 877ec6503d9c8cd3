import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import names, scalars
from cohortloom.operators import intervals, tables, visits
from cohortloom.plans import cohort
from cohortloom.sources import lookups, tables as src


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_genotype_edges(spark):
    call = lambda a, b: one(spark, scalars.allele_call(F.lit(a), F.lit(b)))
    assert call("0/1", "0/0") == "34" and call("1|0", "0|0") == "34" and call("1/1", "1/1") is None
    assert call("./.", "0/0") is None and call("0/0", None) is None
    assert one(spark, scalars.carrier_flag(F.lit(None).cast("string"))) == 0
    assert one(spark, scalars.carrier_flag(F.lit(None).cast("string"), "null")) is None


def test_scalar_edges(spark):
    assert one(spark, scalars.number_or_default(F.lit(" "))) == 0.0
    assert one(spark, scalars.number_or_default(F.lit("many"))) is None
    assert one(spark, scalars.number_or_default(F.lit("2.5"))) == 2.5
    assert one(spark, scalars.safe_log2(F.lit(0.0))) is None and one(spark, scalars.safe_log2(F.lit(-1.0))) is None
    assert one(spark, scalars.joined_key(F.lit(None).cast("string"), F.lit("OH"))) == "NA,OH"
    assert one(spark, scalars.clean_code(F.lit(90), [90], [2])) is None and one(spark, scalars.clean_code(F.lit(2), [90], [2])) == 0


def test_name_cleaning(spark):
    assert one(spark, names.clean_genotype_header(F.lit("[12]AB-CD-b38:GT"))) == "AB-CD"
    assert one(spark, names.clean_run_name(F.lit("CASE_NEU-P12_T3"))) == "CASE-NEU-P"
    assert one(spark, names.part(F.lit("sp|P123|NAME"), "[|]", 2)) == "P123"
    assert one(spark, names.part(F.lit("P123"), "[|]", 2)) is None
    for raw, want in (("a-b", "a.b"), ("1a", "X1a"), (".2x", "X.2x"), ("_x", "X_x"), ("ok_1", "ok_1"), ("", "X")):
        assert one(spark, names.syntactic(F.lit(raw))) == want


def test_feature_naming_suffixes_in_order(spark):
    ids = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3), ("s4", 4), ("s5", 5)], "id string, pos int")
    ann = spark.createDataFrame([("s1", "P1", 1), ("s2", "P2", 2), ("s3", "P1", 3), ("s3", "P9", 4), ("s4", "", 5), ("s5", None, 6)],
                                "aid string, name string, o int")
    got = tables.map_features(ids, ann, "id", "aid", "name", "pos", "o").orderBy("pos").collect()
    assert [(r.id, r.name) for r in got] == [("s1", "P1"), ("s2", "P2"), ("s3", "P1.1")]


def test_feature_naming_passes_taken_names_and_keeps_the_first_row(spark):
    ids = spark.createDataFrame([(f"s{i}", i) for i in range(1, 6)], "id string, pos int")
    ann = spark.createDataFrame([("s1", "P", 1), ("s2", "P", 1), ("s3", "P.1", 1), ("s4", "P", 1), ("s5", "zzz", 1), ("s5", "aaa", 2)],
                                "aid string, name string, o int")
    got = tables.map_features(ids, ann, "id", "aid", "name", "pos", "o").orderBy("pos").collect()
    assert [r.name for r in got] == ["P", "P.2", "P.1", "P.3", "zzz"]


def test_arrays_keep_panel_positions(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (2, "a", 1.0), (2, "c", 3.0)], "s int, f string, v double")
    panel = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "f string")
    got = {r.s: r.features for r in tables.assemble(df, ["s"], "f", "v", panel=panel).collect()}
    assert got == {1: [1.0, 2.0, 3.0, None], 2: [1.0, None, 3.0, None]}
    filled = tables.assemble(df, ["s"], "f", "v", fill=0.0).where("s = 2").first().features
    assert filled == [1.0, 0.0, 3.0]


def test_csv_round_trip_keeps_missing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x"), ("c", 2.0, "")], "k string, v double, t string")
    src.write_csv(df, str(tmp_path / "c"))
    back = {r.k: r for r in src.read_csv(spark, str(tmp_path / "c"), "k string, v double, t string").collect()}
    assert back["b"].v is None and back["a"].t is None and back["b"].t == "x"
    (tmp_path / "m.tsv").write_text("gene\tS-1\tS_2\ng1\t1\tNA\ng2\t3\t4\n")
    long = src.read_matrix(spark, str(tmp_path / "m.tsv"), sep="\t").collect()
    assert {(r.feature, r.sample_id, r.value) for r in long} == {("g1", "S-1", 1.0), ("g1", "S_2", None), ("g2", "S-1", 3.0), ("g2", "S_2", 4.0)}


def test_carrier_table_from_genotype_files(spark, tmp_path):
    head = "#[1]CHROM\t[2]POS\t[3]N1-b38:GT\t[4]N2-b38:GT\t[5]N3-b38:GT\n"
    (tmp_path / "a.tsv").write_text(head + "19\t44908684\t0/0\t0/1\t1/1\n")
    (tmp_path / "b.tsv").write_text(head + "19\t44908822\t0/1\t0/0\t1/1\n")
    read = lambda n: cohort.genotype_rows(spark.read.options(header=True, sep="\t").csv(str(tmp_path / n)))
    people = spark.createDataFrame([("P1", "N1"), ("P2", "N2"), ("P3", "N3"), ("P4", "N4")], "participant string, sample_id string")
    ages = spark.createDataFrame([("P1", 50.0), ("P2", 61.0), ("P3", 70.0)], "participant string, age double")
    got = {r.participant: (r.variant, r.carrier) for r in cohort.carrier_table(read("a.tsv"), read("b.tsv"), people, ages).collect()}
    assert got == {"P1": ("23", 0), "P2": ("34", 1), "P3": (None, 0)}
    with pytest.raises(ValueError):
        tables.require_same_keys(read("a.tsv"), read("b.tsv").where("sample_id <> 'N2'"), "sample_id")


def test_lookup_lists():
    cities = lookups.CITY_CORRECTIONS
    states = lookups.STATE_CORRECTIONS
    assert cities["Bellfontaine"] == "Bellefontaine" and cities["St. Charles"] == "Saint Charles"
    assert states["DC, LA"] == "DC" and len(set(states.values())) < len(states)


def test_visits_drop_single_and_break_ties(spark):
    d = datetime.date
    df = spark.createDataFrame([("a", d(2020, 1, 5), 2), ("a", d(2020, 1, 5), 1), ("a", d(2021, 1, 4), 3), ("b", d(2020, 1, 1), 4)],
                               "s string, date date, rec int")
    out = visits.number_visits(visits.days_from_baseline(df, "s", "date"), "s", "day", ["rec"]).orderBy("visit").collect()
    assert [(r.rec, r.visit, r.day) for r in out] == [(1, 1, 0), (2, 2, 0), (3, 3, 365)]
    assert out[2].years == pytest.approx(365 / 365.25)


@pytest.mark.parametrize("sliced", [False, True])
def test_series_agrees_with_separate_steps(spark, request, sliced):
    if sliced:
        request.getfixturevalue("tiny_slices")
    rng = np.random.default_rng(3)
    day = datetime.date(2020, 1, 1)
    rows = [("hot" if rng.random() < 0.4 else f"s{rng.integers(0, 30)}", day + datetime.timedelta(int(rng.integers(0, 20))), i) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, date date, rec int")
    a = visits.visit_series(df, "s", "date", ["rec"]).select("rec", "day", "visit").toPandas().sort_values("rec")
    b = visits.number_visits(visits.days_from_baseline(df, "s", "date"), "s", "day", ["rec"]).select("rec", "day", "visit").toPandas().sort_values("rec")
    assert a.values.tolist() == b.values.tolist() and len(a) > 100


def test_constant_time_has_no_slope(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "s string, t double, y double")
    assert visits.slopes(df, ["s"], "y", "t").first().slope is None


def test_missing_keys_on_both_sides(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert tables.na_join(a, b, "k").count() == 1 and tables.na_join(a, b, "k", na_matches=True).count() == 2


def test_left_join_chain_rejects_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([("x", 1), ("x", 2)], "k string, b int")
    with pytest.raises(ValueError):
        tables.left_join_chain(a, [b], "k")


def test_near_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    left = [("c1", i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 4000, 60), rng.integers(1, 900, 60)))]
    right = [("c1", j, float(p)) for j, p in enumerate(rng.integers(0, 5000, 60))]
    l = spark.createDataFrame(left, "chr string, peak int, a double, z double")
    r = spark.createDataFrame(right, "chr string, gene int, p double")
    got = {(x.peak, x.gene) for x in intervals.near_join(l, r, "chr", "a", "z", "p", 200.0).select("peak", "gene").collect()}
    want = {(i, j) for _, i, a, z in left for _, j, p in right if a - 200 <= p <= z + 200}
    assert got == want
    best = {x.peak: x.gene for x in intervals.nearest_point(l, r, "chr", "peak", "a", "z", "p", "gene", 200.0).collect()}
    for _, i, a, z in left:
        near = sorted((max(a - p, p - z, 0.0), j) for _, j, p in right if (i, j) in want)
        assert best.get(i) == (near[0][1] if near else None)
