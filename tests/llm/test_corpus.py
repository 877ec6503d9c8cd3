import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.functions import draws
from cohortloom.llm import catalog, importance, unit_dedup
from cohortloom.storage import materialize

MEDIUM, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


# ---- line hashing --------------------------------------------------------------

def plain_units(text, least):
    """(level, start, end, body) of all units, by regular expressions."""
    text, out = text or "", []
    strip = lambda m: (m.start() + len(m.group()) - len(m.group().lstrip()), m.start() + len(m.group().rstrip()))
    flat = lambda place: " ".join(text[slice(*place)].lower().split())
    lines = [m.span() for m in re.finditer(r"[^\n]*\n?", text)]
    full = [bool(text[a:b].strip()) for a, b in lines]
    for i in range(len(lines)):
        if full[i] and not (i and full[i - 1]):
            last = i
            while last + 1 < len(lines) and full[last + 1]:
                last += 1
            if last > i:
                body = text[lines[i][0] : lines[last][1]]
                place = (lines[i][0] + len(body) - len(body.lstrip()), lines[i][0] + len(body.rstrip()))
                out.append(("paragraph", *place, tuple(" ".join(text[a:b].lower().split()) for a, b in lines[i : last + 1])))
    for m in re.finditer(r"[^\n]+", text):
        if not m.group().strip():
            continue
        out.append(("line", *strip(m), flat(strip(m))))
        at = m.start()
        for part in re.split(r"(?<=[.!?])(?=\s)", m.group()):
            if part.strip():
                start = at + len(part) - len(part.lstrip())
                out.append(("sentence", start, start + len(part.strip()), flat((start, start + len(part.strip())))))
            at += len(part)
    words = lambda u: len(" ".join(u[3]).split()) if u[0] == "paragraph" else len(u[3].split())
    return [u for u in out if u[0] in least and words(u) >= least[u[0]]]


def brute_units(rows, least=unit_dedup.LEAST):
    """Removed (doc_id, start, end) by walking the documents in rank order."""
    seen, out = set(), []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for level, start, end, body in sorted(plain_units(text, least), key=lambda u: u[1]):
            if (level, body) in seen:
                gone.append((start, end))
            seen.add((level, body))
        out += [(key, *p) for p in set(gone) if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in gone)]
    return sorted(out, key=repr)


def pieces(texts):
    """All sentence pieces of all lines, whatever their length."""
    return {u[3] for text in texts for u in plain_units(text, {"sentence": 1})}


def places(found):
    return sorted(((r.doc_id, r.start, r.end) for r in found.collect()), key=repr)


@pytest.mark.parametrize("least", [unit_dedup.LEAST, {"sentence": 6}, {"line": 1, "paragraph": 2}, {"sentence": 6, "line": 1, "paragraph": 1}])
def test_repeated_units_against_brute_force(spark, least):
    docs = catalog.table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_units(rows, least)
    assert want and places(unit_dedup.repeated_units(docs, least=least)) == want


def test_repeated_units_of_odd_rows(spark, odd_docs, monkeypatch):
    rows = [*odd_docs, (None, "  The quick  brown FOX jumps over the lazy dog near the river bank.  ", "en", "x")]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], SCHEMA + ", start int, `key` string")
    for share in (unit_dedup.HOT_SHARE, 2):  # by shuffle; hot ones by broadcast
        monkeypatch.setattr(unit_dedup, "HOT_SHARE", share)
        assert places(unit_dedup.repeated_units(docs)) == brute_units(rows)
    assert unit_dedup.repeated_units(docs.where("false")).count() == 0
    left = unit_dedup.deduplicate(docs).collect()
    assert len(left) == len(rows) and all(r.start == 5 and r["key"] == "c" for r in left)
    assert unit_dedup.deduplicate(docs.where("false")).count() == 0


def test_units_are_cut_out_of_the_text(spark):
    line = "one two three four five six seven."
    rows = [(1, f"{line} Own words here.\n{line}", "", ""), (2, f"Start. {line}\nEnd", "", ""), (3, None, "", "")]
    got = {r.doc_id: r.text for r in unit_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: f"{line} Own words here.\n", 2: "Start. \nEnd", 3: None}


def test_rows_with_equal_or_missing_keys_are_cut_one_by_one(spark):
    line = "one two three four five six seven."
    rows = [(1, line, "a", ""), (1, f"zero. {line}", "b", ""), (None, line, "c", "")]
    got = {r.lang: r.text.strip() for r in unit_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": "", "b": "zero.", "c": line}  # a missing key ranks first


def test_a_passage_inside_longer_lines_is_found(spark):
    passage = " ".join(f"The {w} word number {i} stands in this passage here." for i, w in enumerate("abcdefgh"))
    rows = [(i, f"Intro {i} goes before without a mark {passage} and ending {i} follows.", "", "") for i in range(3)] + [(9, "A clean text of its own words only.", "", "")]
    got = unit_dedup.repeated_units(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {1, 2} and sum(r.words for r in got if r.doc_id == 1) > 50


def test_a_paragraph_does_not_take_lines_of_other_texts_along(spark):
    """Document 2's paragraph has the words of document 1's line, but not its line breaks."""
    rows = [(1, "a b c d", "", ""), (2, "a b\nc d", "", ""), (3, "a b", "", ""), (4, "c d", "", ""), (5, "a\nb c d", "", ""), (6, "a b\n c  D", "", "")]
    least = {"sentence": 1, "line": 1, "paragraph": 1}
    got = {r.doc_id: r.text for r in unit_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA), least=least).collect()}
    assert got == {1: "a b c d", 2: "a b\nc d", 3: "", 4: "", 5: "a\nb c d", 6: ""}


@pytest.mark.parametrize("least", [unit_dedup.LEAST, {"sentence": 1, "line": 1, "paragraph": 1}, {"sentence": 3, "line": 1}, {"paragraph": 1, "sentence": 2}])
def test_no_text_is_lost(spark, least):
    """Every piece of every line still stands somewhere, and no kept place lies in a larger unit that is removed."""
    rng = np.random.default_rng(8)
    said = ["A b.", "C d!", "a  B.", "Tail", "one two three four five six seven.", "e f g", "H i? j k."]
    texts = ["".join(str(said[k]) + ["\n", " ", "\n\n", "\n \n", "  "][int(rng.integers(5))] for k in rng.integers(0, len(said), rng.integers(0, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in unit_dedup.deduplicate(docs, least=least).collect()}
    assert pieces(left.values()) >= pieces(texts)
    removed = unit_dedup.repeated_units(docs, least=least).collect()
    order = unit_dedup.LEVELS.index
    gone = {(r.doc_id, r.start, r.end, order(r.level)) for r in removed}
    assert gone and not [r for r in removed if any(d == r.kept_doc_id and a <= r.kept_start < b and g > order(r.level) for d, a, b, g in gone)]


# ---- importance resampling -------------------------------------------------------

def test_held_out_labels_are_told_apart(spark):
    docs, labels = catalog.table(spark, MEDIUM, "documents"), catalog.table(spark, MEDIUM, "labels")
    train = labels.where("doc_id % 2 = 0")
    judged = importance.classify(docs, train, F.col("quality") == 1)
    test = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert test.kept[test.quality == 1].mean() > 0.97 and test.kept[test.quality == 0].mean() < 0.15
    assert judged.count() == docs.count()


@pytest.mark.parametrize("n", [1, 7, 500])
def test_kth_largest(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2).tolist() + [1e9, -1e9, 0.0, 0.0, 0.0, 5e-324]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    for k in {1, 2, len(values) // 2, len(values) - 1, len(values)}:
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0) is None and importance.kth_largest(df, "v", len(values) + 1) is None


def test_weights_against_plain_counts(spark):
    docs = [(1, "good words here"), (2, "good words there"), (3, "bad bad bad"), (4, None), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sample = spark.createDataFrame([(1, True), (3, False)], "_key long, _good boolean")
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for key, text in docs:
        np.add.at(raw, importance.features(text), 1)
        if key == 1:
            np.add.at(target, importance.features(text), 1)
    less = importance.SMOOTHING * target.sum() / raw.sum()
    want = np.log((target + less) / (target + less).sum()) - np.log((raw + importance.SMOOTHING) / (raw + importance.SMOOTHING).sum())
    ratios = importance.fit(frame, sample)
    assert np.allclose(ratios, want)
    scored = {r.doc_id: r for r in importance.score(frame, ratios).collect()}
    assert scored[1].log_weight == pytest.approx(want[importance.features(docs[0][1])].sum())
    assert scored[4].log_weight == scored[5].log_weight == 0.0 and scored[1].log_weight > scored[3].log_weight
    assert importance.features("x x")[2] == 0


def test_kept_texts_are_not_written(spark, monkeypatch):
    """Texts among the kept columns are judged like the rest, also where ids repeat or are missing, and written by the caller only."""
    written = []
    monkeypatch.setattr(importance, "materialize", lambda df, name="stage": written.append(df.columns) or materialize(df, name))
    docs = [(1, "good words here"), (2, "good words there"), (2, "bad bad bad"), (None, "bad words"), (None, None), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0)], "doc_id long, quality int")
    found = [importance.classify(frame, labels, F.col("quality") == 1, keep=keep) for keep in (["doc_id"], ["doc_id", "text"])]
    own = [sorted(map(repr, f.select("doc_id", "n_features", "log_weight", "gumbel_key", "kept").collect())) for f in found]
    assert own[0] == own[1] and len(own[0]) == len(docs)
    assert written and not any("text" in columns for columns in written)


def test_kept_documents_are_the_top_k_by_likelihood_ratio_and_noise(spark):
    """Both models, the weights, the noise and the k-th place, all by plain counts."""
    docs, labels = catalog.table(spark, SMALL, "documents"), catalog.table(spark, SMALL, "labels")
    rows = docs.select("doc_id", "text").collect()
    good = {}
    for key, quality in labels.select("doc_id", "quality").collect():
        if key is not None and quality is not None:
            good[key] = min(good.get(key, 1), int(quality == 1))
    grams = {key: importance.features(text) for key, text in rows}
    raw = np.bincount(np.concatenate(list(grams.values())), minlength=importance.BUCKETS).astype(float)
    target = np.bincount(np.concatenate([g for key, g in grams.items() if good.get(key)]), minlength=importance.BUCKETS).astype(float)
    less = importance.SMOOTHING * target.sum() / raw.sum()
    ratio = np.log((target + less) / (target + less).sum()) - np.log((raw + importance.SMOOTHING) / (raw + importance.SMOOTHING).sum())
    noise = {r.doc_id: -np.log(-np.log((r.u * 4294967296.0 + 0.5) / 4294967296.0))
             for r in docs.select("doc_id", draws.uniform(7, F.lit(0), F.col("doc_id")).alias("u")).collect()}
    place = {key: ratio[g].sum() + noise[key] for key, g in grams.items()}
    k = round(np.mean(list(good.values())) * len(rows))
    want = set(sorted(place, key=place.get, reverse=True)[:k])
    got = importance.classify(docs, labels, F.col("quality") == 1).collect()
    assert {r.doc_id for r in got if r.kept} == want
    assert all(r.gumbel_key == pytest.approx(place[r.doc_id]) for r in got)


def test_classifier_on_odd_rows(spark, odd_docs):
    rows = [*odd_docs, (None, "no id", "en", "s1")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA + ", log_weight double, kept string")
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (7, 1), (8, 1), (99, None), (None, 1)], "doc_id long, quality int")
    got = importance.classify(docs, labels, F.col("quality") == 1, keep=docs.columns)
    assert got.count() == len(rows) and dict(got.dtypes)["kept"] == "boolean"
    share = 2 / 4  # documents 7 and 8 of 1, 5, 7, 8
    assert abs(got.where("kept").count() - share * len(rows)) <= 2  # equal rows tie
    assert importance.classify(docs, labels.where("false"), F.col("quality") == 1).where("not kept").count() == 0
    assert importance.classify(docs.where("false"), labels, F.col("quality") == 1).count() == 0


def test_gumbel_noise_repeats(spark):
    scored = spark.createDataFrame([(i, 0.0) for i in range(2000)], "doc_id long, log_weight double")
    a = importance.select(scored, 0.25).where("kept").select("doc_id").collect()
    b = importance.select(scored.repartition(5), 0.25).where("kept").select("doc_id").collect()
    assert sorted(a) == sorted(b) and len(a) == 500
    assert importance.select(scored, 0.25, seed=8).where("kept").select("doc_id").collect() != a


# ---- pipeline --------------------------------------------------------------------

def test_stages_against_plain_versions(spark):
    """Every stage on its own input, against the verdict of a brute-force version of its rule."""
    from test_contamination import brute as brute_contamination
    from test_set_join import brute as brute_join
    from test_tokens import brute_file

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas())
        results[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            known = {tuple(r) for r in results[name][0]}
            if name != "decontamination":  # which cuts passages
                assert all(tuple(r) in known for r in results[name][1])
    before, after = results["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert np.mean([r.doc_id in kept for r in before if labels.get(r.doc_id) == 1]) > 0.95
    before, after = results["jaccard_join"]
    assert sorted(r.doc_id for r in after) == sorted(k for k, _, c in brute_join([tuple(r) for r in before]) if k == c)
    before, after = results["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], items) if r[-1]}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)
    hits = {r[0]: r[2] for r in brute_contamination([(r.doc_id, r.text) for r in before], items)}
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if not hits[r.doc_id])
    left = brute_contamination([(r.doc_id, r.text) for r in after], [i for i in items if len((i[1] or "").split()) >= 13])
    assert not any(r[-1] for r in left)
    before, after = results["mixture"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert abs(sum(map(size, after)) - sum(map(size, before))) <= 20 * max(map(size, before))
    before, after = results["token_output"]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == sorted(brute_file([(r.doc_id, r.text) for r in before]))
    assert sum(r.n_tokens for r in after) == max(r.start + r.n_tokens for r in after)


def test_join_stage_judges_rows_where_ids_repeat(spark):
    w, u = " ".join(f"w{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(1, w), (2, w), (2, u), (None, w), (None, w), (None, "all alone here"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.jaccard_join(spark, docs, SMALL)
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, w), (2, u), (None, "all alone here"), (None, None), (3, None)], key=repr)


def test_join_stage_with_repeated_and_missing_ids(spark, odd_docs):
    rows = [*odd_docs, (None, "no id and some more words here", "en", "s"), (None, None, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.jaccard_join(spark, docs, SMALL).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(None) == 2 and 7 not in ids and 10 not in ids and ids.count(9) == 0 and ids.count(8) == 1
    assert len(got) == len(set(map(tuple, got)))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0
