import hashlib
import random
import re

import pytest

from cohortloom.llm import contamination
from cohortloom.llm.contamination import SuffixAutomaton, remove_spans, words_of

DOCS = "doc_id long, text string, lang string, source string"


def brute(docs, items):
    out = []
    parsed = [(str(i) if i is not None else "", words_of(t)) for i, t in items]
    for key, text, *_ in docs:
        words, hit, found = words_of(text), set(), set()
        for name, item in parsed:
            size = min(13, len(item))
            windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if item else set()
            for at in range(len(words) - size + 1):
                if size and tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
                    found.add(name)
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def small_world(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 6, 13, 14, 30]))) for i in range(3, 18)] + [(None, "zz yy"), (4, text(20)), (99, None)]
    docs = []
    for i in range(60):
        body = text(rnd.randint(0, 60))
        if rnd.random() < 0.5:
            item = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, len(item))
            body = f"{body}, {' - '.join(item[a : a + rnd.randint(1, 25)])}; {text(9)}".upper()
        docs.append((i, body, "x", "y"))
    return docs, items


def answer(spark, docs, items, **more):
    from pyspark.sql import functions as F

    found = contamination.verdict(contamination.find(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), **more))
    picked = found.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
    return sorted(map(tuple, picked.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = small_world(seed)
    assert answer(spark, docs, items) == brute(docs, items)


def test_items_in_blocks_give_the_same(spark):
    docs, items = small_world(3)
    assert answer(spark, docs, items, block_words=40) == brute(docs, items)


def test_odd_rows_and_empty_tables(spark, odd_docs):
    items = [(1, "quick brown fox"), (2, "w0x0 w1x1"), (3, ""), (None, None)]
    assert answer(spark, odd_docs, items) == brute(odd_docs, items)
    assert answer(spark, odd_docs, []) == brute(odd_docs, [])
    assert answer(spark, [], items) == []


def test_automaton_knows_longest_matches():
    machine = SuffixAutomaton([b"a b c d e".split(), b"x b c y".split()], 2)
    spans, items, longest = machine.scan(b"q b c d q c y".split())
    assert (spans, items, longest) == ([(1, 4), (5, 7)], {0, 1}, 3)


def test_spans_are_cut_from_the_text():
    text = "One, two  THREE-four five."
    assert re.sub(r"\s+", " ", remove_spans(text, [(1, 3)])) == "One, -four five."


def test_a_huge_item_is_read_in_parts(spark):
    rnd = random.Random(4)
    item = [f"i{rnd.randint(0, 50)}" for _ in range(600)]
    docs = [(i, " ".join(item[a : a + n]), "x", "y") for i, (a, n) in enumerate([(0, 20), (90, 30), (95, 13), (300, 200), (580, 20), (10, 12), (0, 600)])]
    items = [(1, " ".join(item)), (2, "alone here")]
    assert answer(spark, docs, items, block_words=200) == brute(docs, items)


def test_spans_and_documents_go_by_length_and_coverage(spark):
    item = " ".join(f"q{i}" for i in range(20))
    own = " ".join(f"own{i}" for i in range(600))
    docs = [(1, f"{own}. {item}, {own}", "x", "y"), (2, f"{item} {item}", "x", "y"), (3, own, "x", "y"), (None, None, "x", "y"),
            (4, f"{own} {own} two words", "x", "y"), (5, "", "x", "y"), (1, f"{item} {own}", "x", "y")]
    frame = spark.createDataFrame([(*d, 7, "s", [1]) for d in docs], DOCS + ", n_words int, doc string, spans array<int>")
    bench = spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string")
    for blocks in (contamination.BLOCK_WORDS, 18):
        got = contamination.decontaminate(frame, bench, block_words=blocks)
        assert got.columns == frame.columns
        rows = sorted(((r.doc_id, " ".join((r.text or "").split()), r.n_words, r.doc) for r in got.collect()), key=repr)
        assert rows == sorted([(1, f"{own}. , {own}", 7, "s"), (1, own, 7, "s"), (3, own, 7, "s"), (None, "", 7, "s"),
                               (4, f"{own} {own} two words", 7, "s"), (5, "", 7, "s")], key=repr)
    short = contamination.decontaminate(frame.where("doc_id = 4"), bench, min_span=1).first()
    assert " ".join(short.text.split()) == f"{own} {own}"
    assert contamination.decontaminate(frame.where("false"), bench).count() == 0


def test_one_block_is_walked_once_by_one_worker(spark):
    """Cutting goes with the walk: texts are read once, and a task needs one Python worker."""
    item = " ".join(f"q{i}" for i in range(20))
    own = " ".join(f"own{i}" for i in range(600))
    frame = spark.createDataFrame([(1, f"{own}. {item}, {own}"), (2, item), (3, None)], "doc_id long, text string")
    got = contamination.decontaminate(frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, f"{own}. , {own}"), (3, None)]
