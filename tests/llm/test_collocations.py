import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortloom.llm import collocations

_TYPE = "doc_id long, text string, lang string, a int, n string, word int"


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def _plain(docs, least, top, subsumed=50):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for words in _words(text):
            for m in (1, 2, 3):
                counts[lang or "und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        total = sum(a for p, a in f.items() if len(p) == 1)
        own, longer = [], defaultdict(int)
        for q, b in found.items():
            for part in (q[:-1], q[1:]) if len(q) == 3 else ():
                longer[part] = max(longer[part], b)
        for p, a in found.items():
            if len(p) == 2 and longer[p] and 100 * longer[p] >= subsumed * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -s))
    return sorted(out)


def _mined(spark, docs, least, top):
    df = spark.createDataFrame([(i, t, g, 1, "n", 2) for i, (t, g) in enumerate(docs)], _TYPE).repartition(3)
    got = collocations.mine(df, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def _corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "new", "york", "CITY", "hall", "é", "naïve", "x-1", "¡hola", "a\xa0b", "'tis"] + [f"w{i}" for i in range(30)]
    seps = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", "\r\n", "; "]
    docs = []
    for i in range(n):
        text = "".join(words[int(rng.zipf(1.4)) % len(words)] + seps[int(rng.integers(len(seps)))] for _ in range(rng.integers(0, 60)))
        docs.append((text, [None, "en", "en", "en", "de"][i % 5]))
    return docs


@pytest.mark.parametrize("least,top", [(2, 10_000), (10, 7), (3, 40)])
def test_matches_counting(spark, least, top):
    docs = _corpus(least, 300) + [(None, "en"), ("", "en"), (" .,\n", "fr"), ("a b c " * 400, "en"), ("a a a a a a a a a a a a", ""), ("new york city " * 3, None)]
    assert _mined(spark, docs, least, top) == _plain(docs, least, top)


def test_odd_docs_match_counting(spark, odd_docs):
    docs = [(t, g) for _, t, g, _ in odd_docs]
    assert _mined(spark, docs, 2, 5000) == _plain(docs, 2, 5000)
    assert _mined(spark, [], 2, 10) == []
    assert _mined(spark, [(None, None)], 2, 10) == []


@pytest.mark.parametrize("level", [0, 1, 2])
def test_blocks_of_any_size_hold_the_same_words(monkeypatch, level):
    """Parts, blocks and carried words change nothing: n-grams over block ends are counted once."""
    docs = _corpus(9, 40) + [("w1 w2 w3. " * 500, "en"), ("longword" * 100 + " tail", "en")]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in docs], "lang": [g or "und" for _, g in docs]})

    def grams(part, block):
        monkeypatch.setattr(collocations, "_PART", part)
        monkeypatch.setattr(collocations, "_WORDS", block)
        out = Counter()
        for lang, h, p, _ in collocations._stream(iter([batch.slice(0, 20), batch.slice(20)]), 0, level):
            for i in range(len(h) - level):
                if p[i] == p[i + level] and p[i] >= 0:
                    out[(lang, *h[i : i + level + 1].tolist())] += 1
        return out

    whole = grams(1 << 20, 1 << 20)
    assert sum(whole.values()) == sum(max(0, len(w) - level) for t, _ in docs for w in _words(t))
    assert grams(64, 10) == whole and grams(1000, 1) == whole


def test_equal_hashes_start_again(spark, monkeypatch):
    docs = _corpus(4, 100)
    calls = []
    plain = collocations.words

    def clashing(df, text, lang, seed):
        from pyspark.sql import functions as F

        calls.append(seed)
        found = plain(df, text, lang, seed)
        return found.withColumn("other", F.lit("~")) if seed == 0 else found

    monkeypatch.setattr(collocations, "words", clashing)
    assert _mined(spark, docs, 3, 100) == _plain(docs, 3, 100)
    assert calls == [0, 1]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 98_765_432_109, 123_456_789_012, 99_999_999_999
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)
