"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix of one or two words and counts the words that
follow it.  Tasks count the stripes of their own texts; stripes of one prefix
are merged elementwise, which is a grouped sum over (prefix, next word), so a
stripe of any length spreads over many tasks.  One structure gives everything:

* an entry of a stripe is the frequency of the extended phrase;
* the sum of a stripe is the frequency of its prefix, as occurrences at the end
  of a piece are counted in an entry of their own;
* the largest entry of a two-word stripe, and the largest entry that ends in a
  bigram, are what decides whether a longer phrase subsumes it.

Phrases are grown level by level, as a phrase is at least as rare as its parts:
words first, then stripes of the words that reach the least frequency, then
stripes of the bigrams that do.  Next words that are too rare share one entry of
the stripe, so its sum stays right.  Which words or bigrams are frequent is told
to the tasks by a bitmap of fixed size; a false positive costs work and is
dropped when the exact counts are known.

Words are compared as 64-bit hashes; if two words of the corpus have the same,
all is counted again with another seed.

Defined cases: a NULL or empty text has no words; a NULL language is ``und``; a
text without separators is one piece, read in parts of bounded size; repeated
rows count as often as they occur; a language without candidates has no row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortloom.llm.common import join_small
from cohortloom.llm.shingles import hash_runs, mixed
from cohortloom.operators.ranks import number_rows
from cohortloom.storage import bounded_batches, materialize

LEAST = 10
TOP = 2000
#: A longer phrase subsumes a part that it holds in at least this share of its occurrences (percent).
SUBSUMED = 50
NONE = "und"
#: Bits of the bitmap of frequent words or bigrams.
BITS = 1 << 26
_END, _REST = 0, 1  # entries of a stripe that are no word
_SPACE, _CUT = 32, 10
_FOLD = bytes(_SPACE if b == 9 else _CUT if b in b".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_PART = 1 << 19
#: Words that a task counts at once; codes of three of them fit 63 bits.
_WORDS = 1 << 18
_SHIFT = 13


class _Words:
    """Word hashes and piece numbers of one language's texts, as far as they are not counted yet."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.size = self.piece = 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        h, p = np.concatenate(self.hashes), np.concatenate(self.pieces)
        self.hashes, self.pieces, self.size = [], [], 0
        return h, p

    def keep(self, h: np.ndarray, p: np.ndarray) -> None:
        self.hashes, self.pieces, self.size = [h], [p], len(h)


def _parts(text: str) -> Iterator[bytes]:
    """A text's folded bytes in parts that end between words."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = min(len(folded), at + _PART)
        if end < len(folded):
            cut = max(folded.rfind(b" ", at, end), folded.rfind(b"\n", at, end))
            if cut < at:  # one word longer than a part
                cuts = [c for c in (folded.find(b" ", end), folded.find(b"\n", end)) if c >= 0]
                cut = min(cuts, default=len(folded) - 1)
            end = cut + 1
        yield folded[at:end]
        at = end


def _stream(batches: Iterator[pa.RecordBatch], seed: int, level: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, list]]:
    """(language, hashes, pieces, texts) in blocks; the last ``level`` words of a block come again in the next.

    ``texts`` are the parts behind the block with the places of their words, at level 0 only.
    """
    held: dict[str, _Words] = defaultdict(_Words)
    kept: dict[str, list] = defaultdict(list)
    salt = mixed(np.array([seed + 1], np.uint64))[0]

    def block(lang: str, last: bool) -> tuple[str, np.ndarray, np.ndarray, list]:
        own = held[lang]
        h, p = own.take()
        if last:  # no word follows: the end of a piece
            pad = np.arange(1, level + 1)
            return lang, np.concatenate([h, np.zeros(level, np.uint64)]), np.concatenate([p, -pad]), kept.pop(lang, [])
        if level:
            own.keep(h[-level:], p[-level:])
        return lang, h, p, kept.pop(lang, [])

    def feed(lang: str, joined: bytes) -> None:
        own = held[lang]
        data = np.frombuffer(joined, np.uint8)
        cut = data == _CUT
        word = (data != _SPACE) & ~cut
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edges[0::2], edges[1::2]
        h = hash_runs(data, start, end)
        if seed:
            h = mixed(h ^ salt)
        h = np.where(h <= _REST, h + np.uint64(2), h)
        passed = np.cumsum(cut)
        own.hashes.append(h)
        own.pieces.append(passed[start] + own.piece if len(start) else np.zeros(0, np.int64))
        own.piece += int(passed[-1]) if len(passed) else 0
        own.size += len(h)
        if level == 0:
            kept[lang].append((joined, start, end))

    for batch in batches:
        waiting: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            for part in _parts(text.as_py() or ""):
                waiting[lang].append(part)
                sizes[lang] += len(part)
                if sizes[lang] >= _PART:
                    feed(lang, b"".join(waiting.pop(lang)))
                    sizes[lang] = 0
                    if held[lang].size >= _WORDS:
                        yield block(lang, False)
            waiting[lang].append(b"\n")
        for lang, texts in waiting.items():
            feed(lang, b"".join(texts))
            if held[lang].size >= _WORDS:
                yield block(lang, False)
    for lang in list(held):
        if held[lang].size:
            yield block(lang, True)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(text), F.coalesce(F.col(lang).cast("string"), F.lit(NONE)))


def words(docs: DataFrame, text: str, lang: str, seed: int) -> DataFrame:
    """``lang``, ``word`` (hash), ``n``, and the least and greatest text with that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, h, _, texts in _stream(batches, seed, 0):
            found, first, n = np.unique(h, return_index=True, return_counts=True)
            ends = np.cumsum([len(start) for _, start, _ in texts])
            place = np.searchsorted(ends, first, side="right")
            spelt = []
            for i, at in zip(place.tolist(), first.tolist()):
                joined, start, end = texts[i]
                at -= int(ends[i]) - len(start)
                spelt.append(joined[start[at] : end[at]].decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found)), pa.array(found.view(np.int64)), pa.array(n), pa.array(spelt, pa.string())],
                names=["lang", "word", "n", "spelt"])

    counted = _texts(docs, text, lang).mapInArrow(run, "lang string, word long, n long, spelt string")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("spelt").alias("spelt"), F.max("spelt").alias("other"))


def _place(first: Column, second: Column | None = None) -> Column:
    mixed_up = first if second is None else first.bitwiseXOR(F.shiftrightunsigned(second, _SHIFT))
    return mixed_up.bitwiseAND(F.lit(BITS - 1))


def _bitmap(keys: DataFrame, place: Column) -> np.ndarray:
    """The places of all keys as bits: BITS / 8 bytes, whatever the number of keys."""
    at = place + 1  # the buckets of 32768 bits start at 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _set_bits(bits: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Whether the places of hashes have their bit set."""
    at = (first if second is None else first ^ (second >> np.uint64(_SHIFT))) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def stripes(docs: DataFrame, text: str, lang: str, seed: int, frequent: np.ndarray, length: int) -> DataFrame:
    """Merged stripes of all prefixes of ``length`` words: ``lang``, ``a`` (, ``b``), ``next``, ``n``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # BITS / 8 bytes
    prefix = ["a", "b"][:length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for name, h, p, _ in _stream(batches, seed, length):
            if len(h) <= length:
                continue
            heads, nexts = [h[i : len(h) - length + i] for i in range(length)], h[length:]
            inside = p[:-length] == p[length:]
            if length == 1:
                known = _set_bits(bits, h)
                nexts = np.where(inside, np.where(known[1:], nexts, np.uint64(_REST)), np.uint64(_END))
                chosen = known[:-1]
            else:
                known = _set_bits(bits, h[:-1], h[1:]) & (p[:-1] == p[1:])
                chosen = inside & known[:-1] & known[1:]
            columns = [c[chosen] for c in (*heads, nexts)]
            # codes of the block's words, so that prefix and next word are one number
            found, codes = np.unique(np.concatenate(columns), return_inverse=True)
            codes = codes.reshape(length + 1, -1).astype(np.uint64)
            width = np.uint64(max(1, int(len(found) - 1).bit_length()))
            key = codes[0]
            for c in codes[1:]:
                key = (key << width) | c
            key, n = np.unique(key, return_counts=True)
            mask, head = (np.uint64(1) << width) - np.uint64(1), key >> width
            # a stripe: one prefix and all its next words
            own, first = np.unique(head, return_index=True)
            ends = np.append(first, len(key)).astype(np.int32)
            parts = [found[(own >> (width * np.uint64(length - 1 - i))) & mask] for i in range(length)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), *[pa.array(x.view(np.int64)) for x in parts],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(found[key & mask].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(n))],
                names=["lang", *prefix, "next", "n"])

    schema = ", ".join(["lang string", *[f"{c} long" for c in prefix], "next array<long>", "n array<long>"])
    own = _texts(docs, text, lang).mapInArrow(run, schema)
    entries = own.select("lang", *prefix, F.inline(F.arrays_zip("next", "n")))
    return entries.groupBy("lang", *prefix, "next").agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)) in whole numbers of up to 38 digits."""
    wide = "decimal(19,0)"
    top = (a.cast(wide) * a.cast(wide)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, left.cast(wide) * right.cast(wide))


def _scored(one: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Both lengths' phrases: ``lang``, ``w1``, ``w2``, ``w3`` (or NULL), ``a``, ``l``, ``r``, ``score`` of the lowest cut."""
    totals = materialize(one.groupBy("lang", "a").agg(F.sum("n").alias("f")), "phrase-totals")

    def whole(df: DataFrame, word: str, name: str) -> DataFrame:
        return join_small(df, totals.select("lang", F.col("a").alias(word), F.col("f").alias(name)), ["lang", word], "inner")

    pairs = whole(whole(bigrams, "w1", "l"), "w2", "r").withColumn("w3", F.lit(None).cast("long"))
    pairs = pairs.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    parts = bigrams.select("lang", "w1", "w2", F.col("a").alias("f"))
    triples = trigrams.join(parts.withColumnRenamed("f", "f12"), ["lang", "w1", "w2"])
    triples = triples.join(parts.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["lang", "w2", "w3"])
    triples = whole(whole(triples, "w1", "f1"), "w3", "f3")
    triples = triples.withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
    first = F.col("s1") <= F.col("s2")
    columns = ["lang", "w1", "w2", "w3", "a", "l", "r", "score"]
    return pairs.select(columns).unionByName(triples.withColumns({
        "l": F.when(first, F.col("f1")).otherwise(F.col("f12")), "r": F.when(first, F.col("f23")).otherwise(F.col("f3")),
        "score": F.least("s1", "s2")}).select(columns))


def _in_reach(found: DataFrame, top: int) -> DataFrame:
    """``found`` without phrases that ``top`` others of their language surely exceed in score."""
    banded = found.withColumn("_band", F.floor(F.log1p("score") * 500).cast("int"))
    higher = W.partitionBy("lang").orderBy(F.desc("_band")).rowsBetween(W.unboundedPreceding, -1)
    counts = banded.groupBy("lang", "_band").count()  # at most 7,000 bands in a language
    reached = counts.withColumn("_higher", F.coalesce(F.sum("count").over(higher), F.lit(0))).where(F.col("_higher") < top)
    lowest = materialize(reached.groupBy("lang").agg(F.min("_band").alias("_lowest")), "phrase-bands")
    return join_small(banded, lowest, ["lang"], "inner").where("_band >= _lowest").drop("_band", "_lowest")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """The first ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    with bounded_batches(docs.sparkSession):
        return _mine(docs, text, lang, least, top, subsumed)


def _mine(docs: DataFrame, text: str, lang: str, least: int, top: int, subsumed: int) -> DataFrame:
    seed = 0
    while True:
        vocabulary = materialize(words(docs, text, lang, seed), "phrase-words")
        if not vocabulary.where("spelt <> other").limit(1).count():
            break
        seed += 1
    often = F.col("n") >= least
    one = materialize(stripes(docs, text, lang, seed, _bitmap(vocabulary.where(often), _place(F.col("word"))), 1), "phrase-stripes")
    bigrams = materialize(
        one.where(often & ~F.col("next").isin(_END, _REST)).select("lang", F.col("a").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a")),
        "phrase-bigrams")
    two = stripes(docs, text, lang, seed, _bitmap(bigrams, _place(F.col("w1"), F.col("w2"))), 2)
    trigrams = materialize(
        two.where(often).select("lang", F.col("a").alias("w1"), F.col("b").alias("w2"), F.col("next").alias("w3"), F.col("n").alias("a")),
        "phrase-trigrams")
    scored = _scored(one, bigrams, trigrams)
    longest = (
        trigrams.select("lang", "w1", "w2", "a").unionByName(trigrams.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("lang", "w1", "w2").agg(F.max("a").alias("_longer")).withColumn("_pair", F.lit(True))
    )
    # only bigrams have a longer candidate; the flag keeps trigrams out of the join's matches
    marked = scored.withColumn("_pair", F.when(F.col("w3").isNull(), True)).join(longest, ["lang", "w1", "w2", "_pair"], "left")
    kept = marked.where(F.coalesce(100 * F.col("_longer") < subsumed * F.col("a"), F.lit(True))).drop("_pair", "_longer")
    found = materialize(_in_reach(materialize(kept, "phrase-scores"), top), "phrase-found")
    needed = found.select("lang", F.explode(F.array("w1", "w2", "w3")).alias("word")).where("word is not null").distinct()
    spelling = materialize(vocabulary.select("lang", "word", "spelt").join(needed, ["lang", "word"]), "phrase-spelling")
    for c in ("w1", "w2", "w3"):
        found = join_small(
            found.withColumn(c, F.coalesce(c, F.lit(_END))),
            spelling.select("lang", F.col("word").alias(c), F.col("spelt").alias(f"_{c}")), ["lang", c], "left")
    named = materialize(
        found.select("lang", F.concat_ws(" ", "_w1", "_w2", "_w3").alias("phrase"), "a", "l", "r", "score",
                     (-F.col("score")).alias("_down"), (-F.col("a")).alias("_fewer")), "phrase-named")
    ranked = number_rows(named, ["lang"], ["_down", "_fewer", "phrase"], "rank").where(F.col("rank") <= top)
    sizes = materialize(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    return join_small(ranked, sizes, ["lang"], "inner").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
