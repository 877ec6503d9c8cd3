"""Line hashing: repeated units of text are kept once in the corpus.

Units are paragraphs of several lines (between blank ones), lines, and as a finer
level the lines cut at sentence ends, so that a passage inside a longer line is
found too.  A unit is normalised (lower case, white space as one space, a
paragraph's line breaks kept) and hashed to 128 bits together with its level.
For every digest the earliest unit by (document key, row, offset) is kept, all
others are removed, with their offsets in the original text retained.  A removed
unit inside another removed one is not named.

No text is lost: two units of one digest consist of the same smaller units, so
the earliest occurrence of a unit never lies inside a larger unit that is
removed.  A kept unit may itself have parts that stand earlier in another text.

``least`` gives the levels and the words that a unit of each level has at least.
By default that is ``MIN_WORDS`` for all three, which leaves short lines (titles,
markers, greetings) alone wherever they stand; 1 takes every line with a word.

Digests are grouped with partial aggregation, so a line that is everywhere
moves once per task.  The way back joins on the digest: the few digests that
hold at least one in ``HOT_SHARE`` of all units are, by that count, at most
``HOT_SHARE`` rows and are broadcast; all others are joined by shuffle.

Defined cases: a NULL or empty text has no units; a NULL key ranks first;
repeated rows are separate documents, of which the first one by row number keeps
its units, and are cut by their row number; an empty table gives an empty
result; other columns are ignored, and kept as they are where texts are cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cohortloom.storage import materialize

MIN_WORDS = 6
LEVELS = ("sentence", "line", "paragraph")
LEAST = {level: MIN_WORDS for level in LEVELS}
HOT_SHARE = 5_000
_SLICE_ROWS = 512
_UNITS = 20_000
# to the end of the line or to sentence marks before white space; each character is looked at once
_UNIT = re.compile(r"(?:[^\n.!?]|[.!?](?!\s))+[.!?]?|[.!?]")


def _digest(level: int, body: str) -> bytes:
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16, salt=bytes([level])).digest()


def units_of(text: str, least: Mapping[str, int] = LEAST) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(level, start, end, words, digest) of the units of a text; offsets in characters."""
    sentence, line_words, paragraph = (least.get(level) for level in LEVELS)
    at, first, last = 0, 0, 0
    lines: list[list[str]] = []

    def block() -> Iterator[tuple[int, int, int, int, bytes]]:
        size = sum(map(len, lines))
        if paragraph is not None and len(lines) > 1 and size >= paragraph:
            yield 2, first, last, size, _digest(2, "\n".join(map(" ".join, lines)))
        lines.clear()

    for line in text.split("\n"):
        words = line.lower().split()
        if words:
            start, end = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
            first, last = (first if lines else start), end
            lines.append(words)
            if line_words is not None and len(words) >= line_words:
                yield 1, start, end, len(words), _digest(1, " ".join(words))
            if sentence is not None and len(words) >= sentence:
                for found in _UNIT.finditer(line):
                    raw = found.group()
                    own = raw.lower().split()
                    if len(own) >= max(1, sentence):
                        place = at + found.start()
                        yield 0, place + len(raw) - len(raw.lstrip()), place + len(raw.rstrip()), len(own), _digest(0, " ".join(own))
        else:
            yield from block()
        at += len(line) + 1
    yield from block()


def numbered(docs: DataFrame, row: str = "_row") -> DataFrame:
    """``docs`` written once with a row number, which tells apart rows with equal keys."""
    if row in docs.columns:
        raise ValueError(f"the documents have a column {row}; name another one")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")


def hash_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least: Mapping[str, int] = LEAST, row: str | None = None) -> DataFrame:
    """``key``, ``row``, ``level``, ``start``, ``end``, ``words`` and the digest as two numbers, one row per unit."""
    kind, least = docs.schema[key].dataType, dict(least)
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("row", T.LongType()), T.StructField("level", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.IntegerType()),
        T.StructField("high", T.LongType()), T.StructField("low", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch_of(part: pa.RecordBatch, place: list, units: list) -> pa.RecordBatch:
            own = part.take(pa.array(place, pa.int64()))
            level, start, end, words, digests = zip(*units) if units else ((),) * 5
            halves = np.frombuffer(b"".join(digests), "<i8")
            return pa.RecordBatch.from_arrays([
                own.column(0).cast(arrow.field(0).type), own.column(1), pa.array(level, pa.int32()), pa.array(start, pa.int64()),
                pa.array(end, pa.int64()), pa.array(words, pa.int32()), pa.array(halves[0::2]), pa.array(halves[1::2])], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part, place, units = batch.slice(at, _SLICE_ROWS), [], []
                for i in range(part.num_rows):
                    for unit in units_of(part.column(2)[i].as_py() or "", least):
                        place.append(i)
                        units.append(unit)
                        if len(units) == _UNITS:
                            yield batch_of(part, place, units)
                            place, units = [], []
                yield batch_of(part, place, units)

    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(F.col(key).alias("key"), number.alias("row"), F.col(text).alias("text")).mapInArrow(run, schema)


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least: Mapping[str, int] = LEAST, row: str | None = None) -> DataFrame:
    """One row per removed unit: its level and place, and the place and copies of the one that is kept.

    ``row`` names the row number of ``numbered`` documents, which the result then holds too.
    """
    units = materialize(hash_units(docs, key, text, least, row), "line-units")
    rank = F.struct("key", "row", "start")
    found = units.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = materialize(found.where("copies > 1"), "line-firsts")
    total = units.count()
    hot = F.col("copies") * HOT_SHARE >= max(total, HOT_SHARE * 2)
    sides = [units.join(F.broadcast(firsts.where(hot)), ["high", "low"]), units.join(firsts.where(~hot), ["high", "low"])]
    joined = sides[0].unionByName(sides[1]).where(~rank.eqNullSafe(F.col("first")))
    # the units of one document either lie apart or one holds the other
    before = W.partitionBy("row").orderBy("start", F.desc("end"), F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    joined = joined.withColumn("_until", F.max("end").over(before)).where("_until is null or _until < end")
    return joined.select(
        F.col("key").alias(key), *([F.col("row").alias(row)] if row else []),
        F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1).alias("level"), "start", "end", "words",
        F.col("first.key").alias(f"kept_{key}"), F.col("first.start").alias("kept_start"), "copies")


def remove_units(docs: DataFrame, removed: DataFrame, text: str = "text", row: str = "_row") -> DataFrame:
    """``numbered`` documents without their removed units; the line ends and spaces between units stay."""
    spans = removed.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    empty = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    whole = F.col("_doc")[text]
    # one document's spans are bounded by its own length
    cut = F.aggregate(
        "_spans", empty,
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept"),
            s["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), F.char_length(whole))))
    joined = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(row)).join(spans, row, "left")
    left = F.when(F.col("_spans").isNull(), whole).otherwise(cut)
    return joined.select(*[left.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: Mapping[str, int] = LEAST, row: str = "_row") -> DataFrame:
    """``docs`` with every repeated unit cut out of all texts but its earliest."""
    rows = numbered(docs, row)
    return remove_units(rows, materialize(repeated_units(rows, key, text, least, row), "line-removed"), text, row).drop(row)
