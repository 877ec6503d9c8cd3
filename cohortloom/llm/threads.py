"""Quotation linking: reply-ordered conversations without their quotes.

A line that starts with ``>`` marks is quoted; the number of marks is its level.
A quoted passage is a run of lines that follow each other at one level; its
normalised lines (blank ones left out) are hashed in runs of 1, 2, 4, ... lines
at every place, and these hashes are joined to the earliest message of the
conversation that has the same lines in a row among its own.  So a passage falls
back to shorter runs of it, and a common line decides only where no longer run
is found.  A message replies to the origin of the longest run found at its least
nested linked level, of several to the latest; without a linked quote it goes
on from the message before it.

Order: the reply tree read depth first, children by time.  Runs of messages that
each go on from the one before are one segment; a segment that starts elsewhere
hangs on a message of an earlier one.  All of a segment comes before the
segments that hang on it, later places first, so a segment's rank is the path
of (-place, start) pairs from the first segment, found by pointer doubling.

Everything is joined and scanned relationally: no conversation is gathered into
one row or task (``number_rows`` slices a conversation too long for one task).

Defined cases: a NULL text has no lines and stays as an empty text; a NULL
conversation is one of its own; NULL turns come first; rows with an equal turn
follow each other in row order; quotes of later or unknown messages are removed
without a link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.llm.common import ascii_lower
from cohortloom.operators.ranks import number_rows, prefix_sums
from cohortloom.storage import materialize

_MARKS = r"^(?:[ \t]?>)+[ \t]?"
_CONV = ["_none", "_conv"]


def normalised(line: Column) -> Column:
    """A line in lower case with single spaces and without quote marks."""
    bare = F.regexp_replace(line, _MARKS, "")
    return F.btrim(F.regexp_replace(ascii_lower(bare), r"[\x20\x09-\x0D]+", " "))


def quote_level(line: Column) -> Column:
    """Number of quote marks at the start of a line."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.char_length(F.regexp_replace(marks, "[^>]", ""))


def read_messages(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per message: own text, hashes of its own lines; place, level and hash (NULL if blank) of its quoted lines."""
    quoted = lambda line: F.rlike(line, F.lit(_MARKS))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    shaped = rows.select(
        F.col(conv).isNull().alias("_none"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("_conv"),
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("_turn"),
        F.monotonically_increasing_id().alias("_row"), lines.alias("_lines"))
    return shaped.select(
        *_CONV, "conv_id", "turn", "role", "_turn", "_row",
        F.array_join(F.filter("_lines", lambda x: ~quoted(x)), "\n").alias("text"),
        F.transform(F.filter("_lines", lambda x: ~quoted(x) & (normalised(x) != "")), lambda x: F.md5(normalised(x))).alias("_own"),
        F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), quote_level(x).alias("level"), F.when(
            quoted(x) & (normalised(x) != ""), F.md5(normalised(x))).alias("hash"))), lambda x: x["level"] > 0).alias("_quoted"),
        F.size(F.filter("_lines", quoted)).cast("long").alias("n_quoted"))


def passages(messages: DataFrame) -> DataFrame:
    """One row per quoted passage: the message's columns, ``level`` and ``hashes`` of its lines, blank ones left out."""
    lines = messages.select(*_CONV, "n", "_row", F.explode("_quoted").alias("q")).select(*_CONV, "n", "_row", "q.*")
    # lines of one level follow each other where place and number grow alike
    run = F.col("at") - F.row_number().over(Window.partitionBy("_row", "level").orderBy("at"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("at", "hash"))))
    grouped = lines.withColumn("_run", run).groupBy(*_CONV, "n", "_row", "level", "_run").agg(ordered.alias("_lines"))
    return grouped.where(F.size("_lines") > 0).select(*_CONV, "n", "_row", "level", F.col("_lines.hash").alias("hashes"))


def line_runs(rows: DataFrame, hashes: str, doublings: int) -> DataFrame:
    """``rows`` without ``hashes``, once for each different run of 1, 2, 4, ... 2^doublings lines: ``lines``, ``hash``.

    A run's hash is that of its two halves' hashes, so each doubling is one pass over the array.
    """
    others = [c for c in rows.columns if c != hashes]
    out = rows.withColumn("_runs0", F.col(hashes))
    for step in range(1, doublings + 1):
        shorter, half = F.col(f"_runs{step - 1}"), 1 << step - 1
        firsts = F.slice(shorter, 1, F.greatest(F.size(shorter) - half, F.lit(0)))
        out = out.withColumn(f"_runs{step}", F.transform(firsts, lambda x, i: F.md5(F.concat(x, F.get(shorter, i + half)))))
    sized = [F.transform(F.array_distinct(f"_runs{step}"), lambda x: F.struct(F.lit(1 << step).alias("lines"), x.alias("hash")))
             for step in range(doublings + 1)]
    return out.select(*others, F.explode(F.concat(*sized)).alias("_r")).select(*others, "_r.*")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``_row`` of each message with a linked quote and the place (n) of its origin."""
    quoted = materialize(passages(messages.where(F.size("_quoted") > 0)), "thread-passages")
    longest = quoted.agg(F.max(F.size("hashes"))).first()[0] or 1
    doublings = longest.bit_length() - 1
    key = [*_CONV, "lines", "hash"]
    asked = line_runs(quoted, "hashes", doublings)
    own = line_runs(messages.where(F.size("_own") > 0).select(*_CONV, "n", "_own"), "_own", doublings)
    origins = own.join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min("n").alias("origin"))
    linked = asked.join(origins, key).where(F.col("origin") < F.col("n"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "lines", "origin"))
    return linked.groupBy("_row").agg(best.alias("b")).select("_row", F.col("b.origin").alias("_origin"))


def _paths(segments: DataFrame) -> DataFrame:
    """Path of every segment that is not the first of its conversation, by pointer doubling.

    ``segments`` has ``_seg``, ``start``, ``place`` and ``above``, the segment it hangs on.
    """
    step = F.array(F.struct((-F.col("place")).alias("place"), F.col("start").alias("start")))
    state = materialize(segments.select(*_CONV, "_seg", F.col("above").alias("_at"), step.alias("path")), "thread-paths")
    while state.where(F.col("_at") > 0).limit(1).count():
        upper = state.select(*_CONV, F.col("_seg").alias("_at"), F.col("_at").alias("_next"), F.col("path").alias("_upper"))
        joined = state.join(upper, [*_CONV, "_at"], "left")
        state = materialize(joined.select(
            *_CONV, "_seg", F.coalesce("_next", "_at").alias("_at"),
            F.when(F.col("_upper").isNull(), F.col("path")).otherwise(F.concat("_upper", "path")).alias("path")), "thread-paths")
    return state.select(*_CONV, "_seg", "path")


def reply_order(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``position``, ``turn``, ``role``, ``reply_to`` (position in time), ``linked``, ``n_quoted``, ``text``."""
    written = materialize(read_messages(rows, conv, turn, role, text), "thread-messages")
    places = materialize(number_rows(written.select(*_CONV, "_turn", "_row"), _CONV, ["_turn", "_row"], "n").select("_row", "n"), "thread-places")
    messages = written.join(places, "_row")
    quoting = messages.where(F.size("_quoted") > 0).select(*_CONV).distinct()
    links = materialize(link_quotes(messages.join(quoting, _CONV, "left_semi")), "thread-links")
    placed = messages.drop("_own", "_quoted").join(links, "_row", "left")
    above = F.when(F.col("n") > 1, F.coalesce(F.col("_origin"), F.col("n") - 1))
    placed = placed.withColumns({"reply_to": above, "linked": F.col("_origin").isNotNull()})
    begins = F.coalesce(F.col("reply_to") != F.col("n") - 1, F.lit(False))
    slim = placed.select(*_CONV, "n", "_row", "reply_to", begins.cast("long").alias("_begins"))
    # only conversations in which some message turns back need more than their own order
    turning = slim.where("_begins = 1").select(*_CONV).distinct()
    bent = slim.join(turning, _CONV, "left_semi")
    numbered = prefix_sums(bent, _CONV, ["n"], {"_earlier": "_begins"}).withColumn("_seg", F.col("_earlier") + F.col("_begins"))
    numbered = materialize(numbered.select(*_CONV, "n", "_row", "reply_to", "_begins", "_seg"), "thread-segments")
    starts = numbered.where("_begins = 1").select(*_CONV, "_seg", F.col("n").alias("start"), F.col("reply_to").alias("place"))
    segments = starts.join(numbered.select(*_CONV, F.col("n").alias("place"), F.col("_seg").alias("above")), [*_CONV, "place"])
    ranked = numbered.join(_paths(segments), [*_CONV, "_seg"], "left")
    none = F.array().cast("array<struct<place:bigint,start:bigint>>")
    ordered = number_rows(ranked.select(*_CONV, "_row", "n", F.coalesce("path", none).alias("path")), _CONV, ["path", "n"], "_position")
    moved = materialize(ordered.select("_row", "_position"), "thread-order")
    return placed.join(moved, "_row", "left").select(
        "conv_id", F.coalesce("_position", "n").alias("position"), "turn", "role", "reply_to", "linked", "n_quoted", "text")
