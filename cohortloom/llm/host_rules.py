"""Host-level quality rules.

Each document gets base figures and a base verdict from its own text.  Base
failures are counted per host (here: ``source``), shrunk with an empirical beta
prior over all hosts, and a host whose lower posterior bound of the failure
rate exceeds ``max_rate`` is rejected with all its documents.

Defined cases: a NULL text has no words and fails the base rules; a NULL host
is a host of its own; repeated rows are judged one by one; an empty table gives
an empty result; other columns, also with equal names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.llm.beta_prior import lower_bound, shrink
from cohortloom.llm.common import WORD, join_small
from cohortloom.storage import materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in ``hashes``.

    The sorted array is bound once as a lambda argument; a window stays if a
    neighbour in hash order is equal, and the positions are then walked once.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        def equal(x, at):
            return F.coalesce(F.get(p, at)["h"] == x["h"], F.lit(False))

        return F.filter(p, lambda x, at: equal(x, at - 1) | equal(x, at + 1))

    known = F.get(F.transform(F.array(placed), twice), 0)
    spots = F.array_sort(F.transform(known, lambda x: x["i"]))
    empty = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(
        spots, empty,
        lambda acc, i: F.struct(i.alias("last"), (acc["words"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("words")),
        lambda acc: acc["words"],
    )


def base_figures(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, the figures of each text and ``base_failed``."""
    body = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = body.withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)))
    size = F.size("_words")
    at = F.sequence(F.lit(0), size - WINDOW)
    window = F.when(
        size >= WINDOW,
        F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])),
    )
    hashed = split.withColumn("_hashes", window)
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    lines = F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD))
    out = hashed.withColumn("_lines", lines).select(
        *keep,
        size.cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _repeated_words(F.col("_hashes"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str, max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Per host: rows, failures, posterior mean and bound, ``host_failed``.  ``host`` holds no NULL."""
    counts = judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    whole = counts.agg((F.sum("f") / F.sum("n")).alias("_prior"))
    shrunk = shrink(counts.crossJoin(F.broadcast(whole)), "_prior", mean="host_rate")
    return (
        shrunk.withColumn("host_bound", lower_bound("host_rate", "weight", z))
        .select(host, F.col("n").alias("host_rows"), "host_rate", "host_bound",
                (F.col("host_bound") > max_rate).alias("host_failed"))
    )


def judge(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", host: str = "source",
          max_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """The ``keep`` columns, the base figures, the host's figures and ``kept`` for every row."""
    own = [F.col(c) for c in keep]
    key = F.concat(F.when(F.col(host).isNull(), "0").otherwise("1"), F.coalesce(F.col(host).cast("string"), F.lit("")))
    figures = materialize(base_figures(docs.withColumn("_host", key), [*own, F.col("_host")], text), "host-base")
    verdicts = materialize(host_verdicts(figures, "_host", max_rate, z), "host-verdicts")
    joined = join_small(figures, verdicts, ["_host"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host", "host_failed")
