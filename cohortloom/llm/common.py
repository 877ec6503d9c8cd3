"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 100_000
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a written lookup table: broadcast if its counted rows allow it, else salted.

    ``keys`` hold no NULL and are unique in ``small``.  The salted way spreads
    a key that holds a large share of ``big`` over ``SALTS`` tasks.
    """
    keys = list(keys)
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", spread).join(copies, [*keys, "_salt"], how).drop("_salt")


def join_weighted(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, total: int,
                  how: str = "left", parts: int = 5_000) -> DataFrame:
    """Join a lookup table that knows how many rows of ``big`` each key holds.

    ``small`` is written, unique in ``keys`` (no NULL), and its weights sum to at
    most ``total``, so at most ``parts`` keys hold a share of 1 / parts or more.
    Those are broadcast; all others are joined by shuffle.
    """
    keys = list(keys)
    heavy = F.col(weight) * parts >= max(total, 2 * parts)
    hot = F.broadcast(small.where(heavy))
    marked = big.join(F.broadcast(small.where(heavy).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    first = marked.where(F.col("_hot")).drop("_hot").join(hot, keys, how)
    return first.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(small.where(~heavy), keys, how))
