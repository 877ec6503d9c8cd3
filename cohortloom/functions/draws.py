"""Repeatable random draws computed from row keys.

A draw depends only on (seed, replicate, key), so it does not change with
partitioning, task retries or row order, and any engine with md5 can redo it.
One digest holds four 32-bit draws; replicates ``4k .. 4k+3`` share digest ``k``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

DRAWS_PER_DIGEST = 4
_SCALE = 4294967296.0


def digest(seed: int, block: Column, *key: Column) -> Column:
    """md5 text of seed, block and key."""
    parts = [F.lit(str(seed)), block.cast("string"), *[k.cast("string") for k in key]]
    return F.md5(F.concat_ws("|", *parts))


def uniform_at(digest_text: Column, slot: int | Column) -> Column:
    """Uniform [0, 1) number in one of the four slots of a digest."""
    start = F.lit(slot) * 8 + 1 if isinstance(slot, int) else slot * 8 + 1
    word = F.substring(digest_text, start, F.lit(8))
    return F.conv(word, 16, 10).cast("double") / F.lit(_SCALE)


def uniform(seed: int, replicate: Column, *key: Column) -> Column:
    """Uniform [0, 1) number of one replicate of a row."""
    block = F.floor(replicate / F.lit(DRAWS_PER_DIGEST)).cast("long")
    slot = (replicate % F.lit(DRAWS_PER_DIGEST)).cast("int")
    return uniform_at(digest(seed, block, *key), slot)


def poisson_thresholds(count: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities, cut to 12 digits."""
    total, out = 0.0, []
    for k in range(count):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(math.floor(total * 1e12) / 1e12)
    return out


def words(digest_text: Column) -> Column:
    """The four 32-bit words of a digest as an array of hex text."""
    return F.array(*[F.substring(digest_text, 1 + 8 * s, 8) for s in range(DRAWS_PER_DIGEST)])


def poisson_limits() -> list[int]:
    """A 32-bit draw's Poisson(1) count is the number of these it reaches."""
    limits = [math.ceil(t * _SCALE) for t in poisson_thresholds()]
    return [limit for limit in limits[:-1] if limit < _SCALE]


def poisson_weight(word: Column) -> Column:
    """Poisson(1) count of a 32-bit hex word (inverse distribution function).

    The limits are compared as hex text of equal width, which orders like the
    number, so no draw is converted.
    """
    weight = None
    for count, limit in enumerate(poisson_limits()):
        below = word < F.lit(format(limit, "08x"))
        weight = F.when(below, count) if weight is None else weight.when(below, count)
    return weight.otherwise(count + 1)


# ---- the same draws for arrays of keys ------------------------------------------

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 4294967296)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = [[(step * i + first) % 16 for i in range(16)] for step, first in ((1, 0), (5, 1), (3, 5), (7, 0))]
_COMMON = 4  # weights above this one are looked for among few draws
_START = tuple(np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def key_text(*key: Column) -> Column:
    """What ``digest`` appends to seed and block for a key (a NULL part is left out)."""
    return F.concat(*[F.coalesce(F.concat(F.lit("|"), k.cast("string")), F.lit("")) for k in key])


def _md5(fixed: Sequence[np.ndarray | int], keys: Mapping[int, np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four state words of the md5 of one block of 16 words, for ``shape`` (heads, keys).

    A word is the sum of its share in ``fixed`` (a number, or one for each head) and in ``keys`` (one for each key).
    """
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        k, j = divmod(i, 16)
        if k < 2:  # a choice between two words by the bits of the third
            by, one, other = (b, c, d) if k == 0 else (d, b, c)
            np.bitwise_xor(one, other, out=f)
            f &= by
            f ^= other
        elif k == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        place = _PLACES[k][j]
        word = fixed[place]
        f += _SINES[i] + word if isinstance(word, np.ndarray) else np.uint32((int(_SINES[i]) + word) & 0xFFFFFFFF)
        if place in keys:
            f += keys[place]
        turn = _TURNS[k][j % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        f <<= np.uint32(turn)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + first for x, first in zip((a, b, c, d), _START)]


def _digests(seed: int, blocks: Sequence[int], keys: np.ndarray) -> list[np.ndarray]:
    """The four draws of ``digest`` for every block and key, each (blocks, keys)."""
    heads = [f"{seed}|{block}".encode() for block in blocks]
    start, size = len(heads[0]), len(heads[0]) + keys.shape[1]
    if size > 55:  # more than one block of the digest
        whole = b"".join(hashlib.md5(head + row.tobytes(), usedforsecurity=False).digest() for head in heads for row in keys)
        return list(np.moveaxis(np.frombuffer(whole, ">u4").reshape(len(heads), -1, 4), 2, 0).astype(np.uint32))
    head = np.zeros((len(heads), 64), np.uint8)
    head[:, :start] = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, start)
    head[:, size] = 128
    head[:, 56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    head = head.view("<u4")
    alike = (head == head[0]).all(axis=0)
    fixed = [int(head[0, j]) if alike[j] else np.ascontiguousarray(head[:, j:j + 1]) for j in range(16)]
    first, last = start // 4, -(-size // 4)
    text = np.zeros((len(keys), 4 * (last - first)), np.uint8)
    text[:, start - 4 * first:size - 4 * first] = keys
    text = text.view("<u4")
    parts = {first + j: np.ascontiguousarray(text[:, j]) for j in range(text.shape[1])} if keys.shape[1] else {}
    return [d.byteswap(inplace=True) for d in _md5(fixed, parts, (len(heads), len(keys)))]


def digest_words(seed: int, blocks: Sequence[int], keys: np.ndarray) -> np.ndarray:
    """The four draws of ``digest`` for every block and key: (blocks, 4, keys) whole numbers.

    ``blocks`` have equally many digits; ``keys`` are texts of ``key_text`` as UTF-8
    of one length, a matrix (keys, bytes).
    """
    return np.stack(_digests(seed, blocks, keys), axis=1)


def poisson_weights(seed: int, blocks: Sequence[int], keys: np.ndarray) -> np.ndarray:
    """The weights of ``poisson_weight`` for the four replicates of each block: (blocks, 4, keys)."""
    limits = [np.uint32(limit) for limit in poisson_limits()]
    weights = np.empty((len(blocks), DRAWS_PER_DIGEST, len(keys)), np.uint8)
    for slot, drawn in enumerate(_digests(seed, blocks, keys)):
        found = (drawn >= limits[0]).view(np.uint8)
        for limit in limits[1:_COMMON]:
            found += (drawn >= limit).view(np.uint8)
        rare = np.nonzero(drawn >= limits[_COMMON])
        found[rare] += (drawn[rare][:, None] >= np.array(limits[_COMMON:])).sum(axis=1, dtype=np.uint8)
        weights[:, slot] = found
    return weights


# ---- keyed permutations -------------------------------------------------------

#: Rounds of the permutation, each with a 32-bit key of its own; modulus and multipliers of the round function.
ROUNDS = 6
_PRIME, _FIRST, _SECOND = 2147483647, 48271, 69621


def sides(n: int) -> tuple[int, int]:
    """A rectangle of at least n places, its sides near the square root of n and its surplus as small as can be."""
    root = math.isqrt(max(n, 1))
    best = min(range(max(1, root), 2 * root + 2), key=lambda a: (a * -(-n // a) - n, a))
    return best, -(-n // best)


def round_keys(seed: int, replicate: Column) -> Column:
    """The keys of a replicate's permutation, an array of ``ROUNDS`` numbers."""
    digests = [digest(seed, replicate * 2 + i) for i in range(-(-ROUNDS // DRAWS_PER_DIGEST))]
    word = lambda d, s: F.conv(F.substring(d, 1 + 8 * s, 8), 16, 10).cast("long")
    return F.array(*[word(digests[r // DRAWS_PER_DIGEST], r % DRAWS_PER_DIGEST) for r in range(ROUNDS)])


def _scrambled(value: Column, key: Column) -> Column:
    first = F.pmod(F.pmod(value + key, F.lit(_PRIME)) * _FIRST, F.lit(_PRIME))
    return F.pmod(first.bitwiseXOR(F.shiftright(first, 15)) * _SECOND, F.lit(_PRIME))


def permuted(place: Column, keys: Column, n: int) -> Column:
    """Where a keyed bijection of the places 0 .. n - 1 sends ``place``.

    The place is a point of a rectangle; in turn one coordinate is shifted by a
    keyed function of the other, which can be undone whatever the function is.
    A point that lands in the rectangle's surplus is sent on until it is below
    n; the surplus bounds how often that can happen.
    """
    a, b = sides(n)

    def once(at: Column) -> Column:
        state = F.struct(F.floor(at / b).cast("long").alias("l"), F.pmod(at, F.lit(b)).cast("long").alias("r"))

        def turn(s: Column, r: Column) -> Column:
            key = F.element_at(keys, (r + 1).cast("int"))
            left = F.pmod(s["l"] + _scrambled(s["r"], key), F.lit(a))
            right = F.pmod(s["r"] + _scrambled(s["l"], key), F.lit(b))
            even = r % 2 == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["l"] * b + s["r"])

    steps = F.sequence(F.lit(0), F.lit(a * b - n))
    return F.aggregate(steps, place.cast("long"), lambda at, i: F.when((i == 0) | (at >= n), once(at)).otherwise(at))


def permute(df: DataFrame, place: str, keys: str, n: int, out: str) -> DataFrame:
    """``df`` with ``out``, the place to which ``permuted`` sends ``place``, as one generated step a round."""
    a, b = sides(n)
    turned = df.withColumns({"_l": F.floor(F.col(place) / F.lit(b)).cast("long"), "_r": F.pmod(F.col(place), F.lit(b)).cast("long")})
    for r in range(ROUNDS):
        moved, other, side = ("_l", "_r", a) if r % 2 == 0 else ("_r", "_l", b)
        turned = turned.withColumn("_f", _scrambled(F.col(other), F.col(keys)[r]))
        turned = turned.withColumn(moved, F.pmod(F.col(moved) + F.col("_f"), F.lit(side)))
    landed = F.col("_l") * b + F.col("_r")
    if a * b > n:
        landed = F.when(landed < n, landed).otherwise(permuted(F.col(place), F.col(keys), n))
    return turned.withColumn(out, landed).drop("_l", "_r", "_f")


def _scrambles(values: int, key: int, side: int) -> np.ndarray:
    """The round function of the numbers 0 .. ``values`` - 1, below ``side``."""
    first = (np.arange(values) + key) % _PRIME * _FIRST % _PRIME
    return (first ^ (first >> 15)) * _SECOND % _PRIME % side


class Places:
    """Places of 0 .. n - 1 that keyed bijections send elsewhere, as ``permuted`` does.

    A round adds a function of one coordinate to the other.  Coordinates are few, so the
    function is looked up; they are brought back below their sides only at the end, the tables
    being repeated as far as the sums can reach.
    """

    def __init__(self, places: np.ndarray, n: int):
        self.n, (self.a, self.b) = n, sides(n)
        self.left = places // self.b
        self.right = places - self.left * self.b
        most = ROUNDS // 2 + 1
        self._rows, self._columns = np.tile(np.arange(self.a) * self.b, most), np.tile(np.arange(self.b), most)

    def tables(self, keys: Sequence[int]) -> list[np.ndarray]:
        """What ``sent`` looks up for one replicate's keys."""
        sizes = (self.b, self.a)
        return [np.tile(_scrambles(sizes[r % 2], keys[r], sizes[1 - r % 2]), (r + 1) // 2 + 1) for r in range(ROUNDS)]

    def _once(self, tables: Sequence[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        for r in range(0, ROUNDS, 2):
            left = left + tables[r].take(right)
            right = right + tables[r + 1].take(left)
        at = self._rows.take(left)
        at += self._columns.take(right)
        return at

    def sent(self, tables: Sequence[np.ndarray], part: slice = slice(None)) -> np.ndarray:
        """Where the places of ``part`` go."""
        at = self._once(tables, self.left[part], self.right[part])
        if self.a * self.b > self.n:
            beyond = np.flatnonzero(at >= self.n)
            while len(beyond):
                left = at[beyond] // self.b
                at[beyond] = self._once(tables, left, at[beyond] - left * self.b)
                beyond = beyond[at[beyond] >= self.n]
        return at


def permuted_places(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """``permuted`` for an array of places and one replicate's keys."""
    found = Places(places, n)
    return found.sent(found.tables(keys))
