"""Exact Jaccard self-join of word-shingle sets by a token-group matrix.

Two documents link when 100 |x and y| >= 75 |x or y|, that is 7 |x and y| >= 3 (|x| + |y|).

1. Equal sets form a class (128-bit digest); all further work is on classes.
2. Shingles take one global order: those that many documents hold last, the
   rest by hash.  Of two linked classes the larger one has a shingle of the
   smaller one's short prefix (its first n - ceil(6n/7) + 1 shingles) in its own
   long prefix (its first n - ceil(3n/4) + 1), whatever the order is.
3. Groups of similar classes: the classes that share a prefix shingle are put in
   two orders in which similar sets tend to be neighbours (by two min-hashes,
   then size), and besides meet the most ordinary one among them; pairs that agree
   in a min-hash are checked on whole sets, and linked classes form a group.  This only proposes: what it misses is left to
   step 5.
4. Token-group matrix: per group, the union of its classes' short prefixes with
   the sizes and the first place behind each shingle.  The long prefix of a class
   outside the group is looked up in it.  The matches, and the places at which
   they stand, bound its overlap with any member that is not larger.
5. Only groups whose bound reaches the threshold are opened: their members that
   share a shingle with the query are bounded pair by pair, by places and by
   parity bits, and checked on whole sets.  Pairs within one group are never formed.

The parity bits of a set say for each of 256 buckets whether it holds an odd
number of the set's shingles.  Every bucket in which two sets differ stands for
at least one shingle that only one of them has, so their number is at most the
size of the symmetric difference, which a link limits to (|x| + |y|) / 7.  256
buckets tell nothing once about as many shingles differ, so every class also keeps
the parity of at least twice as many buckets as it has shingles.  These are
compared pair by pair before any whole set is moved.

In a family of near copies the shingles that all copies share come last in the
order, so a copy with enough shingles of its own has none of the shared ones in
its short prefix: copies that are too far apart to link do not meet.

Steps 3 and 5 miss no link between groups, so the components of all checked
links are those of the whole relation.  The shingles held last are found by
counting in every task and come to at most ``HEAVY`` numbers; which they are
changes the work, not the result.

Shingles are compared as 64-bit hashes and sets as 128-bit digests.

Defined cases: a NULL or empty text has an empty set and links with nothing; a
NULL id is never a component's name unless it stands alone; rows with equal ids
are judged by their own texts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cohortloom.llm.common import BROADCAST_ROWS, join_small, join_weighted
from cohortloom.llm.components import components
from cohortloom.llm.shingles import mixed, shingle_set
from cohortloom.operators.ranks import SLICE, number_rows, slice_groups
from cohortloom.storage import bounded_batches, discard, materialize

HEAVY = 1 << 16
#: A shingle is held last if it was seen in at least one of so many documents.
HEAVY_SHARE = 1_000
_LOCAL = 4
PROPOSALS = 3
_PARITIES = 256
#: The prefix shingles are counted in so many passes, each over its own shingles, to halve what lies on disk at once.
_PASSES = 2
_BITS = ["b0", "b1", "b2", "b3"]
_COUNTED_ROWS = 3_000
_SLICE_ROWS = 512


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8")
    return pa.array(both[0::2]), pa.array(both[1::2])


def _parity(own: np.ndarray) -> np.ndarray:
    """For each of at least 2n buckets, a power of two, whether it holds an odd number of the n shingles."""
    size = max(_PARITIES, 1 << (2 * len(own) - 1).bit_length())
    return (np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def _differing(a: np.ndarray, b: np.ndarray) -> int:
    """Buckets in which two packed parities differ; the longer one is folded to the buckets of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: size and digest of its set; besides, shingles that several documents of a task hold."""
    schema = T.StructType([T.StructField("heavy", T.BooleanType()), T.StructField("key", docs.schema[key].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("n", "high", "low")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: list[np.ndarray] = []

        def seen() -> Iterator[pa.RecordBatch]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(_LOCAL, len(held) // HEAVY_SHARE)
            tokens, counts = tokens[often].view(np.int64), counts[often]
            if len(tokens):
                yield pa.RecordBatch.from_arrays([
                    pa.array([True] * len(tokens)), pa.nulls(len(tokens), arrow.field(1).type),
                    pa.array(counts.astype(np.int64)), pa.array(tokens), pa.nulls(len(tokens), pa.int64())], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                held += sets
                high, low = _halves([_digest(s) for s in sets])
                yield pa.RecordBatch.from_arrays([
                    pa.array([False] * len(sets)), part.column(0).cast(arrow.field(1).type),
                    pa.array([len(s) for s in sets], pa.int64()), high, low], schema=arrow)
                if len(held) >= _COUNTED_ROWS:
                    yield from seen()
                    held.clear()
        if held:
            yield from seen()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _prefixes(docs: DataFrame, text: str, heavy: np.ndarray) -> DataFrame:
    """Digest, ordered long prefix, a second min-hash and the parities of every document with a set."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # HEAVY numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                digests, prefixes, first, other, core, bits, parity = [], [], [], [], [], [], []
                for body in batch.slice(at, _SLICE_ROWS).column(0).to_pylist():
                    own = shingle_set(body)
                    n = len(own)
                    if not n:
                        continue
                    digests.append(_digest(own))
                    late = np.isin(own, last, assume_unique=True)
                    size = n - (3 * n + 3) // 4 + 1
                    prefixes.append(np.concatenate([own[~late], own[late]])[:size])
                    first.append(int(own[:1].view(np.int64)[0]))
                    other.append(int(mixed(own).min().view(np.int64)))
                    core.append(4 * int(late.sum()) - 3 * n)
                    odd = _parity(own)
                    bits.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, _PARITIES), axis=0)).view(np.int64))
                    parity.append(np.packbits(odd).tobytes())
                if digests:
                    high, low = _halves(digests)
                    ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                    parities = np.array(bits)
                    yield pa.RecordBatch.from_arrays([
                        high, low, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64))),
                        pa.array(first, pa.int64()), pa.array(other, pa.int64()), pa.array(core, pa.int64()),
                        *[pa.array(parities[:, i]) for i in range(len(_BITS))], pa.array(parity, pa.binary())],
                        names=["high", "low", "prefix", "first", "other", "core", *_BITS, "parity"])

    schema = "high long, low long, prefix array<long>, first long, other long, core long, " + ", ".join(f"{b} long" for b in _BITS) + ", parity binary"
    return docs.select(F.col(text)).mapInArrow(run, schema)


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``cid`` and whole set of the wanted classes (``cid``, ``high``, ``low``, ``_none``, ``_id``)."""
    where = wanted.select("_none", "_id").distinct()
    keyed = docs.select(F.col(key).isNull().alias("_none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.col(text).alias("text"))
    if where.count() <= BROADCAST_ROWS:
        where = F.broadcast(where)
    chosen = keyed.join(where, ["_none", "_id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                sets = [shingle_set(t) for t in batch.slice(at, _SLICE_ROWS).column(0).to_pylist()]
                high, low = _halves([_digest(s) for s in sets])
                yield pa.RecordBatch.from_arrays([high, low, pa.array([s.tobytes() for s in sets], pa.binary())], names=["high", "low", "set"])

    found = chosen.select("text").mapInArrow(run, "high long, low long, set binary")
    # rows with equal ids or copies may give a class's set more than once
    once = found.groupBy("high", "low").agg(F.first("set").alias("set"))
    return materialize(once.join(wanted.select("cid", "high", "low"), ["high", "low"]).select("cid", "set"), "join-sets")


def _alike(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs (x, y) whose parities leave room for a link."""
    left, right = (ends.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"_{c}")) for c in ("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room = [7 * _differing(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)) <= n
                    for a, b, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(room, pa.bool_()))

    both = pairs.join(right, "y").join(left, "x").select("x", "y", "_x", "_y", (F.col("nx") + F.col("ny")).alias("_n"))
    return both.mapInArrow(run, "x long, y long")


def _checked(pairs: DataFrame, docs: DataFrame, key: str, text: str, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs (x, y) that link, by the intersection of their whole sets."""
    pairs = materialize(_alike(pairs, ends), "join-pairs")
    nodes = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).distinct()
    wanted = materialize(classes.join(nodes, "cid", "left_semi"), "join-wanted")
    sets = _sets(docs, key, text, wanted)
    left, right = sets.select(F.col("cid").alias("x"), F.col("set").alias("_a")), sets.select(F.col("cid").alias("y"), F.col("set").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                links.append(7 * both >= 3 * (len(p) + len(q)))
            chosen = batch.select([0, 1]).filter(pa.array(links, pa.bool_()))
            yield chosen

    links = materialize(pairs.join(right, "y").join(left, "x").select("x", "y", "_a", "_b").mapInArrow(run, "x long, y long"), "join-links")
    for table in (sets, wanted, pairs):
        discard(table)
    return links


def _need(x, y):
    """Least overlap of linked sets of these sizes."""
    return F.ceil(3 * (x + y) / F.lit(7.0))


def _fits(x, y):
    """Sizes that a link allows."""
    return (4 * x >= 3 * y) & (4 * y >= 3 * x)


def _short(n):
    """Length of the short prefix of a set of n."""
    return n - F.ceil(6 * n / F.lit(7.0)) + 1


def _unlike(x: str, y: str):
    """Parity bits in which two sets differ, from the columns of their bits with these endings."""
    return sum((F.bit_count(F.col(f"{b}{x}").bitwiseXOR(F.col(f"{b}{y}"))) for b in _BITS), F.lit(0))


def _proposals(entries: DataFrame) -> DataFrame:
    """Pairs of classes of a shared shingle that agree in a min-hash and whose sizes allow a link.

    A class is paired with its neighbours in two orders, and with the class that
    has most of the shingles held by many and fewest others: in a family of near
    copies that is a text near their common origin.
    """
    keyed = entries.select("token", "cid", "n", "first", "other", "core")
    own = F.struct("core", "cid", "n", "first", "other")
    orders = {c: [c, "n", "cid"] for c in ("first", "other")}
    sliced = {c: slice_groups(keyed, ["token"], order) for c, order in orders.items()}

    def met(df: DataFrame, keys: list[str], chosen: list[str]) -> DataFrame:
        place = W.partitionBy(*keys)
        near = [F.lag(own).over(place.orderBy(*orders[c])) for c in chosen] + [F.max(own).over(place)]
        return df.withColumn("_met", F.array(*near)).select(F.explode("_met").alias("_p"), "cid", "n", "first", "other")

    if None in sliced.values():
        found = met(keyed, ["token"], list(orders))
    else:
        found = met(sliced["first"], ["token", SLICE], ["first"]).unionByName(met(sliced["other"], ["token", SLICE], ["other"]))
    agree = (F.col("first") == F.col("_p.first")).cast("int") + (F.col("other") == F.col("_p.other")).cast("int")
    alike = found.where((F.col("_p.cid") != F.col("cid")) & _fits(F.col("n"), F.col("_p.n"))).select(
        "cid", F.col("_p.cid").alias("prev"), agree.alias("agree"), F.abs(F.col("n") - F.col("_p.n")).alias("gap"))
    pairs = alike.where("agree > 0").distinct()
    # the best few that each class has met are enough to propose a group
    best = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("agree"), "gap", "prev"))
    chosen = pairs.withColumn("_best", best).where(F.col("_best") <= PROPOSALS)
    return chosen.select(F.least("cid", "prev").alias("x"), F.greatest("cid", "prev").alias("y")).distinct()


def _open_groups(entries: DataFrame, groups: DataFrame, ends: DataFrame) -> DataFrame:
    """Candidate pairs between groups: matrix look-up, bound, and opening of the groups that qualify."""
    grouped = join_small(entries.select("token", "cid", "n", "at"), groups, ["cid"], "left").withColumn("group", F.coalesce("component", "cid")).drop("component")
    # a shingle that one group alone holds bounds nothing
    several = grouped.groupBy("token").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high").select("token")
    rows = materialize(grouped.join(several, "token", "left_semi"), "join-rows")
    discard(entries)
    held = rows.where(F.col("at") <= _short(F.col("n")))
    matrix = held.groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("first"))
    crossed = rows.join(matrix.withColumnRenamed("group", "other"), "token").where(
        (F.col("group") != F.col("other")) & (4 * F.col("high") >= 3 * F.col("n")) & (F.col("low") <= F.col("n")))
    met = materialize(crossed.select("cid", "other", "token", "n", "at", "low", "high", "first"), "join-met")
    opened = materialize(_qualifying(met), "join-opened")
    asking = met.join(F.broadcast(opened) if opened.count() <= BROADCAST_ROWS else opened, ["cid", "other"]).where(_passing()).select(
        "token", F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("at").alias("aty"), F.col("other").alias("group"))
    asking = materialize(_with_bits(asking, ends, "y"), "join-asking")
    members = held.select("token", "group", F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("at").alias("atx"))
    members = _with_bits(members.join(asking.select("token", "group").distinct(), ["token", "group"], "left_semi"), ends, "x")
    nx, ny = F.col("nx"), F.col("ny")
    smaller = (nx < ny) | ((nx == ny) & (F.col("x") < F.col("y")))
    reach = F.least(nx - F.col("atx"), ny - F.col("aty")) + 1 >= _need(nx, ny)
    near = asking.join(members, ["token", "group"]).where(
        smaller & _fits(nx, ny) & reach & (7 * _unlike("x", "y") <= nx + ny))
    pairs = materialize(near.select("x", "y").distinct(), "join-candidates")
    for table in (rows, met, opened, asking):
        discard(table)
    return pairs


def _with_bits(rows: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """``rows`` with the parity bits of the class in the column ``name``, ending in that name."""
    return rows.join(ends.select(F.col("cid").alias(name), *[F.col(b).alias(f"{b}{name}") for b in _BITS]), name)


def _passing():
    """Matches that can be the first common shingle of the query and a member.

    What the two share stands from there on, in both of them.  On the query's
    side this is loosest for the smallest member, on the members' side for the
    largest one that the query's size admits.
    """
    n = F.col("n")
    small = F.greatest(F.col("low"), F.ceil(3 * n / F.lit(4.0)))
    large = F.least(F.col("high"), n)
    return (n - F.col("at") + 1 >= _need(n, small)) & (large - F.col("first") + 1 >= _need(n, large))


def _qualifying(met: DataFrame) -> DataFrame:
    """Queries and groups whose bound leaves room for a link with some member that is not larger.

    If the query's long prefix ends before the member's short one, the overlap is
    at most the matches and what the query has behind its prefix, which is
    loosest for the smallest member.  If the member's ends first, the same holds
    with what the member has behind it, which is loosest for the largest one.
    Which case a member is in is not known here, so either bound may open the group.
    """
    n = F.col("n")
    groups = met.groupBy("cid", "other").agg(
        F.count(F.lit(1)).alias("common"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max(_passing()).alias("first"))
    small = F.greatest(F.col("low"), F.ceil(3 * n / F.lit(4.0)))
    large = F.least(F.col("high"), n)
    query_ends = F.col("common") + F.ceil(3 * n / F.lit(4.0)) - 1 >= _need(n, small)
    # the room behind a short prefix grows with the member as fast as the need, up to two ceilings
    member_ends = F.col("common") + F.ceil(6 * large / F.lit(7.0)) >= _need(n, large)
    return groups.where(F.col("first") & (query_ends | member_ends)).select("cid", "other")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``class_size`` (documents with the same set) of every row."""
    with bounded_batches(docs.sparkSession):
        return _link_components(docs, key, text)


def _link_components(docs: DataFrame, key: str, text: str) -> DataFrame:
    seen = materialize(_signatures(docs, key, text), "join-signatures")
    members = seen.where(~F.col("heavy")).select("key", "n", "high", "low")
    counted = seen.where("heavy").groupBy("high").agg(F.sum("n").alias("n"))
    total = members.count()
    often = counted.where(F.col("n") * HEAVY_SHARE >= total).orderBy(F.desc("n"), "high").limit(HEAVY)
    heavy = np.sort(often.select("high").toPandas()["high"].to_numpy(np.int64).view(np.uint64))
    first = F.min("key")
    classes = materialize(
        members.groupBy("high", "low").agg(F.max("n").alias("n"), first.alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"cid": F.monotonically_increasing_id(), "_none": F.col("first").isNull(),
                      "_id": F.coalesce(F.col("first").cast("string"), F.lit(""))}), "join-classes")
    once = _prefixes(docs, text, heavy).groupBy("high", "low").agg(*[F.first(c).alias(c) for c in ("prefix", "first", "other", "core", *_BITS, "parity")])
    named = materialize(once.join(classes.select("high", "low", "cid", "n"), ["high", "low"]).drop("high", "low"), "join-prefixes")
    ends = materialize(named.select("cid", "n", "first", "other", "core", *_BITS, "parity"), "join-ends")
    tokens = named.select("cid", F.posexplode("prefix").alias("at", "token"))
    passes = [
        materialize(
            number_rows(tokens.where(F.pmod("token", F.lit(_PASSES)) == i), ["token"], ["cid"], "_row", total="df")
            .where("df > 1").select("token", "cid", "at"), "join-tokens")
        for i in range(_PASSES)]
    discard(named)
    shared = functools.reduce(DataFrame.unionByName, passes)
    entries = materialize(shared.withColumn("at", F.col("at") + 1).join(ends.select("cid", "n", "first", "other", "core"), "cid"), "join-entries")
    for table in passes:
        discard(table)
    proposed = materialize(_proposals(entries), "join-proposed")
    links = _checked(proposed, docs, key, text, classes, ends)
    discard(proposed)
    groups = components(links).withColumnRenamed("node", "cid")
    candidates = _open_groups(entries, groups, ends)
    more = _checked(candidates, docs, key, text, classes, ends)
    discard(candidates)
    # only links between groups are left to follow, so the groups are the nodes
    for c in ("x", "y"):
        more = more.join(groups.select(F.col("cid").alias(c), F.col("component").alias("_group")), c, "left").withColumn(
            c, F.coalesce("_group", c)).drop("_group")
    tops = components(more.where("x <> y").select("x", "y").distinct())
    grouped = classes.join(groups, "cid", "left").withColumn("group", F.coalesce("component", "cid")).drop("component")
    named = grouped.join(tops.withColumnRenamed("node", "group"), "group", "left").withColumn("component", F.coalesce("component", "group"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = materialize(
        named.join(least, "component").where("n > 0").select("high", "low", "component_id", F.col("copies").alias("class_size")), "join-answer")
    result = join_weighted(members, answer, ["high", "low"], "class_size", total)
    return result.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
