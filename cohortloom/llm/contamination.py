"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of digits, a-z and non-ASCII characters after A-Z was lowered.
A window is ``window`` consecutive words of an item, or the whole item if it is
shorter.  The automaton of all items is walked with a document's words; at each
word it knows the longest item passage that ends there, and through its suffix
links the windows that end there and the items they belong to.

The items are read in blocks of at most ``BLOCK_WORDS`` words, whose size is
counted before anything is brought to the driver; an item longer than that is
read in parts that overlap by a window less one word.  One block is the usual
case.  With more, documents get row numbers in a written table, every block is
walked over all of them, written, and let go before the next one, and the
blocks' findings, without the texts, are joined by row number.

``decontaminate`` acts on what was found: a document of which at least one word in
``share`` is hit exceeds the coverage limit and goes as a whole; from every other one
the spans of at least ``min_span`` hit words are cut, and what stands between stays.

Defined cases: a NULL or empty text has no words and no hits; an item without
words matches nothing; items with equal ids count once, an item without id as
the empty id; repeated documents are judged one by one; empty tables give an
empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortloom.llm.common import ascii_lower
from cohortloom.operators.ranks import prefix_sums
from cohortloom.storage import materialize

WINDOW = 13
BLOCK_WORDS = 200_000
_SLICE_ROWS = 512
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; separators become spaces, UTF-8 bytes above 127 stay."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class SuffixAutomaton:
    """All passages of the items; states keep the length of their longest passage."""

    def __init__(self, items: Sequence[Sequence[bytes]], window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: dict[int, set[int]] = defaultdict(set)
        self.whole: dict[int, list[int]] = defaultdict(list)
        self.vocabulary: set[bytes] = set()
        for number, item in enumerate(items):
            state = 0
            for word in item:
                state = self._append(state, word)
            self.vocabulary.update(item)
        for number, item in enumerate(items):
            state = 0
            for word in item:
                state = self.next[state][word]
                ends[state].add(number)
            if 0 < len(item) < window:
                self.whole[state].append(number)
        self.shortest = min([window, *(len(i) for i in items if i)])
        self._ends, self._items = ends, {}
        self._children: dict[int, list[int]] = defaultdict(list)
        for state, parent in enumerate(self.link):
            if parent >= 0:
                self._children[parent].append(state)
        # nearest state on the way of suffix links that is a whole short item
        self.short_above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.link[state]
            self.short_above[state] = parent if parent in self.whole else self.short_above[parent]
        self.runs = re.compile(b"\x01{%d,}" % self.shortest)

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of state's longest passage + word, cut out of a larger one if need be."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _append(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        fresh = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = fresh
            last = self.link[last]
        if last >= 0:
            self.link[fresh] = self._split(last, word)
        return fresh

    def items(self, state: int) -> frozenset[int]:
        """Items that contain the state's passages."""
        if state not in self._items:
            found, todo = set(), [state]
            while todo:
                s = todo.pop()
                found |= self._ends.get(s, set())
                todo += self._children.get(s, ())
            self._items[state] = frozenset(found)
        return self._items[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged hit spans [start, end) in words, items with occurring windows, longest match."""
        known = bytes(map(self.vocabulary.__contains__, words))
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        length, link, moves = self.length, self.link, self.next
        for run in self.runs.finditer(known):
            state = size = 0
            for at in range(*run.span()):
                word = words[at]
                while state and word not in moves[state]:
                    state = link[state]
                    size = length[state]
                state = moves[state].get(word, 0)
                size = size + 1 if state else 0
                if size > longest:
                    longest = size
                if size >= self.window:
                    top = state
                    while length[link[top]] >= self.window:
                        top = link[top]
                    items |= self.items(top)
                    hits.append((at + 1 - self.window, at + 1))
                if self.whole:
                    short = state if state in self.whole and size >= length[state] else self.short_above[state]
                    while short > 0:
                        items.update(self.whole[short])
                        hits.append((at + 1 - length[short], at + 1))
                        short = self.short_above[short]
        return merged(hits), items, longest


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()),
          T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)]
_AUTOMATA: dict[str, SuffixAutomaton] = {}
_NUMBERS = (uuid.uuid4().hex for _ in itertools.count())


def _automaton(shared, number: str, window: int) -> tuple[list[str], SuffixAutomaton]:
    """The item ids of a block and the worker's automaton of it."""
    names, items = shared.value
    if number not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[number] = SuffixAutomaton(items, window)
    return names, _AUTOMATA[number]


def _walk(docs: DataFrame, keep: Sequence[str], text: str, shared, number: str, window: int) -> DataFrame:
    """Findings of one block of items in every document."""
    sent = list(keep) if text in keep else [*keep, text]
    schema = T.StructType([docs.schema[c] for c in keep] + _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        names, automaton = _automaton(shared, number, window)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                sizes, lengths, ids, spans = [], [], [], []
                for body in part.column(sent.index(text)).to_pylist():
                    words = words_of(body)
                    hits, found, longest = automaton.scan(words)
                    sizes.append(len(words))
                    lengths.append(longest)
                    ids.append(sorted({names[i] for i in found}))
                    spans.append([{"start": a, "end": b} for a, b in hits])
                columns = [pa.array(v, arrow.field(len(keep) + i).type) for i, v in enumerate((sizes, lengths, ids, spans))]
                own = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *columns], schema=arrow)

    return docs.select(*sent).mapInArrow(run, schema)


def _clean(docs: DataFrame, text: str, shared, number: str, window: int, least: int, share: int) -> DataFrame:
    """``docs`` judged and cut by the one block of items, in the walk itself: no text goes to a second worker."""
    schema, at_text = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        _, automaton = _automaton(shared, number, window)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE_ROWS):
                part = batch.slice(at, _SLICE_ROWS)
                kept, bodies = [], []
                for body in part.column(at_text).to_pylist():
                    words = words_of(body)
                    hits = automaton.scan(words)[0]
                    kept.append(not exceeds(sum(b - a for a, b in hits), len(words), share))
                    if kept[-1]:
                        spans = [(a, b) for a, b in hits if b - a >= least]
                        bodies.append(remove_spans(body, spans) if spans else body)
                part = part.filter(pa.array(kept, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bodies, f.type) if i == at_text else part.column(i).cast(f.type) for i, f in enumerate(arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``keep`` columns and, per document, ``n_words``, ``n_hit``, ``longest``, ``item_ids``, ``spans``.

    A kept column with a result's name gives way to it.
    """
    keep = [c for c in keep if c not in ("n_words", "n_hit", "longest", "item_ids", "spans")]
    named, held = _named(items, item_id, item_text, block_words)
    return _find(docs, named, held, keep, text, window, block_words)


def _named(items: DataFrame, item_id: str, item_text: str, block_words: int) -> tuple[DataFrame, list[tuple[str, list[bytes]]] | None]:
    """``id``, ``text`` and ``n`` words of every item; besides, ids and words themselves if one block holds them all."""
    count = F.regexp_count(ascii_lower(F.col(item_text)), F.lit(_SQL_WORD))
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
                         F.col(item_text).alias("text"), F.coalesce(count, F.lit(0)).cast("long").alias("n"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > block_words:
        return named, None
    return named, [(r.id, words_of(r.text)) for r in named.where("n > 0").select("id", "text").collect()]  # block_words bounded


def _find(docs: DataFrame, named: DataFrame, held: list | None, keep: Sequence[str], text: str, window: int, block_words: int) -> DataFrame:
    if held is not None:
        found = _walk(docs, list(keep), text, *_shared(docs.sparkSession, held), window)
    else:
        found = _walk_blocks(docs, keep, text, named, window, block_words)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(*keep, "n_words", size.alias("n_hit"), "longest", "item_ids", "spans")


def _shared(spark: SparkSession, held: list[tuple[str, list[bytes]]]) -> tuple:
    """The items as a broadcast, and a number that tells this broadcast from others."""
    shared = spark.sparkContext.broadcast(([i for i, _ in held], [w for _, w in held]))
    return shared, next(_NUMBERS)


def _walk_blocks(docs: DataFrame, keep: Sequence[str], text: str, named: DataFrame, window: int, block_words: int) -> DataFrame:
    """Findings over more items than one block holds."""
    spark = docs.sparkSession
    own = list(dict.fromkeys([*keep, text]))
    # the caller's columns travel as one, so that no name can clash
    rows = materialize(docs.select(F.struct(*own).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "bench-rows")
    part = max(2 * window, block_words // 2)
    step = part - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                pieces = [b" ".join(words[a : a + part]) for a in range(0, max(1, len(words) - window + 1), step)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(pieces)), pa.array([p.decode("utf-8", "surrogatepass") for p in pieces]),
                     pa.array([len(p.split()) for p in pieces], pa.int64())], names=["id", "text", "n"])

    parts = materialize(named.where("n > 0").select("id", "text").mapInArrow(cut, "id string, text string, n long"), "bench-parts")
    placed = materialize(prefix_sums(parts.withColumn("_at", F.monotonically_increasing_id()), [], ["_at"], {"_before": "n"}), "bench-blocks")
    block = F.floor(F.col("_before") / F.lit(part))
    last = placed.agg(F.max(block)).first()[0]
    found = None
    for number in range(last + 1):
        held = [(r.id, words_of(r.text)) for r in placed.where(block == number).select("id", "text").collect()]  # two parts at most
        if held:
            shared, name = _shared(spark, held)
            one = materialize(_walk(rows, ["row"], "text", shared, name, window), "bench-found")
            shared.destroy()
            found = one if found is None else found.unionByName(one)
    return rows.join(_join_blocks(found, ["row"]), "row").select(
        *[F.col("doc")[c].alias(c) for c in keep], "n_words", "longest", "item_ids", "spans")


def _join_blocks(found: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per document from one row per document and block."""
    grouped = found.groupBy(*carried).agg(
        F.max("n_words").alias("n_words"), F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, s):
        touches = (F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"])
        grown = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
                      ).otherwise(F.concat(acc, F.array(s)))

    return grouped.withColumn("spans", F.aggregate("spans", F.array().cast(_SPANS), add))


def exceeds(n_hit, n_words, share: int):
    """Whether hit words are at least one in ``share``; of numbers or of columns."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Add ``contaminated``: hit words are at least one in ``share``."""
    return found.withColumn("contaminated", exceeds(F.col("n_hit"), F.col("n_words"), share))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, min_span: int | None = None, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents and, in the others, without spans of at least ``min_span`` hit words.

    ``min_span`` is the window by default, which leaves hits by shorter items in place.  One block of
    items needs one walk, which cuts as well; the findings of several are joined before texts are cut.
    """
    least = window if min_span is None else min_span
    named, held = _named(items, item_id, item_text, block_words)
    if held is not None:
        return _clean(docs, text, *_shared(docs.sparkSession, held), window, least, share)
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    found = verdict(_find(own, named, None, ["doc", "text"], "text", window, block_words), share)
    kept = found.where(~F.col("contaminated")).withColumn("spans", F.filter("spans", lambda s: s["end"] - s["start"] >= least))

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([remove_spans(b, [(s["start"], s["end"]) for s in own]) for b, own in zip(bodies, spans)], dtype=object)

    clean, hit = kept.where(F.size("spans") == 0), kept.where(F.size("spans") > 0)
    rest = [c for c in docs.columns if c != text]
    whole = clean.select("doc.*")
    changed = hit.select(*[F.col("doc")[c].alias(c) for c in rest], cut("text", "spans").alias(text)).select(*docs.columns)
    return whole.unionByName(changed)


def remove_spans(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """A text without the words of the spans; what stands between the words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_LETTERS))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
