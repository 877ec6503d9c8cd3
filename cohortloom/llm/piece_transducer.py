"""A tokenizer compiled to a deterministic transducer that counts tokens.

For byte-pair vocabularies in which pieces are merged by score: a sequence of
pieces is the tokenizer's answer exactly if each neighbouring pair is the answer
for its own text.  So the last token of every prefix is unique, and the next
one follows from the unfinished piece starts, the tokens that end where they
begin, and the next character.  That is the state.  A transition on a
character is annotated with the tokens it emits, which is negative where an
emitted run becomes one longer piece.

States and transitions are compiled when text first asks for them and kept up to
a bound, beyond which compilation starts anew; counts do not depend on it.

No piece has a space behind another character, so every space that follows one
returns the transducer to its start: a run of spaces and the characters behind
it is a segment.  The state map of a chunk is then (head, count, tail): the first
segment, which may go on from the left, the tokens of the whole segments, and
the last segment, which may go on to the right.  Maps compose associatively.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from cohortloom.llm.byte_pairs import tokenizer_file

SPACE = "▁"
_SEGMENTS = re.compile(" *[^ ]+| +")
#: Segments whose counts, and transducer states, that are kept at most in a worker.
MEMO_SIZE = 500_000
STATE_SIZE = 300_000


class Map(NamedTuple):
    """State map of a chunk; ``tail`` is None if the chunk is part of one segment."""

    head: str
    count: int
    tail: str | None


class Transducer:
    """Counting transducer of a sentencepiece byte-pair model with byte fallback and identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {
            library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        }
        pieces = {p.replace(SPACE, " "): s for p, s in scores.items()}
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a space behind another character")
        order = sorted(pieces, key=lambda p: -pieces[p])
        self.rank = {p: k for k, p in enumerate(order)}
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        self._agree: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._known: dict[tuple, list] = {}
        self._start = self._state((("", None, 0),))

    def _state(self, entries: tuple) -> list:
        """[transitions, entries]; an entry is (unfinished start, token before it, tokens less than now)."""
        if entries not in self._known:
            self._known[entries] = [{}, entries]
        return self._known[entries]

    def _merge(self, text: str) -> list[str]:
        """Tokens of a short text by merging the best-scored neighbouring pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank),
                       default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair(self, left: str | None, right: str) -> bool:
        """Whether the tokenizer lets ``right`` follow ``left``."""
        if left is None:
            return self._merge(right) == [right]
        key = (left, right)
        if key not in self._agree:
            self._agree[key] = self._merge(left + right) == [left, right]
        return self._agree[key]

    def _compile(self, state: list, char: str) -> tuple[list, int]:
        grown = [(start + char, before, less) for start, before, less in state[1]]
        for text, before, less in grown:  # longest first
            if (text in self.rank or len(text) == 1) and self._pair(before, text):
                token, emitted = text, less + (1 if text in self.rank else len(text.encode("utf-8", "surrogatepass")))
                break
        entries = tuple((t, b, d - emitted) for t, b, d in grown if t in self.starts) + (("", token, 0),)
        state[0][char] = move = (self._state(entries), emitted)
        return move

    def count_segment(self, segment: str) -> int:
        """Tokens of a segment: the emissions along its path."""
        if len(self._known) > STATE_SIZE or len(self._agree) > 4 * STATE_SIZE:
            self._agree.clear()
            self._reset()
        state, total = self._start, 0
        for char in segment:
            move = state[0].get(char)
            if move is None:
                move = self._compile(state, char)
            state, emitted = move
            total += emitted
        return total

    def count(self, segments: Iterable[str]) -> int:
        """Tokens of whole segments, each distinct one walked once."""
        memo, total = self.memo, 0
        for segment in segments:
            n = memo.get(segment)
            if n is None:
                if len(memo) > MEMO_SIZE:
                    memo.clear()
                n = self.count_segment(segment)
                if len(segment) <= 64:
                    memo[segment] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> Map:
        """State map of a chunk of text, in which spaces stand for themselves."""
        return self._map(_SEGMENTS.findall(chunk.replace(SPACE, " ")))

    def _map(self, segments: list[str]) -> Map:
        if len(segments) < 2:
            return Map(segments[0] if segments else "", 0, None)
        return Map(segments[0], self.count(segments[1:-1]), segments[-1])

    def compose(self, a: Map, b: Map) -> Map:
        """The map of two chunks, ``a`` before ``b``."""
        seam = self._map(_SEGMENTS.findall((a.head if a.tail is None else a.tail) + b.head))
        whole = seam.tail is None
        if a.tail is None and b.tail is None:
            return seam
        if a.tail is None:
            return Map(seam.head, seam.count + b.count + (0 if whole else self.count([seam.tail])), b.tail)
        if b.tail is None:
            joined = a.count + seam.count + (0 if whole else self.count([seam.head]))
            return Map(a.head, joined, seam.head if whole else seam.tail)
        ends = [seam.head] if whole else [seam.head, seam.tail]
        return Map(a.head, a.count + seam.count + self.count([e for e in ends if e]) + b.count, b.tail)

    def scan(self, maps: list[Map]) -> Map:
        """Composition of all maps in order, as a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else Map("", 0, None)

    def total(self, m: Map) -> int:
        """Tokens of a finished map."""
        return m.count + self.count([s for s in (m.head, m.tail) if s])


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(name: str) -> Transducer:
    """The worker's transducer of a model file."""
    path = tokenizer_file(name)
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]
