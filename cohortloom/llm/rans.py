"""Static range asymmetric numeral system over interleaved lanes.

Symbol k of a block belongs to lane ``k % lanes``; all lanes take one step at a
time as NumPy vectors and share one word stream, in which the words a step
needs lie in lane order.  A checkpoint holds the decoder's lane states and word
offset before a step, so the segments between checkpoints decode side by side.
States are 64-bit in [2^31, 2^63), words are 32-bit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def table_bits(n_symbols: int) -> int:
    """Precision of the frequency table: 16 slots a symbol, between 2^12 and 2^24."""
    return min(24, max(12, (max(1, n_symbols) - 1).bit_length() + 4))


def scaled_frequencies(symbols: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of the present symbols, at least 1 each, that sum to 2^bits."""
    size, n = 1 << bits, len(symbols)
    if n > size:
        raise ValueError("more symbols than slots")
    share = [int(c) * (size - n) // int(counts.sum()) for c in counts]
    freq = np.array(share, dtype=np.int64) + 1
    freq[int(np.argmax(freq))] += size - int(freq.sum())
    return freq


@dataclass
class Table:
    """Frequencies and their running sums by symbol, and the symbol of each slot."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, freq: np.ndarray, bits: int) -> "Table":
        top = int(symbols.max()) + 1 if len(symbols) else 1
        full = np.zeros(top, dtype=np.uint64)
        full[symbols] = freq.astype(np.uint64)
        start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(full)[:-1]])
        return cls(bits, full, start, np.repeat(np.arange(top, dtype=np.uint32), full.astype(np.int64)))


@dataclass
class Block:
    """One encoded block: words, checkpoints (word offset and lane states) and checksums."""

    n: int
    lanes: int
    every: int
    words: bytes
    offsets: np.ndarray
    states: np.ndarray
    sums: list[int]


def encode(ids: np.ndarray, table: Table, lanes: int, every: int) -> Block:
    """Encode ``ids``; a checkpoint every ``every`` steps of ``lanes`` symbols."""
    n, bits = len(ids), np.uint64(table.bits)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, dtype=np.uint64)
    steps = -(-n // lanes)
    out: list[np.ndarray] = []
    written, marks = 0, []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        low = x[full].astype(np.uint32)
        out.append(low)
        written += len(low)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
        if t % every == 0:
            marks.append((written, state.copy()))
    marks.reverse()
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    span = lanes * every
    little = ids.astype("<u4")
    return Block(
        n, lanes, every, words.astype("<u4").tobytes(),
        np.array([written - w for w, _ in marks], dtype=np.int64),
        np.array([s for _, s in marks], dtype=np.uint64).reshape(len(marks), lanes),
        [zlib.crc32(little[i : i + span].tobytes()) for i in range(0, n, span)],
    )


def decode(block: Block, table: Table) -> np.ndarray:
    """The ids of a block, all segments in lock step; a wrong checksum raises."""
    lanes, every, segments = block.lanes, block.every, len(block.offsets)
    words = np.concatenate([np.frombuffer(block.words, "<u4"), np.zeros(lanes, np.uint32)]).astype(np.uint64)
    out = np.zeros((segments, every, lanes), dtype=np.uint32)
    last = -(-block.n // lanes) - (segments - 1) * every
    state, at = block.states.copy(), block.offsets.astype(np.int64).copy()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for t in range(every if segments > 1 else last):
        live = segments if t < last else segments - 1
        x = state[:live]
        slot = x & mask
        symbol = table.symbol[slot]
        out[:live, t] = symbol
        x = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        short = x < LOW
        place = np.cumsum(short, axis=1)
        source = np.minimum(at[:live, None] + place - 1, len(words) - 1)
        state[:live] = np.where(short, (x << _WORD) | words[source], x)
        at[:live] += place[:, -1]
    ids = out.reshape(-1)[: block.n]
    span = lanes * every
    for i, known in enumerate(block.sums):
        if zlib.crc32(ids[i * span : (i + 1) * span].astype("<u4").tobytes()) != known:
            raise ValueError(f"segment {i} of a token block does not match its checksum")
    return ids
