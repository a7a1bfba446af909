"""Numpy work on the UTF-8 bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a larger piece of its own.
PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """A task that gives unused memory of Arrow back at its end: its process waits for
    others, beside stages that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


@lru_cache(maxsize=1)
def byte_codes(lower: bool = True) -> np.ndarray:
    """A fixed random 64-bit value per byte; A-Z as a-z if ``lower``."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, from 0 to ``n``."""
    if _powers["n"] < n + 1:
        size = max(n + 1, 2 * PIECE_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, step in (("up", _BASE), ("down", inverse)):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end, alike wherever they stand."""
    _, down = powers(len(sums) - 1)
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _BASE)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows; null as empty."""
    text = batch.column(column)
    if pa.types.is_string(text.type) or pa.types.is_binary(text.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(text)
    if n == 0:
        return
    _, raw, body = text.buffers()
    offsets = np.frombuffer(raw, kind, n + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if text.null_count:  # a null may have bytes behind it
        clean = pc.fill_null(text, "" if pa.types.is_string(text.type) else b"")
        _, raw, body = clean.buffers()
        offsets = np.frombuffer(raw, kind, n + 1, clean.offset * np.dtype(kind).itemsize).astype(np.int64)
        whole = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts, ends and rows of the runs of word bytes; none crosses texts."""
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


#: Bytes that are not white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The distinct hashes of n-word shingles of each text, sorted.

    Words are runs of bytes that are not white space, A-Z lowered.  A text with fewer
    words (but not none) has one shingle, the whole sequence.
    """
    starts, ends, rows = word_bounds(data, offsets, NOT_SPACE)
    words = span_hashes(prefix_sums(data, byte_codes()), starts, ends)
    up, _ = powers(n + 1)
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for j in range(n):
        grams += words[j : j + len(grams)] * up[j + 1]
    grams = mix(grams)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * up[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
