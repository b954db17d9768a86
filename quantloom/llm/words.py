"""Vectorised work on the bytes of many texts at once, inside Arrow batches.

A batch is one byte buffer with offsets; words are found, hashed and compared with numpy, so that no Python code runs
per word. Buffers are handled in slices of a few megabytes, which bounds the memory of a task whatever its partition
holds (one text that is longer makes a slice of its own).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
WINDOW_BYTES = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiply-xorshift rounds."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_table(seed: int, fold_case: bool, silent: bytes) -> np.ndarray:
    """A random odd number for each byte value; upper-case A-Z like lower-case, `silent` bytes count nothing."""
    table = mix64(np.arange(1, 257, dtype=_U) * _STEP + _U(seed)) | _U(1)
    if fold_case:
        table[65:91] = table[97:123]
    table[list(silent)] = 0
    return table


#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b" \t\n\v\f\r"
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True
WORD_TABLE = byte_table(1, True, SEPARATORS)
SPAN_TABLE = byte_table(2, False, b"")


@dataclass
class Slice:
    """Rows `first` to `last` (exclusive) of a batch: their bytes and, for n rows, n + 1 offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The UTF-8 bytes of a string column, a few megabytes at a time; NULL is an empty text."""
    texts = column.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def span_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span. A span runs to the start of the next one; bytes with a zero in `table` don't count.

    The hash is a polynomial in the place within the span, summed by `reduceat`, then mixed.
    """
    n = len(starts)
    hashes = np.zeros(n, dtype=_U)
    if not n:
        return hashes
    bounds = np.append(starts, len(data))
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + WINDOW_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        begin = bounds[at:to] - bounds[at]
        lengths = np.diff(bounds[at : to + 1])
        place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        powers = np.full(int(lengths.max()), _STEP, dtype=_U)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=_U)
        hashes[at:to] = np.add.reduceat(table[data[bounds[at] : bounds[to]]] * powers[place], begin)
        at = to
    return mix64(hashes)


@dataclass
class Words:
    """Words in text order: where they start, the row they belong to, their hash; `counts` is words by row."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def find_words(part: Slice, separator: np.ndarray = IS_SEPARATOR, table: np.ndarray = WORD_TABLE) -> Words:
    """Maximal runs of bytes that `separator` does not flag, hashed by `table`, in which separators must be zero.

    By default `SEPARATORS` part the words and A-Z are hashed like a-z.
    """
    inside = ~separator[part.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[part.offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    firsts = np.searchsorted(starts, part.offsets)
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(part.last - part.first), counts)
    return Words(starts, ends, rows, span_hashes(part.data, starts, table), counts)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct hashed shingles of `size` words, ascending: offsets by row, and the hashes.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n_rows, h = len(words.counts), words.hashes
    many = len(h) - size + 1
    if many > 0:
        rolled = np.zeros(many, dtype=_U)
        for k in range(size):
            rolled = rolled * _U(0xD6E8FEB86659FD93) + h[k : k + many]
        whole = words.rows[:many] == words.rows[size - 1 :]
        found, owner = mix64(rolled)[whole], words.rows[:many][whole]
    else:
        found, owner = np.zeros(0, _U), np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=n_rows)
    firsts = np.concatenate([[0], np.cumsum(words.counts)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sets: list[np.ndarray] = []
    for row in range(n_rows):
        if counts[row]:
            sets.append(np.unique(found[bounds[row] : bounds[row + 1]]))
        elif words.counts[row]:
            short = np.array([words.counts[row]], dtype=_U)
            for at in range(firsts[row], firsts[row + 1]):
                short = mix64(short * _STEP + h[at : at + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, _U))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return offsets, np.concatenate(sets) if sets else np.zeros(0, _U)


def freed(run: Callable) -> Callable:
    """`run`, a function for `mapInArrow`, after which a worker gives its free memory back to the machine.

    Spark keeps workers for later stages; without this each goes on to hold what its largest batch has taken.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return released


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
