"""Vectorised text helpers for Arrow batches: bytes with offsets, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """n well-spread odd 64-bit constants from a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE_CODE = stream64(11, 256)
STEP = 0x9E3779B97F4A7C55
STEP_INVERSE = pow(STEP, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def strings(column: pa.Array) -> pa.Array:
    """Null as the empty text, 64-bit offsets."""
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and the n + 1 offsets of its texts in them."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in pieces of about limit bytes of text (one text at least), so that working memory is bounded."""
    for batch in batches:
        column = strings(batch.column(text))
        raw, at = as_bytes(column)
        start, n = 0, len(column)
        while start < n:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
            start = stop


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-spaces inside one text), and n + 1 offsets of the texts in the word list."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of raw[start:end] for each span; equal spans have equal hashes wherever they stand."""
    n = len(raw)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[raw] * _power("up", STEP, n), out=total[1:])
        return mix64((total[ends] - total[starts]) * _power("down", STEP_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + l) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    out[0] = starts[0]
    edge = np.cumsum(lengths)[:-1]
    out[edge] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)
