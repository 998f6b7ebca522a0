"""Vectorised views of the texts of an Arrow batch.

A string column is one UTF-8 buffer plus offsets. Word boundaries, word hashes and
n-gram hashes come from whole-buffer numpy operations instead of a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of words: space and the control characters 0x09 to 0x0D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: A window of the buffer whose powers are kept; longer words are hashed on their own.
_WINDOW = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix finaliser)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes() -> np.ndarray:
    folded = np.arange(256)
    folded[65:91] += 32  # A-Z are lower-cased
    return mix64(folded.astype(_U) + _U(0x51ED2701))


_CODES = _byte_codes()
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = _BASE if kind == "up" else _BASE_INVERSE
        have = np.full(n, step, _U)
        have[0] = _U(1)
        np.multiply.accumulate(have, out=have)
        if n <= 2 * _WINDOW:
            _powers[kind] = have
    return have


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low, high = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
    return data[low:high], offsets - low


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on between tasks and shares its container with others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def member(batch: pa.RecordBatch, path: tuple[str, ...]) -> pa.Array:
    """A column of a batch, or by a longer path a member of a struct column."""
    out = batch.column(batch.schema.get_field_index(path[0]))
    for name in path[1:]:
        out = out.field(out.type.get_field_index(name))
    return out


def slices(batch: pa.RecordBatch, *column: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one row, and at most ``rows`` rows; afterwards free what it took."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(member(batch, column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        end = min(end, batch.num_rows, start + rows)
        yield batch.slice(start, end - start)
        start = end
    release_memory()


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (n + 1 values).

    ``separators`` tells for each of the 256 bytes whether it stands between words.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    gap = separators[data]
    opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
    opens[1:] = gap[:-1]
    closes[:-1] = gap[1:]
    filled = offsets[1:] > offsets[:-1]
    opens[offsets[:-1][filled]] = True
    closes[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(opens & ~gap)
    ends = np.flatnonzero(closes & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up = _power("up", high - low)
        total = np.zeros(high - low + 1, _U)
        np.cumsum(_CODES[data[low:high]] * up[: high - low], out=total[1:])
        down = _power("down", high - low)
        first, last = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[last] - total[first]) * down[first] + (last - first).astype(_U)
        i = j
    return mix64(out)


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column, text after text, and the n + 1 bounds."""
    data, offsets = text_buffer(column)
    starts, ends, bounds = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), bounds


def int64s(values) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.int64, copy=False))


def as_signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=_U).view(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
