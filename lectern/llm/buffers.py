"""Words and windows straight from Arrow's byte buffers, with numpy.

Both word patterns in use break at ASCII bytes only, so UTF-8 needs no
decoding: bytes from 0x80 up always belong to a word. Work goes in slices of
about SLICE_BYTES; memory is some 60 bytes for each byte of a slice, and a
text longer than a slice is a slice of its own.

Hashes are 64 bits: a polynomial over random byte values, then mixed. Two
different words or windows in one text meet with odds of about 1e-19 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_byte = np.arange(256)
#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
#: First bytes of code points.
LEADS = (_byte & 0xC0) != 0x80

_rng = np.random.Generator(np.random.PCG64(20250101))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_power = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_power[base]) < n:
        with np.errstate(over="ignore"):
            _power[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]))
    return _power[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of whole rows of about limit bytes of text each."""
    data, at = bytes_of(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word."""
    inside = kind[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    joined = inside[1:] & inside[:-1] & ~edge[1:-1]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], joined]))
    ends = np.flatnonzero(inside & ~np.concatenate([joined, [False]])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _powers(_BASE, len(data)), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for every i; windows over the ends of texts are
    included, see whole_windows()."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[: len(words) - k + 1] * _STEP[0]
        for j in range(1, k):
            total = total + words[j : len(words) - k + 1 + j] * (_STEP[j % 64] + np.uint64(j - j % 64))
    return mixed(total)


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """The starts of all k-word windows that stay inside their text."""
    counts = np.diff(first)
    if not first[-1]:
        return np.zeros(0, np.int64)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return np.flatnonzero(left >= k)


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
