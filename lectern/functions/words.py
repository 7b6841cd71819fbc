"""Words of lower-cased texts straight from Arrow's byte buffers, with numpy.

The words are those of the patterns in ``operators.search``: which code points
are letters or digits is asked of Spark's own regular expressions, once a
session, so texts cut here and texts cut in a plan have the same words at the
same places. Work goes in slices of SLICE_BYTES; a text longer than that is a
slice of its own and takes some 30 times its size for the moment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: What four bytes of UTF-8 can say.
POINTS = 1 << 21
_known: dict[str, bytes] = {}


def letters(spark: SparkSession) -> bytes:
    """A bit for each code point: whether it is a letter or digit."""
    if (app := spark.sparkContext.applicationId) not in _known:
        points = spark.range(0, 0x110000, 1, 1).where("id NOT BETWEEN 55296 AND 57343")
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = points.where(char.rlike(r"^[\p{L}\p{N}]$")).toArrow().column(0).to_numpy()
        bits = np.zeros(POINTS, bool)
        bits[found] = True
        _known.clear()
        _known[app] = np.packbits(bits).tobytes()
    return _known[app]


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row begins and the last ends) of runs of
    whole rows of about SLICE_BYTES. The column has no null."""
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, whole[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _last(flags: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is flagged, or -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def cut(data: np.ndarray, at: np.ndarray, known: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(inside, starts): the bytes that belong to words, and where words begin.
    With marks, a word goes on over the diacritics after its letters."""
    inside = known[:256][data] & (data < 0x80)
    lead = np.flatnonzero(data >= 0xC0)
    accents = None
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & (0xFF >> (size + 1))).astype(np.int64)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
        good = known[point]
        if marks and (accent := (point >= 0x300) & (point <= 0x36F)).any():
            accents = np.zeros(len(data), bool)
            accents[lead[accent]] = accents[np.minimum(lead[accent] + 1, len(data) - 1)] = True
        for k in range(4):
            spot = lead[good & (size > k)] + k
            inside[spot[spot < len(data)]] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    begins = begins[:-1]
    if accents is not None:
        # of a run of letters and diacritics what comes before its first letter is no word
        run = inside | accents
        opens = run & (begins | ~np.concatenate([[False], run[:-1]]))
        inside = run & (_last(inside) >= _last(opens))
    return inside, np.flatnonzero(inside & (begins | ~np.concatenate([[False], inside[:-1]])))


def counted(column: pa.Array, known: np.ndarray, marks: bool) -> np.ndarray:
    """How many words each text has."""
    out = np.zeros(len(column), np.int64)
    for i, data, at in slices(column):
        if len(data):
            _, starts = cut(data, at, known, marks)
            out[i : i + len(at) - 1] = np.diff(np.searchsorted(starts, at))
    return out


def tokens(column: pa.Array, known: np.ndarray, marks: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(row, position, term) of all words, slice by slice."""
    for i, data, at in slices(column):
        inside, starts = cut(data, at, known, marks) if len(data) else (None, ())
        if len(starts):
            first = np.searchsorted(starts, at)
            counts = np.diff(first)
            edges = np.cumsum(inside, dtype=np.int32)[starts] - 1  # bytes of words before each
            kept = data[inside]
            values = pa.py_buffer(np.ascontiguousarray(kept)), pa.py_buffer(np.r_[edges, np.int32(len(kept))].astype(np.int32))
            terms = pa.StringArray.from_buffers(len(starts), values[1], values[0])
            yield i + np.repeat(np.arange(len(counts)), counts), np.arange(len(starts)) - np.repeat(first[:-1], counts), terms


def no_null(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "") if column.null_count else column
