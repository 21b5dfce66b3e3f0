"""Vectorised work on columns of UTF-8 text that arrive as Arrow batches.

Everything here keeps to whole texts. A batch is worked through in slices of a bounded number of
bytes, so that memory in a Python worker follows the slice and not the table; one text longer than a
slice is a slice of its own. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a worker takes at once.
SLICE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, the text last and never null; columns that the caller's table has besides are left out."""
    return df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n == "text" else F.col(n) for n in names])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = text_buffer(batch.column(batch.schema.get_field_index(text)))[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of a kind inside one text, and each text's first word (len+1)."""
    inside = kind[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(buf):
        before[0] = after[-1] = False
    edges = at[:-1][at[:-1] < len(buf)]
    before[edges] = False
    edges = at[1:][at[1:] > 0]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        pair = []
        for p in (_P, _PINV):
            a = np.ones(size, np.uint64)
            k, step = 1, p
            while k < size:
                a[k : 2 * k] = a[:k] * step
                step, k = step * step, 2 * k
            pair.append(a)
        _powers[:] = pair
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hashes."""
    with np.errstate(over="ignore"):
        power, inverse = _pow(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] values, then the next range's, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i+1]] for each i, exact for empty ranges."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fi" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def rewritten(df: DataFrame, make) -> DataFrame:
    """All columns of `df`, through make() -> (batch -> batch), a slice at a time; the columns keep their types."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in slices(batches):
            yield change(batch)

    return df.mapInArrow(run, schema)


def with_texts(batch: pa.RecordBatch, texts: dict[int, str], n_chars: str = "n_chars") -> pa.RecordBatch:
    """The batch with other texts in some rows, and their lengths there where it has a column for them."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    new = {"text": texts}
    if n_chars in columns:
        new[n_chars] = {i: len(t) for i, t in texts.items()}
    for name, values in new.items():
        columns[name] = pa.array([values.get(i, x) for i, x in enumerate(columns[name].to_pylist())], batch.schema.field(name).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
