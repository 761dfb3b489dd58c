"""Text helpers: row identity, bounded Arrow batches and whitespace word counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def row_key(docs: DataFrame) -> Column:
    """A 64-bit digest of a row, all its columns but maps; rows that differ are told apart even if their doc_id repeats."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in sorted(docs.schema, key=lambda f: f.name) if _hashable(f.dataType)])


def text_key() -> Column:
    """A 64-bit digest of a row's text."""
    return F.xxhash64(F.col("text").cast("string"))


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `limit` bytes of text, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each row."""
    return column.cast(pa.binary()).to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column in one array, and the rows' offsets in it (a null row is empty)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of runs of non-space characters (ASCII space and tab to carriage return) in each row."""
    data, offsets = flat(column)
    if not len(data):
        return np.zeros(len(column), np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(before & ~space)])
    return total[offsets[1:]] - total[offsets[:-1]]
