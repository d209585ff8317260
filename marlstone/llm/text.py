"""Small helpers shared by the operators: words, keys, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 (``bytes.split`` cuts at exactly these blanks)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts hold about ``most_bytes`` (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def hashable(kind: DataType) -> bool:
    """Whether Spark's hash functions take values of this type."""
    if isinstance(kind, ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def apart(id: str, taken: tuple[str, ...]) -> str:
    """The name of an id column in a result with other columns of these names."""
    return "doc_id" if id in taken else id
