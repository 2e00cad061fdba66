"""What the training-data operators share: texts, words and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparquill.operators.staging import importable, salted_join, shared_dir, staged

__all__ = ["SPACE", "WORD", "binary_list", "importable", "salted_join", "shared_dir", "slices", "staged", "text_of"]

#: The white space of the contracts, as a Java/Python regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def binary_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a part holds about `limit` bytes of `column` at most (one longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        start = held = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
