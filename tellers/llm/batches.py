"""Columns computed in Python from a text, batch by batch, beside the columns that stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tellers.llm.text import free_name

_BYTES_AT_ONCE = 4 << 20


def with_text_columns(
    df: DataFrame, text: Column, compute: Callable[[list], Sequence[pa.Array]], added: T.StructType,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with the columns ``compute`` makes of some texts at a time.

    ``keep`` names the columns of ``df`` that stay, all by default; one with the name
    of an added column is replaced. ``compute`` gets a list of texts, of about
    ``_BYTES_AT_ONCE`` in all or a longer one alone, so that a batch of long documents
    is never in memory as Python objects, and returns an array for each added column.
    No row is shuffled.
    """
    names = [f.name for f in added.fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    rows = df.select(*[f"`{c}`" for c in kept], text.alias(free_name(df, "_text_of_row")))
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, len(kept)):
                columns = part.columns[:-1] + list(compute(part.column(len(kept)).to_pylist()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return rows.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, column: int, size: int = _BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text is alone."""
    start = total = 0
    for at, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + (length or 0) > size:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def portions(texts: Sequence, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` together; a longer text is alone."""
    start = total = 0
    for at, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, at
            start, total = at, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
