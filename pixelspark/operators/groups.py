"""Groups of rows that tasks work on many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_AT_ONCE = 1 << 17


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with all rows of each key in one partition, sorted by keys and order, and a column _place of their numbers.

    A window asks for this; unlike repartition it shuffles nothing where rows are dealt out by some of the keys already.
    """
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def same_as_before(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """For each row but the first: whether it equals the row before in all columns; nulls equal each other, and so do NaNs."""
    out = np.ones(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.fill_null(pc.equal(a, b), False) if c.null_count else pc.equal(a, b)
        if c.null_count:
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out &= same.to_numpy(zero_copy_only=False).astype(bool)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows_at_once: int = ROWS_AT_ONCE) -> Iterator[pa.Table]:
    """Batches sorted by keys, regrouped into tables of about rows_at_once rows that hold all rows of their keys."""
    held: list[pa.Table] = []
    n, enough = 0, rows_at_once
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= enough:
            table = pa.concat_tables(held).combine_chunks()
            ends = np.flatnonzero(~same_as_before(*[table.column(k).combine_chunks() for k in keys]))
            if len(ends):
                yield table.slice(0, int(ends[-1]) + 1).combine_chunks()
                table = table.slice(int(ends[-1]) + 1)
            held, n = [table], table.num_rows
            enough = max(rows_at_once, 2 * n) if not len(ends) else rows_at_once  # a long group is not gone through again for each batch
    if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
        yield table
