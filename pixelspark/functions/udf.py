"""The user-component surface: functions over Arrow batches where built-in expressions do not suffice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelspark.operators.groups import in_order, same_as_before, whole_groups


def single_output(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A component with one output per input: run maps a batch to a batch of as many rows."""

    def rows(batches):
        for batch in batches:
            out = run(batch)
            if out.num_rows != batch.num_rows:
                raise ValueError("a single-output component gives one row for each")
            yield out

    return df.mapInArrow(rows, schema)


def multiple_output(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A component with any number of outputs per input."""
    return df.mapInArrow(lambda batches: (run(b) for b in batches), schema)


def gathering(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """A component that sees all values below a prefix at once. A call is given many prefixes: the values of whole ones, one after the
    other, and the rows at which each begins; it gives rows for all of them. One prefix bounds what a call must hold. `each` makes
    such a component of one that takes a single prefix."""
    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            new = ~same_as_before(*[table.column(k).combine_chunks() for k in keys])
            yield from run(table.select(names), np.append(0, np.flatnonzero(new) + 1)).to_batches()

    return in_order(df, keys, keys).mapInArrow(rows, schema)


def each(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """run, which takes the values of one prefix, as a component that takes those of many."""

    def many(table: pa.Table, first: np.ndarray) -> pa.Table:
        return pa.concat_tables([run(table.slice(int(a), int(b - a))) for a, b in zip(first, np.append(first[1:], table.num_rows))])

    return many
