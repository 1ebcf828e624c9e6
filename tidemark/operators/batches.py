"""Sorted groups through Python in Arrow batches, many small groups at once and long ones in pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 1 << 17


def ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def by_group(df: DataFrame, part: Sequence[str], sort: Sequence[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: T.StructType,
             whole: bool, *, rows: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` sorted by group and handed to ``fn(table, starts)`` batch by batch; ``starts`` holds the places where a group
    begins. ``whole``: groups come whole as long as they have at most ``rows`` rows (ROWS by default), longer ones in pieces of that
    many or more. ``extra`` are columns of the sort alone.
    """
    most = rows or ROWS
    df = df.withColumns(extra or {})
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*sort)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                for out in fn(table.drop_columns("_rn"), np.flatnonzero(ints(table.column("_rn")) == 1)):
                    yield from out.cast(arrow).to_batches()

        for batch in batches:
            held.append(batch)
            if whole and sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            first = np.flatnonzero(ints(table.column("_rn")) == 1)
            cut = int(first[-1]) if whole and len(first) and first[-1] > 0 else table.num_rows
            if whole and cut == table.num_rows < most:
                continue
            yield from done(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return numbered.mapInArrow(run, schema)


def spans(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    cuts = sorted({0, *starts.tolist(), n})
    return list(zip(cuts[:-1], cuts[1:]))
