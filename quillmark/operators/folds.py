"""Folds over the rows of a key in their order, where what a row comes to depends on all before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: The state behind a row, and what the row comes to.
Step = Callable[[tuple, dict], tuple[tuple, tuple]]


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], start: tuple, step: Step, schema: str) -> DataFrame:
    """A row of `schema` for each of rows: step takes a state, first `start`, and a row as a dict, by key in the given order.

    Rows are sorted by Spark and streamed through their task, which holds one state and one batch however many rows a key has.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start
                state, result = step(state, row)
                out.append(result)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
