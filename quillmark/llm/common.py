"""What several of these operators share: reading, words, checkpoints and row streams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.folders import CLEANED, shared_folder, written  # noqa: F401

#: Between words: space and the five ASCII controls from tab to carriage return. bytes.split() cuts at the same six.
GAP = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch that hold whole texts; bounds a worker's memory at this many of the longest texts.
TEXT_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, with Arrow batches bounded."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def word_array(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the folder of spark.checkpoint.dir, so that lost executors don't make Spark compute them anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few keys each that may be broadcast, some 64 MB.
BROADCAST_ROWS = 1_000_000


def small(written: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has no more than BROADCAST_ROWS rows; beyond that joins shuffle both sides."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists or arrays. make() runs once a task and returns the function of a batch; strings arrive as UTF-8 bytes."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if not b.num_rows:
                continue
            cols = {}
            for name, c in zip(b.schema.names, b.columns, strict=True):
                cols[name] = (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist()
            out = f(cols)
            if out is not None:
                yield from record_batches(out, arrow)

    return df.mapInArrow(run, schema)


def record_batches(out: dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def numbered(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """The words of several texts as numbers in the order in which they first come, and the words that have those numbers."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64), list(number)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
