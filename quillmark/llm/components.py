"""Connected components of a graph given by edges, in Spark rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed

#: Up to so many edges are settled in one task, for a round costs more than they do; more go through rounds, with the same result.
ONE_TASK = 1_000_000
#: A node of more edges than this, and than 1/HUBS of all, is a hub: its minimum is broadcast. There are at most 2 * HUBS of them.
HUB, HUBS = 100_000, 10_000


def components(edges: DataFrame, a: str = "a", b: str = "b", *, one_task: int = ONE_TASK, hub: int = HUB) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    Alternating large-star and small-star steps; the edges of each round go to the checkpoint folder.
    Minima are aggregated before the shuffle, and a hub's edges stay where they are, for its minimum comes to them.
    Loops and null ends are dropped; no edges give no rows.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = checkpointed(e)
    before = _mark(e)
    if 0 < before[0] <= one_task:
        kind = e.schema["hi"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_settled, f"node {kind}, root {kind}")
    while before[0]:
        many = max(hub, before[0] // HUBS)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _met(both.where("v > u"), least, "u", many).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = _met(large, least, "hi", many)
        e = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(small.select("hi", "m")).distinct()
        e = checkpointed(e)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())


def _met(rows: DataFrame, least: DataFrame, on: str, many: int) -> DataFrame:
    """rows with the minimum m of their node."""
    hubs, others = F.broadcast(least.where(F.col("n") > many)), least.where(F.col("n") <= many)
    return rows.join(hubs, on).drop("n").unionByName(rows.join(hubs, on, "left_anti").join(others, on).drop("n"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a bounded graph at once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = np.concatenate([table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("hi", "lo")])
    nodes, place = np.unique(ends, return_inverse=True)
    root = rooted(len(nodes), place[: table.num_rows], place[table.num_rows :])
    kind = table.schema.field("hi").type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], ["node", "root"])


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: roots are hooked to smaller ones, then all point to their root."""
    root = np.arange(n)
    while True:
        before = root.copy()
        ra, rb = root[a], root[b]
        np.minimum.at(root, ra, rb)
        np.minimum.at(root, rb, ra)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            return root
