"""Connected components of a graph given by its edges, and what observations say about one another by shared identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.folders import shared_folder


def saved(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder, so that rounds don't grow the plan and lost executors don't repeat them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _hooked(edges: DataFrame) -> DataFrame:
    """Each larger end of an edge (hi, lo) with the smallest node near its smaller end, and that end as well."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    met = edges.join(least, "hi")
    return met.select("hi", F.col("least").alias("lo")).union(met.where("lo != least").select("lo", "least")).distinct()


def _spread(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node with the smallest neighbour of that node, or the node itself."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(edges.select("lo", "hi"))
    least = ends.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return ends.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("least").alias("lo")).distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge to another: root is the smallest node that edges lead to.

    Two steps in turn bring each node's neighbours to its smallest one until nothing changes, in a number of rounds that grows with the
    logarithm of the longest path. Minima are taken before they are shuffled, so a node of many edges is no one task's.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, seen = saved(edges), None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()) != seen:
        edges, seen = saved(_hooked(_spread(edges))), now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())


def observed_works(observations: DataFrame, known: DataFrame) -> DataFrame:
    """(observation_id, cluster, n_works, status, work_id) of observations(observation_id, identifiers) by known(identifier, work_id).

    Observations that share identifiers, over any number of others, are of one cluster, named by its smallest identifier. status: known
    where the cluster's identifiers have one work, conflict where they have several (none is chosen), new where they have none: then the work's
    id is the cluster's. Null identifiers say nothing; an observation without any has status unidentified.
    """
    each = observations.select("observation_id", F.explode_outer(F.array_distinct(F.filter("identifiers", lambda i: i.isNotNull()))).alias("identifier"))
    first = each.groupBy("observation_id").agg(F.min("identifier").alias("first"))
    links = each.join(first, "observation_id").where("identifier != first")
    roots = connected(links, "first", "identifier")
    work = known.join(roots, known.identifier == roots.node, "left").select(F.coalesce("root", "identifier").alias("cluster"), "work_id")
    works = work.groupBy("cluster").agg(F.min("work_id").alias("least"), F.max("work_id").alias("most"), F.count_distinct("work_id").alias("n_works"))
    rows = first.join(roots, first["first"] == roots.node, "left").select("observation_id", F.coalesce("root", "first").alias("cluster")).join(works, "cluster", "left")
    n = F.coalesce("n_works", F.lit(0).cast("long"))
    status = F.when(F.col("cluster").isNull(), "unidentified").when(n == 0, "new").when(n == 1, "known").otherwise("conflict")
    return rows.select("observation_id", "cluster", n.alias("n_works"), status.alias("status"), F.when(n == 1, F.col("least")).when(n == 0, F.concat(F.lit("work:"), "cluster")).alias("work_id"))
