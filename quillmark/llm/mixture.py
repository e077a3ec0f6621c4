"""Mixing sources to target weights that change over the training: positions by inverting each source's demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, word_array, written

#: Hex digits of the ordering hash that cut a source into parts, so that its running sums need no single task.
PART_DIGITS = 3
MOST_COPIES = 3


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources with weight: the given ones in turn by the sources' code points, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights)).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, source_size, weight) with target: all words shared by weight, no source above MOST_COPIES times its size.

    What a capped source leaves goes to the others by weight. In the order of cap to weight, the capped ones come first.
    """
    number = lambda c: F.col(c).cast("decimal(38,0)")
    everything, order = Window.partitionBy(), Window.orderBy((F.lit(MOST_COPIES) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("_all", F.sum(number("source_size")).over(everything)).withColumn("_weights", F.sum(number("weight")).over(everything))
    s = s.withColumn("_left", F.col("_all") - MOST_COPIES * F.coalesce(F.sum(number("source_size")).over(before), F.lit(0)))
    s = s.withColumn("_others", F.col("_weights") - F.coalesce(F.sum(number("weight")).over(before), F.lit(0)))
    below = MOST_COPIES * number("source_size") * F.col("_others") > number("weight") * F.col("_left")
    s = s.withColumn("_capped", F.max(below.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    free = lambda c: F.max(F.when(~F.col("_capped"), F.col(c))).over(everything).cast("double")
    s = s.withColumn("_rate", free("_left") / free("_others"))
    target = F.when(F.col("_capped"), (MOST_COPIES * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("_rate"))
    return s.select(*sources.columns, target.alias("target"))


def curriculum(weight: Column) -> Column:
    """A schedule in which sources of weight 1 fade from 1.5 to 0.5 in the course of the training, and those of weight 3 grow from 2.5 to 3.5."""
    bend = (2 - weight) * 0.5
    return F.array(*(F.struct(F.lit(t).alias("t"), w.cast("double").alias("w")) for t, w in ((0.0, weight + bend), (1.0, weight - bend))))


def constant(weight: Column) -> Column:
    return F.array(*(F.struct(F.lit(t).cast("double").alias("t"), weight.cast("double").alias("w")) for t in (0, 1)))


def integrated(knots: Column) -> Column:
    """Pieces of a schedule that is linear between knots (t, w) from t = 0 to t = 1, each with what has summed up before it."""
    piece = lambda a, b: F.struct(a["t"].alias("t"), a["w"].alias("w"), ((b["w"] - a["w"]) / (b["t"] - a["t"])).alias("slope"), ((a["w"] + b["w"]) / 2 * (b["t"] - a["t"])).alias("area"))
    pieces = F.transform(F.slice(knots, 1, F.size(knots) - 1), lambda a, k: piece(a, F.get(knots, k + 1)))
    return F.transform(pieces, lambda p, k: F.struct(p["t"].alias("t"), p["w"].alias("w"), p["slope"].alias("slope"), p["area"].alias("area"), F.aggregate(F.slice(pieces, 1, k), F.lit(0.0), lambda a, x: a + x["area"]).alias("before")))


def position(pieces: Column, share: Column) -> Column:
    """The time at which a source has given this share of its words: the inverse of its cumulative demand."""
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p["area"])
    due = share * whole
    at = F.filter(pieces, lambda p: p["before"] <= due)[F.size(F.filter(pieces, lambda p: p["before"] <= due)) - 1]
    rest = due - at["before"]
    root = F.sqrt(F.greatest(at["w"] * at["w"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), at["t"] + F.when(at["w"] + root > 0, 2 * rest / (at["w"] + root)).otherwise(F.lit(0.0)))


def plan(docs: DataFrame, knots: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): size, source_size, target, taken, copies.

    size counts words, none for null. Documents of a source stand in the order of their ids' MD5; the source gives all of
    them as often as its rounded target holds its size, then from the start again until the words are reached: one
    document there may be cut. copies has for each time a document is taken its position from 0 to 1 and its words.
    knots: a schedule array(struct(t, w)) over `weight`; a constant one if None. Only its shape counts, for the targets
    come from the weights. No source takes more than MOST_COPIES times what it has, so no document does. Ties and repeated
    rows stand side by side and each count; a null source is a source, a null doc_id comes last. Other columns are ignored,
    but for those to carry.
    """
    own = docs.select("doc_id", "source", *carry, F.size(word_array(F.col("text"))).cast("long").alias("size"))
    own = own.withColumn("_order", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("g"))).withColumn("_part", F.substring("_order", 1, PART_DIGITS))
    own = checkpointed(own)
    parts = own.groupBy("source", "_part").agg(F.sum("size").alias("_words"))
    by_source = parts.groupBy("source").agg(F.sum("_words").alias("source_size"))
    sources = targets(repeating_weights(by_source)).select(F.col("source").alias("_source"), "source_size", "weight", "target")
    sources = sources.withColumn("_pieces", integrated(constant(F.col("weight")) if knots is None else knots)).withColumn("_goal", F.round("target").cast("long"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), before.alias("_before"))
    # a row for each part; written, so that the driver doesn't plan the targets together with the documents
    parts = written(parts.join(sources, parts._source.eqNullSafe(sources._source)).drop(sources._source))
    inside = Window.partitionBy("source", "_part").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, placed.source.eqNullSafe(parts._source) & (placed._part == parts._of))
    start = F.col("_before") + F.col("_inside")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("_start", start).withColumn("_full", F.when(full * F.col("source_size") > F.col("_goal"), full - 1).otherwise(full))
    rest = F.col("_goal") - F.col("_full") * F.col("source_size")
    placed = placed.withColumn("_cut", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_start"))))
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_full")),
        lambda k: F.struct(position(F.col("_pieces"), (k * F.col("source_size") + F.col("_start")) / F.greatest(F.col("_goal"), F.lit(1))).alias("position"), F.when(k < F.col("_full"), F.col("size")).otherwise(F.col("_cut")).alias("words")),
    )
    taken = F.col("_full") * F.col("size") + F.col("_cut")
    return placed.select("doc_id", "source", *carry, "size", "source_size", "target", taken.alias("taken"), F.filter(copies, lambda c: c["words"] > 0).alias("copies"))


def by_position(rows: DataFrame, column: str = "position") -> DataFrame:
    """The rows sorted over all partitions by training position, then doc_id."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, column, "doc_id").sortWithinPartitions(column, "doc_id")


def training_order(docs: DataFrame, knots: Column | None = None) -> DataFrame:
    """A row for each time the mix takes a document, by training position: doc_id, text, lang, source, position, words.

    A copy that is cut has the first of its words, joined by one space. Rows that repeat are taken each.
    """
    known = lambda c: F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("null"))
    docs = docs.select("doc_id", "text", "lang", "source", F.unhex(F.md5(F.concat_ws(" ", known("text"), known("lang")).cast("binary"))).alias("_text"))
    planned = plan(docs, knots, ("_text",)).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash"), F.col("source").alias("_source"), "size", "copies")
    repeated = Window.partitionBy("_doc", "_source", "_hash")
    planned = written(planned.withColumn("_n", F.count("*").over(repeated)).withColumn("copy", F.explode("copies")).drop("copies"))
    again = written(planned.where("_n > 1").select("_doc", "_source", "_hash").distinct())
    once = lambda of: docs.doc_id.eqNullSafe(of._doc) & docs.source.eqNullSafe(of._source) & (docs._text == of._hash)
    rows = docs.join(planned.where("_n = 1"), once(planned))
    if again.limit(1).count():
        repeats = docs.join(again, once(again), "left_semi").dropDuplicates(["doc_id", "source", "_text"])
        rows = rows.unionByName(repeats.join(planned.where("_n > 1"), once(planned)))
    words = F.col("copy")["words"]
    text = F.when(words < F.col("size"), F.array_join(F.slice(word_array(F.col("text")), 1, words.cast("int")), " ")).otherwise(F.col("text"))
    return by_position(rows.select("doc_id", text.alias("text"), "lang", "source", F.col("copy")["position"].alias("position"), words.alias("words")))
