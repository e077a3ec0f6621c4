"""Language-model scores of whole texts: context-tree weighting over bytes, beside a plain model of words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import context_tree as tree
from quillmark.llm.common import arrow_schema, numbered, shuffle_partitions, written

#: How many of the most frequent byte grams and words are sent to the tasks: bounds of what is broadcast. All others are joined.
BROADCAST_GRAMS, BROADCAST_WORDS = 4_000_000, 1_000_000
#: Bytes counted together in a task, and words.
COUNTED, WORDS_HELD = 6_000_000, 400_000
END = b"\n"
COUNTS = "kind int, key long, n long"


def tokens(text: bytes | None) -> list[bytes]:
    """Words in small letters (A-Z only), then the end."""
    return [*(text or b"").lower().split(), END]


def word_key(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 7)
    return h - (1 << 64) if h >> 63 else h


def counted(docs: DataFrame, train: str) -> DataFrame:
    """(kind, key, n) over all documents. kind 0: how often training texts have a byte gram, 0 for one of other texts alone;
    kind 1: how often they have a word."""
    arrow = arrow_schema(docs.sparkSession, COUNTS)

    def batch(kind, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def grams():
            for training, arrays in held.items():
                if arrays:
                    keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                    yield batch(0, keys.astype(np.int64), n if training else np.zeros(len(keys), np.int64))
                    arrays.clear()

        def seen():
            if words:
                yield batch(1, np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
                words.clear()

        for b in batches:
            for text, training in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = tokens(text)
                if training:
                    words.update(own)
                g = tree.byte_grams(b" ".join(own[:-1]))
                held[bool(training)].append(g)
                size += len(g)
                if size > COUNTED:
                    yield from grams()
                    size = 0
            if len(words) > WORDS_HELD:
                yield from seen()
        yield from grams()
        yield from seen()

    return docs.select("text", train).mapInArrow(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, n, logp): log10 of the probability that the model gives each byte gram's last byte."""
    n = shuffle_partitions(grams.sparkSession)
    together = grams.withColumn("_two", F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)).repartition(n, "_two").select("key", "n")
    nodes_schema, scores_schema = "code long, zeros double, ones double, weighted double", "key long, n long, logp float"
    nodes_arrow, scores_arrow = arrow_schema(grams.sparkSession, nodes_schema), arrow_schema(grams.sparkSession, scores_schema)

    def whole(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("key", pa.int64()), ("n", pa.int64())]))
        return table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64)

    def nodes(batches):
        keys, counts = whole(batches)
        if len(keys):
            level = tree.deep_levels(keys, counts, 2)[0][-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.codes.astype(np.int64), level.zeros, level.ones, level.weighted)], schema=nodes_arrow)

    two = together.mapInArrow(nodes, nodes_schema)
    one = two.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("product"))
    rows = one.toArrow()  # at most 256 * 255 nodes
    shallow = tree.shallow_levels(rows["code"].to_numpy().astype(np.uint64), *(rows[c].to_numpy() for c in ("zeros", "ones", "product")))
    shared = grams.sparkSession.sparkContext.broadcast(shallow)

    def scores(batches):
        keys, counts = whole(batches)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(tree.log_probabilities(keys, counts, shared.value).astype(np.float32))], schema=scores_arrow)

    return together.mapInArrow(scores, scores_schema)


def frequent(rows: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The count from which on rows(key, n, …) go to the tasks, a power of two or none at all, and those rows: at most `most`."""
    power = F.when(F.col("n") > 0, F.floor(F.log2("n")).cast("int")).otherwise(-1)
    total, least = 0, 1 << 62
    for p, n in sorted(rows.groupBy(power.alias("power")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = 1 << p if p >= 0 else 0
    return least, rows.where(F.col("n") >= least).toArrow()


ROWS = "doc_id long, n_tokens long, known long, logs double, found double, n_scored long, rare array<long>, grams array<long>"


def scored(docs: DataFrame, known_words: tuple[np.ndarray, np.ndarray], lookup: tree.Lookup) -> DataFrame:
    """A row for each document: sums over its frequent words and byte grams, and those that have still to be joined."""
    sc = docs.sparkSession.sparkContext
    shared, arrow = sc.broadcast((known_words, lookup)), arrow_schema(docs.sparkSession, ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, n), find = shared.value
        logs = np.log10(n + 0.5)
        for b in batches:
            out, docs_tokens = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                own = tokens(text)
                docs_tokens.append(own)
                g = tree.byte_grams(b" ".join(own[:-1]))
                value = find(g)
                rare = np.isnan(value)
                out.append((float(value[~rare].sum(dtype=np.float64)), len(g), g[rare].astype(np.int64)))
            ids, words = numbered(docs_tokens)
            docs_words = np.split(ids, np.cumsum([len(own) for own in docs_tokens])[:-1])
            every = np.fromiter(map(word_key, words), np.int64, len(words))
            at = np.searchsorted(keys, every)
            there = np.zeros(len(every), bool)
            inside = at < len(keys)
            there[inside] = keys[at[inside]] == every[inside]
            value = np.where(there, logs[np.minimum(at, len(keys) - 1)] if len(keys) else 0.0, 0.0)
            known = [there[i] for i in docs_words]
            columns = [
                b.column(0).to_pylist(),
                [len(i) for i in docs_words],
                [int(k.sum()) for k in known],
                [float(value[i].sum()) for i in docs_words],
                [s for s, _, _ in out],
                [n for _, n, _ in out],
                [every[i[~k]] for i, k in zip(docs_words, known, strict=True)],
                [g for _, _, g in out],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS).withColumn("_row", F.monotonically_increasing_id())


def score(docs: DataFrame, train: Column, *, broadcast_grams: int = BROADCAST_GRAMS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of docs(doc_id, text).

    train: which documents the models learn from; null counts as no. A text is its words in small letters (A-Z) with one
    space between, and an end. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over words and end. score is the log10
    probability of all its bytes and the end under context-tree weighting, bits_per_byte their code length in bits for each of them. Counts are of all training documents: byte
    grams are counted in the tasks, then by key, and a tree's nodes meet by their last two bytes. Null and empty texts are
    an end alone. With no training document every bit has one half. Repeated rows are learned from and scored each; other
    columns are ignored. Words are known by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("_train"))
    counts = written(counted(docs, "_train"))
    words, grams = counts.where("kind = 1").select("key", "n"), counts.where("kind = 0").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = written(gram_scores(grams)) if grams.limit(1).count() else grams.withColumn("logp", F.lit(0.0).cast("float"))
    least_gram, table = frequent(model, broadcast_grams)
    lookup = tree.Lookup(table["key"].to_numpy().astype(np.uint64), table["logp"].to_numpy())
    least, table = frequent(words, broadcast_words)
    table = table.sort_by("key")
    keys, of = table["key"].to_numpy(), table["n"].to_numpy()
    del table
    each = written(scored(docs, (keys, of), lookup))
    rare = each.select("_row", F.explode("rare").alias("key")).join(words.where(F.col("n") < least), "key")
    rare = rare.groupBy("_row").agg(F.count("*").alias("_known"), F.sum(F.log10(F.col("n") + 0.5)).alias("_logs"))
    each = each.join(rare, "_row", "left")
    by_gram = each.select("_row", F.explode("grams").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("_times"))
    by_gram = by_gram.join(model.where(F.col("n") < least_gram), "key").groupBy("_row").agg(F.sum(F.col("_times") * F.col("logp").cast("double")).alias("_joined"))
    each = each.join(by_gram, "_row", "left").withColumn("score", F.col("found") + F.coalesce("_joined", F.lit(0.0)))
    n_known = F.col("known") + F.coalesce("_known", F.lit(0))
    unknown = (F.col("n_tokens") - n_known) * F.log10(F.lit(0.5))
    base = F.col("logs") + F.coalesce("_logs", F.lit(0.0)) + unknown - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    return each.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_scored")).alias("bits_per_byte"))
