"""Substring dedup: words of long passages that stand elsewhere as well are removed, wherever they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_schema, shuffle_partitions, written
from quillmark.llm.recompress import PrimeSums, Sums, anchors, mix, word_tokens

#: Bytes of texts named together, and anchors held in a task until equal ones become one row.
BYTES_HELD, ANCHORS_HELD = 320_000, 1_000_000
OCCURRENCES = "route long, span long, other long, doc long, first int, n int, times int"
WINDOWS = "route long, hash long, other long, doc long, first int, place int, alone boolean, times int"


def once_each(hashes: np.ndarray, others: np.ndarray, route: np.ndarray, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row goes, and how many it stands for, of rows whose equality is two hashes being the same.

    The first of equal rows goes along its route and stands for all of them; the others are repeats whatever comes, stand for
    none and go anywhere. A row that shares just the first hash with its first stands for itself.
    """
    _, example, of = np.unique(hashes, return_index=True, return_inverse=True)
    same = others == others[example[of]]
    times = np.bincount(of[same], minlength=len(example)).astype(np.int32)
    to, count = np.where(same, elsewhere, route), np.where(same, 0, 1).astype(np.int32)
    to[example], count[example] = route[example], times
    return to, count


def occurrences(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts' windows: name, two hashes of all words of the windows that share it, text, first window, their number."""
    tokens, others, sizes = word_tokens(texts)
    offsets, part = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(np.arange(len(tokens)) + width <= offsets[1:][part]) if len(tokens) else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    name, at = anchors(tokens, part, starts, width)
    new = np.r_[True, (at[1:] != at[:-1]) | (name[1:] != name[:-1]) | (starts[1:] != starts[:-1] + 1)]
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    shape = mix((at[begin] - first).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)) ^ mix(name[begin])
    span, other = (mix(sums(first, first + n - 1 + width) ^ shape).astype(np.int64) for sums in (Sums(tokens), PrimeSums(others)))
    return name[begin].astype(np.int64), span, other, part[first], first - offsets[part[first]], n


def found_anchors(docs: DataFrame, width: int) -> DataFrame:
    """A row for each anchor and span of a task, times it came, and one for each further place of it. The first go to their
    anchor's name; the others, which are repeats whatever comes, go anywhere: route is a hash of their place."""
    arrow = arrow_schema(docs.sparkSession, OCCURRENCES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows():
            anchor, span, other, doc, first, n = (np.concatenate(c) for c in zip(*held, strict=True))
            route, count = once_each(span, other, anchor, mix(doc.astype(np.uint64) + first.astype(np.uint64)).astype(np.int64))
            columns = (route, span, other, doc, first.astype(np.int32), n.astype(np.int32), count)
            for at in range(0, len(span), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for b in batches:
            keys, texts, size, first_key = b.column(0).to_numpy(), [], 0, 0
            every = b.column(1).cast(pa.binary()).to_pylist()
            for i, text in enumerate(every):
                texts.append(text)
                size += len(text)
                if size > BYTES_HELD or i == len(every) - 1:
                    anchor, span, other, part, first, n = occurrences(texts, width)
                    held.append((anchor, span, other, keys[part + first_key], first, n))
                    texts, size, first_key = [], 0, i + 1
            if sum(len(h[0]) for h in held) > ANCHORS_HELD:
                yield from rows()
                held.clear()
        if held:
            yield from rows()

    return docs.select("_doc", "text").mapInArrow(run, OCCURRENCES)


def listed(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Of an array of structs: the row that each element is in, and its fields."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, of = column.flatten(), pc.list_parent_indices(column).to_numpy()
    return of, *(flat.field(flat.type.get_field_index(f)).to_numpy(zero_copy_only=False) for f in fields)


def every(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... n times for each, and which it is of."""
    of = np.repeat(np.arange(len(first)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def open_windows(joined: DataFrame, width: int) -> DataFrame:
    """A hash for each window of the anchors that are still open (kind > 0), of rows (_doc, text, ranges)."""
    arrow = arrow_schema(joined.sparkSession, WINDOWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def rows():
            one, other, doc, first, place, alone = (np.concatenate(c) for c in zip(*held, strict=True))
            route, count = once_each(one, other, one, mix(doc.astype(np.uint64) + first.astype(np.uint64)).astype(np.int64))
            columns = (route, one, other, doc, first, place, alone, count)
            for at in range(0, len(one), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for b in batches:
            of, first, n, kind = listed(b.column(2), "first", "n", "kind")
            opened = kind > 0
            of, first, n, kind = of[opened], first[opened].astype(np.int64), n[opened].astype(np.int64), kind[opened]
            if not len(of):
                continue
            tokens, others, sizes = word_tokens(b.column(1).cast(pa.binary()).to_pylist())
            start, r = every((np.cumsum(sizes) - sizes)[of] + first, n)
            place = (start - (np.cumsum(sizes) - sizes)[of[r]] - first[r]).astype(np.int32)
            hashes = (sums(start, start + width).astype(np.int64) for sums in (Sums(tokens), PrimeSums(others)))
            held.append((*hashes, b.column(0).to_numpy()[of[r]], first[r].astype(np.int32), place, kind[r] == 1))
            if sum(len(h[0]) for h in held) > ANCHORS_HELD:
                yield from rows()
                held.clear()
        if held:
            yield from rows()

    return joined.mapInArrow(run, WINDOWS)


KEPT = "doc_id long, n_words long, n_removed long, kept string"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def removed(batch: pa.RecordBatch, sizes: np.ndarray, width: int) -> np.ndarray:
    """Which of a batch's words are covered by a removed window; columns 2 and 3 are ranges and singles."""
    offsets = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    of, first, n, kind = listed(batch.column(2), "first", "n", "kind")
    gone = kind != 1
    start = offsets[of[gone]] + first[gone]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n[gone] - 1 + width, -1)
    of, first, mask = listed(batch.column(3), "first", "mask")
    for k in range(width if len(mask) else 0):
        own = mask >> k & 1 == 1
        start = offsets[of[own]] + first[own] + k
        np.add.at(edge, start, 1)
        np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, *, width: int = 35, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs(doc_id, text); kept_sha256 in place of kept if asked.

    A word goes if it is covered by a window of `width` words whose sequence also starts anywhere else, in this document or
    another; windows are those of the input. kept joins what stays by one space. width is at most 63.

    Equal windows have the same anchor (see recompress), so all that share anything meet by it. An anchor's windows in a row
    are held together first: where the words of all of them are the same elsewhere, they go as one. What is left open, one
    example for each different span of a shared anchor, is settled window by window.
    Texts are named in the tasks; anchors, not windows, are shuffled, and texts once by document. Null texts have no words;
    repeated rows count as copies of each other, and come out each; other columns are ignored. Anchors only bring together what
    may be equal; equality of spans and windows is by two independent 64-bit hashes of their words, 128 bits together.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = written(docs.withColumn("_doc", F.monotonically_increasing_id()))
    seen = found_anchors(docs, width).repartition(parts, "route")
    same_anchor, same_span = Window.partitionBy("route"), Window.partitionBy("route", "span", "other")
    seen = seen.withColumn("_span", F.sum("times").over(same_span)).withColumn("_nth", F.row_number().over(same_span.orderBy("doc", "first")))
    seen = seen.withColumn("_all", F.sum("times").over(same_anchor))
    again = F.col("times") == 0
    settled, example = again | (F.col("_span") > 1), ~again & (F.col("_all") > F.col("_span")) & (F.col("_nth") == 1)
    kind = F.when(settled & example, 2).when(settled, 0).when(example, 1)  # 1: open, 2: gone, and an example for the open ones
    ranges = seen.select("doc", F.struct("first", "n", kind.cast("int").alias("kind")).alias("range")).where("range.kind is not null")
    ranges = written(ranges.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("range").alias("ranges")))
    by_doc = docs.repartition(parts, "_doc")
    joined = by_doc.join(ranges.where(F.exists("ranges", lambda r: r["kind"] > 0)), "_doc").select("_doc", "text", "ranges")
    windows = open_windows(joined, width)
    singles = written(repeated(windows, parts))
    whole = by_doc.join(ranges, "_doc", "left").join(singles, "_doc", "left").select("doc_id", "text", "ranges", "singles")
    schema = DIGEST if digest else KEPT
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text.split() for text in b.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(words) for words in texts], np.int64)
            gone = removed(b, sizes, width)
            n_gone = np.diff(np.r_[0, np.cumsum(gone)][np.r_[0, np.cumsum(sizes)]])
            out, at = [], 0
            for words, n in zip(texts, n_gone, strict=True):
                kept = words if not n else [] if n == len(words) else list(compress(words, (~gone[at : at + len(words)]).tolist()))
                at += len(words)
                joined = b" ".join(kept)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(n_gone), pa.array(out, pa.string())], schema=arrow)

    return whole.mapInArrow(run, schema)


def repeated(windows: DataFrame, parts: int) -> DataFrame:
    """(_doc, singles): of the open anchors, the windows whose words stand more than once."""
    same = Window.partitionBy("route", "hash", "other")
    twice = windows.repartition(parts, "route").withColumn("_n", F.sum("times").over(same)).where("alone and (times = 0 or _n > 1)")
    masks = twice.groupBy("doc", "first").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    return masks.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first", "mask")).alias("singles"))
