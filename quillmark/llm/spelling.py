"""Spelling variants: words of a corpus one edit apart, the more frequent of which is the form of the other.

Words that are one inserted, deleted or replaced code point apart share a positional bigram among the three rarest of each: an edit touches
two bigrams of a word at most. Rarity is global, so that words meet where few do. The edit lies on one side of a shared bigram; on the other side both words
are the same, up to their ends. That is the limit on positions: a row joins by the bigram with all that stands before it, or with all that stands behind it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import in_batches, written
from quillmark.operators.aliases import closure

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit touches this many bigrams, and one more must be shared. Buckets of bigrams whose frequencies the driver and all tasks know.
TOUCHED, BUCKETS = 2, 1 << 16
#: Words that share a key up to which they are compared with each other; beyond, they meet by what is left without one code point as well.
TOGETHER = 200
ROWS = "word string, n long, size int, key long, inner string"


def words(docs: DataFrame, *, alter: Callable[[Column, Column], Column] | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): maximal runs of Latin letters of docs(doc_id, text), A-Z in lower case, of at least `shortest` code points and `least` occurrences.

    alter(doc_id as text, run) gives what is counted in place of a run. Null texts have no words, a null doc_id is empty text.
    Words are counted in the tasks before they are shuffled.
    """
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    word = alter(F.col("d"), F.col("run")) if alter else F.col("run")
    return each.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequencies(counted: DataFrame) -> dict[int, int]:
    """How often bigrams occur in the words, by bucket: a table of bounded size for an alphabet of any."""
    grams = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    bucket = (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int")
    return {r.bucket: r["count"] for r in grams.groupBy(bucket.alias("bucket")).count().collect()}


def rarest(word: str, frequency: dict[int, int]) -> list[int]:
    """Places of the rarest bigrams, by frequency, then by the bigram itself, then by place: one order for all words."""
    order = []
    for at in range(len(word) - 1):
        gram = word[at : at + 2]
        order.append((frequency.get(zlib.crc32(gram.encode()) % BUCKETS, 0), gram, at))
    return [at for _, _, at in sorted(order)[: TOUCHED + 1]]


def keys(counted: DataFrame, frequency: dict[int, int]) -> DataFrame:
    """ROWS: for each of a word's rarest bigrams the key of the bigram with what stands before it, and behind it; `inner` is the rest."""

    def make():
        def f(cols):
            out = {k: [] for k in ("word", "n", "size", "key", "inner")}
            for raw, n in zip(cols["word"], cols["n"], strict=True):
                word = raw.decode()
                for at in rarest(word, frequency):
                    for mark, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
                        key = xxhash.xxh64_intdigest(mark + same)
                        for name, value in zip(out, (word, n, len(word), key - (1 << 64) if key >> 63 else key, rest), strict=True):
                            out[name].append(value)
            return out

        return f

    return in_batches(counted.select("word", "n"), make, ROWS)


def near_pairs(counted: DataFrame, *, together: int = TOGETHER) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of counted(word, n) that are exactly one edit apart, once. Words have two code points at least.

    A key that more than `together` words of one length share is split: its words join by what is left of them, whole or without one code
    point, which at most a few thousand words of any alphabet of hundreds share. The pairs are the same for any `together`.
    """
    rows = written(keys(counted, frequencies(counted)))
    crowded = written(rows.groupBy("key", "size").count().where(F.col("count") > together).select("key", "size"))
    # a is the shorter; where both are as long, the smaller
    longer = lambda df: df.withColumn("fits", F.explode(F.array("size", F.col("size") - 1)))
    few = rows.join(crowded, ["key", "size"], "left_anti")
    many = rows.join(crowded, ["key", "size"], "left_semi")
    beside = longer(rows).join(crowded.withColumnRenamed("size", "fits"), ["key", "fits"], "left_anti")
    behind = longer(rows).join(crowded.withColumnRenamed("size", "fits"), ["key", "fits"], "left_semi")
    cut = F.transform(F.sequence(F.lit(1), F.char_length("inner")), lambda i: F.concat(F.substring("inner", F.lit(1), i - 1), F.substring("inner", i + 1, F.char_length("inner"))))
    left = F.explode(F.array_distinct(F.concat(F.array("inner"), F.when(F.char_length("inner") > 0, cut).otherwise(F.array()))))
    one = (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1) & ((F.col("a.size") < F.col("b.size")) | (F.col("a.word") < F.col("b.word")))
    met = lambda x, y, on: x.alias("a").join(y.alias("b"), on & (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.fits")) & one).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    slim = lambda df: df.select("word", "n", "size", "key", *(c for c in ("fits", "left") if c in df.columns))
    pairs = met(slim(few), slim(beside), F.lit(True))
    split = met(slim(many.withColumn("left", left)), slim(behind.withColumn("left", left)), F.col("a.left") == F.col("b.left"))
    return pairs.union(split).distinct()


def variants(counted: DataFrame, *, ratio: int = 2, together: int = TOGETHER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of counted(word, n), words distinct.

    n_near words are one edit away; form is the most frequent of them (the smallest by code points of equal ones) if it occurs at least `ratio` (over 1) times as
    often, else null; root is where the forms lead, the word itself if it has none. No words, no rows.
    """
    counted = written(counted.select("word", "n"))
    pairs = written(near_pairs(counted, together=together))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), "other")).alias("best"))
    known = counted.join(near, "word", "left")
    form_n = -F.col("best.col1")
    found = known.withColumns({"form_n": F.when(form_n >= ratio * F.col("n"), form_n), "form": F.when(form_n >= ratio * F.col("n"), F.col("best.other"))})
    found = written(found.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
    ends = closure(found.where("form is not null").select(F.col("word").alias("alias_id"), F.col("form").alias("canonical_id")), 64)  # n doubles at each step
    roots = ends.select(F.col("alias_id").alias("word"), F.col("canonical_id").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
