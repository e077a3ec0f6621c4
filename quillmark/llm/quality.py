"""Quality rules from DataFrame functions alone: counts of a text, and its distance from what is usual in its language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import checkpointed, word_array

#: Frequent words of some languages.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with", "be", "as", "by", "this", "are", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "sur", "au", "il"],
}
#: Characters: ASCII capitals, ASCII digits, other ASCII signs, beyond ASCII; then white space, and the rest: ASCII small letters and controls.
CLASSES = {"capitals": "[A-Z]+", "digits": "[0-9]+", "signs": r"[!-/:-@\[-`{-~]+", "beyond": r"[^\x00-\x7F]+"}
WINDOW = 8
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more. Sorting the windows' hashes finds equal ones."""

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p).cast("long")))

    def places(rows: Column) -> Column:
        key = lambda j: F.get(rows, j)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda j: (key(j) == F.coalesce(key(j + 1), key(j) + 1)) | ((j > 0) & (key(j) == F.coalesce(key(F.greatest(j - 1, F.lit(0))), key(j)))))
        return F.sort_array(F.transform(again, lambda j: F.get(rows, j)["i"]))

    def found(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = let(let(rows, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeats).otherwise(F.lit(0).cast("long"))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(each) - WINDOW + 1), lambda i: F.xxhash64(F.slice(each, i, WINDOW)))

    long_enough = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), found)
    return F.when(F.size(words) > WINDOW, long_enough).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text; class_counts and word_counts are the two histograms."""
    text = F.coalesce("text", F.lit(""))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    split = docs.select("doc_id", "lang", text.alias("text"), F.explode(F.array(word_array(text))).alias("words"))  # explode, so that the words are made once
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.filter("words", lambda w: w.isin(listed))
    own_list = F.array().cast("array<string>")
    for lang, own in COMMON_WORDS.items():
        own_list = F.when(F.col("lang") == lang, F.array(*map(F.lit, own))).otherwise(own_list)
    word_counts = let(common, lambda c: F.transform(own_list, lambda w: (F.size(c) - F.size(F.array_remove(c, w))).cast("long")))
    chars = F.char_length("text").cast("long")
    own = {k: chars - F.char_length(F.regexp_replace("text", p, "")) for k, p in CLASSES.items()}
    out = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        chars.alias("chars"),
        F.array(*own.values()).alias("class_counts"),
        word_counts.alias("word_counts"),
    )
    classes = F.concat("class_counts", F.array(F.col("chars") - F.col("word_chars"), F.col("word_chars") - total(F.col("class_counts"))))
    return out.select("doc_id", "lang", *NAMES, classes.alias("class_counts"), F.concat("word_counts", F.array(F.greatest(F.col("n_words") - total(F.col("word_counts")), F.lit(0)))).alias("word_counts"))


def shares(counts: Column) -> Column:
    return let(total(counts), lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance: 0 for equal histograms, 1 for ones without a common entry."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def assess(docs: DataFrame, *, most_class: float = 0.25, most_class_short: float = 0.3, most_word: float = 0.3, least_class_words: int = 50, full_class_words: int = 100, least_word_words: int = 150) -> DataFrame:
    """doc_id, the counts, base_failed and kept, for every row of docs(doc_id, text, lang).

    Fails the base: fewer than 20 words, or over 30 % of the words inside repeated windows. What passes is kept unless its
    character classes are further than most_class (under full_class_words words, most_class_short), or its frequent words further than most_word, from those of all documents
    of its language that pass the base, taken together; documents under least_class_words or least_word_words words are not held against
    that histogram, for few words say little. A null lang is a language of its own; one without a word list has only the
    character classes. Null and empty texts have no words and fail. Repeated rows come out each; other columns are ignored.
    """
    each = checkpointed(measures(docs))
    lengths = {c: max([0, *(len(v) for v in COMMON_WORDS.values())]) + 1 if c == "word_counts" else len(CLASSES) + 2 for c in ("class_counts", "word_counts")}
    sums = [F.sum(F.coalesce(F.get(c, F.lit(k)), F.lit(0))).alias(f"{c}_{k}") for c, n in lengths.items() for k in range(n)]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    usual = each.where(~failed).groupBy("lang").agg(*sums).select(F.col("lang").alias("_lang"), *(F.array(*(F.col(f"{c}_{k}") for k in range(n))).alias(f"usual_{c}") for c, n in lengths.items()))
    held = each.join(usual, each.lang.eqNullSafe(usual._lang), "left")
    padded = F.transform(F.sequence(F.lit(0), F.lit(lengths["word_counts"] - 1)), lambda k: F.coalesce(F.get("word_counts", k), F.lit(0).cast("long")))
    held = held.withColumn("class_distance", js_distance(shares(F.col("class_counts")), shares(F.col("usual_class_counts"))))
    held = held.withColumn("word_distance", js_distance(shares(padded), shares(F.col("usual_word_counts"))))
    far_class = F.col("class_distance") > F.when(F.col("n_words") >= full_class_words, most_class).otherwise(most_class_short)
    far = ((F.col("n_words") >= least_class_words) & far_class) | ((F.col("n_words") >= least_word_words) & (F.col("word_distance") > most_word))
    return held.select("doc_id", *NAMES, failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance")
