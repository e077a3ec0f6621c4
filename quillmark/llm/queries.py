"""One thin query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import chat, codebooks, decontaminate, language, mixture, pii, quality, scoring, simhash, spelling, substrings, tokens, warc
from quillmark.llm.common import read, remainder
from quillmark.sources.folders import shared_folder


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat.END + chat.START + "assistant ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(turns.union(own)))


OP1_CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=64, blocks=4, same=2, distance=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixture.plan(read(spark, sf_dir, "documents"), mixture.curriculum(F.col("weight")))
    first = planned.withColumn("position", F.try_element_at("copies", F.lit(1))["position"])
    return mixture.by_position(first).select("doc_id", "size", "source_size", "target", "taken", "position")


OP6_MIXTURE = r"""
WITH own AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    coalesce(md5(CAST(doc_id AS VARCHAR)), 'g') AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM own GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, source ASC NULLS LAST) AS n FROM sources
), sums AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others
  FROM ordered
), capped AS (
  SELECT *, max(CASE WHEN 3 * source_size * others > weight * words_left THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) = 0 AS is_capped FROM sums
), rate AS (
  SELECT max(words_left)::DOUBLE / max(others)::DOUBLE AS rate FROM capped WHERE NOT is_capped
), goals AS (
  SELECT source, source_size, weight, CASE WHEN is_capped THEN (3 * source_size)::DOUBLE ELSE weight * rate END AS target FROM capped LEFT JOIN rate ON true
), placed AS (
  SELECT doc_id, size, source_size, target, round(target)::HUGEINT AS goal, weight + (2 - weight) * 0.5::DOUBLE AS w, (2 - weight) * -1.0::DOUBLE AS slope, weight::DOUBLE AS area,
    coalesce(sum(size) OVER (PARTITION BY own.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM own JOIN goals ON own.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, taken, CASE WHEN taken > 0 THEN least(1.0::DOUBLE, 2 * due / (w + sqrt(greatest(w * w + 2 * slope * due, 0)))) END AS position
FROM (
  SELECT *, (start::DOUBLE / greatest(goal, 1)::DOUBLE) * area AS due,
    (CASE WHEN source_size > 0 THEN (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) ELSE 0 END)::BIGINT AS taken
  FROM placed
)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


OP9_QUALITY = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CASE LISTS ELSE [] END AS listed
  FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)
), spots AS (
  SELECT r, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS win FROM w WHERE len(words) > 7
), again AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS n FROM spots) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, gap)) AS n_repeat_words FROM (SELECT r, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8) AS gap FROM again) GROUP BY r
), base AS MATERIALIZED (
  SELECT w.r, doc_id, lang, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), length(text) - length(regexp_replace(text, '[0-9]', '', 'g')),
     length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')), length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))] AS found,
    length(text) AS chars, list_transform(listed, lambda v: len(list_filter(words, lambda x: x = v))) AS seen
  FROM w LEFT JOIN covered USING (r)
), entries AS (
  SELECT r, lang, 'class' AS kind, unnest(range(6)) AS k, unnest(list_concat(found, [chars - word_chars, word_chars - list_sum(found)])) AS n FROM base
  UNION ALL SELECT r, lang, 'word', unnest(range(len(seen) + 1)), unnest(list_append(seen, greatest(n_words - coalesce(list_sum(seen), 0), 0))) FROM base
), usual AS (
  SELECT lang, kind, k, sum(n) AS u FROM entries WHERE r IN (SELECT r FROM base WHERE n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words) GROUP BY ALL
), share AS (
  SELECT r, e.kind, coalesce(n / nullif(sum(n) OVER (PARTITION BY r, e.kind), 0), 0) AS p, coalesce(u / nullif(sum(u) OVER (PARTITION BY r, e.kind), 0), 0) AS q
  FROM entries e LEFT JOIN usual ON e.lang IS NOT DISTINCT FROM usual.lang AND e.kind = usual.kind AND e.k = usual.k
), far AS (
  SELECT r, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 0)) AS d FROM share GROUP BY ALL
), judged AS (
  SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (n_words >= 50 AND c.d > CASE WHEN n_words >= 100 THEN 0.25 ELSE 0.3 END) OR (n_words >= 150 AND v.d > 0.3) AS is_far
  FROM base JOIN far c ON c.r = base.r AND c.kind = 'class' JOIN far v ON v.r = base.r AND v.kind = 'word'
)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT is_far AS kept FROM judged
""".replace("LISTS", " ".join(f"WHEN lang = '{lang}' THEN {words}" for lang, words in quality.COMMON_WORDS.items()))


#: The key of the surrogates here and in the pipeline. A secret one belongs in its place where originals must stay unknown.
PII_KEY = b"surrogates of the corpus"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.checked(docs, PII_KEY).select("doc_id", "text", F.size("entities").cast("long").alias("n_replaced"), "entities")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(True)))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(read(spark, sf_dir, "documents"), width=35, digest=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(read(spark, sf_dir, "embeddings"), carry=("label",))
    rows = codebooks.with_group_error(found.rows, "label")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("group_error").alias("label_error"), F.lit(found.sha256()).alias("codebooks_sha256"))


def _rounds_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds over all pairs, a few common table expressions for each."""
    ctes = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)
), first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {entries}),
b0 AS MATERIALIZED (SELECT p, e, x AS c, list_inner_product(x, x) AS cc FROM part JOIN first USING (r))"""]  # fmt: skip
    for n in range(rounds + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, p, min([list_inner_product(x, x) - 2 * list_inner_product(x, c) + cc, e::DOUBLE]) AS best FROM part JOIN b{n} USING (p) GROUP BY r, p)")
        if n < rounds:
            ctes.append(f"""m{n} AS (SELECT p, e, list(floor(s / k) ORDER BY i) AS c FROM (
  SELECT p, best[2] AS e, i, sum(x[i]) AS s, count(*)::DOUBLE AS k FROM part JOIN a{n} USING (r, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL) GROUP BY p, e
), b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c, list_inner_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) AS cc FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)""")
    return f"""WITH {", ".join(ctes)}, codes AS (
  SELECT r, string_agg(printf('%02x', best[2]::BIGINT), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (r)"""


OP13_VECTOR_CODES = _rounds_sql()


def misspelt(doc_id: Column, run: Column) -> Column:
    """A run without one of its code points, in one of 97 runs by the checksum of both."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(read(spark, sf_dir, "documents"), alter=misspelt))


#: Remainders of the checksum for each value of a byte: eight steps of its polynomial.
_CRC = "[" + ", ".join(str(functools.reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(8), n)) for n in range(256)) + "]"
OP11_SPELLING = rf"""
WITH RECURSIVE run AS (
  SELECT d, lo AS run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS lo FROM documents
  ) GROUP BY ALL
), summed AS (
  SELECT run, k, length(run) AS size, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(d || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, ({_CRC}::BIGINT[])[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h
  FROM run
), word AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n, length(word) AS size FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % size)::INTEGER) || substr(run, (h % size)::INTEGER + 2) ELSE run END AS word FROM summed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS part, i FROM word, unnest(range(1, size + 1)) u(i)
), pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word.word, less.word, less.n FROM word JOIN less ON word.word = part
  UNION ALL SELECT less.word, word.word, word.n FROM word JOIN less ON word.word = part
), near AS (SELECT DISTINCT * FROM pair
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other COLLATE C) AS other, max(m) AS m FROM near GROUP BY word
), form AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL
), ends AS (
  SELECT walk.word, root FROM walk JOIN form ON root = form.word WHERE form.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN ends USING (word)
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write(warc.records_of(read(spark, sf_dir, "pages")), folder)
    page = lambda c: F.regexp_extract(c, "^urn:page:(.*):[0-9a-f]{32}$", 1).try_cast("long")
    found = warc.read(spark, folder, payload="false").where("record_type in ('response', 'revisit')")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP12_WARC = """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) = 1 AS is_first, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
  FROM pages
)
SELECT page_id, payload_bytes, CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT is_first THEN best END AS refers_to,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS payload_digest
FROM own
"""
