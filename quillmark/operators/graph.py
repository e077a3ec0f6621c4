"""Relations and integrity updates out of items' JSON: entries, what can't be read, and the events they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import identifiers, texts, values
from quillmark.functions.hashing import framed_sha256

#: Relations within a work, and between works.
INTRA_WORK = [
    "is-expression-of", "has-expression", "is-format-of", "has-format", "is-identical-to", "is-manifestation-of", "has-manifestation",
    "is-manuscript-of", "has-manuscript", "is-preprint-of", "has-preprint", "is-replaced-by", "replaces", "is-translation-of",
    "has-translation", "is-variant-form-of", "is-original-form-of", "is-version-of", "has-version",
]
INTER_WORK = [
    "is-based-on", "is-basis-for", "is-comment-on", "has-comment", "is-continued-by", "continues", "is-derived-from", "has-derivation",
    "is-documented-by", "documents", "finances", "is-financed-by", "is-part-of", "has-part", "is-review-of", "has-review", "references",
    "is-referenced-by", "is-related-material", "has-related-material", "is-reply-to", "has-reply", "requires", "is-required-by",
    "is-compiled-by", "compiles", "is-supplement-to", "is-supplemented-by",
]


def relation_class(predicate: Column) -> Column:
    small = F.lower(predicate)
    return F.when(small.isin(INTRA_WORK), "intra_work").when(small.isin(INTER_WORK), "inter_work").otherwise("unknown")


def relation_entries(items: DataFrame) -> DataFrame:
    """(item_id, predicate, place, ordinal, id_type, target, asserted_by, class, gap) of items(item_id, json).

    A row for each entry, by predicate and place. gap says why it can't be used (and the ordinal, which counts usable
    entries, is null then): not_object for the relations as a whole, predicate_invalid, entries_not_list, entry_not_object, target_missing or asserted_by_invalid.
    """
    relation = values.member(F.try_parse_json("json"), "relation")
    rows = items.select("item_id", relation.alias("_all")).where(values.there(F.col("_all")))
    rows = rows.select("item_id", F.explode_outer(values.members(F.col("_all"))).alias("predicate", "_list"), (values.kind(F.col("_all")) == "object").alias("_object")).where("not (_object and predicate is null)")
    named = texts.valid_text(F.col("predicate"), 256)
    rows = rows.select("item_id", "predicate", "_object", named.alias("_named"), values.kind(F.col("_list")).alias("_kind"), F.posexplode_outer(F.when(named, values.elements(F.col("_list")))).alias("place", "_e"))
    rows = rows.where("not (_named and _kind = 'array' and place is null)")
    usable = lambda k, n: values.plain(values.member(F.col("_e"), k), n)
    gap = (
        F.when(~F.col("_object"), "not_object")
        .when(~F.col("_named"), "predicate_invalid")
        .when(F.col("_kind") != "array", "entries_not_list")
        .when(values.kind(F.col("_e")) != "object", "entry_not_object")
        .when(usable("id-type", 128).isNull() | usable("id", 4096).isNull(), "target_missing")
        .when(values.there(values.member(F.col("_e"), "asserted-by")) & usable("asserted-by", 128).isNull(), "asserted_by_invalid")
    )
    out = rows.withColumn("gap", gap)
    order = Window.partitionBy("item_id", F.col("gap").isNull()).orderBy("predicate", F.asc_nulls_first("place"))
    return out.select(
        "item_id",
        "predicate",
        "place",
        F.when(F.col("gap").isNull(), F.row_number().over(order) - 1).alias("ordinal"),
        usable("id-type", 128).alias("id_type"),
        usable("id", 4096).alias("target"),
        usable("asserted-by", 128).alias("asserted_by"),
        relation_class(F.col("predicate")).alias("class"),
        "gap",
    )


def _updates(items: DataFrame) -> DataFrame:
    """(item_id, direction, path, ordinal, _raw): entries of both directions' lists, and what is no list with null ordinal."""

    def one(key: str) -> DataFrame:
        rows = items.select("item_id", values.member(F.try_parse_json("json"), key).alias("_all")).where(values.there(F.col("_all")))
        rows = rows.select("item_id", values.kind(F.col("_all")).alias("_kind"), F.posexplode_outer(values.elements(F.col("_all"))).alias("ordinal", "_raw")).where("not (_kind = 'array' and ordinal is null)")
        path = F.when(F.col("ordinal").isNull(), key).otherwise(F.format_string(f"{key}[%d]", "ordinal"))
        return rows.select("item_id", F.lit(key.replace("-", "_")).alias("direction"), path.alias("path"), "ordinal", "_raw")

    rows = one("update-to").union(one("updated-by"))
    fields = {"doi": ("DOI", 2048), "type": ("type", 256), "source": ("source", 256), "label": ("label", 1024)}
    rows = rows.withColumn("_object", F.coalesce(values.kind(F.col("_raw")) == "object", F.lit(False)))
    for name, (key, longest) in fields.items():
        value = values.member(F.col("_raw"), key)
        rows = rows.withColumns({f"_{name}": values.plain(value, longest), f"_{name}_wrong": values.there(value) & values.plain(value, longest).isNull()})
    updated = values.member(F.col("_raw"), "updated")
    return rows.withColumns({"_updated": values.there(updated), "_date": texts.provider_date(F.when(values.kind(updated) == "object", F.to_json(updated)))})


def integrity_entries(items: DataFrame) -> DataFrame:
    """(item_id, direction, ordinal, counterparty, kind, updated, precision) of items(item_id, json): both directions' updates.

    What can't be read is null here and a row of integrity_gaps; an entry that is no object is only there.
    """
    rows = _updates(items).where("_object")
    kind = F.coalesce(texts.integrity_kind(F.col("_type")), F.lit("other_update"))
    return rows.select("item_id", "direction", "ordinal", F.col("_doi").alias("counterparty"), kind.alias("kind"), F.col("_date.value").alias("updated"), F.col("_date.precision").alias("precision"))


def integrity_gaps(items: DataFrame) -> DataFrame:
    """(item_id, path, code) of what in the updates can't be read."""
    rows = _updates(items)
    gap = lambda when, path, code: F.when(when, F.struct(F.concat("path", F.lit(path)).alias("path"), F.lit(code).alias("code")))
    wrong = lambda c: F.col("_object") & F.col(f"_{c}_wrong")
    gaps = F.array_compact(F.array(
        gap(F.col("ordinal").isNull(), "", "integrity_updates_not_list"),
        gap(F.col("ordinal").isNotNull() & ~F.col("_object"), "", "integrity_update_not_object"),
        gap(wrong("doi"), ".DOI", "integrity_counterparty_doi_invalid_text"),
        *(gap(wrong(c), f".{c}", "integrity_field_invalid") for c in ("type", "source", "label")),
        gap(F.col("_object") & F.col("_updated") & F.col("_date.value").isNull(), ".updated", "integrity_updated_invalid"),
    ))
    return rows.select("item_id", F.explode(gaps).alias("g")).select("item_id", "g.path", "g.code")


def targets(entries: DataFrame, id_type: str = "id_type", target: str = "target") -> DataFrame:
    """entries with target_state: normalized, raw (of no known kind) or invalid; and target_value."""
    known = F.coalesce(F.lower(F.col(id_type)).isin("doi", "arxiv", "pmid", "pmc"), F.lit(False))
    norm = identifiers.normalized(F.lower(F.col(id_type)), F.col(target))
    state = F.when(~known, "raw").when(norm["value"].isNotNull(), "normalized").otherwise("invalid")
    return entries.withColumn("target_state", state).withColumn("target_value", F.coalesce(norm["value"], F.when(~known, F.col(target))))


def promoted(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """(item_id, ordinal, work_id, event_kind, occurred, state): corrections and retractions, promoted where their counterparty is bound
    to a work and unresolved elsewhere. They are dated only if to the second."""
    joined = entries.where(F.col("kind").isin("correction", "retraction")).join(bindings, F.col("counterparty") == F.col("doi"), "left")
    state = F.when(F.col("work_id").isNull(), "unresolved").otherwise("promoted")
    return joined.select("item_id", "ordinal", "work_id", F.col("kind").alias("event_kind"), F.when(F.col("precision") == "second", F.col("updated")).alias("occurred"), state.alias("state"))


def recorded_relations(requests: DataFrame, works: DataFrame) -> DataFrame:
    """(request_id, relation_id, outcome) of requests(request_id, source, target, type, evidence, at) between works(work_id).

    Of sound requests for the same relation the first, by time and id, is recorded; one with its evidence is a replay of it, any
    other a work_relation_conflict. invalid_work_relation: of a work to itself or of no lower-case type; work_missing: either is.
    """
    known = works.select(F.col("work_id").alias("source"), F.lit(True).alias("_s")).distinct()
    rows = requests.join(known, "source", "left").join(known.select(F.col("source").alias("target"), F.col("_s").alias("_t")), "target", "left")
    unsound = F.when((F.col("source") == F.col("target")) | ~F.coalesce(F.col("type").rlike("^[a-z][a-z0-9_-]{0,63}$"), F.lit(False)), "invalid_work_relation").when(F.col("_s").isNull() | F.col("_t").isNull(), "work_missing")
    rows = rows.withColumn("_bad", unsound)
    key = ["source", "target", "type"]
    first = rows.where("_bad is null").groupBy(*key).agg(F.min(F.struct("at", "request_id", "evidence")).alias("_first"))
    rows = rows.join(first, key, "left")
    made = F.when(F.col("request_id") == F.col("_first.request_id"), "recorded").when(F.col("evidence") == F.col("_first.evidence"), "replay").otherwise("work_relation_conflict")
    relation_id = F.concat(F.lit("relation:"), framed_sha256(F.lit("work-relation-v1"), *map(F.col, key)))
    return rows.select("request_id", F.when(F.col("_bad").isNull(), relation_id).alias("relation_id"), F.coalesce("_bad", made).alias("outcome"))


def distinct_assertions(entries: DataFrame, content: list[str], revision: str, observed: str) -> tuple[DataFrame, DataFrame]:
    """Assertions by their content with when they were first observed, and each revision's observations of them."""
    key = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content))), 256)
    rows = entries.withColumn("assertion_id", key)
    return rows.groupBy("assertion_id", *content).agg(F.min(observed).alias("first_observed")), rows.select("assertion_id", revision, observed).distinct()
