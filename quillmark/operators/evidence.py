"""Evidence: anchors in texts, how much of a text was read, and claims held against what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import texts
from quillmark.functions.hashing import canonical_json_utf8


def anchors_checked(anchors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """anchors(anchor_id, snapshot_id, start, quote) with status: ok, mismatch (other text there) or no_snapshot."""
    joined = anchors.join(snapshots.select("snapshot_id", "text"), "snapshot_id", "left")
    status = F.when(F.col("text").isNull(), "no_snapshot").when(texts.quoted_at(F.col("text"), F.col("start"), F.col("quote")), "ok").otherwise("mismatch")
    return joined.withColumn("status", status).drop("text")


def coverage(scope: Column, complete: Column, included: Column, missing: Column) -> Column:
    """abstract_only, selected_sections or full_text; `invalid` where a section is both included and missing, something complete
    misses one, or an abstract is more or less than that."""
    abstract = scope == "abstract"
    wrong = F.arrays_overlap(included, missing) | (abstract & (complete | (included != F.array(F.lit("abstract"))))) | (~abstract & complete & (F.size(missing) > 0))
    return F.when(wrong, "invalid").when(abstract, "abstract_only").when(complete, "full_text").otherwise("selected_sections")


def number_findings(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, text, source) with three checks of their numbers: the same ones as often, none more often than in the
    source, and none that the source hasn't."""
    left, right = texts.numbers(F.col("text")), texts.numbers(F.col("source"))
    rows = pairs.select("pair_id", left.alias("_left"), right.alias("_right"))
    return rows.select(
        "pair_id",
        F.size("_left").alias("n_numbers"),
        (F.array_sort("_left") == F.array_sort("_right")).alias("same_multiset"),
        texts.contained(F.col("_left"), F.col("_right")).alias("multiset_subset"),
        (F.size(F.array_except("_left", "_right")) == 0).alias("set_subset"),
    )


def cites_phrase(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """rows(decision, quotes) with error direct_evidence_missing where a direct decision's quotes have none of the phrases as words."""
    pattern = r"(?i)(^|[^A-Za-z0-9])(" + "|".join(phrases) + r")([^A-Za-z0-9]|$)"
    found = F.exists("quotes", lambda q: q.rlike(pattern))
    return rows.withColumn("error", F.when((F.col("decision") == "direct") & ~found, "direct_evidence_missing"))


#: Keys of a relevance answer, and its decisions.
RELEVANCE_KEYS = ["schema_version", "snapshot_id", "profile_id", "domain_id", "input_fingerprint", "profile_revision", "domain_revision", "decision", "recommendation_reason", "anchor_ids"]
DECISIONS = ["direct", "adjacent", "uncertain", "irrelevant"]


def parsed_relevance(candidates: DataFrame, anchors: DataFrame, phrases: dict[str, list[str]], model: str, most_anchors: int = 16, longest: int = 4096) -> DataFrame:
    """(run_id, decision, reason, anchor_ids, error) of candidates: run_id, model_name, finish_reason, content_json and what was asked:
    schema_version, snapshot_id, profile_id, domain_id, input_fingerprint, profile_revision, domain_revision.

    A refused answer has an error alone. phrases: words that a direct decision of a domain must cite from anchors(snapshot_id,
    anchor_id, quote).
    """
    asked = RELEVANCE_KEYS[:7]
    kinds = {"profile_revision": "int", "domain_revision": "int", "anchor_ids": "array<string>"}
    schema = ", ".join(f"`{k}` {kinds.get(k, 'string')}" for k in RELEVANCE_KEYS)
    rows = candidates.withColumn("_r", F.from_json("content_json", schema)).withColumn("_keys", F.array_sort(F.json_object_keys("content_json")))
    known = anchors.groupBy("snapshot_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor_id", "quote"))).alias("_known"))
    rows = rows.join(known, "snapshot_id", "left").withColumn("_known", F.coalesce("_known", F.create_map().cast("map<string,string>")))
    r = lambda k: F.col("_r")[k]
    ids, reason = r("anchor_ids"), F.regexp_replace(r("recommendation_reason"), r"^\s+|\s+$", "")
    other = F.lit(False)
    for k in asked:
        other = other | ~F.coalesce(r(k) == F.col(k), F.lit(False))
    fine = r("decision").isin(DECISIONS) & F.length(reason).between(1, longest) & ~r("recommendation_reason").contains("\0") & (F.size(ids) <= most_anchors)
    fine = fine & F.forall(ids, lambda a: F.map_contains_key("_known", a)) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (~r("decision").isin("direct", "adjacent") | (F.size(ids) > 0))
    gate = F.lit(False)
    for domain, words in phrases.items():
        pattern = r"(?i)(^|[^A-Za-z0-9])(" + "|".join(words) + r")([^A-Za-z0-9]|$)"
        cited = F.transform(ids, lambda a: F.element_at("_known", a))
        gate = gate | ((F.col("domain_id") == domain) & (r("decision") == "direct") & ~F.array_join(cited, "\n").rlike(pattern))
    error = (
        F.when(F.col("model_name") != model, "relevance_model_mismatch")
        .when(F.col("finish_reason") != "stop", "incomplete_relevance_response")
        .when(F.coalesce(F.col("_keys") != F.array_sort(F.array(*map(F.lit, RELEVANCE_KEYS))), F.lit(True)), "invalid_relevance_response")
        .when(other, "relevance_version_mismatch")
        .when(~F.coalesce(fine, F.lit(False)), "invalid_relevance_response")
        .when(gate, "direct_evidence_missing")
    )
    rows = rows.withColumn("error", error)
    kept = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("run_id", kept(r("decision")).alias("decision"), kept(r("recommendation_reason")).alias("reason"), kept(F.array_sort(ids)).alias("anchor_ids"), "error")


def in_order(anchors: DataFrame) -> DataFrame:
    """anchors(snapshot_id, offset_start, offset_end, anchor_id) with place, from 1 in each snapshot."""
    return anchors.withColumn("place", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("offset_start", "offset_end", "anchor_id")))


def claims_outside(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """claims(claim_id, snapshot_id, anchor_id) whose anchor isn't one of the same snapshot."""
    return claims.join(anchors.select("snapshot_id", "anchor_id"), ["snapshot_id", "anchor_id"], "left_anti")


def parsed_claims(candidates: DataFrame, anchors: DataFrame, kinds: list[str], most_anchors: int = 8) -> DataFrame:
    """A row for each claim of candidates(run_id, snapshot_id, input_fingerprint, content_json): claim_id, kind, anchor_ids, error.

    error: snapshot_mismatch, input_mismatch or invalid_response for a whole response; for a claim unknown_kind, anchor_count,
    anchor_repeated, anchor_unknown (not one of the snapshot's anchors(snapshot_id, anchor_id)) or repeated.
    """
    schema = "struct<snapshot_id:string,input_fingerprint:string,claims:array<struct<claim_type:string,anchor_ids:array<string>>>>"
    rows = candidates.withColumn("_r", F.from_json("content_json", schema))
    keys = lambda c, *names: F.coalesce(F.array_sort(F.json_object_keys(c)) == F.array_sort(F.array(*map(F.lit, names))), F.lit(False))
    each = F.from_json(F.get_json_object("content_json", "$.claims"), "array<string>")
    closed = keys(F.col("content_json"), "snapshot_id", "input_fingerprint", "claims") & F.forall(each, lambda c: keys(c, "claim_type", "anchor_ids"))
    whole = (
        F.when(F.col("_r.claims").isNull() | ~F.coalesce(closed, F.lit(False)), "invalid_response")
        .when(F.col("_r.snapshot_id") != F.col("snapshot_id"), "snapshot_mismatch")
        .when(F.col("_r.input_fingerprint") != F.col("input_fingerprint"), "input_mismatch")
    )
    rows = rows.withColumn("_whole", whole)
    known = anchors.groupBy("snapshot_id").agg(F.collect_set("anchor_id").alias("_known"))
    rows = rows.join(known, "snapshot_id", "left").select("run_id", "input_fingerprint", "_whole", "_known", F.posexplode_outer(F.when(F.col("_whole").isNull(), F.col("_r.claims"))).alias("place", "_c"))
    ids = F.array_sort("_c.anchor_ids")
    payload = F.to_json(F.struct(ids.alias("anchor_ids"), F.col("_c.claim_type").alias("claim_type"), "input_fingerprint"))
    rows = rows.withColumns({"claim_id": F.concat(F.lit("claim:"), F.sha2(payload, 256)), "kind": F.col("_c.claim_type"), "anchor_ids": ids})
    came = F.row_number().over(Window.partitionBy("run_id", "claim_id").orderBy("place"))
    error = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole"))
        .when(F.col("place").isNull(), None)
        .when(~F.col("kind").isin(kinds), "unknown_kind")
        .when((F.size("anchor_ids") < 1) | (F.size("anchor_ids") > most_anchors), "anchor_count")
        .when(F.size(F.array_distinct("anchor_ids")) < F.size("anchor_ids"), "anchor_repeated")
        .when(F.size(F.array_except("anchor_ids", F.coalesce("_known", F.array().cast("array<string>")))) > 0, "anchor_unknown")
        .when(came > 1, "repeated")
    )
    return rows.withColumn("error", error).where("place is not null or error is not null").select("run_id", "place", F.when(F.col("place").isNotNull(), F.col("claim_id")).alias("claim_id"), "kind", "anchor_ids", "error")


def findings(pairs: DataFrame, all_numbers: bool = False) -> DataFrame:
    """(pair_id, finding) of pairs(pair_id, text, source): number_mismatch and unit_mismatch, each once."""
    numbers, units = texts.numbers, lambda t: F.transform(texts.measured(t), lambda m: F.concat_ws(" ", m["number"], m["unit"]))
    same = F.array_sort(numbers(F.col("text"))) == F.array_sort(numbers(F.col("source"))) if all_numbers else texts.contained(numbers(F.col("text")), numbers(F.col("source")))
    found = F.array_compact(F.array(F.when(~same, F.lit("number_mismatch")), F.when(~texts.contained(units(F.col("text")), units(F.col("source"))), F.lit("unit_mismatch"))))
    return pairs.select("pair_id", F.explode(found).alias("finding"))


#: Words for the two roles of a compared value.
ROLES = {
    "baseline": r"baseline|基準|基线",
    "proposed": r"proposed(?: method)?|new method|our method|新方法|本方法|所提方法|提出的方法",
}
VALUE = r"([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def role_values(text: Column, role: str) -> Column:
    """The different numbers close behind, or just before, a word for the role."""
    words = ROLES[role]
    behind = F.regexp_extract_all(text, F.lit(f"(?i)(?:{words})[^0-9]{{0,24}}{VALUE}"), F.lit(1))
    ahead = F.regexp_extract_all(text, F.lit(f"(?i){VALUE}[^A-Za-z0-9]{{0,16}}(?:{words})"), F.lit(1))
    return F.array_sort(F.array_union(behind, ahead))


def role_mismatch(text: Column, source: Column) -> Column:
    """Whether a role has a number that it doesn't have in the source; never across scripts, where the order of words may change."""
    cjk = lambda t: t.rlike("[㐀-鿿]")
    other = F.lit(False)
    for role in ROLES:
        other = other | (F.size(F.array_except(role_values(text, role), role_values(source, role))) > 0)
    return (cjk(text) == cjk(source)) & other


def identified(snapshots: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots and anchors with ids that are hashes of their canonical JSON.

    snapshots(revision_id, work_id, object_id, text_object_id, parser_version, evidence_level); anchors besides
    (quote, offset_start, offset_end, section_label), joined to their snapshot by revision_id.
    """
    body = F.to_json(F.struct("evidence_level", F.lit(1).alias("format_version"), "object_id", "parser_version", "revision_id", "text_object_id", "work_id"))
    known = snapshots.withColumn("snapshot_id", F.concat(F.lit("snapshot:"), F.sha2(canonical_json_utf8(body), 256)))
    rows = anchors.join(known.select("revision_id", "snapshot_id"), "revision_id")
    place = F.to_json(F.struct("offset_end", "offset_start", "quote", "section_label", "snapshot_id"), {"ignoreNullFields": "false"})
    return known, rows.withColumn("anchor_id", F.concat(F.lit("anchor:"), F.sha2(canonical_json_utf8(place), 256)))


def card_report(cards: DataFrame, anchors: DataFrame, claims: DataFrame) -> DataFrame:
    """(card_id, error, verdict, findings) of cards: card_id, abstract, translation array<struct<text, anchor_ids>> and statements
    array<struct<text, claim_type, claim_ids>>, with anchors(card_id, anchor_id, quote) and claims(card_id, claim_id, claim_type, quotes).

    A finding is struct(code, kind, place, claim_ids); place is -1 for a whole card or translation. A card that cites nothing
    or what isn't there, or one claim as of two kinds, has an error and neither verdict nor findings.
    """
    quotes = anchors.groupBy("card_id", "anchor_id").agg(F.min("quote").alias("quote"))
    quotes = quotes.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor_id", "quote"))).alias("_quotes"))
    known = claims.groupBy("card_id", "claim_id").agg(F.min(F.struct("claim_type", F.array_join("quotes", "\n").alias("quote"))).alias("c"), F.count("*").alias("n"))
    known = known.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_id", "c"))).alias("_claims"), F.max("n").alias("_most"))
    rows = cards.join(quotes, "card_id", "left").join(known, "card_id", "left")
    rows = rows.withColumns({"_quotes": F.coalesce("_quotes", F.create_map().cast("map<string,string>")), "_claims": F.coalesce("_claims", F.create_map().cast("map<string,struct<claim_type:string,quote:string>>"))})
    units = lambda t: F.transform(texts.measured(t), lambda m: F.concat_ws(" ", m["number"], m["unit"]))
    nobody = F.array().cast("array<string>")

    def finding(code: str, kind: str, place: Column, ids: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"), place.cast("int").alias("place"), ids.alias("claim_ids"))

    def found(text: Column, source: Column, kind: str, place: Column, ids: Column) -> Column:
        tests = {
            "number_mismatch": ~texts.contained(texts.numbers(text), texts.numbers(source)),
            "unit_mismatch": ~texts.contained(units(text), units(source)),
            "role_value_mismatch": role_mismatch(text, source),
        }
        return F.array_compact(F.array(*(F.when(test, finding(code, kind, place, ids)) for code, test in tests.items())))

    def bad_passage(p: Column) -> Column:
        return F.when(F.coalesce(F.size(p["anchor_ids"]), F.lit(0)) < 1, "invalid_verification_input").when(~F.forall(p["anchor_ids"], lambda a: F.map_contains_key("_quotes", a)), "verification_anchor_mismatch")

    def bad_statement(s: Column) -> Column:
        fits = lambda c: F.map_contains_key("_claims", c) & F.coalesce(F.try_element_at("_claims", c)["claim_type"] == s["claim_type"], F.lit(False))
        return F.when(F.coalesce(F.size(s["claim_ids"]), F.lit(0)) < 1, "invalid_verification_input").when(~F.forall(s["claim_ids"], fits), "verification_claim_mismatch")

    broken = F.array_compact(F.concat(F.array(F.when(F.col("_most") > 1, F.lit("invalid_verification_input"))), F.transform("translation", bad_passage), F.transform("statements", bad_statement)))
    passage = lambda p, i: found(p["text"], F.array_join(F.transform(p["anchor_ids"], lambda a: F.try_element_at("_quotes", a)), "\n"), "translation", i, nobody)
    statement = lambda s, i: found(s["text"], F.array_join(F.transform(s["claim_ids"], lambda c: F.try_element_at("_claims", c)["quote"]), "\n"), "card", i, s["claim_ids"])
    whole = F.array_join(F.transform("translation", lambda p: p["text"]), "\n")
    of_card = F.array_compact(
        F.array(
            F.when(F.size("statements") == 0, finding("empty_reading_card", "card", F.lit(-1), nobody)),
            F.when(F.array_sort(texts.numbers(whole)) != F.array_sort(texts.numbers(F.col("abstract"))), finding("number_mismatch", "translation", F.lit(-1), nobody)),
        )
    )
    every = F.array_distinct(F.concat(of_card, F.flatten(F.transform("translation", passage)), F.flatten(F.transform("statements", statement))))
    rows = rows.withColumn("error", F.get(broken, F.lit(0))).withColumn("findings", F.when(F.col("error").isNull(), every))
    verdict = F.when(F.col("error").isNull(), F.when(F.size("findings") > 0, "rejected").otherwise("passed"))
    return rows.select("card_id", "error", verdict.alias("verdict"), "findings")


def explanation_outcome(rows: DataFrame) -> DataFrame:
    """rows with state and error_code: what an explanation comes to by its claims, relevance, summary and pointer.

    same_evidence and same_profile say whether claims and relevance are those asked for, same_revisions whether of the current
    revisions; execution and decision are the relevance's, qa_state the summary's, pointer_matches whether it became current.
    """
    c = F.col
    steps = [
        (~c("same_evidence"), "awaiting_external", "explanation_evidence_mismatch"),
        (~c("same_profile"), "awaiting_external", "explanation_relevance_mismatch"),
        (~c("same_revisions") | (c("execution") == "stale"), "cancelled", "scheduled_input_stale"),
        (c("execution") == "failed", "failed", "relevance_assessment_failed"),
        ((c("execution") != "succeeded") | ~c("decision").isin("direct", "adjacent", "uncertain", "irrelevant"), "awaiting_external", "relevance_assessment_corrupt"),
        (c("decision").isin("uncertain", "irrelevant"), "succeeded", None),
        (c("qa_state") == "pending", "awaiting_external", "summary_verification_pending"),
        (c("qa_state") == "rejected", "cancelled", "summary_verification_rejected"),
        (c("qa_state") != "passed", "awaiting_external", "summary_qa_state_corrupt"),
        (~c("pointer_matches"), "awaiting_external", "current_summary_mismatch"),
    ]
    state, code = F.lit("succeeded"), F.lit(None).cast("string")
    for test, name, error in reversed(steps):
        state, code = F.when(test, name).otherwise(state), F.when(test, F.lit(error)).otherwise(code)
    return rows.withColumn("state", state).withColumn("error_code", code)


def card_problems(cards: DataFrame) -> DataFrame:
    """(card_id, problem) of cards(card_id, translation, source, points array, quotes array): translation_numbers where a translation
    hasn't just the numbers of its source, as often; point_numbers where a point has a number that no quote has."""
    numbers = texts.numbers
    of_points = F.flatten(F.transform("points", lambda p: numbers(p)))
    of_quotes = F.flatten(F.transform("quotes", lambda q: numbers(q)))
    problems = F.array_compact(
        F.array(
            F.when(F.array_sort(numbers(F.col("translation"))) != F.array_sort(numbers(F.col("source"))), F.lit("translation_numbers")),
            F.when(F.size(F.array_except(of_points, of_quotes)) > 0, F.lit("point_numbers")),
        )
    )
    return cards.select("card_id", F.explode(problems).alias("problem"))


def support_verdicts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, verdict) of requests(request_id, claim_id) and responses(request_id, claim_id, support): invalid where the answered
    claims aren't those asked for, once each; else rejected, pending or passed by the worst support."""
    asked = requests.select("request_id", "claim_id").distinct().withColumn("_asked", F.lit(1))
    got = responses.groupBy("request_id", "claim_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("support") == "unsupported").alias("_bad"), F.bool_or(F.col("support") == "uncertain").alias("_open"), F.bool_or(~F.col("support").isin("supported", "unsupported", "uncertain")).alias("_odd"))
    both = asked.join(got, ["request_id", "claim_id"], "full_outer")
    wrong = F.bool_or(F.col("_asked").isNull() | F.col("_n").isNull() | (F.col("_n") > 1) | F.coalesce("_odd", F.lit(False)))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return both.groupBy("request_id").agg(F.when(wrong, "invalid").when(any_("_bad"), "rejected").when(any_("_open"), "pending").otherwise("passed").alias("verdict"))
