"""Captured responses: claims on them, their bodies, and what a reservation for a call sets aside."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillmark.functions import values
from quillmark.sources.folders import written

OPEN = ("reserved", "dispatching")


def claim_violations(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(claim_id, reason) of claims(claim_id, page_id, pass_id, token, state, reserved_us, dispatched_us, ended_us, lease_us) that
    break the rules, with resolutions(claim_id, action, not_before_us).

    state: the times don't fit it. token: not one more than the page's last. early: before a retry is allowed. unresolved: the
    last claim is neither given back unsent nor, once sent, resolved to be made again in the same pass. open_twice: another is open.
    """
    sent = F.col("dispatched_us").isNotNull()
    fits = (
        F.when(F.col("state") == "reserved", ~sent & F.col("ended_us").isNull())
        .when(F.col("state") == "dispatching", (F.col("dispatched_us") >= F.col("reserved_us")) & (F.col("dispatched_us") < F.col("lease_us")) & F.col("ended_us").isNull())
        .when(F.col("state").isin("released", "expired"), ~sent & (F.col("ended_us") >= F.col("reserved_us")))
        .otherwise(False)
    )
    rows = claims.join(resolutions.where("action = 'retry'").select("claim_id", "not_before_us"), "claim_id", "left")
    w = Window.partitionBy("page_id").orderBy("token", "claim_id")
    before = lambda c: F.lag(c).over(w)
    again = (before("state") == "dispatching") & before("not_before_us").isNotNull()
    n_open = F.count_if(F.col("state").isin(*OPEN) & F.col("not_before_us").isNull()).over(Window.partitionBy("page_id"))
    second = F.row_number().over(w) > 1
    reason = (
        F.when(~F.coalesce(fits, F.lit(False)), "state")
        .when(second & (F.col("token") != before("token") + 1), "token")
        .when(second & again & (F.col("reserved_us") < before("not_before_us")), "early")
        .when(second & ~before("state").isin("released", "expired") & ~F.coalesce(again & (before("pass_id") == F.col("pass_id")), F.lit(False)), "unresolved")
        .when((n_open > 1) & F.col("state").isin(*OPEN) & F.col("not_before_us").isNull(), "open_twice")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("claim_id", "reason")


def entity(encoding: str, most_bytes: int):
    """A column function: the body behind a content coding (identity, gzip or deflate); null if it is broken, goes on behind its end,
    or would grow beyond most_bytes."""

    def decoded(body: bytes | None) -> bytes | None:
        if body is None or encoding == "identity":
            return body if body is None or len(body) <= most_bytes else None
        inflate = zlib.decompressobj(31 if encoding == "gzip" else 15)
        try:
            out = inflate.decompress(bytes(body), most_bytes + 1)
        except zlib.error:
            return None
        return out if inflate.eof and not inflate.unused_data and len(out) <= most_bytes else None

    @F.pandas_udf(BinaryType())
    def decode(bodies: pd.Series) -> pd.Series:
        return pd.Series([decoded(b) for b in bodies], dtype=object)

    return decode


def reservation(request_bytes: Column, prompt_price: Column, output_tokens: Column, completion_price: Column, domains: Column) -> Column:
    """Millionths of a dollar to set aside: all bytes as prompt tokens and all output at prices for a million tokens, upwards; for two
    calls and one for each domain."""
    price = lambda n, p: n.cast("decimal(18,0)") * p.cast("decimal(18,6)")
    return F.ceil(price(request_bytes, prompt_price) + price(output_tokens, completion_price)).cast("long") * (2 + domains)


def dispatch_claim(outbox: Column, digest: Column, changed: Column, enabled: Column, current: Column, effects: Column, same_epoch: Column) -> Column:
    """What a claim to send a delivery comes to."""
    return (
        F.when(outbox.isin("provider_accepted", "unknown", "cancelled", "sending", "failed"), outbox)
        .when((outbox != "pending") | (digest != "queued"), "corrupt")
        .when(changed, "snapshot_changed")
        .when(~enabled | ~current, "cancelled")
        .when(~effects | ~same_epoch, "effects_disabled")
        .otherwise("claimed")
    )


def preferred(attempts: DataFrame, key: str) -> DataFrame:
    """(key, attempt_no): a captured attempt before a failed one before any other, the newest of its kind."""
    rank = F.when(F.col("state") == "captured", 0).when(F.col("state") == "failed", 1).otherwise(2)
    return attempts.groupBy(key).agg(F.min_by("attempt_no", F.struct(rank, -F.col("attempt_no"))).alias("attempt_no"))


def next_batch(ids: Column, done: Column, size: int) -> Column:
    """The ids that come next behind those done."""
    return F.slice(ids, done.cast("int") + 1, F.lit(size))


def finalisable(latest: DataFrame) -> Column:
    """Whether a window's latest pass may be made final."""
    c = F.col
    return F.coalesce((c("state") == "completed") & c("traversal_complete") & c("accounting_complete") & ~c("repair_pending") & ~c("drift") & (c("parse_gaps") == 0) & (c("completeness") == "provisional"), F.lit(False))


def maintenance(finalise: DataFrame, repair: DataFrame, budget: int) -> DataFrame:
    """(window_id, action) within one tick's budget: windows to finalise first, then repairs, each in its own order (place)."""
    both = finalise.select("window_id", "place", F.lit("finalise").alias("action"), F.lit(0).alias("_k")).union(repair.select("window_id", "place", F.lit("repair"), F.lit(1)))
    return both.orderBy("_k", "place", "window_id").limit(budget).select("window_id", "action")


def framing(headers: Column) -> Column:
    """struct(length, error) of headers array<struct<key,value>>: the stated length of a body, null where it isn't stated or comes in chunks.

    invalid_response_framing: either header twice, both, a coding other than chunked, or a length that is no number of up to 18 digits.
    """
    own = lambda name: F.transform(F.filter(headers, lambda h: h["key"] == name), lambda h: F.trim(h["value"]))
    lengths, codings = own("content-length"), F.transform(own("transfer-encoding"), F.lower)
    length = F.when(F.get(lengths, F.lit(0)).rlike(r"^[0-9]{1,18}\z"), F.get(lengths, F.lit(0)).try_cast("long"))
    wrong = (F.size(lengths) > 1) | (F.size(codings) > 1) | ((F.size(lengths) > 0) & ((F.size(codings) > 0) | length.isNull())) | ((F.size(codings) > 0) & (F.get(codings, F.lit(0)) != "chunked"))
    return F.struct(F.when(~wrong, length).alias("length"), F.when(wrong, "invalid_response_framing").alias("error"))


def receipt(content: Column) -> Column:
    """struct(attempt_key, fingerprint, body_sha256, body_size, complete, error) of a receipt's JSON; attempt_key is null for what is no receipt.

    crossref_orphan_receipt_invalid: of another version, without a sound hash or size, or with an object that isn't the body's hash.
    """
    value = F.when(F.octet_length(content) <= MOST_RECEIPT, F.try_parse_json(content))
    text = lambda k, v=value: F.when(values.kind(values.member(v, k)) == "text", F.try_variant_get(values.member(v, k), "$", "string"))
    whole = lambda k: F.when(values.kind(values.member(value, k)) == "integer", F.try_variant_get(values.member(value, k), "$", "bigint"))
    complete = F.when(values.kind(values.member(value, "complete")) == "boolean", F.try_variant_get(values.member(value, "complete"), "$", "boolean"))
    sha, size = text("body_sha256"), whole("body_size")
    sound = (whole("schema_version") == 1) & sha.rlike(r"^[0-9a-f]{64}\z") & (text("body_object_id") == F.concat(F.lit("raw:"), sha)) & (size >= 0) & complete.isNotNull()
    error = F.when(~F.coalesce(sound, F.lit(False)), "crossref_orphan_receipt_invalid")
    return F.struct(text("attempt_key").alias("attempt_key"), text("request_fingerprint", values.member(value, "request")).alias("fingerprint"), sha.alias("body_sha256"), size.alias("body_size"), complete.alias("complete"), error.alias("error"))


#: The longest receipt.
MOST_RECEIPT = 1 << 20


def orphan_receipts(pages: DataFrame, objects: DataFrame, attempts: DataFrame) -> DataFrame:
    """(page_id, outcome, receipt_id): what becomes of pages whose answer may have been stored without being noted.

    pages(page_id, fingerprint, active); objects(object_id, sha256, size, state, content) of raw bytes; attempts(receipt_id). Objects that no attempt has are looked
    through: attached where exactly one is a receipt for the page and its request; crossref_orphan_receipt_ambiguous for several; crossref_orphan_request_mismatch or
    crossref_orphan_receipt_invalid for one that doesn't fit or isn't sound; none. crossref_orphan_page_not_active for other pages. If any object looked through
    is registered wrongly or isn't what its hash says, no page can be settled: the error of the first such object, by id, is each active page's.

    Objects are judged where they are read, so that no content is shuffled, only hashes of those that are receipts of active pages or wrong. An object that comes several
    times is one.
    """
    wrong = (
        F.when(~F.coalesce((F.col("object_id") == F.concat(F.lit("raw:"), F.col("sha256"))) & F.col("sha256").rlike(r"^[0-9a-f]{64}\z") & (F.col("size") >= 0), F.lit(False)), "crossref_orphan_registry_corrupt")
        .when(~F.coalesce((F.col("state") == "available") & (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256")), F.lit(False)), "crossref_orphan_object_unreadable")
    )
    digest = lambda c: F.unhex(F.sha2(c, 256))
    name = lambda c: F.when(c.rlike(r"^raw:[0-9a-f]{64}\z"), F.unhex(F.substring(c, 5, 64))).otherwise(digest(c))
    seen = objects.select("object_id", wrong.alias("wrong"), receipt(F.col("content")).alias("r")).where("wrong is not null or r.attempt_key is not null")
    fault = F.col("wrong").isNotNull()
    narrow = seen.select(
        name(F.col("object_id")).alias("name"), "wrong", F.when(fault, F.col("object_id")).alias("object_id"), F.when(fault, F.col("object_id")).otherwise(F.col("r.attempt_key")).alias("key"),
        F.when(~fault, F.substring(digest(F.col("r.fingerprint")), 1, 16)).alias("asked"), F.when(~fault, F.col("r.error")).alias("error"),
    )
    open_pages = pages.where(F.coalesce("active", F.lit(True))).select(F.col("page_id").alias("key"), F.lit(True).alias("open")).distinct()
    asked = written(narrow.join(open_pages, "key", "left").where("wrong is not null or open").drop("open"))
    free = written(asked.join(attempts.select(name(F.col("receipt_id")).alias("name")), "name", "left_anti"))
    blocked = free.where("wrong is not null").agg(F.min(F.struct("object_id", "wrong")).alias("first")).select(F.col("first.wrong").alias("blocked"))  # one row
    found = free.where("wrong is null").groupBy(F.col("key").alias("page_id")).agg(F.min("name").alias("name"), (F.min("name") != F.max("name")).alias("several"), F.min("asked").alias("asked"), F.min("error").alias("error"))
    rows = pages.join(found, "page_id", "left").crossJoin(F.broadcast(blocked))
    outcome = (
        F.when(~F.col("active"), "crossref_orphan_page_not_active")
        .when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(F.col("name").isNull(), "none")
        .when(F.col("several"), "crossref_orphan_receipt_ambiguous")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("asked").eqNullSafe(F.substring(digest(F.col("fingerprint")), 1, 16)), "crossref_orphan_request_mismatch")
        .otherwise("attached")
    )
    return rows.withColumn("outcome", outcome).select("page_id", "outcome", F.when(F.col("outcome") == "attached", F.concat(F.lit("raw:"), F.lower(F.hex("name")))).alias("receipt_id"))
