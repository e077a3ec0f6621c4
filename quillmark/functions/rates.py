"""What a provider's answer means for the next request: to go on, to wait and how long, or to stop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import timing

#: Seconds between requests at least and to wait at most, and the failures of a capture that are worth another try.
LEAST, MOST = 1.0, 31 * 86400
RETRYABLE = ["source_timeout", "source_connection_error", "response_incomplete", "source_protocol_error"]
#: What a header's name and value may be.
NAME, VALUE = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]{1,128}\z", r"^[\x20-\x7E]{0,4096}\z"


def header(headers: Column, name: str) -> tuple[Column, Column]:
    """(value, how many) of the headers array<struct<key,value>> of a name, in any case."""
    own = F.filter(headers, lambda h: F.lower(h["key"]) == name)
    return F.trim(F.get(own, F.lit(0))["value"]), F.size(own)


def counted(value: Column, most: int) -> Column:
    """A whole number from 1 to most; null for anything else."""
    number = F.when(value.rlike(r"^[0-9]{1,9}\z"), value.try_cast("long"))
    return F.when(number.between(1, most), number)


def decision(status: Column, headers: Column, now: Column, failures: Column, jitter: Column, capture_error: Column) -> Column:
    """struct(action, code, delay, interval, concurrency, rate_type, warnings, halts).

    action: accept, retry after `delay` seconds, or stop; halts where the provider must not be asked again. The interval between requests is the one
    that the rate headers state, but a second at least; headers that come twice or can't be read are warnings. 429, 5xx and broken captures
    are tried again: after the doubling of two seconds by failures (to 300, spread by jitter), the interval, or Retry-After, whichever is longest.
    A Retry-After that can't be read or is over 31 days stops. Null input where a value is needed, or headers that are none, give action invalid.
    """
    fine = (F.size(headers) <= 64) & F.forall(headers, lambda h: F.coalesce(h["key"].rlike(NAME) & h["value"].rlike(VALUE), F.lit(False)))
    sound = (status.isNull() | status.between(100, 599)) & failures.between(0, 1_000_000) & jitter.between(0.0, 1.0) & now.isNotNull() & (capture_error.isNull() | capture_error.rlike(r"^[a-z][a-z0-9_]{0,79}\z"))
    (limit, n_limits), (period, n_periods) = header(headers, "x-rate-limit-limit"), header(headers, "x-rate-limit-interval")
    seconds = F.when(period.rlike(r"^[0-9]{1,7}(?:\.[0-9]{1,6})?s\z"), F.rtrim(period, F.lit("s")).try_cast("double"))
    stated = F.when((n_limits == 1) & (n_periods == 1) & (seconds > 0) & (seconds <= MOST), seconds / counted(limit, 1_000_000))
    interval = F.greatest(F.lit(LEAST), F.coalesce(stated, F.lit(LEAST)))
    at_once, n_at_once = header(headers, "x-concurrency-limit")
    concurrency = F.when(n_at_once == 1, counted(at_once, 1024))
    kind, n_kinds = header(headers, "x-rate-limit-type")
    rate_type = F.when((n_kinds == 1) & F.length(kind).between(1, 64), kind)
    warnings = F.array_compact(F.array(
        F.when(n_limits + n_periods == 0, "crossref_rate_headers_missing").when(stated.isNull(), "crossref_rate_headers_invalid"),
        F.when((n_at_once > 0) & concurrency.isNull(), "crossref_concurrency_header_invalid"),
        F.when((n_kinds > 0) & rate_type.isNull(), "crossref_rate_type_invalid"),
    ))
    (after, n_after), (date, n_dates) = header(headers, "retry-after"), header(headers, "date")
    wait = F.when(n_after == 0, 0.0).when(n_after == 1, timing.retry_after(after, now, F.when(n_dates == 1, date)))
    again = F.coalesce((status == 429) | (status >= 500), F.lit(False)) | ((status.isNull() | (status == 200)) & F.coalesce(capture_error.isin(RETRYABLE), F.lit(False)))
    backoff = F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(failures + 1, F.lit(9)))) * (0.5 + 0.5 * jitter)
    code = (
        F.when(again, F.when(status == 429, "crossref_rate_limited").when(status >= 500, "crossref_server_error").otherwise(capture_error))
        .when((status == 200) & capture_error.isNull(), None)
        .otherwise(F.coalesce(capture_error, F.when(status.between(300, 399), "crossref_redirect").when(status.isNotNull(), "crossref_http_error").otherwise("crossref_no_response")))
    )
    forbidden, unread = F.coalesce(status == 403, F.lit(False)), again & wait.isNull()
    action = F.when(forbidden | unread, "stop").when(again, "retry").when((status == 200) & capture_error.isNull(), "accept").otherwise("stop")

    def out(action: Column, code: Column, delay: Column, interval: Column, concurrency: Column, rate_type: Column, warnings: Column, halts: Column) -> Column:
        names = ("action", "code", "delay", "interval", "concurrency", "rate_type", "warnings", "halts")
        return F.struct(*(c.alias(n) for n, c in zip(names, (action, code, delay, interval, concurrency, rate_type, warnings, halts), strict=True)))

    text, whole = F.lit(None).cast("string"), F.lit(None).cast("long")
    known = out(action, F.when(forbidden, "crossref_forbidden").when(unread, "crossref_retry_after_invalid").otherwise(code), F.when(again & ~forbidden & ~unread, F.greatest(interval, wait, backoff)).otherwise(0.0), interval, concurrency, rate_type, warnings, forbidden | unread)
    broken = out(F.lit("stop"), F.lit("crossref_forbidden"), F.lit(0.0), F.lit(LEAST), whole, text, F.array(F.lit("crossref_response_headers_invalid")), F.lit(True))
    refused = lambda code: out(F.lit("invalid"), F.lit(code), F.lit(0.0), F.lit(LEAST), whole, text, F.array().cast("array<string>"), F.lit(False))
    return F.when(~F.coalesce(sound, F.lit(False)), refused("invalid_crossref_rate_input")).when(F.coalesce(fine, F.lit(False)), known).when(forbidden, broken).otherwise(refused("invalid_crossref_headers"))
