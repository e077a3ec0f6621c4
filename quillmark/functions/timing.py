"""Points in time and waits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_BACKOFF, DOUBLINGS = 300.0, 9


def backoff(failures: Column, jitter: Column, interval: Column, retry_after: Column) -> Column:
    """Seconds to wait: doubled with each failure up to a bound and made shorter by jitter, no less than server or interval say."""
    base = F.least(F.lit(LONGEST_BACKOFF), F.power(F.lit(2.0), F.least(failures + 1, F.lit(DOUBLINGS))))
    return F.greatest(interval, F.coalesce(retry_after, F.lit(0.0)), base * (F.lit(0.5) + F.lit(0.5) * jitter))


def decision(status: Column, capture_error: Column, retryable_errors: list[str]) -> Column:
    """accept, retry or stop, by HTTP status and what went wrong in the capture."""
    broken = (status.isNull() | (status == 200)) & F.coalesce(capture_error.isin(retryable_errors), F.lit(False))
    return (
        F.when(status == 403, "stop")
        .when((status == 429) | (status >= 500) | broken, "retry")
        .when((status == 200) & capture_error.isNull(), "accept")
        .otherwise("stop")
    )


def local_cutoff(now: Column, zone: Column, hour: Column, minute: Column) -> Column:
    """The last time, in UTC, that clocks of the zone showed this hour and minute."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), hour, minute)
    due = F.when(local < today, today - F.expr("INTERVAL 1 DAY")).otherwise(today)
    return F.to_utc_timestamp(due, zone)


def window_end(source: Column, now: Column) -> Column:
    """Where a window of a source may end: at a day for pubmed, at a minute for arxiv, anywhere for others."""
    return F.when(source == "pubmed", F.date_trunc("day", now)).when(source == "arxiv", F.date_trunc("minute", now)).otherwise(now)


#: Places of an ISO text: a date with or without hyphens, a time to the hour, minute, second or a part of it, and a zone.
ISO = r"^(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d)).(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)\z"


def instant(value: Column) -> Column:
    """The timestamp of an ISO text that says its zone, to the microsecond; null for any other. Weeks and days of a year are not read."""
    part = lambda n: F.regexp_extract(value, ISO, n)
    two = lambda n: F.rpad(part(n), 2, "0")
    month, day = F.concat(part(2), part(4)), F.concat(part(3), part(5))
    zone = F.regexp_replace(part(10), "[:Z]", "")
    digits = lambda at: F.coalesce(F.substring(zone, at, 2).try_cast("int"), F.lit(0))
    ahead = F.when(zone.startswith("-"), -1).otherwise(1) * (digits(2) * 3600 + digits(4) * 60 + digits(6))
    inside = (digits(2) < 24) & (digits(4) < 60) & (digits(6) < 60)
    text = F.concat(part(1), F.lit("-"), month, F.lit("-"), day, F.lit(" "), two(6), F.lit(":"), two(7), F.lit(":"), two(8), F.lit("."), F.rpad(F.substring(part(9), 1, 6), 6, "0"), F.lit(" +0000"))
    local = F.when(value.rlike(ISO) & inside, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS Z")))
    return F.timestamp_micros(F.unix_micros(local) - ahead.cast("long") * 1_000_000)


def instant_text(value: Column) -> Column:
    """The same in UTC as ISO text, with a fraction only where there is one."""
    utc = F.to_utc_timestamp(instant(value), F.current_timezone())
    fraction = F.when(F.date_format(utc, "SSSSSS") != "000000", F.date_format(utc, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


#: The longest wait that is a wait, in seconds.
LONGEST_WAIT = 31 * 86400


def http_date(value: Column) -> Column:
    """The timestamp of a date as HTTP and mail write it, with or without the day of the week; null for anything else, and without a zone."""
    form = r"^(?:[A-Za-z]{3},? )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) (GMT|UTC|UT|[+-]\d{4})\z"
    zone = F.regexp_extract(value, form, 5)
    text = F.concat(F.lpad(F.regexp_extract(value, form, 1), 2, "0"), *(x for n in (2, 3, 4) for x in (F.lit(" "), F.regexp_extract(value, form, n))), F.lit(" "), F.when(zone.rlike("^[+-]"), zone).otherwise("+0000"))
    return F.when(value.rlike(form), F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss Z")))


def retry_after(value: Column, now: Column, date: Column | None = None) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date, which is no wait once past; null for anything else and for more than 31 days.
    The server's own date, if it can be read, can only make the wait longer."""
    due = http_date(value)
    left = lambda at: (F.unix_micros(due) - F.unix_micros(at)) / 1e6
    wait = F.greatest(F.lit(0.0), left(now), left(http_date(date))) if date is not None else F.greatest(F.lit(0.0), left(now))
    wait = F.when(value.rlike(r"^\d{1,10}\z"), value.cast("double")).when(due.isNotNull(), wait)
    return F.when(wait <= LONGEST_WAIT, wait)
