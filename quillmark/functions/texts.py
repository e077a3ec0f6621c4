"""Texts, addresses, dates and amounts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import timing

#: Updates that say what becomes of a paper.
INTEGRITY_KINDS = {
    "correction": ["correction", "corrigendum", "erratum"],
    "retraction": ["retraction", "partial retraction"],
    "expression_of_concern": ["expression of concern"],
    "reinstatement": ["reinstatement"],
}
#: Licences by a part of their address, the first that fits.
LICENSES = {
    "/publicdomain/zero/": "cc0",
    "/licenses/by-nc-nd/": "cc-by-nc-nd",
    "/licenses/by-nc-sa/": "cc-by-nc-sa",
    "/licenses/by-nc/": "cc-by-nc",
    "/licenses/by-nd/": "cc-by-nd",
    "/licenses/by-sa/": "cc-by-sa",
    "/licenses/by/": "cc-by",
}
#: Names of units.
UNITS = {
    "h": ["hour", "hours", "小時"],
    "min": ["minute", "minutes", "分鐘"],
    "s": ["second", "seconds", "秒"],
    "ms": ["millisecond", "milliseconds", "毫秒"],
    "m": ["meter", "meters", "metre", "metres", "公尺"],
    "cm": ["centimeter", "centimeters", "centimetre", "centimetres", "公分"],
    "mm": ["millimeter", "millimeters", "millimetre", "millimetres", "毫米"],
    "km": ["kilometer", "kilometers", "kilometre", "kilometres", "公里"],
    "kg": ["kilogram", "kilograms"],
    "g": ["gram", "grams"],
}
NUMBER = r"(?<![A-Za-z0-9_])([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"


def integrity_kind(kind: Column) -> Column:
    """correction, retraction, expression_of_concern, reinstatement or other_update."""
    flat = F.trim(F.regexp_replace(F.lower(kind), r"[-_\s]+", " "))
    out = F.lit("other_update")
    for name, words in INTEGRITY_KINDS.items():
        out = F.when(flat.isin(words), name).otherwise(out)
    return out


def license_class(url: Column) -> Column:
    flat = F.concat(F.rtrim(F.lower(url), F.lit("/")), F.lit("/"))
    out = F.lit("unknown")
    for part, name in reversed(LICENSES.items()):
        out = F.when(flat.contains(part), name).otherwise(out)
    return out


def valid_text(value: Column, longest: int) -> Column:
    """Not empty, no controls, nothing blank at the ends, at most so many bytes; false for null."""
    fine = (value != "") & (F.octet_length(value) <= longest) & ~value.rlike(r"[\x00-\x1F\x7F]") & ~value.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$")
    return F.coalesce(fine, F.lit(False))


def safe_url(url: Column) -> Column:
    """https without a user, fragment, other port than 443 or a host of this machine or network; literal IPs must be global."""
    parts = r"^https://([^/?#@\[\]:]+|\[[0-9A-Fa-f:.]+\])(?::(\d*))?(?:[/?][^#]*)?#?$"
    host = F.rtrim(F.lower(F.regexp_extract(url, parts, 1)), F.lit("."))
    port = F.regexp_extract(url, parts, 2)
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    own = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.(1[89]|51\.100)\.|^203\.0\.113\.|^(2[4-5]\d)\.|^\[(::1?|f[cd].*|fe[89ab].*)\]$")
    local = (host == "localhost") | host.rlike(r"\.(localhost|local)$")
    fine = url.rlike(parts) & (F.length(url) <= 8192) & ~url.rlike(r"[\s\x00-\x1F\x7F]") & port.isin("", "443") & (host != "") & ~local & ~((ip | host.startswith("[")) & own)
    return F.coalesce(fine, F.lit(False))


def digest_url(url: Column) -> Column:
    """https with a host, or http to this machine, without a user."""
    return F.coalesce(url.rlike(r"^https://[^/?#@\s]+([/?#]\S*)?$") | url.rlike(r"^http://(localhost|127\.0\.0\.1|\[::1\])(:\d+)?([/?#]\S*)?$"), F.lit(False))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """struct(value, precision): as much of a date as is there and right; null where a part is not."""
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    right_year, right_month = year.between(1, 9999), month.between(1, 12)
    whole = F.try_to_date(F.concat_ws("-", digits(year, 4), digits(month, 2), digits(day, 2)), "yyyy-MM-dd")
    value = (
        F.when(~right_year, None)
        .when(month.isNull() & day.isNull(), digits(year, 4))
        .when(right_month & day.isNull(), F.concat_ws("-", digits(year, 4), digits(month, 2)))
        .when(right_month & whole.isNotNull(), F.concat_ws("-", digits(year, 4), digits(month, 2), digits(day, 2)))
    )
    precision = F.when(F.length(value) == 4, "year").when(F.length(value) == 7, "month").when(value.isNotNull(), "day")
    return F.struct(value.alias("value"), precision.alias("precision"))


def provider_date(updated: Column) -> Column:
    """struct(value, precision) of {"date-time": …, "date-parts": [[…]]}: the time to the second if it says its zone, else the parts."""
    second = timing.instant_text(F.get_json_object(updated, "$.date-time"))
    parts = F.from_json(F.get_json_object(updated, "$['date-parts']"), "array<array<int>>")
    own = F.get(parts, F.lit(0))
    whole = (F.size(parts) == 1) & F.size(own).between(1, 3) & ~F.exists(own, lambda x: x.isNull())
    date = partial_date(F.get(own, F.lit(0)), F.get(own, F.lit(1)), F.get(own, F.lit(2)))
    value = F.coalesce(second, F.when(whole, date["value"]))
    precision = F.when(second.isNotNull(), "second").when(whole, date["precision"])
    return F.struct(value.alias("value"), precision.alias("precision"))


def micros(usd: Column) -> Column:
    """Dollars as a decimal string to whole millionths, upwards."""
    return F.ceil(usd.cast("decimal(38,12)") * 1_000_000).cast("long")


def flat_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def stripped(value: Column) -> Column:
    """Without what is blank at the ends; nothing inside is changed."""
    blank = r"[\s\p{Z}\x1C-\x1F\x85]+"
    return F.regexp_replace(value, f"^{blank}|{blank}\\z", "")


def newlines(value: Column) -> Column:
    """CR LF and CR made LF, and nothing blank at the ends."""
    return F.regexp_replace(F.regexp_replace(value, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def html_escape(value: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(sign), F.lit(entity))
    return value


def numbers(text: Column) -> Column:
    """All number literals in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f looks at it."""
    return F.transform(F.array(value), f)[0]


def counted(items: Column) -> Column:
    """An array as a multiset: sorted distinct struct(item, n). It is sorted once, and cut where an item differs from the one before."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(F.array().cast("array<int>"))
        return bound(starts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("item"), (F.coalesce(F.get(at, k + 1), n) - a).alias("n"))))

    return bound(F.array_sort(items), runs)


def contained(left: Column, right: Column) -> Column:
    """Whether each item of left is in right at least as often. Both are sorted, and right is walked through once: an item of left that is passed over isn't in it."""
    found = lambda s: F.aggregate(s["r"], F.lit(0), lambda at, y: at + F.when(F.get(s["l"], at) == y, 1).otherwise(0)) == F.size(s["l"])
    return F.when(left.isNotNull() & right.isNotNull(), bound(F.struct(F.array_sort(left).alias("l"), F.array_sort(right).alias("r")), found))


def unit_name(unit: Column) -> Column:
    small = F.lower(unit)
    out = small
    for name, words in UNITS.items():
        out = F.when(small.isin(words), name).otherwise(out)
    return out


def quoted_at(text: Column, start: Column, quote: Column) -> Column:
    """Whether the quote stands at this offset, counted in code points from 0."""
    return F.substring(text, start + 1, F.char_length(quote)) == quote


#: A number and a unit behind it.
MEASURED = (
    r"([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(%|(?i:(?:mhz|khz|hz|ms|mm|cm|km|kg|m|s|g)(?:/[A-Za-z0-9µμ°]+)?|"
    + "|".join(sorted((w for ws in UNITS.values() for w in ws), key=len, reverse=True))
    + r"|人|段|篇|次))(?![A-Za-z0-9µμ°])"
)


def measured(text: Column) -> Column:
    """All numbers with a unit: struct(number, unit), units by one name each."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(MEASURED), F.lit(1)).alias("number"), F.regexp_extract_all(text, F.lit(MEASURED), F.lit(2)).alias("unit"))
    return F.transform(found, lambda m: F.struct(m["number"].alias("number"), unit_name(m["unit"]).alias("unit")))
