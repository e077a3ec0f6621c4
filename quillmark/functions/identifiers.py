"""Identifiers of papers brought to one form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INVALID = "invalid_identifier"


def ascii_fold(value: Column) -> Column:
    """A-Z made small; other letters stay, unlike with lower()."""
    return F.translate(value, CAPITALS, SMALL)


def result(value: Column, version: Column | None = None) -> Column:
    """struct(value, version, error): the error just where there is no value."""
    version = F.lit(None).cast("string") if version is None else version
    return F.struct(value.alias("value"), F.when(value.isNotNull(), version).alias("version"), F.when(value.isNull(), INVALID).alias("error"))


def plain(value: Column, longest: int) -> Column:
    """Nothing empty or too long, no white space, controls, question marks or hashes."""
    return (value != "") & (F.octet_length(value) <= longest) & ~value.rlike(r"[\x00-\x20\x7F?#\p{Z}]")


def decoded_once(value: Column) -> Column:
    """Percent signs decoded one time; null for a broken one. A plus sign is no space."""
    whole = ~value.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(whole, F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))


def doi(value: Column) -> Column:
    """DOIs, after four kinds of URL or `doi:`; only what was in a URL is decoded."""
    wrapper = r"^(?i)https?://(dx\.)?doi\.org/"
    wrapped = value.rlike(wrapper)
    bare = F.when(wrapped, decoded_once(F.trim(F.regexp_replace(value, wrapper, "")))).when(value.rlike("^(?i)doi:"), F.trim(F.substring(value, 5, 1 << 20))).when(~value.contains("://"), F.trim(value))
    return result(F.when(plain(bare, 512) & bare.rlike(r"^10\.\d{4,9}/\S+$"), ascii_fold(bare)))


def arxiv(value: Column) -> Column:
    """Modern ids (four digits to 1412, five from 1501) and older ones with an archive, each with an optional version."""
    wrapper = r"^(?i)https?://arxiv\.org/abs/"
    bare = F.when(value.rlike(wrapper), F.regexp_replace(value, wrapper, "")).when(value.rlike("^(?i)arxiv:"), F.substring(value, 7, 1 << 20)).when(~value.contains("://"), value)
    bare = F.trim(bare)
    fine = plain(bare, 128) & ~bare.rlike(r"[^\x00-\x7F]|%")
    modern, older = r"^(\d{2})(0[1-9]|1[0-2])\.(\d{4,5})(?:v([1-9]\d*))?$", r"^([a-z][A-Za-z0-9.-]*)/(\d{2}(?:0[1-9]|1[0-2])\d{3})(?:v([1-9]\d*))?$"
    period = F.concat(F.regexp_extract(bare, modern, 1), F.regexp_extract(bare, modern, 2))
    digits = F.length(F.regexp_extract(bare, modern, 3))
    right = ((period >= "0704") & (period <= "1412") & (digits == 4)) | ((period >= "1501") & (digits == 5))
    id_ = F.when(fine & bare.rlike(modern) & right, F.concat(period, F.lit("."), F.regexp_extract(bare, modern, 3))).when(
        fine & bare.rlike(older), F.concat(F.regexp_extract(bare, older, 1), F.lit("/"), F.regexp_extract(bare, older, 2))
    )
    version = F.when(bare.rlike(modern), F.regexp_extract(bare, modern, 4)).otherwise(F.regexp_extract(bare, older, 3))
    return result(id_, F.nullif(version, F.lit("")))


def pmid(value: Column) -> Column:
    bare = F.trim(value)
    return result(F.when(bare.rlike("^[0-9]{1,10}$") & ~bare.rlike("^0+$"), F.regexp_replace(bare, "^0+", "")))


def pmc(value: Column) -> Column:
    bare = F.upper(F.trim(value))
    return result(F.when(bare.rlike("^PMC[0-9]{1,10}$") & ~bare.rlike("^PMC0+$"), F.regexp_replace(bare, "^PMC0*", "PMC")))


def normalized(namespace: Column, value: Column) -> Column:
    """struct(value, version, error) by the namespace: doi, arxiv, pmid or pmc."""
    known = {"doi": doi, "arxiv": arxiv, "pmid": pmid, "pmc": pmc}
    out = result(F.lit(None).cast("string"))
    for name, f in known.items():
        out = F.when(namespace == name, f(value)).otherwise(out)
    return out
