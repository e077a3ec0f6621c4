"""Ids from hashes, and JSON in one form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def framed_sha256(*parts: Column) -> Column:
    """SHA-256 of the parts, a zero byte behind each."""
    zero = F.lit("\0")
    return F.sha2(F.concat(*(x for p in parts for x in (p, zero))), 256)


def _canonical(text: str | None, ascii_only: bool) -> str | None:
    if text is None:
        return None

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key twice")
        return out

    def no_constant(name):
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=no_constant)
        return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json_ascii(texts: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, other than ASCII escaped; null for what isn't strict JSON, has a key twice or isn't finite."""
    return pd.Series([_canonical(t, True) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def canonical_json_utf8(texts: pd.Series) -> pd.Series:
    """The same with all characters as they are."""
    return pd.Series([_canonical(t, False) for t in texts], dtype=object)
