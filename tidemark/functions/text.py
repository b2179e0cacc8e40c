"""Text functions: names, codes, local times, redaction.  NFKC has no built-in, so it is the one vectorised UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms at the end of a name.
SUFFIXES = ("co ltd", "company limited", "incorporated", "inc", "corporation", "corp", "limited", "ltd", "plc", "holdings", "hd", "kk", "株式会社")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFKC", v).casefold() if v is not None else None)


def normalised_name(name: str) -> Column:
    """NFKC, case folded, without punctuation, and without legal forms at the end, however many."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(nfkc(name), r"[\p{P}\p{S}]+", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, f"( ?({'|'.join(SUFFIXES)}))+$", ""))


def class_token(name: str) -> Column:
    """The share class in a security's name: A, B, ..., or null."""
    return F.nullif(F.upper(F.regexp_extract(F.lower(name), r"\b(?:class|cl|series)\s+([a-z])\b", 1)), F.lit(""))


def identity_key(registry: str, anchor: str, name: str) -> Column:
    """The registry's number, else the anchor (a market code), else a provisional key of the normalised name."""
    return F.coalesce(F.concat(F.lit("registry:"), registry), F.concat(F.lit("anchored:"), anchor), F.concat(F.lit("provisional:"), normalised_name(name)))


def local_to_utc(local: str, zone: str = "Asia/Tokyo") -> Column:
    return F.to_utc_timestamp(local, zone)


def session_times(day: str | Column) -> dict[str, Column]:
    """Of a Tokyo session day, as instants: session_end, confirmed_at (all bars final) and send_by (the next weekday's open)."""
    d = F.col(day) if isinstance(day, str) else day
    # The close moved from 15:00 to 15:30 on 2024-11-05; the feed is 20 minutes late.
    minutes = F.when(d >= F.lit("2024-11-05").cast("date"), 15 * 60 + 30).otherwise(15 * 60)
    at = lambda x, m: F.to_utc_timestamp(F.timestamp_add("MINUTE", m, x.cast("timestamp_ntz").cast("timestamp")), "Asia/Tokyo")
    # Monday is 0: from Friday three days on, from Saturday two.
    ahead = F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))
    return {"session_end": at(d, minutes), "confirmed_at": at(d, minutes + 40), "send_by": at(ahead, F.lit(9 * 60))}


def redacted(text: str, *variants: str) -> Column:
    """text without the names in the given columns and without free-standing four-digit codes."""
    out = F.col(text)
    for v in variants:
        quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(v, r"\\E", ""), F.lit(r"\E"))
        out = F.when(F.coalesce(F.length(v), F.lit(0)) > 0, F.regexp_replace(out, quoted, F.lit("[NAME]"))).otherwise(out)
    return F.regexp_replace(out, r"(?<![0-9A-Za-z])[0-9]{4}(?![0-9A-Za-z])", "[CODE]")


def canonical_json(**values: Column) -> Column:
    """JSON of whole numbers and texts with its keys in order and no blanks, nulls included: equal rows give equal text."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})
