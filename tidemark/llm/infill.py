"""Fill-in-the-middle: texts cut at two places between units and put together again with markers.

A unit is a word with the white space before it (or white space at the end).  Texts go through a
pandas UDF in Arrow batches: the regex library's finditer gives the units, whose end offsets are
kept in a compact array; two look-ups there give the offsets at which the text is sliced.  The
places and the form come from a digest of a seed and the document's id, so they do not depend on
how rows are dealt.  What stands in the output is enough to give the text back (restored).

Defined cases: null text counts as empty; an empty text stays as it is (form plain, no units); a
text that holds a marker stays as it is, so a marker in an output of another form is always one that was put there; a null id has
the seed alone before it; repeated rows give equal rows; an empty table gives an empty table.
Columns pass through; those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def numbers(seed: int, key) -> list[int]:
    """Four numbers of 32 bits that a seed and an id give."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def units(text: str) -> array:
    """Offsets at which units end, after a 0: in code points."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    return ends


def infill(text: str, key, seed: int, rate: int, spm: int) -> tuple[str, str, int, int | None, int | None]:
    """Output, form, number of units, and lengths of prefix and middle (None: plain)."""
    ends = units(text)
    n = len(ends) - 1
    h = numbers(seed, key)
    if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", n, None, None
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, a, b - a


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    x, rest = output.removeprefix(first).split(second, 1)
    y, middle = rest.split(MIDDLE, 1)
    return y + middle + x if form == "spm" else x + middle + y


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(seed: int, rate: int, spm: int, outputs: bool):
    """The pandas UDF of (id, text)."""

    @F.pandas_udf(FIELDS + (", output string" if outputs else ""))
    def run(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for k, t in zip(key, text, strict=True):
            t = t or ""
            output, form, n, prefix, middle = infill(t, k, seed, rate, spm)
            rows.append((n, form, prefix, middle, _sha256(output), _sha256(restored(output, form)), *([output] if outputs else [])))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if outputs else [])])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, outputs: bool = True) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and (if asked for) output.

    rate: hundredths of the documents that are cut; spm: hundredths of those with the suffix first.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if outputs else [])]
    c.small_batches(docs.sparkSession)
    made: Column = transform(seed, rate, spm, outputs)(F.col(id).cast("string"), F.col(text))
    rest = [x for x in docs.columns if x not in new]
    return docs.select(*rest, made.alias("__made")).select(*rest, *[F.col(f"__made.{x}").alias(x) for x in new])


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs, outputs=False).drop("text")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k
), s AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM s
"""
