"""Two clocks: histories by valid time, read at a knowledge time, through published runs only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scd2(rows: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """A history of `value` per key: a row per change, from then until the next change.

    The last state of an instant counts (by tie); a state that repeats only confirms (`last_confirmed_at`).
    """
    last = rows.groupBy(key, at).agg(F.max_by(value, tie).alias(value))
    w = Window.partitionBy(key).orderBy(at)
    marked = last.withColumn("changed", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
    marked = marked.withColumn("episode", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(key, "episode").agg(F.first(value).alias(value), F.min(at).alias("effective_from"), F.max(at).alias("last_confirmed_at"))
    return spans.withColumn("effective_to", F.lead("effective_from").over(Window.partitionBy(key).orderBy("effective_from"))).drop("episode")


def as_of(history: DataFrame, key: str, effective_at: str, known_at: str) -> DataFrame:
    """Per key the state valid at one time as it was known at another (latest available wins, then latest start)."""
    e, k = F.lit(effective_at).cast("date"), F.lit(known_at).cast("date")
    valid = history.where((F.col("available_at") <= k) & (F.col("effective_from") <= e) & (F.col("effective_to").isNull() | (F.col("effective_to") > e)))
    rest = [c for c in history.columns if c != key]
    return valid.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("effective_from", "available_at")).alias("s")).select(key, "s.*")


def authoritative(runs: DataFrame, key: str, known_at: str) -> DataFrame:
    """Per key the published run with the latest (published_at, publication_seq) at the knowledge time."""
    seen = runs.where(F.col("published_at") <= F.lit(known_at).cast("date"))
    rest = [c for c in runs.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("published_at", "publication_seq")).alias("s")).select(key, "s.*")


def revisions(rows: DataFrame, key: list[str], at: str, payload: list[str]) -> DataFrame:
    """Rows whose payload digest differs from the one before it, numbered per key."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in payload]), 256)
    w = Window.partitionBy(*key).orderBy(at)
    marked = rows.withColumn("digest", digest).withColumn("before", F.lag("digest").over(w))
    changed = marked.where(F.col("before").isNull() | (F.col("before") != F.col("digest")))
    return changed.withColumn("revision", F.row_number().over(w)).drop("before")
