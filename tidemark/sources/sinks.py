"""Sinks: guarded day writes, upserts with a revision log, inserts that ignore what is there, write-once artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def write_day(bars: DataFrame, path: str, day: str) -> DataFrame:
    """Write one day: nothing to write or rows of another day refuse it; the same content again changes nothing."""
    seen = bars.agg(F.count("*").alias("n"), F.count_if(F.col("trade_date") != F.lit(day).cast("date")).alias("other")).first()
    if not seen["n"]:
        raise ValueError(f"no rows for {day}")
    if seen["other"]:
        raise ValueError(f"{seen['other']} rows are not of {day}")
    return store.append_days(bars, path)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], values: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(merged, log): the latest row per key by `at` wins; the log has old and new values of keys that changed."""
    new = incoming.groupBy(*key).agg(F.max_by(F.struct(*values, at), at).alias("new"))
    both = current.groupBy(*key).agg(F.max_by(F.struct(*values, at), at).alias("old")).join(new, key, "full_outer")
    newer = F.col("old").isNull() | (F.col("new").isNotNull() & (F.col(f"new.{at}") >= F.col(f"old.{at}")))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}"))
    merged = both.select(*key, F.when(newer, F.col("new")).otherwise(F.col("old")).alias("s")).select(*key, "s.*")
    changed = both.where(newer & F.col("old").isNotNull() & ~same)
    log = changed.select(*key, F.struct(*[F.col(f"old.{v}").alias(v) for v in values]).alias("before"), F.struct(*[F.col(f"new.{v}").alias(v) for v in values]).alias("after"), F.col(f"new.{at}").alias("changed_at"))
    return merged, log


def insert_ignore(current: DataFrame, incoming: DataFrame, key: list[str], first_by: str) -> DataFrame:
    """The rows to append: those whose key is not there yet, the first of each."""
    rest = [c for c in incoming.columns if c not in key]
    fresh = incoming.join(current.select(*key), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), first_by).alias("s")).select(*key, "s.*").select(*incoming.columns)


def confirm(current: DataFrame, snapshot: DataFrame, key: list[str], values: list[str], at: str) -> DataFrame:
    """Master rows after a snapshot: known ones keep their first and move their last sighting, new ones start."""
    both = current.withColumn("__c", F.lit(True)).alias("c").join(snapshot.withColumn("__s", F.lit(True)).alias("s"), key, "full_outer")
    return both.select(*key, *[F.coalesce(f"s.{v}", f"c.{v}").alias(v) for v in values], F.coalesce("c.first_seen", f"s.{at}").alias("first_seen"), F.greatest("c.last_seen", f"s.{at}").alias("last_seen"))


def flattened(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for readers that know flat tables only."""
    nested = [n for n, k in rows.dtypes if k.startswith(("array", "map", "struct"))]
    return rows.withColumns({n: F.to_json(n) for n in nested}) if nested else rows


def write_artifacts(artifacts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write each table once (never over one that is there), then the manifest: the single point of commit.

    The manifest has (name, rows, digest), the digest being independent of the order of rows; a folder without a manifest
    was not finished.
    """
    spark = next(iter(artifacts.values())).sparkSession
    told = []
    for name, rows in artifacts.items():
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{folder}/{name}")
        back = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
        one = back.select(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s")).first()
        told.append((name, one["n"], one["s"]))
    manifest = spark.createDataFrame(told, "name string, rows long, digest string")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest
