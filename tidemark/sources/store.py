"""Bars on disk: partitioned, content-addressed, write-once Parquet, and its readers.

Partitions are provider= / market= / dataset= / year= / month= / trade_date=, so that a range of days prunes folders and
symbols reach the scan as a pushed filter.  A file is named by the SHA-256 of its rows; writing the same
rows again changes nothing, and other rows for the same day are a revision beside the first, with the next number of
that day (revision_seq), so copies of a store answer alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DAILY_BAR

PARTITIONS = ["provider_id", "market_code", "dataset_key", "year", "month", "trade_date"]
#: What makes two rows of a day the same content.
CONTENT = ["native_symbol", "open", "high", "low", "close", "volume", "turnover"]


def with_revision(bars: DataFrame) -> DataFrame:
    """bars with `revision`: a digest of the whole day's rows that does not depend on their order."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CONTENT]), 256)
    # A sum over row digests: combined before the shuffle, a day's rows are never gathered.
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    day = ["provider_id", "market_code", "dataset_key", "trade_date"]
    digest = bars.groupBy(*day).agg(F.sha2(F.concat_ws("|", F.count("*"), *[F.sum(part(i)) for i in range(4)]), 256).alias("revision"))
    return bars.join(digest, day)


def append_days(bars: DataFrame, path: str) -> DataFrame:
    """Append the days whose content is not in the store yet; gives (day keys, revision, is_new)."""
    spark = bars.sparkSession
    rows = with_revision(bars).withColumns({"year": F.year("trade_date"), "month": F.month("trade_date")})
    day = ["provider_id", "market_code", "dataset_key", "trade_date", "revision"]
    try:
        known = spark.read.parquet(path).select(*day, "revision_seq").distinct()
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = rows.select(*day, F.lit(0).alias("revision_seq")).limit(0)
    last = known.groupBy(*day[:-1]).agg((F.max("revision_seq") + 1).alias("__next"))
    seen = known.select(*day).withColumn("seen", F.lit(True))
    few = known.count() < 100_000
    near = lambda x: F.broadcast(x) if few else x
    marked = rows.join(near(seen), day, "left").join(near(last), day[:-1], "left").withColumn("revision_seq", F.coalesce("__next", F.lit(1))).drop("__next")
    # A row per day of the batch; taken now, since after the write every day would count as seen.
    told = marked.groupBy(*day).agg(F.first("seen").isNull().alias("is_new"))
    report = spark.createDataFrame(told.collect(), told.schema)
    new = marked.where("seen is null").drop("seen")
    new.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "native_symbol").write.mode("append").option("compression", "zstd").partitionBy(*PARTITIONS).parquet(path)
    return report


def read_days(spark: SparkSession, path: str, start: str, end: str, symbols: list[str] | None = None) -> DataFrame:
    """Days of a range (inclusive), optionally some symbols; of several revisions of a day that of the highest number."""
    rows = spark.read.schema(_stored_schema()).parquet(path).where(F.col("trade_date").between(start, end))
    if symbols is not None:
        rows = rows.where(F.col("native_symbol").isin(symbols))
    day = ["provider_id", "market_code", "dataset_key", "trade_date"]
    last = rows.groupBy(*day).agg(F.max("revision_seq").alias("revision_seq"))
    return rows.join(last, [*day, "revision_seq"]).drop("year", "month")


def _stored_schema():
    from pyspark.sql import types as T

    return T.StructType([*DAILY_BAR.fields, T.StructField("revision", T.StringType()), T.StructField("revision_seq", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
