"""Text sources: pipe-delimited symbol directories, statistical CSV by column name, nested chart JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def symbol_directory(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a pipe-delimited directory: header and trailer are skipped, lines of a wrong width are errors."""
    lines = spark.read.text(path).where(~F.col("value").startswith("File Creation Time") & (F.col("value") != "") & (F.col("value") != "|".join(columns)))
    parts = lines.withColumn("parts", F.split("value", r"\|", -1))
    good = parts.where(F.size("parts") == len(columns))
    records = good.select(*[F.nullif(F.trim(F.col("parts")[i]), F.lit("")).alias(n) for i, n in enumerate(columns)])
    return records, parts.where(F.size("parts") != len(columns)).select(F.col("value").alias("line"), F.size("parts").alias("width"))


def observations(spark: SparkSession, path: str, period: str = "TIME_PERIOD", value: str = "OBS_VALUE", series: str = "CURRENCY") -> DataFrame:
    """(series, source_date, rate) of a CSV whose columns are found by name; blank observations are skipped."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    rate = F.expr(f"try_cast(`{value}` AS decimal(20,10))")
    day = F.expr(f"try_cast(`{period}` AS date)")
    return rows.select(F.col(series).alias("series"), day.alias("source_date"), rate.alias("rate")).where("rate is not null and source_date is not null")


CHART = "meta struct<currency:string,symbol:string>, timestamp array<bigint>, indicators struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>, events struct<splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>"


def chart_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of chart JSON lines: parallel arrays zipped by position; null prices stay null."""
    rows = spark.read.schema(CHART).json(path)
    quote = F.col("indicators.quote")[0]
    zipped = F.arrays_zip(F.col("timestamp").alias("at"), quote["open"].alias("open"), quote["high"].alias("high"), quote["low"].alias("low"), quote["close"].alias("close"), quote["volume"].alias("volume"))
    bars = rows.select(F.col("meta.symbol").alias("symbol"), F.col("meta.currency").alias("currency"), F.explode(zipped).alias("b"))
    names = ("open", "high", "low", "close", "volume")
    return bars.select("symbol", "currency", F.to_date(F.timestamp_seconds("b.at")).alias("trade_date"), *[F.col("b")[n].alias(n) for n in names])


def chart_splits(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CHART).json(path).select(F.col("meta.symbol").alias("symbol"), F.explode(F.map_values("events.splits")).alias("s"))
    return rows.select("symbol", F.to_date(F.timestamp_seconds("s.date")).alias("ex_date"), F.col("s.denominator").alias("split_from"), F.col("s.numerator").alias("split_to"))


def chart_history(spark: SparkSession, path: str, currency: str = "JPY", zone: str = "Asia/Tokyo") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars as traded with turnover, splits as actions, refused: symbol, currency) of chart JSON lines.

    Chart prices are adjusted for every later split; bars without a close are no sessions; a chart in
    another currency is refused whole.  Days are those of the market's zone.
    """
    from ..operators.restate import as_traded

    charts = spark.read.schema(CHART).json(path).select(F.col("meta.symbol").alias("symbol"), F.col("meta.currency").alias("currency"), "timestamp", F.get("indicators.quote", F.lit(0)).alias("q"), "events")
    other = F.coalesce(F.col("currency") != currency, F.lit(False))
    good = charts.where(~other)
    day = lambda stamp: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(stamp), zone))
    names = ("open", "high", "low", "close", "volume")
    # By position: a chart may lack an array, or have one that is too short.
    each = good.select("symbol", "q", F.posexplode("timestamp").alias("n", "at"))
    bars = each.select("symbol", day(F.col("at")).alias("trade_date"), *[F.get(f"q.{x}", F.col("n")).cast("double").alias(x) for x in names]).where("close IS NOT NULL AND trade_date IS NOT NULL")
    splits = good.select("symbol", F.explode(F.map_values("events.splits")).alias("s")).select("symbol", day(F.col("s.date")).alias("ex_date"), F.col("s.denominator").alias("split_from"), F.col("s.numerator").alias("split_to"))
    actions = splits.withColumns({"action_type": F.when(F.col("split_to") >= F.col("split_from"), "SPLIT").otherwise("REVERSE_SPLIT"), "adjustment_factor": F.lit(None).cast("double")})
    out = as_traded(bars, actions.where("split_from > 0 AND split_to > 0"))
    return out.withColumn("turnover", F.col("close") * F.col("volume")).select("symbol", "trade_date", *names, "turnover"), actions, charts.where(other).select("symbol", "currency")
