"""FX as of a day, latest prices, and the eligibility cascade whose refusals stay visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("ELIGIBLE", "ABOVE_THRESHOLD", "PRICE_MISSING", "STALE_PRICE", "FX_MISSING", "STALE_FX")
THRESHOLD, MAX_PRICE_AGE_DAYS, MAX_FX_AGE_DAYS = 3000.0, 5, 4
#: The sample prices are read as hundredths of a dollar outside Japan.
US_SCALE = 0.01


def fx_cross(legs: DataFrame) -> DataFrame:
    """USDJPY through EUR, six decimals half up; a day with one leg stays, with a null rate and a note."""
    rate = F.floor(F.try_divide("jpy_per_eur", F.nullif("usd_per_eur", F.lit(0.0))) * 1e6 + 0.5) / 1e6
    note = F.when(F.col("usd_per_eur").isNull() & F.col("jpy_per_eur").isNull(), "BOTH_MISSING").when(F.col("usd_per_eur").isNull(), "USD_MISSING").when(F.col("jpy_per_eur").isNull(), "JPY_MISSING")
    return legs.select("source_date", rate.alias("rate"), note.alias("note"))


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, values: list[str], key: list[str] | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it (per key): one sort, no pair is formed.

    Right rows sort before left rows of the same time; a left row without an earlier right row keeps nulls.
    """
    key = key or []
    right_rows = right.select(*key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*values, F.col(right_time).alias("__at")).alias("__v"))
    left_rows = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1)})
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values], F.col("__v.__at").alias(f"{right_time}_used"))


def latest_prices(bars: DataFrame, as_of: str) -> DataFrame:
    """Per symbol the last bar with a close on or before the day."""
    known = bars.where((F.col("trade_date") <= F.lit(as_of).cast("date")) & F.col("close").isNotNull())
    return known.groupBy("symbol").agg(F.max("trade_date").alias("price_date"), F.max_by("close", "trade_date").alias("close"))


def eligibility(symbols: DataFrame, bars: DataFrame, fx: DataFrame, as_of: str) -> DataFrame:
    """One row per symbol: the price used, the rate used, and the first rule that decides."""
    day = F.lit(as_of).cast("date")
    rate = fx.where((F.col("source_date") <= day) & F.col("rate").isNotNull()).agg(F.max("source_date").alias("fx_date"), F.max_by("rate", "source_date").alias("rate"))
    # The rate is one row.
    rows = symbols.join(latest_prices(bars, as_of), "symbol", "left").join(F.broadcast(rate), F.lit(True), "left")
    yen = F.when(F.col("market_code") == "JP", F.col("close")).otherwise(F.floor(F.col("close") * US_SCALE * F.col("rate") * 1e6 + 0.5) / 1e6)
    abroad = F.col("market_code") != "JP"
    outcome = (
        F.when(F.col("close").isNull(), "PRICE_MISSING")
        .when(F.datediff(day, "price_date") > MAX_PRICE_AGE_DAYS, "STALE_PRICE")
        .when(abroad & F.col("rate").isNull(), "FX_MISSING")
        .when(abroad & (F.datediff(day, "fx_date") > MAX_FX_AGE_DAYS), "STALE_FX")
        .when(yen <= THRESHOLD, "ELIGIBLE")
        .otherwise("ABOVE_THRESHOLD")
    )
    return rows.select("symbol", "market_code", "price_date", yen.alias("price_jpy"), outcome.alias("outcome"))
