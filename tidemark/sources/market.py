"""Market inputs derived from the sample tables: daily bars, markets, corporate actions, FX legs.

Nulls, gaps and unreadable actions, which the tables do not hold, are put in by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x) -> F.Column:
    """Two decimals by floor, which engines agree on."""
    return F.floor(x * 100) / 100


def bars(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(symbol, trade_date, open, high, low, close, volume, turnover): trades of a supplier's lines by ship date.

    The first and last trade of a day are told by one number, order * 1000 + line (an order has fewer lines), so the
    aggregate hashes.  The close is null where symbol % 13 = 0 on a 7th, the turnover where symbol % 11 = 0.

    parts: lines are dealt by symbol to so many partitions, and bars stay there.  A line is narrower than the halves of a
    bar, so what takes a symbol's bars together shuffles once, and less.
    """
    line = table(spark, sf_dir, "lineitem")
    trades = line.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("at"), "l_quantity", "l_extendedprice")
    if parts:
        trades = trades.repartition(parts, "symbol")
    trades = trades.withColumn("price", cents(F.col("l_extendedprice") / F.col("l_quantity")))
    daily = trades.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
        (F.floor(F.sum("l_extendedprice") * 100 + 0.5) / 100).alias("turnover"),
    )
    hole = (F.col("symbol") % 13 == 0) & (F.dayofmonth("trade_date") == 7)
    return daily.withColumns({"close": F.when(~hole, F.col("close")), "turnover": F.when(F.col("symbol") % 11 != 0, F.col("turnover"))})


BARS_SQL = """
trades AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey AS ok, l_linenumber AS ln,
         floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity, l_extendedprice FROM lineitem
), bars AS (
  SELECT symbol, trade_date, first(price ORDER BY ok, ln) AS open, max(price) AS high, min(price) AS low,
         CASE WHEN NOT (symbol % 13 = 0 AND day(trade_date) = 7) THEN last(price ORDER BY ok, ln) END AS close,
         sum(l_quantity) AS volume,
         CASE WHEN symbol % 11 <> 0 THEN floor(sum(l_extendedprice) * 100 + 0.5) / 100 END AS turnover
  FROM trades GROUP BY symbol, trade_date
)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, market_code, currency): suppliers of ASIA are JP in JPY, the others US in USD."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    # 5 regions and 25 nations: fixed dimensions.
    place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    joined = supplier.join(F.broadcast(place), supplier.s_nationkey == nation.n_nationkey)
    japan = F.col("r_name") == "ASIA"
    return joined.select(F.col("s_suppkey").alias("symbol"), F.when(japan, "JP").otherwise("US").alias("market_code"), F.when(japan, "JPY").otherwise("USD").alias("currency"))


MARKETS_SQL = """
markets AS (
  SELECT s_suppkey AS symbol, CASE WHEN r_name = 'ASIA' THEN 'JP' ELSE 'US' END AS market_code,
         CASE WHEN r_name = 'ASIA' THEN 'JPY' ELSE 'USD' END AS currency
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, action_type, ex_date, split_from, split_to, adjustment_factor): splits, an unreadable one, dividends."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("symbol") * 37 % 1500).cast("int"))
    none = F.lit(None).cast("double")
    split = s.where("symbol % 10 = 0").select("symbol", F.lit("SPLIT").alias("action_type"), day.alias("ex_date"), F.lit(1.0).alias("split_from"), F.lit(2.0).alias("split_to"), none.alias("adjustment_factor"))
    second = s.where("symbol % 20 = 0").select("symbol", F.lit("REVERSE_SPLIT").alias("action_type"), F.date_add(day, 200).alias("ex_date"), none.alias("split_from"), none.alias("split_to"), F.lit(4.0).alias("adjustment_factor"))
    bad = s.where("symbol % 37 = 5").select("symbol", F.lit("SPLIT").alias("action_type"), day.alias("ex_date"), none.alias("split_from"), none.alias("split_to"), none.alias("adjustment_factor"))
    cash = s.where("symbol % 10 = 3").select("symbol", F.lit("CASH_DIVIDEND").alias("action_type"), day.alias("ex_date"), none.alias("split_from"), none.alias("split_to"), none.alias("adjustment_factor"))
    return split.unionByName(second).unionByName(bad).unionByName(cash)


ACTIONS_SQL = """
actions AS (
  SELECT s_suppkey AS symbol, 'SPLIT' AS action_type, DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS ex_date, 1.0 AS split_from, 2.0 AS split_to, NULL::DOUBLE AS adjustment_factor
  FROM supplier WHERE s_suppkey % 10 = 0
  UNION ALL SELECT s_suppkey, 'REVERSE_SPLIT', DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) + 200, NULL, NULL, 4.0 FROM supplier WHERE s_suppkey % 20 = 0
  UNION ALL SELECT s_suppkey, 'SPLIT', DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER), NULL, NULL, NULL FROM supplier WHERE s_suppkey % 37 = 5
  UNION ALL SELECT s_suppkey, 'CASH_DIVIDEND', DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER), NULL, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 3
)"""


def fx_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_date, usd_per_eur, jpy_per_eur) from orders of a day; one leg is missing on every 11th and 13th day of the year."""
    o = table(spark, sf_dir, "orders")
    day = o.groupBy(F.to_date("o_orderdate").alias("source_date")).agg(F.count("*").alias("n"))
    n = F.dayofyear("source_date")
    return day.select("source_date", F.when(n % 11 != 0, 1.0 + F.col("n") % 20 / 100).alias("usd_per_eur"), F.when(n % 13 != 0, 120.0 + F.col("n") % 40).alias("jpy_per_eur"))


FX_SQL = """
legs AS (
  SELECT CAST(o_orderdate AS DATE) AS source_date,
    CASE WHEN dayofyear(CAST(o_orderdate AS DATE)) % 11 <> 0 THEN 1.0::DOUBLE + count(*) % 20 / 100::DOUBLE END AS usd_per_eur,
    CASE WHEN dayofyear(CAST(o_orderdate AS DATE)) % 13 <> 0 THEN 120.0::DOUBLE + count(*) % 40 END AS jpy_per_eur
  FROM orders GROUP BY CAST(o_orderdate AS DATE)
)"""
