"""A day's samples and the population of several months, over bars: a close above the bar before is what passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sampling as sp
from ..sources import market as m
from .registry import query

VERSION, SEED = "v1", "42"
POOL_SQL = f"""{m.BARS_SQL}, b AS (SELECT symbol, trade_date, close, coalesce(close > lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), false) AS passed FROM bars WHERE close IS NOT NULL AND symbol % 9 <> 0),
p AS (SELECT *, CASE WHEN passed THEN 'PRIMARY_POOL' ELSE 'CONTROL_POOL' END AS pool, sha256(concat_ws('|', '{VERSION}', '{SEED}', CAST(trade_date AS VARCHAR), CASE WHEN passed THEN 'PRIMARY' ELSE 'CONTROL' END, CAST(symbol AS VARCHAR))) AS selection_key, sha256(concat_ws('|', '{VERSION}', '{SEED}', CAST(trade_date AS VARCHAR), 'ANCHOR', CAST(symbol AS VARCHAR))) AS anchor_key FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY trade_date, pool ORDER BY selection_key) AS rank, count(*) OVER (PARTITION BY trade_date, pool) AS n FROM p), i AS (SELECT *, passed AND rank <= 60 AS is_primary FROM r),
a AS (SELECT *, row_number() OVER (PARTITION BY trade_date, is_primary ORDER BY anchor_key) AS ak FROM i),
pool AS (SELECT symbol, trade_date, pool, selection_key, CASE WHEN passed THEN rank END AS selection_rank, is_primary, CASE WHEN passed THEN least(1.0, 60.0::DOUBLE / n) END AS probability, is_primary AND ak <= least(20, ceil(least(n, 60) * 20 / 60::DOUBLE)) AS is_anchor FROM a)"""


def pool(spark, d):
    bars = m.bars(spark, d).where("close is not null and symbol % 9 <> 0")
    rises = F.col("close") > F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    rows = bars.select("symbol", "trade_date", F.coalesce(rises, F.lit(False)).alias("passed"))
    return sp.candidate_pool(rows, "trade_date", "symbol", "passed", VERSION, SEED)


@query("candidate_pool", f"WITH {POOL_SQL} SELECT * FROM pool")
def candidate_pool(spark, d):
    """Every candidate of every day as it was considered: its pool, key, rank, chance, and whether a control is matched to it."""
    return pool(spark, d).select("symbol", "trade_date", "pool", "selection_key", F.col("selection_rank").cast("long").alias("selection_rank"), "is_primary", "probability", "is_anchor")


@query("sensitivity_subsets", f"WITH {POOL_SQL}, s AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY sha256(concat_ws('|', '{VERSION}', '{SEED}', CAST(trade_date AS VARCHAR), 'SENSITIVITY', CAST(symbol AS VARCHAR)))) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM pool WHERE is_primary) SELECT symbol, trade_date, k <= least(8, n // 10) AS anonymized_pair, k > least(8, n // 10) AND k <= least(8, n // 10) + least(4, n // 20) AS drift_repeat FROM s")
def sensitivity_subsets(spark, d):
    rows = pool(spark, d).where("is_primary").select("symbol", "trade_date")
    return sp.sensitivity(rows.withColumn("sample", F.col("symbol").cast("string")), "trade_date", "sample", VERSION, SEED).drop("sample")


@query("month_dates", f"WITH {m.BARS_SQL}, s AS (SELECT DISTINCT trade_date FROM bars), r AS (SELECT trade_date, row_number() OVER (PARTITION BY date_trunc('month', trade_date) ORDER BY sha256(concat_ws('|', '{SEED}', CAST(trade_date AS VARCHAR)))) AS draw FROM s) SELECT trade_date, draw FROM r WHERE draw <= 3")
def month_dates(spark, d):
    return sp.month_dates(m.bars(spark, d).select("trade_date").distinct(), "trade_date", 3, SEED).select("trade_date", F.col("draw").cast("long").alias("draw"))


DRAW_SQL = f"""{POOL_SQL}, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM bars)),
c AS (SELECT symbol, pool.trade_date, pos, selection_key, row_number() OVER (PARTITION BY symbol ORDER BY selection_key) AS k FROM pool JOIN days ON days.trade_date = pool.trade_date WHERE pool = 'PRIMARY_POOL'),
g AS (SELECT symbol, 0::BIGINT AS k, NULL::DATE AS trade_date, NULL::VARCHAR AS selection_key, false AS kept, []::BIGINT[] AS taken FROM (SELECT DISTINCT symbol FROM c)
  UNION ALL SELECT symbol, k, trade_date, selection_key, ok, CASE WHEN ok THEN list_append(taken, pos) ELSE taken END FROM (SELECT g.symbol, c.k, c.trade_date, c.selection_key, c.pos, g.taken, len(list_filter(g.taken, lambda x: abs(x - c.pos) < 20)) = 0 AS ok FROM g JOIN c ON c.symbol = g.symbol AND c.k = g.k + 1)),
spaced AS (SELECT symbol, trade_date, selection_key FROM g WHERE kept), t AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('month', trade_date) ORDER BY selection_key) AS turn FROM spaced),
drawn AS (SELECT symbol, trade_date, turn FROM t ORDER BY turn, date_trunc('month', trade_date), selection_key LIMIT 200)"""


def population(spark, d):
    """200 samples (the draw's size), one of each month in turn, those of one symbol at least SPACING sessions apart."""
    bars = m.bars(spark, d)
    # Sessions of a market are thousands.
    days = bars.select("trade_date").distinct().withColumn("at", F.row_number().over(Window.orderBy("trade_date")))
    rows = pool(spark, d).where("pool = 'PRIMARY_POOL'").select("symbol", "trade_date", "selection_key").join(F.broadcast(days), "trade_date")
    rows = sp.spaced(rows, "symbol", "at", "selection_key").withColumn("month", F.date_trunc("month", "trade_date"))
    return sp.round_robin(rows, "month", "selection_key", 200).select("symbol", "trade_date", F.col("turn").cast("long").alias("turn"))


@query("population_draw", f"WITH RECURSIVE {DRAW_SQL} SELECT * FROM drawn")
def population_draw(spark, d):
    return population(spark, d)


@query("population_reduced", f"WITH {m.BARS_SQL}, s AS (SELECT symbol, trade_date, CASE WHEN symbol % 3 = 0 THEN 'CONTROL' ELSE 'PRIMARY' END AS cohort, substr(sha256(concat_ws('|', CAST(symbol AS VARCHAR), CAST(trade_date AS VARCHAR), CASE WHEN symbol % 3 = 0 THEN 'CONTROL' ELSE 'PRIMARY' END)), 1, 16) AS sample_id FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sha256(concat_ws('|', 'reduce', sample_id))) AS draw FROM s) SELECT symbol, trade_date, cohort, sample_id, draw FROM r WHERE draw <= CASE cohort WHEN 'PRIMARY' THEN 40 ELSE 15 END")
def population_reduced(spark, d):
    cohort = F.when(F.col("symbol") % 3 == 0, "CONTROL").otherwise("PRIMARY")
    rows = m.bars(spark, d).select("symbol", "trade_date", cohort.alias("cohort"), F.substring(sp.draw_key(F.col("symbol").cast("string"), F.col("trade_date").cast("string"), cohort), 1, 16).alias("sample_id"))
    return sp.reduced(rows, "cohort", "sample_id", {"PRIMARY": 40, "CONTROL": 15}, "reduce").withColumn("draw", F.col("draw").cast("long"))
