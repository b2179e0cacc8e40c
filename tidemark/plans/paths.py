"""Paths over daily bars, intraday bars and trades: a session is a symbol's month, its bars are days, its trades the lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import paths as pa
from ..sources import market as m
from .registry import q, query, sq

KEYS = ["symbol", "period"]

# An episode every 24 months of a symbol: S0 is entered at its 10th, noon, at the month's opening price.
FACTS_SQL = """
t AS (SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate)::DATE AS period, l_shipdate::DATE + INTERVAL 9 HOUR + (l_linenumber % 2) * INTERVAL 6 HOUR AS ts, floor(l_extendedprice / l_quantity * 100) / 100 AS price FROM lineitem),
k AS (SELECT symbol, period, arg_min(price, (ts, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, price)) AS close, row_number() OVER (PARTITION BY symbol ORDER BY period) - 1 AS k FROM t GROUP BY symbol, period),
o AS (SELECT *, symbol * 1000 + k // 24 AS episode_id, k % 24 AS idx, first_value(open) OVER (PARTITION BY symbol, k // 24 ORDER BY k) AS entry FROM k),
s AS (SELECT symbol, period, episode_id, idx, entry, CASE WHEN NOT (symbol % 13 = 0 AND month(period) = 4) THEN open END AS open, high, low, close, entry * 1.25::DOUBLE AS target, entry * CASE WHEN symbol % 29 = 7 THEN 1.5 ELSE 0.75 END::DOUBLE AS failure,
  CASE WHEN idx = 0 THEN period + INTERVAL 9 DAY + INTERVAL 12 HOUR END AS from_time, symbol % 3 <> 0 AS intraday_exists, symbol % 2 = 0 AS trades_exist FROM o),
tr AS (SELECT * FROM t WHERE symbol % 5 <> 2),
ba AS (SELECT symbol, period, ts::DATE + INTERVAL 9 HOUR AS starts_at, arg_min(price, (ts, price)) AS open, max(price) AS high, min(price) AS low FROM t WHERE symbol % 7 <> 1 AND NOT (symbol % 4 = 3 AND day(ts) > 20) GROUP BY symbol, period, ts::DATE)"""
PATHS_SQL = f"""{FACTS_SQL},
ti AS (SELECT s.symbol, s.period, ts, count(*) AS n, bool_or(price >= target) AS up, bool_or(price <= failure) AS down, max(price) AS top, min(price) AS bottom FROM tr JOIN s ON tr.symbol = s.symbol AND tr.period = s.period WHERE from_time IS NULL OR ts > from_time GROUP BY s.symbol, s.period, ts),
tf AS (SELECT symbol, period, sum(n) AS trades, min(ts) FILTER (WHERE up OR down) AS t_at, max(top) AS t_top, min(bottom) AS t_bottom FROM ti GROUP BY symbol, period),
tg AS (SELECT tf.*, up, down FROM tf LEFT JOIN ti ON tf.symbol = ti.symbol AND tf.period = ti.period AND t_at = ts),
bi AS (SELECT s.symbol, s.period, starts_at, CASE WHEN ba.open >= target THEN 'TARGET_FIRST' WHEN ba.open <= failure THEN 'FAILURE_FIRST' WHEN ba.high >= target AND ba.low <= failure THEN 'AMBIGUOUS_PATH' WHEN ba.high >= target THEN 'TARGET_FIRST' WHEN ba.low <= failure THEN 'FAILURE_FIRST' END AS side, ba.high, ba.low FROM ba JOIN s ON ba.symbol = s.symbol AND ba.period = s.period WHERE from_time IS NULL OR starts_at >= from_time),
bf AS (SELECT symbol, period, count(*) AS bars, min(starts_at) FILTER (WHERE side IS NOT NULL) AS b_at, arg_min(side, starts_at) FILTER (WHERE side IS NOT NULL) AS side, max(high) AS b_top, min(low) AS b_bottom FROM bi GROUP BY symbol, period),
j AS (SELECT s.*, coalesce(trades, 0) AS trades, t_at, t_top, t_bottom, up, down, coalesce(bars, 0) AS bars, b_at, side, b_top, b_bottom, CASE WHEN up AND down THEN 'AMBIGUOUS_PATH' WHEN up THEN 'TARGET_FIRST' WHEN down THEN 'FAILURE_FIRST' END AS t_side, s.high >= target AND s.low <= failure AS both_lines FROM s LEFT JOIN tg ON s.symbol = tg.symbol AND s.period = tg.period LEFT JOIN bf ON s.symbol = bf.symbol AND s.period = bf.period),
rung AS (SELECT *, CASE WHEN failure >= target THEN 'refused'
  WHEN from_time IS NOT NULL THEN CASE WHEN trades > 0 THEN 'trade' WHEN bars > 0 THEN 'bar' WHEN NOT intraday_exists AND NOT trades_exist THEN 'unknowable' ELSE 'missing' END
  WHEN open >= target OR open <= failure THEN 'open' WHEN open IS NULL THEN 'missing' WHEN NOT both_lines THEN 'day'
  WHEN bars > 0 AND side IS NULL THEN 'missing' WHEN bars > 0 AND side <> 'AMBIGUOUS_PATH' THEN 'bar' WHEN bars = 0 AND intraday_exists THEN 'missing'
  WHEN trades > 0 THEN 'trade' WHEN NOT trades_exist THEN 'unknowable' ELSE 'missing' END AS rung FROM j),
paths AS (SELECT symbol, period, episode_id, idx, entry, CASE rung WHEN 'refused' THEN 'REFUSED_LINES' WHEN 'missing' THEN 'UNRESOLVED_MISSING_DATA' WHEN 'unknowable' THEN 'AMBIGUOUS_PATH' WHEN 'trade' THEN t_side WHEN 'bar' THEN side WHEN 'open' THEN CASE WHEN open >= target THEN 'TARGET_FIRST' ELSE 'FAILURE_FIRST' END WHEN 'day' THEN CASE WHEN high >= target THEN 'TARGET_FIRST' WHEN low <= failure THEN 'FAILURE_FIRST' END END AS resolution,
  CASE WHEN rung = 'trade' AND t_side IS NOT NULL THEN 'TRADE' WHEN rung = 'bar' AND side IS NOT NULL OR rung = 'unknowable' THEN 'INTRADAY_BAR' WHEN rung = 'open' THEN 'SESSION_OPEN' WHEN rung = 'day' AND (high >= target OR low <= failure) THEN 'DAY' END AS granularity,
  CASE rung WHEN 'trade' THEN t_at WHEN 'bar' THEN b_at END AS decided_at, CASE WHEN from_time IS NULL THEN high ELSE greatest(t_top, b_top) END AS top, CASE WHEN from_time IS NULL THEN low ELSE least(t_bottom, b_bottom) END AS bottom,
  coalesce(CASE WHEN from_time IS NULL THEN high ELSE greatest(t_top, b_top) END >= target, false) AS touched_target FROM rung)"""


def facts(spark, d):
    """(sessions, bars, trades) of the sample tables."""
    at = F.timestamp_add("HOUR", (9 + F.col("l_linenumber") % 2 * 6).cast("int"), F.to_date("l_shipdate").cast("timestamp"))
    trades = m.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "month").alias("period"), at.alias("at"), m.cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    order = F.struct("at", "price")
    months = trades.groupBy(*KEYS).agg(F.min(order).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(order).alias("last"))
    k = months.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("period")) - 1)
    block = F.floor(F.col("k") / 24)
    entry = F.first("first.price").over(Window.partitionBy("symbol", block).orderBy("k"))
    s = F.col("symbol")
    sessions = k.select(*KEYS, (s * 1000 + block).alias("episode_id"), (F.col("k") % 24).alias("idx"), entry.alias("entry"), F.when(~((s % 13 == 0) & (F.month("period") == 4)), F.col("first.price")).alias("open"), "high", "low", F.col("last.price").alias("close"))
    noon = F.timestamp_add("HOUR", F.lit(9 * 24 + 12), F.col("period").cast("timestamp"))
    sessions = sessions.select("*", (F.col("entry") * 1.25).alias("target"), (F.col("entry") * F.when(s % 29 == 7, 1.5).otherwise(0.75)).alias("failure"), F.when(F.col("idx") == 0, noon).alias("from_time"), (s % 3 != 0).alias("intraday_exists"), (s % 2 == 0).alias("trades_exist"))
    held = trades.where((s % 7 != 1) & ~((s % 4 == 3) & (F.dayofmonth("at") > 20)))
    bars = held.groupBy(*KEYS, F.timestamp_add("HOUR", F.lit(9), F.to_date("at").cast("timestamp")).alias("starts_at")).agg(F.min(order).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"))
    return sessions, bars.select(*KEYS, "starts_at", F.col("first.price").alias("open"), "high", "low"), trades.where(s % 5 != 2)


@query("session_paths", f"WITH {PATHS_SQL} SELECT symbol, period, resolution, granularity, decided_at, top, bottom, touched_target FROM paths")
def session_paths(spark, d):
    """Every session's path; the first of an episode counts only what came after its entry."""
    out = pa.resolve(*facts(spark, d), KEYS)
    return out.select(*KEYS, "resolution", "granularity", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"), "top", "bottom", "touched_target")


@query(
    "episode_paths",
    f"""WITH {PATHS_SQL},
    g AS (SELECT episode_id, count(*) AS observed, max(idx) AS last_idx, min(idx) FILTER (WHERE resolution IS NOT NULL) AS di, arg_min(resolution, idx) FILTER (WHERE resolution IS NOT NULL) AS dr, min(idx) FILTER (WHERE touched_target) AS hit_idx, max((top - entry) / entry) AS mfe, min((bottom - entry) / entry) AS mae FROM paths WHERE idx <= 20 GROUP BY episode_id),
    d AS (SELECT g.*, CASE WHEN g.episode_id % 3 = 0 THEN (g.episode_id % 5)::INTEGER END AS at_idx, p.granularity AS dg, p.decided_at AS da, h.resolution AS hr, h.decided_at AS ha FROM g LEFT JOIN paths p ON p.episode_id = g.episode_id AND p.idx = di LEFT JOIN paths h ON h.episode_id = g.episode_id AND h.idx = hit_idx),
    f AS (SELECT *, di IS NOT NULL AND (at_idx IS NULL OR di <= at_idx) AS first, coalesce(last_idx > at_idx, false) AS invalid FROM d)
    SELECT episode_id, CASE WHEN first THEN CASE dr WHEN 'TARGET_FIRST' THEN 'TARGET_HIT' WHEN 'FAILURE_FIRST' THEN 'INITIAL_FAILURE_HIT' ELSE dr END WHEN invalid THEN 'THESIS_INVALIDATED' WHEN observed > 20 THEN 'HORIZON_EXPIRED' END AS "primary",
      CASE WHEN first THEN di WHEN invalid THEN at_idx WHEN observed > 20 THEN 20 END::BIGINT AS stop_idx, CASE WHEN first THEN dr WHEN NOT invalid AND observed > 20 THEN 'NEITHER_BY_HORIZON' END AS path_resolution, CASE WHEN first THEN dg END AS granularity, CASE WHEN first THEN da END AS resolved_at,
      CASE WHEN NOT first AND NOT invalid AND observed <= 20 THEN 'HORIZON_INCOMPLETE' END AS pending, dr AS first_resolution, CASE WHEN hit_idx IS NOT NULL THEN true WHEN observed > 20 THEN false END AS later_target_hit, hit_idx::BIGINT AS hit_idx, CASE WHEN hr = 'TARGET_FIRST' THEN ha END AS hit_at, {sq('mfe')} AS mfe, {sq('mae')} AS mae, observed FROM f""",
)
def episode_paths(spark, d):
    """Both layers of an episode every 24 sessions; a third of them are called off at a fixed session."""
    sessions = pa.resolve(*facts(spark, d), KEYS)
    called_off = sessions.where("episode_id % 3 = 0").select("episode_id", (F.col("episode_id") % 5).cast("int").alias("at_idx")).distinct()
    out = pa.episodes(sessions, called_off)
    return out.withColumns({"mfe": q("mfe"), "mae": q("mae")} | {x: F.col(x).cast("timestamp_ntz") for x in ("resolved_at", "hit_at")})
