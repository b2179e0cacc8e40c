"""Chart measurements at each symbol's last bar, and concepts with what speaks for and against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as co
from ..sources import market as m
from .registry import q, query, sq
from .technical import PATH_SQL

# Volume can't be brought to one share count for every ninth symbol.
MEASURES_SQL = f"""WITH RECURSIVE {m.BARS_SQL.replace("bars AS (", "raw AS (")}, bars AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS holes FROM raw) WHERE holes = 0), {PATH_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER o AS before, lag(high) OVER o AS high0, lead(high) OVER o AS high2, lag(low) OVER o AS low0, lead(low) OVER o AS low2, ln(close / lag(close) OVER o) AS r FROM raw WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
a AS (SELECT symbol, n, symbol % 9 <> 4 AS comparable, min(back) FILTER (WHERE NOT coalesce(close < before, false)) - 1 AS run, max(high) FILTER (WHERE back <= 20) AS top, arg_max(back, (coalesce(volume, 0), -back)) FILTER (WHERE back <= 60) AS anchor, max(volume) FILTER (WHERE back <= 60) AS heaviest_volume, count(*) - count(close) AS holes,
  {", ".join(f"max({x}) FILTER (WHERE back = 1) AS {x}" for x in ("open", "high", "low", "close", "volume", "before"))}, {", ".join(f"CASE WHEN count(volume) FILTER (WHERE back BETWEEN {x} AND {y}) = {y - x + 1} THEN avg(volume) FILTER (WHERE back BETWEEN {x} AND {y}) END AS {k}" for k, x, y in (("v20", 2, 21), ("v5", 1, 5), ("v10", 6, 10), ("usual", 2, 21), ("usual_now", 1, 20)))},
  list(close ORDER BY trade_date DESC) FILTER (WHERE close IS NOT NULL) AS closes, max(close) FILTER (WHERE back <= 20) AS best, CASE WHEN count(r) FILTER (WHERE back <= 20) = 20 AND count(close) = count(*) THEN stddev_samp(r) FILTER (WHERE back <= 20) END AS realized_vol_20d FROM b GROUP BY symbol, n),
p AS (SELECT a.symbol, min(back) FILTER (WHERE back <= 20 AND b.high = top) AS peak, max(b.volume) FILTER (WHERE back = run) AS run_volume FROM a JOIN b ON a.symbol = b.symbol GROUP BY a.symbol),
vw AS (SELECT a.symbol, avg(b.volume) FILTER (WHERE back BETWEEN peak AND peak + 10) AS advance, avg(b.volume) FILTER (WHERE back < peak) AS retreat, sum((coalesce(b.high, 0) + coalesce(b.low, 0) + coalesce(b.close, 0)) / 3 * coalesce(b.volume, 0)) FILTER (WHERE back <= anchor) AS weighted, sum(b.volume) FILTER (WHERE back <= anchor) AS traded FROM a JOIN p ON a.symbol = p.symbol JOIN b ON a.symbol = b.symbol GROUP BY a.symbol),
pv AS (SELECT symbol, high AS price, coalesce(volume, 0) AS volume FROM b WHERE high >= high0 AND high >= high2 UNION ALL SELECT symbol, low, coalesce(volume, 0) FROM b WHERE low <= low0 AND low <= low2), pk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price, volume) AS k FROM pv),
cl AS (SELECT symbol, k, price, volume::DOUBLE AS volume, price AS first, 1 AS cluster FROM pk WHERE k = 1 UNION ALL SELECT symbol, k, price, volume, CASE WHEN near THEN first ELSE price END, CASE WHEN near THEN cluster ELSE cluster + 1 END FROM (SELECT pk.symbol, pk.k, pk.price, pk.volume, cl.first, cl.cluster, abs(pk.price / cl.first - 1.0::DOUBLE) * 100.0::DOUBLE <= 1.0 AS near FROM cl JOIN pk ON pk.symbol = cl.symbol AND pk.k = cl.k + 1)),
lv AS (SELECT symbol, cluster, sum(price) / count(*) AS price, count(*) AS touches, sum(volume) AS volume FROM cl GROUP BY symbol, cluster),
lx AS (SELECT a.symbol, count(*) AS n_levels, CASE WHEN a.close IS NOT NULL THEN count(*) FILTER (WHERE price > a.close) END AS overhead_levels, max(price) FILTER (WHERE price < a.close) AS nearest_support, arg_max(touches, price) FILTER (WHERE price < a.close) AS nearest_support_touches, min(price) FILTER (WHERE price > a.close) AS nearest_resistance, arg_min(touches, price) FILTER (WHERE price > a.close) AS nearest_resistance_touches,
  arg_max(lv.price, (lv.volume, -lv.price)) FILTER (WHERE price > a.close) AS heavy_price, max(lv.volume) FILTER (WHERE price > a.close) AS heavy_volume, CASE WHEN n >= 5 THEN max(price) FILTER (WHERE price > a.close AND price < best) END AS breakout_level FROM a JOIN lv ON a.symbol = lv.symbol GROUP BY a.symbol, a.close, n),
h1 AS (SELECT b.symbol, min(back) FILTER (WHERE b.close > breakout_level) AS fa, coalesce(min(back) FILTER (WHERE b.close IS NULL), count(*) + 1) AS hole, count(*) AS k FROM b JOIN lx ON b.symbol = lx.symbol WHERE back <= 20 GROUP BY b.symbol),
h2 AS (SELECT b.symbol, coalesce(least(coalesce(min(back) FILTER (WHERE back > fa AND b.close <= breakout_level), any_value(k) + 1), any_value(hole)) - any_value(CASE WHEN fa < hole THEN fa END), 0) AS above FROM b JOIN h1 ON b.symbol = h1.symbol JOIN lx ON b.symbol = lx.symbol WHERE back <= 20 GROUP BY b.symbol),
atr AS (SELECT symbol, arg_max(st, k) AS st, max(k) AS k FROM s GROUP BY symbol),
j AS (SELECT a.*, peak, run_volume, advance, retreat, weighted, traded, lx.* EXCLUDE (symbol), above, CASE WHEN atr.k = a.n AND atr.k >= 15 THEN atr.st END AS atr_14, CASE WHEN len(closes) >= 20 THEN list_avg(closes[1:20]) END AS ma20 FROM a JOIN p ON a.symbol = p.symbol JOIN vw ON a.symbol = vw.symbol LEFT JOIN lx ON a.symbol = lx.symbol LEFT JOIN h2 ON a.symbol = h2.symbol LEFT JOIN atr ON a.symbol = atr.symbol),
w AS (SELECT *, high > 0 AND low > 0 AND close IS NOT NULL AS ranged, comparable AND least(n, 60) >= 5 AND heaviest_volume > 0 AND traded > 0 AS anchor_ok, n >= 10 AND close IS NOT NULL AND top > 0 AS pulled, CASE WHEN volume <> 0 THEN volume / nullif(usual, 0) END AS surge FROM j),
ms AS (SELECT symbol, n, comparable, ranged, anchor_ok, atr_14, n_levels, close,
  run::DOUBLE AS consecutive_down_days, CASE WHEN run >= 2 THEN volume / nullif(run_volume, 0) END AS down_day_volume_decay, CASE WHEN ranged THEN CASE WHEN high > low THEN (least(close, coalesce(open, close)) - low) / (high - low) ELSE 0 END END AS lower_wick_ratio, surge AS capitulation_volume_ratio,
  breakout_level, CASE WHEN breakout_level IS NOT NULL THEN above END::DOUBLE AS bars_above_breakout, CASE WHEN breakout_level IS NOT NULL THEN (close < breakout_level)::INTEGER END::DOUBLE AS closed_back_below, CASE WHEN breakout_level IS NOT NULL THEN surge END AS failure_volume_ratio,
  CASE WHEN pulled THEN (1 - close / top) * 100 END AS pullback_depth_pct, CASE WHEN pulled THEN retreat / nullif(advance, 0) END AS pullback_volume_contraction, (close >= ma20)::INTEGER::DOUBLE AS holding_above_ma20, CASE WHEN pulled THEN peak - 1 END::DOUBLE AS pullback_bars,
  heavy_volume / nullif(usual_now, 0) AS overhead_volume_ratio, overhead_levels::DOUBLE AS overhead_levels, (heavy_price / close - 1) * 100 AS distance_to_heaviest_overhead_pct, CASE WHEN comparable THEN volume / nullif(v20, 0) END AS relative_volume_20d, CASE WHEN comparable AND n >= 10 THEN v5 / nullif(v10, 0) - 1 END AS volume_trend_5d,
  CASE WHEN ranged THEN (high - low) / low * 100 END AS session_range_pct, atr_14 / nullif(close, 0) * 100 AS atr_pct, CASE WHEN anchor_ok THEN weighted / traded END AS anchored_vwap, CASE WHEN anchor_ok THEN (close / (weighted / traded) - 1) * 100 END AS distance_from_anchored_vwap_pct,
  nearest_support, nearest_support_touches::DOUBLE AS nearest_support_touches, nearest_resistance, nearest_resistance_touches::DOUBLE AS nearest_resistance_touches, (high + low + close) / 3 AS session_vwap, (close / ((high + low + close) / 3) - 1) * 100 AS distance_from_session_vwap_pct, CASE WHEN ranged THEN CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END END AS close_position_in_range, (open / nullif(before, 0) - 1) * 100 AS gap_pct, realized_vol_20d FROM w)"""
GAPS_SQL = "concat_ws(',', CASE WHEN n < 75 THEN 'short history' END, CASE WHEN NOT coalesce(ranged, false) THEN 'session range' END, CASE WHEN NOT comparable THEN 'volume not comparable' END, CASE WHEN atr_14 IS NULL THEN 'volatility' END, CASE WHEN n_levels IS NULL OR close IS NULL THEN 'support and resistance' END, CASE WHEN NOT coalesce(anchor_ok, false) THEN 'anchored vwap' END)"


def measured(spark, d):
    return co.measurements(m.bars(spark, d).withColumn("volume_comparable", F.col("symbol") % 9 != 4))


@query("chart_measurements", f"{MEASURES_SQL} SELECT symbol, {', '.join(f'{sq(n)} AS {n}' for n in co.MEASURES)}, {GAPS_SQL} AS gaps FROM ms")
def chart_measurements(spark, d):
    rows = measured(spark, d)
    return rows.select("symbol", *[q(n, n) for n in co.MEASURES], F.array_join("gaps", ",").alias("gaps"))


def _held(concept: str, which: str) -> str:
    """The names of a concept's conditions that hold, fail or can't be told, in order and once each."""
    cases, seen = [], {}
    for k, name, op, bound in co.CONDITIONS:
        if k == concept:
            seen.setdefault(name, []).append(f"coalesce({name} {op} {bound}, NULL)")
    for name, tests in seen.items():
        any_ = {"support": " OR ".join(f"({t})" for t in tests), "against": " OR ".join(f"NOT ({t})" for t in tests), "missing": " OR ".join(f"({t}) IS NULL" for t in tests)}[which]
        cases.append(f"CASE WHEN {any_} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(cases)})"


_ALL = {k: " AND ".join(f"coalesce({n} {op} {x}, false)" for kk, n, op, x in co.CONDITIONS if kk == k) for k in co.SHOWN}
_ROWS = " UNION ALL ".join(f"SELECT symbol, '{k}' AS concept, {_ALL[k]} AS fired, {_held(k, 'support')} AS support, {_held(k, 'against')} AS against, {_held(k, 'missing')} AS missing, CASE WHEN {_ALL[k]} THEN concat_ws(';', {', '.join(f"'{n}=' || coalesce(floor(({n}) * 1000 + 0.5)::BIGINT::VARCHAR, '?')" for n in names)}) END AS evidence FROM ms" for k, names in co.SHOWN.items())


@query("chart_concepts", f"{MEASURES_SQL} {_ROWS}")
def chart_concepts(spark, d):
    """Evidence in thousandths of each measurement shown."""
    rows = co.match(measured(spark, d))
    names = lambda x: F.array_join(F.array_distinct(F.transform(x, lambda s: s["name"])), ",")
    shown = F.array_join(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.floor(e["value"] * 1000 + 0.5).cast("string"), F.lit("?")))), ";")
    return rows.select("symbol", "concept", "fired", names(F.col("support")).alias("support"), names(F.col("against")).alias("against"), F.array_join("missing", ",").alias("missing"), shown.alias("evidence"))
