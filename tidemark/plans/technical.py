"""Bars, indicators, restated series, features and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as i
from ..operators import features as ft
from ..operators import restate as rs
from ..sources import market as m
from .registry import q, query, sq

W = "WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)"


def frame(n: int, offset: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1 + offset} PRECEDING AND {f'{offset} PRECEDING' if offset else 'CURRENT ROW'})"


def guard(value: str, x: str, n: int, offset: int = 0) -> str:
    f = frame(n, offset)
    return f"CASE WHEN count(*) OVER {f} = {n} AND count({x}) OVER {f} = {n} THEN {value} OVER {f} END"


@query("bars_daily", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, open, high, low, close, volume, turnover FROM bars")
def bars_daily(spark, d):
    return m.bars(spark, d)


@query("sma_guarded", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, {', '.join(f'{sq(guard("avg(close)", "close", n))} AS sma{n}' for n in (5, 25, 75))} FROM bars")
def sma_guarded(spark, d):
    rows = i.with_rolling(m.bars(spark, d).select("symbol", "trade_date", "close"), **{f"sma{n}": ("mean", "close", n) for n in (5, 25, 75)})
    return rows.select("symbol", "trade_date", *[q(n, n) for n in ("sma5", "sma25", "sma75")])


@query("rolling_extremes", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, {guard('max(high)', 'high', 20)} AS high20, {guard('min(low)', 'low', 20)} AS low20, {guard('max(close)', 'close', 60)} AS close60 FROM bars")
def rolling_extremes(spark, d):
    rows = i.with_rolling(m.bars(spark, d).select("symbol", "trade_date", "high", "low", "close"), high20=("max", "high", 20), low20=("min", "low", 20), close60=("max", "close", 60))
    return rows.select("symbol", "trade_date", "high20", "low20", "close60")


@query("returns_multi", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, {', '.join(f'{sq(f"(close - lag(close, {k}) OVER o) / nullif(lag(close, {k}) OVER o, 0) * 100")} AS ret{k}' for k in (1, 5, 20))} FROM bars {W}")
def returns_multi(spark, d):
    return m.bars(spark, d).select("symbol", "trade_date", *[q(i.pct_change("close", k), f"ret{k}") for k in (1, 5, 20)])


@query(
    "bars_since_high",
    f"""WITH {m.BARS_SQL}, s AS (SELECT *, row_number() OVER o AS seq FROM bars {W}),
    l AS (SELECT symbol, trade_date, seq, list(struct_pack(h := high, s := seq)) OVER {frame(20)} AS xs FROM s)
    SELECT symbol, trade_date, CASE WHEN len(xs) = 20 THEN seq - list_max(xs).s END AS bars_since_high20 FROM l""",
)
def bars_since_high(spark, d):
    rows = i.with_rolling(m.bars(spark, d).select("symbol", "trade_date", "high"), bars_since_high20=("since_max", "high", 20))
    return rows.select("symbol", "trade_date", "bars_since_high20")


TR_SQL = "CASE WHEN row_number() OVER o = 1 THEN high - low WHEN lag(close) OVER o IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END"


@query("true_range", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, {sq(TR_SQL)} AS tr FROM bars {W}")
def true_range(spark, d):
    return m.bars(spark, d).select("symbol", "trade_date", q(i.true_range(), "tr"))


@query(
    "bollinger_20",
    f"""WITH {m.BARS_SQL}, s AS (
      SELECT symbol, trade_date, close, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS holes,
        {guard('avg(close)', 'close', 20)} AS mid, {guard('stddev_pop(close)', 'close', 20)} AS dev FROM bars
    ) SELECT symbol, trade_date, {sq('CASE WHEN holes = 0 THEN 4 * dev / mid END')} AS bb_width,
      {sq('CASE WHEN holes = 0 AND dev > 1e-9 THEN (close - mid + 2 * dev) / (4 * dev) END')} AS bb_percent FROM s""",
)
def bollinger_20(spark, d):
    rows = i.with_bollinger(m.bars(spark, d).select("symbol", "trade_date", "close"), "close")
    return rows.select("symbol", "trade_date", q("bb_width", "bb_width"), q(F.when(F.col("bb_upper") - F.col("bb_lower") > 4e-9, F.col("bb_percent")), "bb_percent"))


@query(
    "realized_vol",
    f"""WITH {m.BARS_SQL}, s AS (SELECT symbol, trade_date, CASE WHEN close > 0 AND lag(close) OVER o > 0 THEN ln(close / lag(close) OVER o) END AS r, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS holes FROM bars {W}),
    v AS (SELECT symbol, trade_date, CASE WHEN holes = 0 THEN {guard('stddev_samp(r)', 'r', 20)} END AS daily FROM s) SELECT symbol, trade_date, {sq('sqrt(252.0) * daily')} AS vol20, {sq('daily')} AS daily20 FROM v""",
)
def realized_vol(spark, d):
    rows = m.bars(spark, d).withColumn("r", i.log_return("close"))
    return rows.select("symbol", "trade_date", q(i.realised_volatility("r", 20), "vol20"), q(i.realised_volatility("r", 20, yearly=False), "daily20"))


@query("relative_volume", f"WITH {m.BARS_SQL} SELECT symbol, trade_date, {', '.join(f'{sq(f"volume / nullif({guard("avg(volume)", "volume", n, 1)}, 0)")} AS rvol{n}' for n in (5, 20))}, {sq(f"turnover / nullif({guard("avg(turnover)", "turnover", 20, 1)}, 0)")} AS turnover_rvol FROM bars")
def relative_volume(spark, d):
    return m.bars(spark, d).select("symbol", "trade_date", *[q(i.relative_volume("volume", n), f"rvol{n}") for n in (5, 20)], q(i.relative_volume("turnover", 20), "turnover_rvol"))


@query(
    "candle_shape",
    f"""WITH {m.BARS_SQL} SELECT symbol, trade_date, {sq('CASE WHEN high > low AND close IS NOT NULL THEN (greatest(open, close) - least(open, close)) / (high - low) * 100 END')} AS body_pct,
      {sq('CASE WHEN high > low AND close IS NOT NULL THEN (high - greatest(open, close)) / (high - low) * 100 END')} AS upper_wick_pct,
      {sq('CASE WHEN high > low AND close IS NOT NULL THEN (least(open, close) - low) / (high - low) * 100 END')} AS lower_wick_pct,
      {sq('CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) END')} AS clv FROM bars""",
)
def candle_shape(spark, d):
    return m.bars(spark, d).select("symbol", "trade_date", *[q(v, k) for k, v in i.candle().items()])


@query(
    "up_streak",
    f"""WITH {m.BARS_SQL}, s AS (SELECT symbol, trade_date, row_number() OVER o AS seq, coalesce(close > lag(close) OVER o, false) AS rises, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS holes FROM bars {W})
    SELECT symbol, trade_date, CASE WHEN holes = 0 AND seq >= 2 THEN seq - max(CASE WHEN NOT rises THEN seq ELSE 0 END) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) END AS up_streak FROM s""",
)
def up_streak(spark, d):
    w = i.by_symbol()
    rows = m.bars(spark, d).withColumns({"seq": F.row_number().over(w).cast("long"), "rises": F.coalesce(F.col("close") > F.lag("close").over(w), F.lit(False))})
    return rows.select("symbol", "trade_date", i.up_streak().alias("up_streak"))


def arrays(spark, d):
    return m.bars(spark, d).where("close is not null").groupBy("symbol").agg(i.series("high", "low", "close").alias("bars"))


def _fold_sql(n: int, seed: str, rest: str, step: str) -> str:
    return f"CASE WHEN len(xs) >= {n} THEN list_reduce(list_concat([{seed}], {rest}), lambda a, x: {step}) END"


SERIES_SQL = "p AS (SELECT symbol, list(close ORDER BY trade_date) AS xs, list(high ORDER BY trade_date) AS hs, list(low ORDER BY trade_date) AS ls FROM bars WHERE close IS NOT NULL GROUP BY symbol)"


@query("ema_12", f"WITH {m.BARS_SQL}, {SERIES_SQL} SELECT symbol, {sq(_fold_sql(12, 'list_sum(xs[1:12]) / 12', 'xs[13:]', '(x - a) * (2.0::DOUBLE / 13) + a'))} AS ema12 FROM p")
def ema_12(spark, d):
    return arrays(spark, d).select("symbol", q(i.ema_of(F.col("bars.close"), 12), "ema12"))


@query(
    "rsi_14",
    f"""WITH {m.BARS_SQL}, {SERIES_SQL}, c AS (SELECT symbol, xs, [xs[k + 1] - xs[k] FOR k IN range(1, len(xs))] AS ds FROM p),
    g AS (SELECT symbol, [greatest(x, 0) FOR x IN ds] AS gs, [greatest(-x, 0) FOR x IN ds] AS ls FROM c),
    f AS (SELECT symbol, {_fold_sql(14, 'list_sum(gs[1:14]) / 14', 'gs[15:]', '(a * 13 + x) / 14').replace('len(xs)', 'len(gs)')} AS gain,
      {_fold_sql(14, 'list_sum(ls[1:14]) / 14', 'ls[15:]', '(a * 13 + x) / 14').replace('len(xs)', 'len(ls)')} AS loss FROM g)
    SELECT symbol, {sq('CASE WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END')} AS rsi14 FROM f""",
)
def rsi_14(spark, d):
    return arrays(spark, d).select("symbol", q(i.rsi_of(F.col("bars.close")), "rsi14"))


@query(
    "atr_14",
    f"""WITH {m.BARS_SQL}, k AS (SELECT * FROM bars WHERE close IS NOT NULL), t AS (SELECT symbol, trade_date, {TR_SQL} AS tr, row_number() OVER o AS seq FROM k {W}),
    p AS (SELECT symbol, list(tr ORDER BY trade_date) FILTER (WHERE seq > 1) AS xs FROM t GROUP BY symbol)
    SELECT symbol, {sq(_fold_sql(14, 'list_sum(xs[1:14]) / 14', 'xs[15:]', '(a * 13 + x) / 14'))} AS atr14 FROM p""",
)
def atr_14(spark, d):
    known = m.bars(spark, d).where("close is not null").withColumns({"tr": i.true_range(), "seq": F.row_number().over(i.by_symbol())})
    path = known.where("seq > 1").groupBy("symbol").agg(i.series("tr").alias("bars"))
    first = known.select("symbol").distinct()
    return first.join(path, "symbol", "left").select("symbol", q(i.wilder_of(F.col("bars.tr"), 14), "atr14"))


def _smooth(state: str, x: str, k: str, n: int, alpha: str) -> str:
    """A recursive mean in SQL: a sum up to the n-th value, their mean there, folded after it."""
    return f"CASE WHEN {k} < {n} THEN {state} + {x} WHEN {k} = {n} THEN ({state} + {x}) / {n} ELSE ({x} - {state}) * {alpha} + {state} END"


PATH_SQL = f"""n AS (SELECT symbol, trade_date, row_number() OVER o AS k, close, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr, high - lag(high) OVER o AS rise, lag(low) OVER o - low AS fall FROM bars WHERE close IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
v AS (SELECT symbol, trade_date, k, close, tr, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0.0 END AS up, CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0.0 END AS down FROM n),
s AS (SELECT symbol, 0::BIGINT AS k, NULL::DATE AS trade_date, 0.0::DOUBLE AS f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS st, 0.0::DOUBLE AS su, 0.0::DOUBLE AS sd, NULL::DOUBLE AS pdi, NULL::DOUBLE AS mdi, 0::BIGINT AS ac, 0.0::DOUBLE AS ax FROM (SELECT DISTINCT symbol FROM v)
  UNION ALL SELECT symbol, k, trade_date, f, w, sg, st, su, sd, pdi, mdi, CASE WHEN dx IS NULL THEN ac ELSE ac + 1 END, CASE WHEN dx IS NULL THEN ax ELSE {_smooth('ax', 'dx', '(ac + 1)', 14, '(1.0::DOUBLE / 14)')} END FROM (
    SELECT *, CASE WHEN k >= 26 THEN {_smooth('sg0', '(f - w)', '(k - 25)', 9, '(2.0::DOUBLE / 10)')} ELSE 0.0 END AS sg, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi IS NOT NULL THEN 0.0 END AS dx FROM (
      SELECT *, CASE WHEN k >= 15 AND st <> 0 THEN 100 * su / st END AS pdi, CASE WHEN k >= 15 AND st <> 0 THEN 100 * sd / st END AS mdi FROM (
        SELECT v.symbol, v.k, v.trade_date, {_smooth('s.f', 'v.close', 'v.k', 12, '(2.0::DOUBLE / 13)')} AS f, {_smooth('s.w', 'v.close', 'v.k', 26, '(2.0::DOUBLE / 27)')} AS w, s.sg AS sg0,
          CASE WHEN v.k > 1 THEN {_smooth('s.st', 'v.tr', '(v.k - 1)', 14, '(1.0::DOUBLE / 14)')} ELSE 0.0 END AS st, CASE WHEN v.k > 1 THEN {_smooth('s.su', 'v.up', '(v.k - 1)', 14, '(1.0::DOUBLE / 14)')} ELSE 0.0 END AS su, CASE WHEN v.k > 1 THEN {_smooth('s.sd', 'v.down', '(v.k - 1)', 14, '(1.0::DOUBLE / 14)')} ELSE 0.0 END AS sd, s.ac, s.ax FROM s JOIN v ON v.symbol = s.symbol AND v.k = s.k + 1))))"""


@query("macd_adx", f"WITH RECURSIVE {m.BARS_SQL}, {PATH_SQL} SELECT symbol, trade_date, {sq('CASE WHEN k >= 26 THEN f - w END')} AS macd, {sq('CASE WHEN k >= 34 THEN sg END')} AS macd_signal, {sq('CASE WHEN k >= 34 THEN f - w - sg END')} AS macd_histogram, {sq('pdi')} AS plus_di, {sq('mdi')} AS minus_di, {sq('CASE WHEN ac >= 14 THEN ax END')} AS adx FROM s WHERE k > 0")
def macd_adx(spark, d):
    """MACD(12,26,9) and ADX/DI(14) on every day: recursive, so a fold over each symbol's bars that keeps its path."""
    rows = i.with_recursive_means(m.bars(spark, d).where("close is not null").select("symbol", "trade_date", "high", "low", "close"))
    return rows.select("symbol", "trade_date", q("macd", "macd"), q("macd_signal", "macd_signal"), q("macd_hist", "macd_histogram"), q("plus_di_14", "plus_di"), q("minus_di_14", "minus_di"), q("adx_14", "adx"))


SHARE_SQL = f"{m.ACTIONS_SQL}, acts AS (SELECT symbol, ex_date, coalesce(split_to / nullif(split_from, 0), 1.0 / nullif(adjustment_factor, 0)) AS mult FROM actions WHERE action_type IN ('SPLIT', 'REVERSE_SPLIT', 'STOCK_DIVIDEND'))"
AS_OF = "1998-06-30"


@query(
    "split_restated_series",
    f"""WITH {m.BARS_SQL}, {SHARE_SQL}, bad AS (SELECT DISTINCT symbol FROM acts WHERE mult IS NULL AND ex_date <= DATE '{AS_OF}'),
    k AS (SELECT b.symbol, b.trade_date, any_value(b.close) AS close, any_value(b.volume) AS volume, any_value(b.turnover) AS turnover, coalesce(product(a.mult), 1.0) AS multiplier
      FROM bars b LEFT JOIN acts a ON a.symbol = b.symbol AND a.ex_date > b.trade_date AND a.ex_date <= DATE '{AS_OF}' AND a.mult IS NOT NULL
      WHERE b.trade_date <= DATE '{AS_OF}' GROUP BY b.symbol, b.trade_date)
    SELECT symbol, trade_date, {sq('CASE WHEN bad.symbol IS NULL THEN close / multiplier END')} AS close, {sq('CASE WHEN bad.symbol IS NULL THEN volume * multiplier END')} AS volume, turnover, bad.symbol IS NOT NULL AS refused
    FROM k LEFT JOIN bad USING (symbol)""".replace("SELECT symbol, trade_date, floor((CASE WHEN bad", "SELECT k.symbol, trade_date, floor((CASE WHEN bad"),
)
def split_restated_series(spark, d):
    rows = rs.restate(m.bars(spark, d), m.actions(spark, d), AS_OF)
    return rows.select("symbol", "trade_date", q("close", "close"), q("volume", "volume"), "turnover", "refused")


@query("broken_series", f"WITH {SHARE_SQL} SELECT symbol, count(*) AS unreadable, min(ex_date) AS first_unreadable FROM acts WHERE mult IS NULL GROUP BY symbol")
def broken_series(spark, d):
    bad = rs.share_actions(m.actions(spark, d)).where("multiplier is null")
    return bad.groupBy("symbol").agg(F.count("*").alias("unreadable"), F.min("ex_date").alias("first_unreadable"))


_RATIOS = " ".join(f"WHEN abs(r - {x!r}) / {x!r} <= 0.02 THEN {x!r}::DOUBLE" for x in rs.SPLIT_RATIOS)


@query(
    "suspect_splits",
    f"""WITH {m.BARS_SQL}, {SHARE_SQL}, k AS (SELECT symbol, trade_date, open / nullif(lag(close) OVER o, 0) AS r FROM bars {W}), h AS (SELECT *, CASE {_RATIOS} END AS suspected FROM k)
    SELECT symbol, trade_date, {sq('r')} AS ratio, {sq('suspected')} AS suspected FROM h WHERE suspected IS NOT NULL AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.symbol = h.symbol AND a.ex_date = h.trade_date)""",
)
def suspect_splits(spark, d):
    return rs.suspected_splits(m.bars(spark, d), m.actions(spark, d)).select("symbol", "trade_date", q("ratio", "ratio"), q("suspected", "suspected"))


def feature_rows(spark, d):
    rows = rs.latest_basis(m.bars(spark, d), m.actions(spark, d)).join(m.markets(spark, d), "symbol")
    return ft.features(rows)


_W25 = guard("avg(close)", "close", 25)
FEATURES_SQL = f"""{m.BARS_SQL}, {m.MARKETS_SQL}, {SHARE_SQL},
mul AS (SELECT b.symbol, b.trade_date, coalesce(product(a.mult) FILTER (WHERE a.ex_date > b.trade_date AND a.mult IS NOT NULL), 1.0) AS to_asof, coalesce(bool_or(a.mult IS NULL AND a.ex_date <= b.trade_date AND a.symbol IS NOT NULL), false) AS blocked
  FROM bars b LEFT JOIN acts a ON a.symbol = b.symbol GROUP BY b.symbol, b.trade_date),
basis AS (SELECT symbol, trade_date, open / to_asof AS open, high / to_asof AS high, low / to_asof AS low, close / to_asof AS close, volume * to_asof AS volume, turnover, to_asof, blocked, market_code
  FROM bars JOIN mul USING (symbol, trade_date) JOIN markets USING (symbol)),
f1 AS (SELECT *, row_number() OVER o AS seq, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS holes,
  {_W25} AS sma25, {guard('avg(close)', 'close', 75)} AS sma75, {guard('max(high)', 'high', 5)} AS high5, {guard('min(low)', 'low', 5)} AS low5, {guard('max(high)', 'high', 20)} AS high20, {guard('min(low)', 'low', 20)} AS low20, {guard('avg(close)', 'close', 20)} AS mid, {guard('stddev_pop(close)', 'close', 20)} AS dev,
  (close - lag(close, 1) OVER o) / nullif(lag(close, 1) OVER o, 0) * 100 AS ret1, (close - lag(close, 5) OVER o) / nullif(lag(close, 5) OVER o, 0) * 100 AS ret5, (close - lag(close, 20) OVER o) / nullif(lag(close, 20) OVER o, 0) * 100 AS ret20,
  volume / nullif({guard('avg(volume)', 'volume', 5, 1)}, 0) AS rvol5, volume / nullif({guard('avg(volume)', 'volume', 20, 1)}, 0) AS rvol20,
  {guard('avg(turnover)', 'turnover', 20)} AS turnover20, turnover / nullif({guard('avg(turnover)', 'turnover', 20, 1)}, 0) AS turnover_rvol,
  CASE WHEN high > low AND close IS NOT NULL THEN (least(open, close) - low) / (high - low) * 100 END AS lower_wick_pct, CASE WHEN high > low AND close IS NOT NULL THEN ((close - low) - (high - close)) / (high - low) END AS clv
  FROM basis {W}),
f2 AS (SELECT *, (close - sma25) / nullif(sma25, 0) * 100 AS close_vs_sma25, (high20 - close) / nullif(high20, 0) * 100 AS dist_high20, CASE WHEN holes = 0 THEN 4 * dev / mid END AS bb_width,
  CASE WHEN low5 > 0 AND low20 > 0 THEN ((high5 - low5) / low5 * 100) / nullif((high20 - low20) / low20 * 100, 0) END AS contraction FROM f1),
features AS (SELECT *, min(close_vs_sma25) OVER {frame(5, 1)} AS lowest_gap FROM f2)"""


@query(
    "features_daily",
    f"""WITH {FEATURES_SQL} SELECT symbol, trade_date, market_code, seq, blocked, seq >= 75 AS warm, {', '.join(f'{sq(x)} AS {x}' for x in ('ret1', 'ret5', 'ret20', 'rvol5', 'rvol20', 'close_vs_sma25', 'dist_high20', 'bb_width', 'contraction', 'lower_wick_pct', 'clv', 'turnover_rvol', 'lowest_gap'))},
    {sq('sma25 * to_asof')} AS sma25, {sq('sma75 * to_asof')} AS sma75, {sq('high20 * to_asof')} AS high20 FROM features""",
)
def features_daily(spark, d):
    rows = feature_rows(spark, d)
    names = ("ret1", "ret5", "ret20", "rvol5", "rvol20", "close_vs_sma25", "dist_high20", "bb_width", "contraction", "lower_wick_pct", "clv", "turnover_rvol", "lowest_gap")
    return rows.select("symbol", "trade_date", "market_code", F.col("seq").cast("long").alias("seq"), "blocked", "warm", *[q(n, n) for n in names], *[q(F.col(n) * F.col("to_asof"), n) for n in ("sma25", "sma75", "high20")])


RULES_SQL = {
    "A": "dist_high20 <= 3 AND rvol20 >= 1",
    "B": "close_vs_sma25 >= 0 AND lowest_gap < 0",
    "C": "rvol20 >= 2.5 AND abs(ret1) <= 5",
    "D": "contraction <= 0.6 AND bb_width <= 0.10",
    "E": "lower_wick_pct >= 40 AND clv >= 0.6 AND ret5 <= -5",
    "F": "turnover20 <= CASE WHEN market_code = 'JP' THEN 500000000.0 ELSE 3500000.0 END AND turnover_rvol >= 3",
    "G": "ret5 >= 5 AND ret20 <= 30 AND rvol20 >= 1.5",
    "H": "close_vs_sma25 >= 0 AND dist_high20 BETWEEN 3 AND 15 AND rvol5 <= 1",
}


def _rule_sql(k: str) -> str:
    return f"coalesce(NOT blocked AND seq >= {ft.MIN_BARS[k]} AND {RULES_SQL[k]}, false)"


for _k in RULES_SQL:
    _names = ft.EVIDENCE[_k]

    def _route(spark, d, k=_k, names=_names):
        rows = feature_rows(spark, d)
        return rows.where(ft.route_predicates()[k]).select("symbol", "trade_date", *[q(n, n) for n in names])

    query(f"route_{_k.lower()}", f"WITH {FEATURES_SQL} SELECT symbol, trade_date, {', '.join(f'{sq(n)} AS {n}' for n in _names)} FROM features WHERE {_rule_sql(_k)}")(_route)

_CODES = f"concat_ws(',', {', '.join(f"CASE WHEN {_rule_sql(k)} THEN '{k}' END" for k in RULES_SQL)})"
CANDIDATES_SQL = f"{FEATURES_SQL}, candidates AS (SELECT symbol, trade_date, market_code, {_CODES} AS codes FROM features)"


@query(
    "route_candidates",
    f"""WITH {CANDIDATES_SQL} SELECT symbol, trade_date, codes, len(string_split(codes, ',')) AS n_routes,
    CASE WHEN codes = 'D' THEN 'D_ONLY' WHEN contains(codes, 'D') THEN 'D_PLUS_OTHER' ELSE 'NON_D' END AS subgroup FROM candidates WHERE codes <> ''""",
)
def route_candidates(spark, d):
    rows = ft.evaluate_routes(feature_rows(spark, d)).where(F.size("routes") > 0)
    return rows.select("symbol", "trade_date", F.array_join("routes", ",").alias("codes"), F.size("routes").cast("long").alias("n_routes"), ft.route_d_subgroup().alias("subgroup"))


@query(
    "route_coverage",
    f"WITH {CANDIDATES_SQL} SELECT trade_date, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE contains(codes, '{k}')) AS route_{k.lower()}" for k in RULES_SQL)}, count(*) FILTER (WHERE len(codes) > 1) AS multi FROM candidates GROUP BY trade_date",
)
def route_coverage(spark, d):
    rows = ft.evaluate_routes(feature_rows(spark, d))
    return rows.groupBy("trade_date").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("routes", k)).alias(f"route_{k.lower()}") for k in RULES_SQL], F.count_if(F.size("routes") > 1).alias("multi"))


@query("route_performance", f"WITH {CANDIDATES_SQL}, r AS (SELECT unnest(string_split(codes, ',')) AS route, market_code, symbol FROM candidates WHERE codes <> '') SELECT route, market_code, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM r GROUP BY route, market_code")
def route_performance(spark, d):
    rows = ft.evaluate_routes(feature_rows(spark, d)).select("symbol", "market_code", F.explode("routes").alias("route"))
    return rows.groupBy("route", "market_code").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("n_symbols"))


S0 = "1997-06-16"


@query("screen_s0", f"WITH {CANDIDATES_SQL}, s AS (SELECT symbol, codes, blocked FROM candidates JOIN (SELECT symbol, trade_date, blocked FROM features) USING (symbol, trade_date) WHERE trade_date = DATE '{S0}') SELECT symbol, codes, CASE WHEN blocked IS NULL THEN 'NO_BAR_ON_DATE' WHEN blocked THEN 'REFUSED' WHEN codes <> '' THEN 'PASSED' ELSE 'NOT_PASSED' END AS outcome FROM markets LEFT JOIN s USING (symbol)")
def screen_s0(spark, d):
    """Every symbol screened on one date, from what was there by then."""
    day = F.lit(S0).cast("date")
    bars = rs.latest_basis(m.bars(spark, d).where(F.col("trade_date") <= day), m.actions(spark, d).where(F.col("ex_date") <= day))
    markets = m.markets(spark, d)
    return ft.screen_at(bars.join(markets, "symbol"), markets, S0).select("symbol", F.array_join("routes", ",").alias("codes"), "outcome")
