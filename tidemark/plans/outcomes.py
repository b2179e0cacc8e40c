"""Eligibility, FX, forward outcomes, paths and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import eligibility as el
from ..operators import outcome as oc
from ..sources import market as m
from .registry import q, query, sq

AS_OF = "1999-03-31"
FX_RATE_SQL = f"{m.FX_SQL}, fx AS (SELECT source_date, floor(jpy_per_eur / nullif(usd_per_eur, 0) * 1e6 + 0.5) / 1e6 AS rate, CASE WHEN usd_per_eur IS NULL AND jpy_per_eur IS NULL THEN 'BOTH_MISSING' WHEN usd_per_eur IS NULL THEN 'USD_MISSING' WHEN jpy_per_eur IS NULL THEN 'JPY_MISSING' END AS note FROM legs)"


@query("fx_cross", f"WITH {FX_RATE_SQL} SELECT * FROM fx")
def fx_cross(spark, d):
    return el.fx_cross(m.fx_legs(spark, d))


@query("fx_asof", f"WITH {FX_RATE_SQL}, k AS (SELECT * FROM fx WHERE rate IS NOT NULL), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, day, k.rate AS rate, k.source_date AS source_date_used FROM o ASOF LEFT JOIN k ON o.day >= k.source_date")
def fx_asof(spark, d):
    """Every order with the last rate known on its day, partitioned by year so that no sort holds all rows."""
    fx = el.fx_cross(m.fx_legs(spark, d)).where("rate is not null")
    orders = m.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    days = el.as_of_join(orders.select("day").distinct(), fx, "day", "source_date", ["rate"])  # days: thousands, not rows
    return orders.join(days, "day").select("o_orderkey", "day", "rate", "source_date_used")


@query("latest_price_asof", f"WITH {m.BARS_SQL} SELECT symbol, max(trade_date) AS price_date, arg_max(close, trade_date) AS close FROM bars WHERE close IS NOT NULL AND trade_date <= DATE '{AS_OF}' GROUP BY symbol")
def latest_price_asof(spark, d):
    return el.latest_prices(m.bars(spark, d), AS_OF)


ELIGIBLE_SQL = f"""{m.BARS_SQL}, {m.MARKETS_SQL}, {FX_RATE_SQL},
latest AS (SELECT symbol, max(trade_date) AS price_date, arg_max(close, trade_date) AS close FROM bars WHERE close IS NOT NULL AND trade_date <= DATE '{AS_OF}' GROUP BY symbol),
rate AS (SELECT max(source_date) AS fx_date, arg_max(rate, source_date) AS rate FROM fx WHERE rate IS NOT NULL AND source_date <= DATE '{AS_OF}'),
priced AS (SELECT symbol, market_code, price_date, close, fx_date, rate, CASE WHEN market_code = 'JP' THEN close ELSE floor(close * 0.01::DOUBLE * rate * 1e6 + 0.5) / 1e6 END AS price_jpy FROM markets LEFT JOIN latest USING (symbol) CROSS JOIN rate),
eligible AS (SELECT symbol, market_code, price_date, price_jpy, CASE WHEN close IS NULL THEN 'PRICE_MISSING' WHEN DATE '{AS_OF}' - price_date > 5 THEN 'STALE_PRICE'
  WHEN market_code <> 'JP' AND rate IS NULL THEN 'FX_MISSING' WHEN market_code <> 'JP' AND DATE '{AS_OF}' - fx_date > 4 THEN 'STALE_FX' WHEN price_jpy <= 3000 THEN 'ELIGIBLE' ELSE 'ABOVE_THRESHOLD' END AS outcome FROM priced)"""


def eligible(spark, d):
    return el.eligibility(m.markets(spark, d), m.bars(spark, d), el.fx_cross(m.fx_legs(spark, d)), AS_OF)


@query("eligibility", f"WITH {ELIGIBLE_SQL} SELECT symbol, market_code, price_date, {sq('price_jpy')} AS price_jpy, outcome FROM eligible")
def eligibility(spark, d):
    return eligible(spark, d).withColumn("price_jpy", q("price_jpy"))


@query("eligibility_coverage", f"WITH {ELIGIBLE_SQL} SELECT market_code, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o.lower()}" for o in el.OUTCOMES)} FROM eligible GROUP BY market_code")
def eligibility_coverage(spark, d):
    return eligible(spark, d).groupBy("market_code").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in el.OUTCOMES])


SESSIONS_SQL = "sessions AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, have FROM (SELECT trade_date, count(DISTINCT symbol) AS have FROM bars GROUP BY trade_date) WHERE have >= greatest(1, floor((SELECT count(DISTINCT symbol) FROM bars) * 0.3)))"


@query("sessions_inferred", f"WITH {m.BARS_SQL}, {SESSIONS_SQL} SELECT trade_date, idx FROM sessions")
def sessions_inferred(spark, d):
    return oc.sessions(m.bars(spark, d)).withColumn("idx", F.col("idx").cast("long"))


def _range(a: int, b: int) -> str:
    return f"(PARTITION BY symbol ORDER BY idx RANGE BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


OUTCOME_SQL = f"""{m.BARS_SQL}, {SESSIONS_SQL}, r AS (SELECT b.*, idx, (SELECT max(idx) FROM sessions) AS last FROM bars b JOIN sessions USING (trade_date)),
w AS (SELECT *, count(close) OVER {_range(1, 20)} AS known, max(high) OVER {_range(1, 20)} AS top, max(close) OVER {_range(1, 20)} AS top_close, min(low) OVER {_range(1, 20)} AS bottom,
  list(struct_pack(i := idx, h := high)) OVER {_range(1, 20)} AS path, {', '.join(f'max(close) OVER {_range(k, k)} AS c{k}' for k in (1, 5, 20))} FROM r),
outcomes AS (SELECT symbol, trade_date, CASE WHEN idx + 20 > last THEN 'PENDING' WHEN known < 20 THEN 'UNRESOLVED_MISSING_DATA' ELSE 'RESOLVED' END AS resolution,
  top >= close * 1.2::DOUBLE AS hit_high, top_close >= close * 1.2::DOUBLE AS hit_close, list_min([p.i - idx FOR p IN path IF p.h >= close * 1.2::DOUBLE]) AS first_hit,
  {', '.join(f'(c{k} / close - 1) * 100 AS ret_t{k}' for k in (1, 5, 20))}, (top / close - 1) * 100 AS max_upside, (bottom / close - 1) * 100 AS max_drawdown, 20 - known AS missing FROM w WHERE close IS NOT NULL)"""
OWN_SQL = OUTCOME_SQL.replace("r AS (SELECT b.*, idx, (SELECT max(idx) FROM sessions) AS last FROM bars b JOIN sessions USING (trade_date))", "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS idx, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM bars)")
NUMBERS = ("ret_t1", "ret_t5", "ret_t20", "max_upside", "max_drawdown")


@query("forward_outcome", f"WITH {OUTCOME_SQL} SELECT symbol, trade_date, resolution, hit_high, hit_close, first_hit, missing, {', '.join(f'{sq(n)} AS {n}' for n in NUMBERS)} FROM outcomes")
def forward_outcome(spark, d):
    rows = oc.forward_outcome(m.bars(spark, d))
    return rows.select("symbol", "trade_date", "resolution", "hit_high", "hit_close", F.col("first_hit").cast("long").alias("first_hit"), "missing", *[q(n, n) for n in NUMBERS])


@query("mfe_mae", f"WITH {OWN_SQL} SELECT symbol, count(*) AS n, {sq('max(max_upside)')} AS mfe, {sq('min(max_drawdown)')} AS mae FROM outcomes WHERE resolution = 'RESOLVED' GROUP BY symbol")
def mfe_mae(spark, d):
    rows = oc.forward_outcome(m.bars(spark, d), own_sessions=True).where("resolution = 'RESOLVED'")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), q(F.max("max_upside"), "mfe"), q(F.min("max_drawdown"), "mae"))


LABELS = {"hit_10": "max_upside >= 10", "hit_20": "max_upside >= 20", "hit_30": "max_upside >= 30"}


@query("objective_labels", f"WITH {OWN_SQL} SELECT symbol, trade_date, {', '.join(f"CASE WHEN resolution = 'RESOLVED' THEN {v} END AS {k}" for k, v in LABELS.items())}, CASE WHEN resolution = 'RESOLVED' THEN first_hit END AS days_to_20 FROM outcomes WHERE resolution <> 'PENDING'")
def objective_labels(spark, d):
    rows = oc.forward_outcome(m.bars(spark, d), own_sessions=True).where("resolution <> 'PENDING'")
    sure = F.col("resolution") == "RESOLVED"
    return rows.select("symbol", "trade_date", *[F.when(sure, F.expr(v)).alias(k) for k, v in LABELS.items()], F.when(sure, F.col("first_hit").cast("long")).alias("days_to_20"))


@query("outcome_counts", f"WITH {OUTCOME_SQL} SELECT resolution, count(*) AS n, count(*) FILTER (WHERE hit_high) AS hits, {sq('max(max_upside)')} AS best, {sq('min(max_drawdown)')} AS worst FROM outcomes GROUP BY resolution")
def outcome_counts(spark, d):
    rows = oc.forward_outcome(m.bars(spark, d))
    return rows.groupBy("resolution").agg(F.count("*").alias("n"), F.count_if("hit_high").alias("hits"), q(F.max("max_upside"), "best"), q(F.min("max_drawdown"), "worst"))


PATHS_SQL = """e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, value FROM events WHERE value > 0),
entry AS (SELECT user_id, day, min(ts) AS t0, arg_min(value, ts) AS entry FROM e GROUP BY user_id, day),
touch AS (SELECT e.user_id, e.day, e.ts, e.value >= entry * 1.5::DOUBLE AS up, e.value <= entry * 0.5::DOUBLE AS down FROM e JOIN entry USING (user_id, day) WHERE e.ts > t0),
firsts AS (SELECT user_id, day, min(ts) FILTER (WHERE up OR down) AS at FROM touch GROUP BY user_id, day)"""


@query(
    "path_resolution",
    f"""WITH {PATHS_SQL}, d AS (SELECT t.user_id, t.day, bool_or(up) AS up, bool_or(down) AS down FROM touch t JOIN firsts f ON t.user_id = f.user_id AND t.day = f.day AND t.ts = f.at GROUP BY t.user_id, t.day)
    SELECT n.user_id, n.day, entry, CASE WHEN up AND down THEN 'AMBIGUOUS_PATH' WHEN up THEN 'TARGET_FIRST' WHEN down THEN 'FAILURE_FIRST' ELSE 'NOT_REACHED' END AS resolution FROM entry n LEFT JOIN d USING (user_id, day)""".replace("SELECT n.user_id, n.day,", "SELECT user_id, day,"),
)
def path_resolution(spark, d):
    e = m.table(spark, d, "events").where("value > 0")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("at"), F.col("value").alias("price")))).alias("path"))
    entry = F.col("path")[0]["price"]
    later = F.filter("path", lambda p: p["at"] > F.col("path")[0]["at"])
    return days.select("user_id", "day", entry.alias("entry"), oc.first_touch(later, entry * 1.5, entry * 0.5).alias("resolution"))


@query(
    "liquidity_bands",
    f"""WITH {m.BARS_SQL}, {m.MARKETS_SQL}, t AS (SELECT symbol, market_code, floor(sum(floor(turnover * 100 + 0.5)) / count(turnover)) / 100 AS turnover FROM bars JOIN markets USING (symbol) GROUP BY symbol, market_code),
    k AS (SELECT *, row_number() OVER (PARTITION BY market_code ORDER BY turnover, symbol) - 1 AS r, count(*) OVER (PARTITION BY market_code) AS n FROM t WHERE turnover IS NOT NULL),
    c AS (SELECT market_code, {', '.join(f'max(turnover) FILTER (WHERE r = floor(n * {i} / 4.0)) AS c{i}' for i in (1, 2, 3))} FROM k GROUP BY market_code)
    SELECT symbol, market_code, turnover, 1 + (turnover >= c1)::INTEGER + (turnover >= c2)::INTEGER + (turnover >= c3)::INTEGER AS band FROM k JOIN c USING (market_code)""",
)
def liquidity_bands(spark, d):
    from ..operators import evaluation as ev

    t = m.bars(spark, d).join(m.markets(spark, d), "symbol").groupBy("symbol", "market_code").agg((F.floor(F.try_divide(F.sum(F.floor(F.col("turnover") * 100 + 0.5)), F.count("turnover"))) / 100).alias("turnover"))
    return ev.quartile_bands(t, ["market_code"], "turnover", "symbol").select("symbol", "market_code", "turnover", "band")


SWINGS_SQL = f"""{m.BARS_SQL}, k AS (SELECT * FROM bars WHERE close IS NOT NULL), n AS (SELECT *, lag(high) OVER o AS h0, lead(high) OVER o AS h2, lag(low) OVER o AS l0, lead(low) OVER o AS l2 FROM k WINDOW o AS (PARTITION BY symbol ORDER BY trade_date))"""


def swings(bars):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    rows = bars.where("close is not null").withColumns({"h0": F.lag("high").over(w), "h2": F.lead("high").over(w), "l0": F.lag("low").over(w), "l2": F.lead("low").over(w)})
    high = (F.col("high") >= F.col("h0")) & (F.col("high") >= F.col("h2"))
    low = (F.col("low") <= F.col("l0")) & (F.col("low") <= F.col("l2"))
    pivots = F.filter(F.array(F.when(high, F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"), "volume")), F.when(low, F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price"), "volume"))), lambda x: x.isNotNull())
    return rows.select("symbol", "trade_date", F.explode(pivots).alias("p")).select("symbol", "trade_date", "p.*")


@query("swing_pivots", f"WITH {SWINGS_SQL} SELECT symbol, trade_date, 'HIGH' AS kind, high AS price, volume FROM n WHERE high >= h0 AND high >= h2 UNION ALL SELECT symbol, trade_date, 'LOW', low, volume FROM n WHERE low <= l0 AND low <= l2")
def swing_pivots(spark, d):
    return swings(m.bars(spark, d))


LEVELS_SQL = f"""WITH RECURSIVE {m.BARS_SQL}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE close IS NOT NULL) WHERE back <= 120),
sw AS (SELECT symbol, high, low, volume, lag(high) OVER o AS h0, lead(high) OVER o AS h2, lag(low) OVER o AS l0, lead(low) OVER o AS l2 FROM recent WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
pv AS (SELECT symbol, high AS price, volume FROM sw WHERE high >= h0 AND high >= h2 UNION ALL SELECT symbol, low, volume FROM sw WHERE low <= l0 AND low <= l2), pk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price, volume) AS k FROM pv),
cl AS (SELECT symbol, k, price, volume, price AS anchor, 1 AS cluster FROM pk WHERE k = 1 UNION ALL SELECT pk.symbol, pk.k, pk.price, pk.volume, CASE WHEN pk.price <= cl.anchor * 1.01::DOUBLE THEN cl.anchor ELSE pk.price END, CASE WHEN pk.price <= cl.anchor * 1.01::DOUBLE THEN cl.cluster ELSE cl.cluster + 1 END FROM cl JOIN pk ON pk.symbol = cl.symbol AND pk.k = cl.k + 1),
lv AS (SELECT symbol, cluster, sum(price) / count(*) AS level, sum(volume) AS volume FROM cl GROUP BY symbol, cluster), la AS (SELECT symbol, close AS last FROM recent WHERE back = 1)
SELECT lv.symbol, last, {sq('max(level) FILTER (WHERE level < last)')} AS support, {sq('min(level) FILTER (WHERE level > last)')} AS resistance, {sq('arg_max(level, (volume, -level)) FILTER (WHERE level > last)')} AS heaviest_above, count(*) AS levels FROM lv JOIN la ON la.symbol = lv.symbol GROUP BY lv.symbol, last"""


@query("support_resistance", LEVELS_SQL)
def support_resistance(spark, d):
    """Levels: pivots of the last 120 bars in order of price, a new cluster where a price is over 1 % above the cluster's first.

    Of equally heavy levels above the price, the nearest is the heaviest.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    recent = m.bars(spark, d).where("close is not null").withColumn("back", F.row_number().over(w)).where("back <= 120")
    close = recent.where("back = 1").select("symbol", F.col("close").alias("last"))
    points = swings(recent).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("price", "volume"))).alias("ps"))
    kind = "array<struct<anchor:double,total:double,n:bigint,volume:double>>"

    def add(levels, p):
        top = F.element_at(levels, -1)
        new = F.struct(p["price"].alias("anchor"), p["price"].alias("total"), F.lit(1).cast("long").alias("n"), p["volume"].cast("double").alias("volume"))
        grown = F.struct(top["anchor"].alias("anchor"), (top["total"] + p["price"]).alias("total"), (top["n"] + 1).alias("n"), (top["volume"] + p["volume"]).alias("volume"))
        joins = (F.size(levels) > 0) & (p["price"] <= F.coalesce(top["anchor"], F.lit(0.0)) * 1.01)
        return F.when(joins, F.concat(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(levels, F.array(new))).cast(kind)

    levels = points.withColumn("levels", F.aggregate("ps", F.array().cast(kind), add)).select("symbol", F.explode("levels").alias("l")).select("symbol", (F.col("l.total") / F.col("l.n")).alias("level"), F.col("l.n").alias("touches"), F.col("l.volume").alias("volume"))
    rows = levels.join(close, "symbol")
    return rows.groupBy("symbol", "last").agg(q(F.max(F.when(F.col("level") < F.col("last"), F.col("level"))), "support"), q(F.min(F.when(F.col("level") > F.col("last"), F.col("level"))), "resistance"), q(F.max_by("level", F.when(F.col("level") > F.col("last"), F.struct("volume", -F.col("level")))), "heaviest_above"), F.count("*").alias("levels"))


@query(
    "anchored_vwap",
    f"""WITH {m.BARS_SQL}, k AS (SELECT symbol, trade_date, (high + low + close) / 3 AS typical, volume, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE close IS NOT NULL),
    a AS (SELECT symbol, arg_max(back, (volume, -back)) AS anchor FROM k WHERE back <= 60 GROUP BY symbol)
    SELECT symbol, anchor - 1 AS anchor_age, CASE WHEN anchor >= 5 THEN {sq('sum(typical * volume) / sum(volume)')} END AS vwap FROM k JOIN a USING (symbol) WHERE back <= anchor GROUP BY symbol, anchor""",
)
def anchored_vwap(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    k = m.bars(spark, d).where("close is not null").withColumns({"back": F.row_number().over(w).cast("long"), "typical": (F.col("high") + F.col("low") + F.col("close")) / 3}).where("back <= 60")
    k = k.withColumn("anchor", F.max_by("back", F.struct("volume", -F.col("back"))).over(Window.partitionBy("symbol")))
    out = k.where("back <= anchor").groupBy("symbol", "anchor").agg(F.try_divide(F.sum(F.col("typical") * F.col("volume")), F.sum("volume")).alias("v"))
    return out.select("symbol", (F.col("anchor") - 1).alias("anchor_age"), F.when(F.col("anchor") >= 5, q("v")).alias("vwap"))


@query(
    "obstacles",
    f"""WITH {m.BARS_SQL}, k AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak, count(*) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n,
      lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) AS c5, avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20, last(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM bars WHERE close IS NOT NULL)
    SELECT symbol, trade_date, high AS price, CASE WHEN high >= c5 * 1.2::DOUBLE THEN 'PRIOR_SURGE_HIGH' WHEN volume > v20 * 1.5::DOUBLE THEN 'SUPPLY_OVERHANG' ELSE 'HORIZONTAL' END AS kind FROM k WHERE n = 5 AND high = peak AND high > latest""",
)
def obstacles(spark, d):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    centre = w.rowsBetween(-2, 2)
    k = m.bars(spark, d).where("close is not null").withColumns({"peak": F.max("high").over(centre), "n": F.count("*").over(centre), "c5": F.lag("close", 5).over(w), "v20": F.avg("volume").over(w.rowsBetween(-19, 0)), "latest": F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    kind = F.when(F.col("high") >= F.col("c5") * 1.2, "PRIOR_SURGE_HIGH").when(F.col("volume") > F.col("v20") * 1.5, "SUPPLY_OVERHANG").otherwise("HORIZONTAL")
    return k.where((F.col("n") == 5) & (F.col("high") == F.col("peak")) & (F.col("high") > F.col("latest"))).select("symbol", "trade_date", F.col("high").alias("price"), kind.alias("kind"))
