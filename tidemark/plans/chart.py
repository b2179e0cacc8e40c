"""Chart readings per symbol at its last bar: volatility expansion, breakouts, and the assessment that joins them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as i
from ..sources import market as m
from . import judgement, outcomes, technical
from .registry import ORACLES, q, query, sq


def priced(spark, d):
    """Bars with a close, numbered backwards from the last."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))).cast("long")
    return m.bars(spark, d).where("close is not null").withColumn("back", back)


def expansion(spark, d):
    rows = priced(spark, d).withColumns({"tr": i.true_range(), "seq": F.row_number().over(i.by_symbol())}).where("seq > 1")
    arrays = rows.groupBy("symbol").agg(F.transform(i.series("tr"), lambda x: x["tr"]).alias("tr"))
    # The last 8 bars have 7 ranges with a close before them.
    short = i.wilder_of(F.when(F.size("tr") >= 7, F.slice("tr", -7, 7)), 5)
    return arrays.select("symbol", F.try_divide(short, i.wilder_of(F.col("tr"), 14)).alias("expansion"))


@query(
    "volatility_expansion",
    f"""WITH {m.BARS_SQL}, k AS (SELECT * FROM bars WHERE close IS NOT NULL), t AS (SELECT symbol, trade_date, {technical.TR_SQL} AS tr, row_number() OVER o AS seq FROM k WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
    p AS (SELECT symbol, list(tr ORDER BY trade_date) AS xs FROM t WHERE seq > 1 GROUP BY symbol), h AS (SELECT symbol, xs, xs[len(xs) - 6 : len(xs)] AS ys FROM p)
    SELECT symbol, {sq("CASE WHEN len(xs) >= 14 THEN list_reduce(list_concat([list_sum(ys[1:5]) / 5], ys[6:]), lambda a, x: (a * 4 + x) / 5) / nullif(list_reduce(list_concat([list_sum(xs[1:14]) / 14], xs[15:]), lambda a, x: (a * 13 + x) / 14), 0) END")} AS expansion FROM h""",
)
def volatility_expansion(spark, d):
    return expansion(spark, d).withColumn("expansion", q("expansion"))


def breakouts(spark, d):
    last, before = F.col("back") <= 20, F.col("back").between(21, 40)
    rows = priced(spark, d).where("back <= 40").groupBy("symbol").agg(F.max(F.when(before, F.col("high"))).alias("level"), F.count_if(before).alias("n"), F.max(F.when(last, F.col("close"))).alias("best"), F.min_by("close", "back").alias("last"))
    cleared = F.col("best") > F.col("level")
    return rows.where("n = 20").select("symbol", "level", cleared.alias("cleared"), (cleared & (F.col("last") < F.col("level"))).alias("lost"))


@query(
    "breakout_state",
    f"""WITH {m.BARS_SQL}, k AS (SELECT symbol, high, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE close IS NOT NULL),
    g AS (SELECT symbol, max(high) FILTER (WHERE back BETWEEN 21 AND 40) AS level, count(*) FILTER (WHERE back BETWEEN 21 AND 40) AS n, max(close) FILTER (WHERE back <= 20) AS best, arg_min(close, back) AS last FROM k GROUP BY symbol)
    SELECT symbol, level, best > level AS cleared, best > level AND last < level AS lost FROM g WHERE n = 20""",
)
def breakout_state(spark, d):
    return breakouts(spark, d)


def _assessment_sql() -> str:
    """The queries that the assessment joins, each as its own SQL."""
    o = ORACLES
    concepts = {"FAILED_BREAKOUT": "lost", "BREAKOUT_RETEST": "cleared AND NOT lost AND depth_pct <= 5", "BASE": "contraction <= 0.6", "CAPITULATION": "run >= 3 AND volume_decay >= 1.5", "SUPPORT_HOLD": "last <= support * 1.03::DOUBLE", "OVERHEAD_SUPPLY": "resistance <= last * 1.05::DOUBLE"}
    names = ("support", "resistance", "contraction", "rvol20", "level", "depth_pct", "expansion")
    return f"""SELECT s.symbol, last, {', '.join(f'{sq(n)} AS {n}' for n in names)}, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in concepts.items())}) AS concepts, concat_ws(',', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names)}) AS measurement_gaps
    FROM ({o['support_resistance']}) s LEFT JOIN (SELECT symbol, contraction, rvol20 FROM (SELECT symbol, contraction, rvol20, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM ({o['features_daily']})) WHERE n = 1) f ON f.symbol = s.symbol LEFT JOIN ({o['breakout_state']}) b ON b.symbol = s.symbol LEFT JOIN ({o['pullback']}) p ON p.symbol = s.symbol
    LEFT JOIN ({o['volatility_expansion']}) v ON v.symbol = s.symbol LEFT JOIN (SELECT symbol, run, volume_decay FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM ({o['exhaustion']})) WHERE n = 1) x ON x.symbol = s.symbol"""


@query("chart_assessment", _assessment_sql())
def chart_assessment(spark, d):
    """Measurements, the concepts they support (none on a missing measurement), and the measurements that are missing."""
    levels = outcomes.support_resistance(spark, d).select("symbol", "last", "support", "resistance", "heaviest_above")
    newest = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    latest = technical.feature_rows(spark, d).withColumn("n", F.row_number().over(newest)).where("n = 1").select("symbol", "contraction", "rvol20", "clv")
    runs = judgement.exhaustion(spark, d).groupBy("symbol").agg(F.max("trade_date").alias("run_day"), F.max_by("run", "trade_date").alias("run"), F.max_by("volume_decay", "trade_date").alias("volume_decay"))
    rows = levels.join(latest, "symbol", "left").join(breakouts(spark, d), "symbol", "left").join(judgement.pullback(spark, d), "symbol", "left").join(expansion(spark, d), "symbol", "left").join(runs, "symbol", "left")
    c = F.col
    concepts = {
        "FAILED_BREAKOUT": c("lost"),
        "BREAKOUT_RETEST": c("cleared") & ~c("lost") & (c("depth_pct") <= 5),
        "BASE": c("contraction") <= 0.6,
        "CAPITULATION": (c("run") >= 3) & (c("volume_decay") >= 1.5),
        "SUPPORT_HOLD": c("last") <= c("support") * 1.03,
        "OVERHEAD_SUPPLY": c("resistance") <= c("last") * 1.05,
    }
    measures = ["support", "resistance", "contraction", "rvol20", "level", "depth_pct", "expansion"]
    present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return rows.select("symbol", "last", *[q(n, n) for n in measures], F.array_join(present([F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in concepts.items()]), ",").alias("concepts"), F.array_join(present([F.when(c(n).isNull(), F.lit(n)) for n in measures]), ",").alias("measurement_gaps"))
