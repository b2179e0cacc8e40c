"""A chart's measurements at a symbol's last bar, and the concepts they support, with what speaks for and against each.

Concepts are a table of conditions on measurements.  A concept fires when all its conditions hold; a condition on a
missing measurement neither holds nor fails: it is listed as missing, and nothing fires on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as i

WARM_BARS = 75
#: Prices within so many hundredths of a cluster's first pivot are one level.
TOLERANCE = 1.0

# What each concept asks of the measurements (a number, or another measurement), and what else it shows.
CONDITIONS = (
    ("SELLER_EXHAUSTION", "consecutive_down_days", ">=", 3.0),
    ("SELLER_EXHAUSTION", "down_day_volume_decay", "<", 0.7),
    ("SELLER_EXHAUSTION", "lower_wick_ratio", ">=", 0.4),
    ("FAILED_BREAKOUT", "closed_back_below", ">=", 1.0),
    ("FAILED_BREAKOUT", "bars_above_breakout", ">=", 1.0),
    ("HEALTHY_PULLBACK", "pullback_depth_pct", ">", 0.0),
    ("HEALTHY_PULLBACK", "pullback_depth_pct", "<=", 15.0),
    ("HEALTHY_PULLBACK", "pullback_volume_contraction", "<", 0.8),
    ("HEALTHY_PULLBACK", "holding_above_ma20", ">=", 1.0),
    ("SUPPLY_OVERHANG", "overhead_volume_ratio", ">=", 1.5),
    ("SUPPLY_OVERHANG", "distance_to_heaviest_overhead_pct", ">", 0.0),
    ("VOLUME_DRY_UP", "relative_volume_20d", "<", 0.6),
    ("VOLUME_DRY_UP", "session_range_pct", "<", "atr_pct"),
    ("VWAP_RECLAIM", "distance_from_anchored_vwap_pct", ">", 0.0),
    ("VWAP_RECLAIM", "relative_volume_20d", ">=", 1.0),
)
SHOWN = {
    "SELLER_EXHAUSTION": ("consecutive_down_days", "down_day_volume_decay", "lower_wick_ratio", "capitulation_volume_ratio"),
    "FAILED_BREAKOUT": ("breakout_level", "bars_above_breakout", "closed_back_below", "failure_volume_ratio"),
    "HEALTHY_PULLBACK": ("pullback_depth_pct", "pullback_volume_contraction", "holding_above_ma20", "pullback_bars"),
    "SUPPLY_OVERHANG": ("overhead_volume_ratio", "overhead_levels", "distance_to_heaviest_overhead_pct"),
    "VOLUME_DRY_UP": ("relative_volume_20d", "volume_trend_5d", "session_range_pct", "atr_pct"),
    "VWAP_RECLAIM": ("anchored_vwap", "distance_from_anchored_vwap_pct", "relative_volume_20d"),
}
MEASURES = tuple(dict.fromkeys([n for names in SHOWN.values() for n in names] + ["nearest_support", "nearest_support_touches", "nearest_resistance", "nearest_resistance_touches", "session_vwap", "distance_from_session_vwap_pct", "close_position_in_range", "gap_pct", "realized_vol_20d"]))
OPS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


def levels(points: Column) -> Column:
    """Levels of an array of pivots (price, volume) in order of price: (price: the mean, touches, volume) of each cluster."""
    kind = "array<struct<first:double,total:double,touches:bigint,volume:double>>"

    def add(done, p):
        top = F.element_at(done, -1)
        new = F.struct(p["price"].alias("first"), p["price"].alias("total"), F.lit(1).cast("long").alias("touches"), p["volume"].alias("volume"))
        grown = F.struct(top["first"].alias("first"), (top["total"] + p["price"]).alias("total"), (top["touches"] + 1).alias("touches"), (top["volume"] + p["volume"]).alias("volume"))
        near = (F.size(done) > 0) & F.coalesce(F.abs(p["price"] / F.nullif(F.get(done, F.size(done) - 1)["first"], F.lit(0.0)) - 1.0) * 100.0 <= TOLERANCE, F.lit(False))
        return F.when(near, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new))).cast(kind)

    return F.transform(F.aggregate(points, F.array().cast(kind), add), lambda x: F.struct((x["total"] / x["touches"]).alias("price"), x["touches"].alias("touches"), x["volume"].alias("volume")))


def measurements(bars: DataFrame) -> DataFrame:
    """MEASURES of each symbol at its last bar, and gaps: what could not be measured, in words.

    bars: symbol, trade_date, open, high, low, close, volume, and volume_comparable (null or false: measures of
    volume are withheld).  Bars are numbered back from the last; all frames share one shuffle by symbol, and the
    pivots of a symbol are one array.
    """
    c = F.col
    rows = i.with_recursive_means(bars.select("symbol", "trade_date", "open", "high", "low", "close", "volume", F.coalesce("volume_comparable", F.lit(False)).alias("volume_comparable")))
    w, whole = i.by_symbol(), Window.partitionBy("symbol")
    back = whole.orderBy(F.desc("trade_date"))
    rows = rows.withColumns({"back": F.row_number().over(back).cast("long"), "before": F.lag("close").over(w), "high0": F.lag("high").over(w), "high2": F.lead("high").over(w), "low0": F.lag("low").over(w), "low2": F.lead("low").over(w), "r": i.log_return("close")})
    # Known volumes before the last bar, and known closes and volumes up to it, by how far back they are.
    known = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(back)
    rows = rows.withColumns(
        {
            "n": F.count("*").over(whole),
            "run": F.min(F.when(~F.coalesce(c("close") < c("before"), F.lit(False)), c("back"))).over(whole) - 1,
            "top": F.max(F.when(c("back") <= 20, c("high"))).over(whole),
            "last": F.max(F.when(c("back") == 1, c("close"))).over(whole),
            "v_before": known((c("back") > 1) & c("volume").isNotNull()),
            "v_all": known(c("volume").isNotNull()),
            "c_all": known(c("close").isNotNull()),
            "heavy": F.max(F.when(c("back") <= 60, F.struct(F.coalesce("volume", F.lit(0.0)).cast("double").alias("v"), (-c("back")).alias("minus")))).over(whole),
        }
    )
    rows = rows.withColumns({"peak": F.min(F.when((c("back") <= 20) & (c("high") == c("top")), c("back"))).over(whole), "anchor": -c("heavy.minus"), "up": F.coalesce(c("close") > c("before"), F.lit(False))})
    now = lambda x: F.max(F.when(c("back") == 1, x))
    mean = lambda x, cond: F.avg(F.when(cond, x))
    full = lambda x, low, high: F.when(F.count(F.when(c("back").between(low, high), x)) == high - low + 1, F.avg(F.when(c("back").between(low, high), x)))
    pivot = lambda side, ok: F.when(ok, F.struct(c(side).cast("double").alias("price"), F.coalesce("volume", F.lit(0.0)).cast("double").alias("volume")))
    highs = (c("high") >= c("high0")) & (c("high") >= c("high2"))
    lows = (c("low") <= c("low0")) & (c("low") <= c("low2"))
    typical = (F.coalesce("high", F.lit(0.0)) + F.coalesce("low", F.lit(0.0)) + F.coalesce("close", F.lit(0.0))) / 3 * F.coalesce("volume", F.lit(0.0))
    anchored = c("back") <= c("anchor")
    out = rows.groupBy("symbol", "n", "run", "peak", "anchor", "top").agg(
        *[now(c(x)).alias(x) for x in ("open", "high", "low", "close", "volume", "before", "atr_14")], F.bool_and("volume_comparable").alias("comparable"),
        full(c("volume"), 2, 21).alias("v20"), full(c("volume"), 1, 5).alias("v5"), full(c("volume"), 6, 10).alias("v10"),
        F.max(F.when(c("back") == c("run"), c("volume"))).alias("run_volume"),
        F.when(F.max("v_before") >= 20, mean(c("volume"), (c("back") > 1) & (c("v_before") <= 20))).alias("usual"),
        F.when(F.max("v_all") >= 20, mean(c("volume"), c("v_all") <= 20)).alias("usual_now"),
        F.when(F.max("c_all") >= 20, mean(c("close"), c("c_all") <= 20)).alias("ma20"),
        mean(c("volume"), c("back").between(c("peak"), c("peak") + 10)).alias("advance"), mean(c("volume"), c("back") < c("peak")).alias("retreat"),
        F.sum(F.when(anchored, typical)).alias("weighted"), F.sum(F.when(anchored, F.coalesce("volume", F.lit(0.0)))).alias("traded"), F.max("heavy.v").alias("heaviest_volume"),
        F.when((F.count(F.when(c("back") <= 20, c("r"))) == 20) & (F.count("close") == F.count("*")), F.stddev_samp(F.when(c("back") <= 20, c("r")))).alias("realized_vol_20d"),
        F.max(F.when(c("back") <= 20, c("close"))).alias("best"),
        F.sort_array(F.collect_list(F.when(c("back") <= 20, F.struct("back", "close")))).alias("recent"),
        F.sort_array(F.concat(F.collect_list(pivot("high", highs)), F.collect_list(pivot("low", lows)))).alias("pivots"),
    )
    out = out.withColumn("levels", levels(c("pivots")))
    by_price = lambda x: F.struct(x["price"].alias("price"), x["touches"].alias("touches"), x["volume"].alias("volume"))
    above, below = F.filter("levels", lambda x: x["price"] > c("close")), F.filter("levels", lambda x: x["price"] < c("close"))
    heaviest = F.element_at(F.sort_array(F.transform(above, lambda x: F.struct(x["volume"].alias("volume"), (-x["price"]).alias("minus")))), -1)
    crossed = F.array_max(F.transform(F.filter(above, lambda x: x["price"] < c("best")), lambda x: x["price"]))
    out = out.withColumns({"above": F.when(c("close").isNotNull(), F.transform(above, by_price)), "under": F.when(c("close").isNotNull(), F.transform(below, by_price)), "breakout_level": F.when((c("n") >= 5) & c("close").isNotNull(), crossed)})
    # The run of closes above the level that ended last; a hole in the closes ends the search.
    first = F.array_min(F.transform(F.filter("recent", lambda x: x["close"] > c("breakout_level")), lambda x: x["back"]))
    hole = F.coalesce(F.array_min(F.transform(F.filter("recent", lambda x: x["close"].isNull()), lambda x: x["back"])), F.size("recent") + 1)
    out = out.withColumns({"heaviest": F.when(F.size("above") > 0, heaviest), "first_above": F.when(first < hole, first), "hole": hole})
    end = F.least(F.coalesce(F.array_min(F.transform(F.filter("recent", lambda x: (x["back"] > c("first_above")) & (x["close"] <= c("breakout_level"))), lambda x: x["back"])), F.size("recent") + 1), c("hole"))
    span, per = c("high") - c("low"), lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    seen = c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
    ranged, comparable, one = seen & (c("low") > 0), c("comparable"), lambda x: x.cast("double")
    surge = F.when(c("volume") != 0, per(c("volume"), c("usual")))
    pulled = (c("n") >= 10) & c("close").isNotNull() & (c("top") > 0)
    anchor_ok = comparable & (F.least(c("n"), F.lit(60)) >= 5) & (c("heaviest_volume") > 0) & (c("traded") > 0)
    vwap = F.when(anchor_ok, c("weighted") / c("traded"))
    support, resistance = F.when(F.size("under") > 0, F.array_max("under")), F.when(F.size("above") > 0, F.array_min("above"))
    values = {
        "consecutive_down_days": c("run"),
        "down_day_volume_decay": F.when(c("run") >= 2, per(c("volume"), c("run_volume"))),
        "lower_wick_ratio": F.when(ranged, F.when(span > 0, (F.least(c("close"), F.coalesce("open", "close")) - c("low")) / span).otherwise(0.0)),
        "capitulation_volume_ratio": surge,
        "breakout_level": c("breakout_level"),
        "bars_above_breakout": F.when(c("breakout_level").isNotNull(), F.coalesce(end - c("first_above"), F.lit(0))),
        "closed_back_below": F.when(c("breakout_level").isNotNull(), one(c("close") < c("breakout_level"))),
        "failure_volume_ratio": F.when(c("breakout_level").isNotNull(), surge),
        "pullback_depth_pct": F.when(pulled, (1.0 - c("close") / c("top")) * 100.0),
        "pullback_volume_contraction": F.when(pulled, per(c("retreat"), c("advance"))),
        "holding_above_ma20": one(c("close") >= c("ma20")),
        "pullback_bars": F.when(pulled, c("peak") - 1),
        "overhead_volume_ratio": per(c("heaviest.volume"), c("usual_now")),
        "overhead_levels": F.when(F.size("levels") > 0, F.size("above")),
        "distance_to_heaviest_overhead_pct": (-c("heaviest.minus") / c("close") - 1.0) * 100.0,
        "relative_volume_20d": F.when(comparable, per(c("volume"), c("v20"))),
        "volume_trend_5d": F.when(comparable & (c("n") >= 10), per(c("v5"), c("v10")) - 1.0),
        "session_range_pct": F.when(ranged, span / c("low") * 100.0),
        "atr_pct": per(c("atr_14"), c("close")) * 100.0,
        "anchored_vwap": vwap,
        "distance_from_anchored_vwap_pct": (per(c("close"), vwap) - 1.0) * 100.0,
        "nearest_support": support["price"], "nearest_support_touches": support["touches"], "nearest_resistance": resistance["price"], "nearest_resistance_touches": resistance["touches"],
        "session_vwap": F.when(seen, (c("high") + c("low") + c("close")) / 3.0),
        "distance_from_session_vwap_pct": F.when(seen, (per(c("close"), (c("high") + c("low") + c("close")) / 3.0) - 1.0) * 100.0),
        "close_position_in_range": F.when(ranged, F.when(span > 0, (c("close") - c("low")) / span).otherwise(0.5)),
        "gap_pct": (per(c("open"), c("before")) - 1.0) * 100.0,
        "realized_vol_20d": c("realized_vol_20d"),
    }
    gaps = F.array_compact(F.array(F.when(c("n") < WARM_BARS, "short history"), F.when(~ranged, "session range"), F.when(~comparable, "volume not comparable"), F.when(c("atr_14").isNull(), "volatility"), F.when((F.size("levels") == 0) | c("close").isNull(), "support and resistance"), F.when(~anchor_ok, "anchored vwap")))
    return out.select("symbol", *[values[n].cast("double").alias(n) for n in MEASURES], gaps.alias("gaps"))


def match(rows: DataFrame) -> DataFrame:
    """A row for each symbol and concept: fired, support and against (measure to value), missing, and evidence (measure to value) where it fired."""

    def conditions(concept: str) -> Column:
        own = []
        for k, name, op, bound in CONDITIONS:
            if k == concept:
                value = F.col(name)
                own.append(F.struct(F.lit(name).alias("name"), value.alias("value"), OPS[op](value, F.col(bound) if isinstance(bound, str) else F.lit(bound)).alias("holds")))
        return F.array(*own)

    shown = lambda concept: F.map_from_arrays(F.array(*[F.lit(n) for n in SHOWN[concept]]), F.array(*[F.col(n) for n in SHOWN[concept]]))
    every = F.array(*[F.struct(F.lit(k).alias("concept"), conditions(k).alias("conditions"), shown(k).alias("evidence")) for k in SHOWN])
    out = rows.select("symbol", F.inline(every))
    picked = lambda test: F.array_distinct(F.transform(F.filter("conditions", test), lambda x: F.struct(x["name"], x["value"])))
    fired = F.forall("conditions", lambda x: F.coalesce(x["holds"], F.lit(False)))
    missing = F.array_distinct(F.transform(F.filter("conditions", lambda x: x["holds"].isNull()), lambda x: x["name"]))
    return out.select("symbol", "concept", fired.alias("fired"), picked(lambda x: x["holds"]).alias("support"), picked(lambda x: ~x["holds"]).alias("against"), missing.alias("missing"), F.when(fired, F.col("evidence")).alias("evidence"))
