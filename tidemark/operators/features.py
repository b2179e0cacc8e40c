"""The feature row of every symbol and day, and the screening routes over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as i

FEATURES_VERSION, ROUTES_VERSION = "features-1.0.0", "route-1.0.0"
WARM_BARS = 75
#: Bars a series must have before a route is asked.
MIN_BARS = {"A": 25, "B": 30, "C": 25, "D": 30, "E": 10, "F": 25, "G": 25, "H": 30}
TURNOVER_LIMIT = {"JP": 500_000_000.0, "US": 3_500_000.0}


def features(bars: DataFrame) -> DataFrame:
    """Measurements per bar (one sort: all frames share symbol and date); bars on one share basis, with market_code."""
    w = i.by_symbol()
    base = bars.withColumns({"seq": F.row_number().over(w), "tr": i.true_range(), "log_ret": i.log_return("close"), "rises": F.coalesce(F.col("close") > F.lag("close").over(w), F.lit(False))})
    # With an offset of 1, the mean of the bars before.
    out = i.with_rolling(
        base,
        **{f"sma{n}": ("mean", "close", n) for n in (5, 25, 75)},
        **{f"high{n}": ("max", "high", n) for n in (5, 20, 60)},
        **{f"low{n}": ("min", "low", n) for n in (5, 20, 60)},
        **{f"bars_since_high{n}": ("since_max", "high", n) for n in (20, 60)},
        **{f"volume{n}_before": ("mean", "volume", n, 1) for n in (5, 20)},
        **{f"vol{n}": ("sample_deviation", "log_ret", n) for n in (20, 60)},
        turnover20=("mean", "turnover", 20),
        turnover20_before=("mean", "turnover", 20, 1),
    )
    known = i.whole_series_known("close")
    out = out.withColumns(
        {f"ret{k}": i.pct_change("close", k) for k in (1, 3, 5, 10, 20, 60)}
        | {f"rvol{n}": i.ratio("volume", f"volume{n}_before") for n in (5, 20)}
        | {"turnover_rvol": i.ratio("turnover", "turnover20_before")}
        | {f"vol{n}": F.when(known, F.col(f"vol{n}")) * F.sqrt(F.lit(252.0)) for n in (20, 60)}
        | {"up_streak": i.up_streak(), "gap_pct": F.try_divide(F.col("open") - F.lag("close").over(w), F.nullif(F.lag("close").over(w), F.lit(0.0))) * 100}
        | i.candle()
    )
    out = i.with_bollinger(out, "close").drop("volume5_before", "volume20_before", "turnover20_before")
    reach = lambda n: F.when(F.col(f"low{n}") > 0, (F.col(f"high{n}") - F.col(f"low{n}")) / F.col(f"low{n}") * 100)
    out = out.withColumns({"close_vs_sma25": F.try_divide(i.apart("close", "sma25"), F.nullif("sma25", F.lit(0.0))) * 100, "dist_high20": F.try_divide(F.col("high20") - F.col("close"), F.nullif("high20", F.lit(0.0))) * 100, "contraction": F.try_divide(reach(5), F.nullif(reach(20), F.lit(0.0))), "vwap": F.try_divide("turnover", F.nullif("volume", F.lit(0.0))), "warm": F.col("seq") >= WARM_BARS})
    # The lowest gap to the average in the five bars before.
    return out.withColumn("lowest_gap", F.least(*[F.lag("close_vs_sma25", k).over(w) for k in range(1, 6)])).withColumn("features_version", F.lit(FEATURES_VERSION))


def route_predicates() -> dict[str, Column]:
    """Each route's predicate; none fires on a missing measurement."""
    c = F.col
    limit = F.when(c("market_code") == "JP", TURNOVER_LIMIT["JP"]).otherwise(TURNOVER_LIMIT["US"])
    rules = {
        "A": (c("dist_high20") <= 3) & (c("rvol20") >= 1),
        "B": (c("close_vs_sma25") >= 0) & (c("lowest_gap") < 0),
        "C": (c("rvol20") >= 2.5) & (F.abs("ret1") <= 5),
        "D": (c("contraction") <= 0.6) & (c("bb_width") <= 0.10),
        "E": (c("lower_wick_pct") >= 40) & (c("clv") >= 0.6) & (c("ret5") <= -5),
        "F": (c("turnover20") <= limit) & (c("turnover_rvol") >= 3),
        "G": (c("ret5") >= 5) & (c("ret20") <= 30) & (c("rvol20") >= 1.5),
        "H": (c("close_vs_sma25") >= 0) & c("dist_high20").between(3, 15) & (c("rvol5") <= 1),
    }
    blocked = F.col("blocked")
    return {k: F.coalesce(~blocked & (c("seq") >= MIN_BARS[k]) & r, F.lit(False)) for k, r in rules.items()}


EVIDENCE = {"A": ("dist_high20", "rvol20"), "B": ("close_vs_sma25", "lowest_gap"), "C": ("rvol20", "ret1"), "D": ("contraction", "bb_width"), "E": ("lower_wick_pct", "clv", "ret5"), "F": ("turnover20", "turnover_rvol"), "G": ("ret5", "ret20", "rvol20"), "H": ("close_vs_sma25", "dist_high20", "rvol5")}


def evaluate_routes(rows: DataFrame) -> DataFrame:
    """rows with routes (codes in order) and evidence (route to what it saw); rows on which nothing fires stay."""
    rules = route_predicates()
    routes = F.filter(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    pairs = [x for k, names in EVIDENCE.items() for x in (F.lit(k), F.when(rules[k], F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))))]
    evidence = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return rows.withColumns({"routes": routes, "evidence": evidence, "routes_version": F.lit(ROUTES_VERSION)})


def route_d_subgroup() -> Column:
    has = F.array_contains("routes", "D")
    return F.when(has & (F.size("routes") == 1), "D_ONLY").when(has, "D_PLUS_OTHER").otherwise("NON_D")


#: Measures in money a share (on the basis of their own date), and in shares; all others are ratios, counts or money.
LEVELS = (
    *("open", "high", "low", "close", "sma_5", "sma_25", "sma_75", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "bb_mid_20", "bb_upper_20", "bb_lower_20", "vwap_day", "atr_14"),
    *(f"{side}_{n}d" for side in ("high", "low") for n in (5, 10, 20, 60)), "resistance_20d", "resistance_60d", "support_20d", "support_60d",
)
SHARES = ("volume", "vol_avg_5d", "vol_avg_20d", "vol_avg_60d")


def _percent(part: Column, of: Column) -> Column:
    return F.try_divide(part, F.nullif(of, F.lit(0.0))) * 100


def feature_row(bars: DataFrame, dealt: bool = False) -> DataFrame:
    """All 74 measurements of every bar (MEASUREMENTS), with symbol, trade_date, bars_available, warmup_satisfied, blocked.

    bars: on the latest share basis, with to_asof (what brings a price to the basis of its own date) and
    blocked (an unreadable action lies before): ratios don't depend on the basis, levels are brought
    back.  One shuffle by symbol (none if bars are dealt by it): the recursive means are a fold over a symbol's bars, the
    windows share its partitioning and one sort.  A blocked bar has no measurements.
    """
    w, c = i.by_symbol(), F.col
    rows = i.with_recursive_means(bars, dealt=dealt)
    before = F.lag("close").over(w)
    rows = rows.withColumns({"seq": F.row_number().over(w), "before": before, "log_ret": i.log_return("close"), "rises": F.coalesce(c("close") > before, F.lit(False)), "known": i.whole_series_known("close")})
    rows = i.with_rolling(
        rows,
        **{f"high_{n}d": ("max", "high", n) for n in (5, 10, 20, 60)},
        **{f"low_{n}d": ("min", "low", n) for n in (5, 10, 20, 60)},
        **{f"sma_{n}": ("mean", "close", n) for n in (5, 25, 75)},
        **{f"vol_avg_{n}d": ("mean", "volume", n) for n in (5, 20, 60)},
        **{f"days_since_high_{n}d": ("since_max", "high", n) for n in (20, 60)},
        **{f"volume_{n}_before": ("mean", "volume", n, 1) for n in (5, 20)},
        **{f"rv_{n}d": ("sample_deviation", "log_ret", n) for n in (10, 20)},
        turnover_avg_20d=("mean", "turnover", 20),
        turnover_20_before=("mean", "turnover", 20, 1),
        mid=("mean", "close", 20),
        dev=("deviation", "close", 20),
    )
    rows = rows.withColumns(
        {f"ret_{k}d": i.pct_change("close", k) for k in (1, 3, 5, 10, 20)}
        | {f"rvol_{n}d": i.ratio("volume", f"volume_{n}_before") for n in (5, 20)}
        | {"turnover_rvol": i.ratio("turnover", "turnover_20_before"), "up": i.up_streak()}
    )
    span = c("high") - c("low")
    shape = F.when((span > 0) & c("open").isNotNull() & c("close").isNotNull(), span)
    part = lambda x: F.try_divide(x, shape) * 100
    reach = lambda n: F.when(c(f"low_{n}d") > 0, (c(f"high_{n}d") - c(f"low_{n}d")) / c(f"low_{n}d") * 100)
    wide = F.greatest(span, F.abs(c("high") - c("before")), F.abs(c("low") - c("before")))
    rows = rows.withColumns({"bb_mid_20": F.when(c("known"), c("mid")), "bb_upper_20": F.when(c("known"), c("mid") + 2 * c("dev")), "bb_lower_20": F.when(c("known"), c("mid") - 2 * c("dev")), "range_5d_pct": reach(5), "range_20d_pct": reach(20)} | {f"rv_{n}d": F.when(c("known"), c(f"rv_{n}d")) for n in (10, 20)})
    rows = rows.withColumns(
        {f"dist_from_high_{n}d_pct": _percent(c(f"high_{n}d") - c("close"), c(f"high_{n}d")) for n in (5, 10, 20, 60)}
        | {
            "dist_from_low_20d_pct": _percent(c("close") - c("low_20d"), c("low_20d")),
            "atr_pct_14": _percent(c("atr_14"), c("close")),
            "true_range_pct": F.when(c("before").isNotNull(), _percent(wide, c("before"))),
            "rv_20d_annualized": c("rv_20d") * F.sqrt(F.lit(252.0)),
            "close_vs_sma25_pct": _percent(c("close") - c("sma_25"), c("sma_25")),
            "sma5_vs_sma25_pct": _percent(c("sma_5") - c("sma_25"), c("sma_25")),
            "bb_width_20": F.try_divide(c("bb_upper_20") - c("bb_lower_20"), F.nullif("bb_mid_20", F.lit(0.0))),
            "bb_percent_b": F.try_divide(c("close") - c("bb_lower_20"), F.nullif(c("bb_upper_20") - c("bb_lower_20"), F.lit(0.0))),
            "vwap_day": F.try_divide("turnover", F.nullif("volume", F.lit(0.0))),
            "gap_pct": _percent(c("open") - c("before"), c("before")),
            "body_pct": part(F.abs(c("close") - c("open"))),
            "upper_wick_pct": part(c("high") - F.greatest("open", "close")),
            "lower_wick_pct": part(F.least("open", "close") - c("low")),
            "close_location_value": F.try_divide((c("close") - c("low")) - (c("high") - c("close")), shape),
            "range_contraction_ratio": F.try_divide("range_5d_pct", F.nullif("range_20d_pct", F.lit(0.0))),
            "consecutive_up_days": c("up"),
            "resistance_20d": c("high_20d"), "resistance_60d": c("high_60d"), "support_20d": c("low_20d"), "support_60d": c("low_60d"),
        }
    )
    rows = rows.withColumns({"vwap_source": F.when(c("vwap_day").isNotNull(), "TURNOVER_OVER_VOLUME"), "breakout_distance_pct": c("dist_from_high_20d_pct")})
    rows = rows.withColumns({n: c(n) * c("to_asof") for n in LEVELS} | {n: c(n) / c("to_asof") for n in SHARES})
    return rows.select("symbol", "trade_date", c("seq").alias("bars_available"), (c("seq") >= WARM_BARS).alias("warmup_satisfied"), "blocked", *[F.when(~c("blocked"), c(n)).alias(n) for n in MEASUREMENTS])


#: Names that a user of the feature row asks for, in its order.
MEASUREMENTS = (
    *("open", "high", "low", "close", "volume", "turnover"), *(f"ret_{k}d" for k in (1, 3, 5, 10, 20)),
    *(f"{side}_{n}d" for side in ("high", "low") for n in (5, 10, 20, 60)), *(f"dist_from_high_{n}d_pct" for n in (5, 10, 20, 60)), "dist_from_low_20d_pct", "days_since_high_20d", "days_since_high_60d",
    *("atr_14", "atr_pct_14", "true_range_pct", "rv_10d", "rv_20d", "rv_20d_annualized", "vol_avg_5d", "vol_avg_20d", "vol_avg_60d", "rvol_5d", "rvol_20d", "turnover_avg_20d", "turnover_rvol"),
    *("sma_5", "sma_25", "sma_75", "ema_12", "ema_26", "close_vs_sma25_pct", "sma5_vs_sma25_pct", "rsi_14", "macd", "macd_signal", "macd_hist", "adx_14", "plus_di_14", "minus_di_14"),
    *("bb_mid_20", "bb_upper_20", "bb_lower_20", "bb_width_20", "bb_percent_b", "vwap_day", "vwap_source", "gap_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_location_value"),
    *("range_5d_pct", "range_20d_pct", "range_contraction_ratio", "breakout_distance_pct", "consecutive_up_days", "resistance_20d", "resistance_60d", "support_20d", "support_60d"),
)


def screen_at(bars: DataFrame, symbols: DataFrame, day: str) -> DataFrame:
    """One date's screen: (symbol, routes, outcome) of every symbol; bars as features takes them, none of them after the date.

    A symbol without a bar on the date has no screen, whatever its history.
    """
    rows = evaluate_routes(features(bars)).where(F.col("trade_date") == F.lit(day).cast("date")).select("symbol", "routes", "blocked")
    outcome = F.when(F.col("blocked").isNull(), "NO_BAR_ON_DATE").when(F.col("blocked"), "REFUSED").when(F.size("routes") > 0, "PASSED").otherwise("NOT_PASSED")
    return symbols.select("symbol").join(rows, "symbol", "left").select("symbol", "routes", outcome.alias("outcome"))
