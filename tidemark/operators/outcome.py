"""Forward outcomes over market sessions, and which of two price lines was reached first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZON, TARGET = 20, 1.2


def sessions(bars: DataFrame) -> DataFrame:
    """Days on which at least 30 % of all symbols have a bar, numbered from 0."""
    n = bars.agg(F.count_distinct("symbol").alias("n"))
    days = bars.groupBy("trade_date").agg(F.count_distinct("symbol").alias("have"))
    days = days.join(F.broadcast(n), F.lit(True)).where(F.col("have") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.3)))
    return days.select("trade_date", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("idx"))


def numbered(bars: DataFrame, own: bool) -> DataFrame:
    """bars with idx, the number of the session, and last, the last one's: of the market, or of the symbol's own trading."""
    if own:
        per = Window.partitionBy("symbol")
        return bars.withColumns({"idx": F.row_number().over(per.orderBy("trade_date")) - 1, "last": F.count("*").over(per) - 1})
    days = sessions(bars)
    return bars.join(F.broadcast(days), "trade_date").join(F.broadcast(days.agg(F.max("idx").alias("last"))), F.lit(True))


def forward_outcome(bars: DataFrame, own_sessions: bool = False) -> DataFrame:
    """For every bar on a session: what the next 20 sessions (of the market, or of the symbol's own) brought.

    PENDING until 20 sessions have passed; UNRESOLVED_MISSING_DATA if a bar is missing, with the values over the
    bars that are known.  A range frame on the session number, so missing sessions count as missing.
    """
    rows = numbered(bars, own_sessions)
    w = Window.partitionBy("symbol").orderBy("idx").rangeBetween(1, HORIZON)
    base = F.col("close")
    rows = rows.withColumns(
        {"known": F.count("close").over(w), "top": F.max("high").over(w), "top_close": F.max("close").over(w), "bottom": F.min("low").over(w), "path": F.collect_list(F.struct("idx", "high")).over(w)}
        | {f"c{k}": F.max("close").over(Window.partitionBy("symbol").orderBy("idx").rangeBetween(k, k)) for k in (1, 5, 20)}
    )
    reached = F.filter("path", lambda p: p["high"] >= base * TARGET)
    return rows.where("close is not null").select(
        "symbol",
        "trade_date",
        F.when(F.col("idx") + HORIZON > F.col("last"), "PENDING").when(F.col("known") < HORIZON, "UNRESOLVED_MISSING_DATA").otherwise("RESOLVED").alias("resolution"),
        (F.col("top") >= base * TARGET).alias("hit_high"),
        (F.col("top_close") >= base * TARGET).alias("hit_close"),
        F.array_min(F.transform(reached, lambda p: p["idx"] - F.col("idx"))).alias("first_hit"),
        *[((F.col(f"c{k}") / base - 1) * 100).alias(f"ret_t{k}") for k in (1, 5, 20)],
        ((F.col("top") / base - 1) * 100).alias("max_upside"),
        ((F.col("bottom") / base - 1) * 100).alias("max_drawdown"),
        (HORIZON - F.col("known")).alias("missing"),
    )


def first_touch(path: Column, target: Column, failure: Column) -> Column:
    """Over an array of (at, price) in order: TARGET_FIRST, FAILURE_FIRST, AMBIGUOUS_PATH or NOT_REACHED.

    Prices of one instant that reach both lines can't be ordered: the path is ambiguous, which is not missing data.
    """
    touched = F.filter(path, lambda p: (p["price"] >= target) | (p["price"] <= failure))
    first = F.element_at(touched, 1)
    group = F.filter(touched, lambda p: p["at"] == first["at"])
    up, down = F.exists(group, lambda p: p["price"] >= target), F.exists(group, lambda p: p["price"] <= failure)
    return F.when(F.size(touched) == 0, "NOT_REACHED").when(up & down, "AMBIGUOUS_PATH").when(up, "TARGET_FIRST").otherwise("FAILURE_FIRST")


def resolve_session(intraday_exists: Column, trades_exist: Column, bars: Column, trades: Column, open_: Column, high: Column, low: Column, target: Column, failure: Column) -> Column:
    """The ladder for one session: the open decides, then the day's range, then intraday bars, then trades.

    A day that touched both lines needs finer data: where the market has none of it the path is
    AMBIGUOUS_PATH (can't be known); where it should exist but is empty, UNRESOLVED_MISSING_DATA.
    """
    day_up, day_down = high >= target, low <= failure
    undecided = F.filter(bars, lambda b: (b["high"] >= target) | (b["low"] <= failure))
    first = F.element_at(undecided, 1)
    by_bar = F.when(first["open"] >= target, "TARGET_FIRST").when(first["open"] <= failure, "FAILURE_FIRST").when((first["high"] >= target) & (first["low"] <= failure), "BOTH").when(first["high"] >= target, "TARGET_FIRST").otherwise("FAILURE_FIRST")
    by_trade = first_touch(trades, target, failure)
    fine = (
        F.when(~intraday_exists, "AMBIGUOUS_PATH")
        .when(F.size(bars) == 0, "UNRESOLVED_MISSING_DATA")
        .when(F.size(undecided) == 0, "UNRESOLVED_MISSING_DATA")
        .when(by_bar != "BOTH", by_bar)
        .when(~trades_exist, "AMBIGUOUS_PATH")
        .when(F.size(trades) == 0, "UNRESOLVED_MISSING_DATA")
        .when(by_trade == "NOT_REACHED", "UNRESOLVED_MISSING_DATA")
        .otherwise(by_trade)
    )
    return (
        F.when(open_ >= target, "TARGET_FIRST")
        .when(open_ <= failure, "FAILURE_FIRST")
        .when(high.isNull() | low.isNull() | open_.isNull(), "UNRESOLVED_MISSING_DATA")
        .when(day_up & day_down, fine)
        .when(day_up, "TARGET_FIRST")
        .when(day_down, "FAILURE_FIRST")
        .otherwise("NOT_REACHED")
    )
