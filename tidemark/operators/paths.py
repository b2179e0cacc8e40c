"""Which of two lines a price reached first, session by session, from daily bars, intraday bars and trades.

A session has a row (its keys, open, high, low, close, target, failure, from_time, intraday_exists,
trades_exist); bars and trades are tables of their own with the same keys.  Nothing is collected into arrays:
trades are first put together by instant, which combines before the shuffle and leaves no more rows
a session than its clock has ticks; the first instant, or bar, that touches a line is then a minimum.

Refusals stay as rows: lines that are not in order are REFUSED_LINES.  AMBIGUOUS_PATH: no finer
record exists, so the order can't be known.  UNRESOLVED_MISSING_DATA: one should exist and is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON = 20
#: What a primary result is called, by the path that decided it.
VERDICTS = {"TARGET_FIRST": "TARGET_HIT", "FAILURE_FIRST": "INITIAL_FAILURE_HIT", "AMBIGUOUS_PATH": "AMBIGUOUS_PATH", "UNRESOLVED_MISSING_DATA": "UNRESOLVED_MISSING_DATA", "REFUSED_LINES": "REFUSED_LINES"}


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _found(resolution: str | Column, granularity: str | None = None, at: Column | None = None) -> Column:
    value = F.lit(resolution) if isinstance(resolution, str) else resolution
    return F.struct(value.alias("resolution"), F.lit(granularity).cast("string").alias("granularity"), (F.lit(None) if at is None else at).cast("timestamp").alias("decided_at"))


MISSING = ("UNRESOLVED_MISSING_DATA",)
UNKNOWABLE = ("AMBIGUOUS_PATH", "INTRADAY_BAR")


def _trade_facts(trades: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of the trades that count (after from_time, not at it): how many, the first instant at a line, highest and lowest price."""
    instants = trades.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.max("price").alias("top"), F.min("price").alias("bottom"))
    up, down = _true(F.col("top") >= F.col("target")), _true(F.col("bottom") <= F.col("failure"))
    counted = instants.join(lines, keys).where("from_time IS NULL OR at > from_time")
    return counted.groupBy(*keys).agg(F.sum("n").alias("trades"), F.min(F.when(up | down, F.struct("at", up.alias("up"), down.alias("down")))).alias("trade"), F.max("top").alias("trade_top"), F.min("bottom").alias("trade_bottom"))


def _bar_facts(bars: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Of the bars that count (begun at from_time or later): how many, the first at a line, highest and lowest price."""
    touched = _true(F.col("open") >= F.col("target")) | _true(F.col("open") <= F.col("failure")) | _true(F.col("high") >= F.col("target")) | _true(F.col("low") <= F.col("failure"))
    counted = bars.select(*keys, "starts_at", "open", "high", "low").join(lines, keys).where("from_time IS NULL OR starts_at >= from_time")
    return counted.groupBy(*keys).agg(F.count("*").alias("bars"), F.min(F.when(touched, F.struct("starts_at", "open", "high", "low"))).alias("bar"), F.max("high").alias("bar_top"), F.min("low").alias("bar_bottom"))


def resolve(sessions: DataFrame, bars: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """sessions with resolution (null: undecided), granularity, decided_at, top and bottom (prices that count), touched_target.

    A session with a from_time counts only what came after it: its daily bar, which holds the move
    before, is never read.  keys identify a session and must not be null.
    """
    lines = sessions.select(*keys, "target", "failure", "from_time")
    rows = sessions.join(_trade_facts(trades, lines, keys), keys, "left").join(_bar_facts(bars, lines, keys), keys, "left")
    target, failure, c = F.col("target"), F.col("failure"), F.col
    up, down = (lambda x: _true(x >= target)), (lambda x: _true(x <= failure))
    some_trades, some_bars, partial = _true(c("trades") > 0), _true(c("bars") > 0), c("from_time").isNotNull()

    trade_side = F.when(c("trade").isNull(), F.lit(None)).when(c("trade.up") & c("trade.down"), "AMBIGUOUS_PATH").when(c("trade.up"), "TARGET_FIRST").otherwise("FAILURE_FIRST")
    by_trade = F.when(c("trade").isNull(), _found(F.lit(None).cast("string"))).otherwise(_found(trade_side, "TRADE", c("trade.at")))
    # A bar that opens beyond a line decides, whatever it does later.
    bar_side = F.when(up(c("bar.open")), "TARGET_FIRST").when(down(c("bar.open")), "FAILURE_FIRST").when(up(c("bar.high")) & down(c("bar.low")), "AMBIGUOUS_PATH").when(up(c("bar.high")), "TARGET_FIRST").otherwise("FAILURE_FIRST")
    by_bar = F.when(c("bar").isNull(), _found(F.lit(None).cast("string"))).otherwise(_found(bar_side, "INTRADAY_BAR", c("bar.starts_at")))

    from_trades = F.when(some_trades, by_trade).when(~_true(c("trades_exist")), _found(*UNKNOWABLE)).otherwise(_found(*MISSING))
    # Bars that cross neither line contradict the day, so they don't cover it.
    both = (
        F.when(some_bars & c("bar").isNull(), _found(*MISSING))
        .when(some_bars & (bar_side != "AMBIGUOUS_PATH"), by_bar)
        .when(some_bars | ~_true(c("intraday_exists")), from_trades)
        .otherwise(_found(*MISSING))
    )
    after_entry = F.when(some_trades, by_trade).when(some_bars, by_bar).when(~_true(c("intraday_exists")) & ~_true(c("trades_exist")), _found(*UNKNOWABLE)).otherwise(_found(*MISSING))
    complete = c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
    whole = (
        F.when(up(c("open")), _found("TARGET_FIRST", "SESSION_OPEN"))
        .when(down(c("open")), _found("FAILURE_FIRST", "SESSION_OPEN"))
        .when(~complete, _found(*MISSING))
        .when(up(c("high")) & down(c("low")), both)
        .when(up(c("high")), _found("TARGET_FIRST", "DAY"))
        .when(down(c("low")), _found("FAILURE_FIRST", "DAY"))
        .otherwise(_found(F.lit(None).cast("string")))
    )
    found = F.when(_true(failure < target), F.when(partial, after_entry).otherwise(whole)).otherwise(_found("REFUSED_LINES"))
    seen = c("high").isNotNull() & c("low").isNotNull()
    top = F.when(partial, F.greatest("trade_top", "bar_top")).otherwise(F.when(seen, c("high")))
    bottom = F.when(partial, F.least("trade_bottom", "bar_bottom")).otherwise(F.when(seen, c("low")))
    touched = F.when(partial, up(F.greatest("trade_top", "bar_top"))).otherwise(up(c("high")))
    return rows.withColumns({"found": found, "top": top, "bottom": bottom, "touched_target": touched}).select(*sessions.columns, "found.*", "top", "bottom", "touched_target")


def episodes(sessions: DataFrame, invalidations: DataFrame | None = None) -> DataFrame:
    """Both layers of each episode_id over its sessions S0 to S20 (resolve's rows with episode_id, idx, entry, and perhaps suspected).

    primary stops where the episode stops: at the first decided session, unless the thesis was called
    off (invalidations: episode_id, at_idx) at an earlier one; HORIZON_EXPIRED needs all 21 sessions.  The
    other layer goes on: the first resolution of any session, whether the target was touched at all (null while
    that is open), and the excursions.  A suspected split leaves everything but the excursions open.
    """
    if "suspected" not in sessions.columns:
        sessions = sessions.withColumn("suspected", F.lit(False))
    rows = sessions.where(F.col("idx").between(0, HORIZON))
    decided = F.when(F.col("resolution").isNotNull(), F.struct("idx", "resolution", "granularity", "decided_at"))
    hit = F.when(F.col("touched_target"), F.struct("idx", F.when(F.col("resolution") == "TARGET_FIRST", F.col("decided_at")).alias("at")))
    out = rows.groupBy("episode_id").agg(
        F.count("*").alias("observed"), F.max("idx").alias("last_idx"), F.min(decided).alias("decided"), F.min(hit).alias("hit"),
        F.max((F.col("top") - F.col("entry")) / F.col("entry")).alias("mfe"), F.min((F.col("bottom") - F.col("entry")) / F.col("entry")).alias("mae"), F.bool_or(_true(F.col("suspected"))).alias("suspected"),
    )
    if invalidations is None:
        out = out.withColumn("at_idx", F.lit(None).cast("int"))
    else:
        out = out.join(invalidations.groupBy("episode_id").agg(F.min("at_idx").alias("at_idx")), "episode_id", "left")
    c, complete = F.col, F.col("observed") > HORIZON
    first = _true(c("decided").isNotNull() & (c("at_idx").isNull() | (c("decided.idx") <= c("at_idx"))))
    invalid = _true(c("last_idx") > c("at_idx"))
    verdict = F.coalesce(*[F.when(c("decided.resolution") == k, F.lit(v)) for k, v in VERDICTS.items()])
    primary = F.when(c("suspected"), None).when(first, verdict).when(invalid, "THESIS_INVALIDATED").when(complete, "HORIZON_EXPIRED")
    stop = F.when(c("suspected"), None).when(first, c("decided.idx")).when(invalid, c("at_idx")).when(complete, F.lit(HORIZON))
    own = lambda name: F.when(first & ~c("suspected"), c(f"decided.{name}"))
    open_ = ~c("suspected")
    return out.select(
        "episode_id",
        primary.alias("primary"),
        stop.cast("long").alias("stop_idx"),
        F.when(own("resolution").isNotNull(), own("resolution")).when(primary == "HORIZON_EXPIRED", "NEITHER_BY_HORIZON").alias("path_resolution"),
        own("granularity").alias("granularity"),
        own("decided_at").alias("resolved_at"),
        F.when(c("suspected"), "CORPORATE_ACTION_SUSPECTED").when(primary.isNull(), "HORIZON_INCOMPLETE").alias("pending"),
        F.when(open_, c("decided.resolution")).alias("first_resolution"),
        F.when(open_, F.when(c("hit").isNotNull(), True).when(complete, False)).alias("later_target_hit"),
        F.when(open_, c("hit.idx").cast("long")).alias("hit_idx"),
        F.when(open_, c("hit.at")).alias("hit_at"),
        F.when(open_, c("mfe")).alias("mfe"),
        F.when(open_, c("mae")).alias("mae"),
        "observed",
    )
