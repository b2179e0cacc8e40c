"""Series restated across share-count changes, with what an as-of date could know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE_ACTIONS = ("SPLIT", "REVERSE_SPLIT", "STOCK_DIVIDEND")
#: Ratios of open to previous close that look like a split nobody recorded, the first hit wins.
SPLIT_RATIOS = (2.0, 3.0, 4.0, 5.0, 10.0, 0.5, 1 / 3, 0.25, 0.2, 0.1)


def share_multiplier() -> Column:
    """New shares per old: split_to / split_from, else 1 / adjustment_factor, else null (unreadable)."""
    ratio = F.try_divide("split_to", F.nullif("split_from", F.lit(0.0)))
    return F.coalesce(ratio, F.try_divide(F.lit(1.0), F.nullif("adjustment_factor", F.lit(0.0))))


def share_actions(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action_type").isin(*SHARE_ACTIONS)).withColumn("multiplier", share_multiplier())


def action_arrays(actions: DataFrame) -> DataFrame:
    """(symbol, acts): a symbol's share actions in order (a handful per symbol)."""
    return share_actions(actions).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "multiplier"))).alias("acts"))


def product_after(day: Column, until: Column | None = None) -> Column:
    """Product of the multipliers with day < ex_date (<= until); null if one is unreadable."""
    later = F.filter(F.coalesce("acts", F.array().cast("array<struct<ex_date:date,multiplier:double>>")), lambda a: (a["ex_date"] > day) & (a["ex_date"] <= until if until is not None else F.lit(True)))
    return F.aggregate(later, F.lit(1.0), lambda p, a: p * a["multiplier"])


def restate(bars: DataFrame, actions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Bars up to as_of on its share basis: prices / multiplier, volumes * multiplier, turnover as it was.

    Actions that the as-of date could not know do nothing; rows after it are dropped; a symbol with an unreadable
    action on or before it is refused (`refused`, with null prices), never taken as 1.
    """
    if as_of:
        bars = bars.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
        actions = actions.where(F.col("ex_date") <= F.lit(as_of).cast("date"))
    joined = bars.join(action_arrays(actions), "symbol", "left")
    joined = joined.withColumn("multiplier", product_after(F.col("trade_date"))).withColumn("refused", F.coalesce(F.exists("acts", lambda a: a["multiplier"].isNull()), F.lit(False)))
    usable = ~F.col("refused")
    prices = {n: F.when(usable, F.col(n) / F.col("multiplier")) for n in ("open", "high", "low", "close")}
    return joined.withColumns(prices | {"volume": F.when(usable, F.col("volume") * F.col("multiplier"))}).drop("acts")


def latest_basis(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """All bars on the latest share basis, with `to_asof` (what turns a level of that basis into the bar's own) and
    `blocked` (an unreadable action lies on or before the bar).  Ratios on this basis are those of every as-of date."""
    joined = bars.join(action_arrays(actions), "symbol", "left")
    readable = F.filter(F.coalesce("acts", F.array().cast("array<struct<ex_date:date,multiplier:double>>")), lambda a: a["multiplier"].isNotNull() & (a["ex_date"] > F.col("trade_date")))
    joined = joined.withColumn("to_asof", F.aggregate(readable, F.lit(1.0), lambda p, a: p * a["multiplier"]))
    joined = joined.withColumn("blocked", F.coalesce(F.exists("acts", lambda a: a["multiplier"].isNull() & (a["ex_date"] <= F.col("trade_date"))), F.lit(False)))
    return joined.withColumns({n: F.col(n) / F.col("to_asof") for n in ("open", "high", "low", "close")} | {"volume": F.col("volume") * F.col("to_asof")}).drop("acts")


def suspected_splits(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Days whose open is within 2 % of a split ratio of the close before, without a recorded action that day."""
    known = share_actions(actions).select("symbol", F.col("ex_date").alias("trade_date")).distinct()
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    moved = bars.withColumn("ratio", F.try_divide("open", F.nullif(before, F.lit(0.0))))
    hit = F.coalesce(*[F.when(F.abs(F.col("ratio") - r) / r <= 0.02, F.lit(r)) for r in SPLIT_RATIOS])
    return moved.withColumn("suspected", hit).where("suspected is not null").join(known, ["symbol", "trade_date"], "left_anti").select("symbol", "trade_date", "ratio", "suspected")


# What prices and volumes may be on, and the venues whose range is the market's.
RAW, SPLIT_ADJUSTED = "RAW", "SPLIT_ADJUSTED"
WHOLE_MARKET = ("CONSOLIDATED_SIP_REQUESTED", "CONSOLIDATED_SIP_VERIFIED")


def is_raw() -> Column:
    """Every price of the bar is as traded (columns open_basis, high_basis, low_basis, close_basis)."""
    return (F.col("open_basis") == RAW) & (F.col("high_basis") == RAW) & (F.col("low_basis") == RAW) & (F.col("close_basis") == RAW)


def may_resolve_outcome() -> Column:
    """The bar's high and low are the session's: as traded, and of the whole market (venue_basis)."""
    return is_raw() & F.col("venue_basis").isin(*WHOLE_MARKET)


def comparable_series(bars: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """restate's rows up to as_of, of bars with bases, with volume_comparable and refusal.

    A symbol with a bar that isn't raw is refused (NOT_RAW, null prices).  Volume that the provider has adjusted can't be
    restated if a split lies after as_of (it is null on every bar then); if none does, it is on the as-of basis already.
    """
    day = F.lit(as_of).cast("date")
    rows = restate(bars, actions, as_of)
    later = share_actions(actions).where(F.col("ex_date") > day).select("symbol", F.lit(True).alias("__later")).distinct()
    known = bars.where(F.col("trade_date") <= day).groupBy("symbol").agg(F.bool_or(F.col("volume_basis") == SPLIT_ADJUSTED).alias("__adjusted"), F.bool_and(is_raw()).alias("__raw"))
    rows = rows.join(known, "symbol").join(later, "symbol", "left")
    comparable = ~(F.col("__adjusted") & F.coalesce("__later", F.lit(False)))
    adjusted = F.col("volume_basis") == SPLIT_ADJUSTED
    volume = F.when(comparable & ~F.col("refused"), F.when(adjusted, F.col("volume") / F.col("multiplier")).otherwise(F.col("volume")))
    refusal = F.when(~F.col("__raw"), "NOT_RAW").when(F.col("refused"), "UNREADABLE_ACTION")
    prices = {n: F.when(F.col("__raw"), F.col(n)) for n in ("open", "high", "low", "close")}
    return rows.withColumns(prices | {"volume": F.when(F.col("__raw"), volume), "volume_comparable": comparable & volume.isNotNull() & F.col("__raw"), "refusal": refusal}).drop("__later", "__adjusted", "__raw", "refused")


def comparable_path(sessions: DataFrame, actions: DataFrame, entry: str = "entry_date") -> DataFrame:
    """sessions (symbol, entry_date, trade_date, prices) in the shares of the entry: prices times the multipliers of entry < ex_date <= session.

    applied has the ex-dates of those; a session past an unreadable action has null prices.
    """
    rows = sessions.join(action_arrays(actions), "symbol", "left")
    acts = F.coalesce("acts", F.array().cast("array<struct<ex_date:date,multiplier:double>>"))
    between = F.filter(acts, lambda a: (a["ex_date"] > F.col(entry)) & (a["ex_date"] <= F.col("trade_date")))
    ratio = product_after(F.col(entry), F.col("trade_date"))
    rows = rows.withColumns({"ratio": ratio, "applied": F.array_join(F.transform(between, lambda a: a["ex_date"].cast("string")), ",")})
    return rows.withColumns({n: F.col(n) * F.col("ratio") for n in ("open", "high", "low", "close") if n in sessions.columns}).drop("acts")


def as_traded(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """A vendor's back-adjusted bars as they traded: prices times all later splits, half up to 0.1; volume divided, half up to 1."""
    rows = bars.join(action_arrays(splits), "symbol", "left").withColumn("factor", product_after(F.col("trade_date"))).drop("acts")
    exact = lambda n: F.col(n).cast("decimal(20,6)") * F.col("factor").cast("decimal(18,6)")
    prices = {n: F.round(exact(n), 1).cast("double") for n in ("open", "high", "low", "close") if n in bars.columns}
    return rows.withColumns(prices | {"volume": F.round((F.col("volume").cast("decimal(20,6)") / F.col("factor").cast("decimal(18,6)")).cast("decimal(30,6)"), 0).cast("double")})
