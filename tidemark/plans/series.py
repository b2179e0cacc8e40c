"""Series on one share basis with their refusals, paths from an entry, adjustments undone, and cascades over single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import decisions as de
from ..operators import outcome as oc
from ..operators import restate as rs
from ..sources import market as m
from .registry import q, query, sq
from .technical import AS_OF, SHARE_SQL

BASIS_SQL = f"""{m.BARS_SQL}, {SHARE_SQL}, bb AS (SELECT *, CASE WHEN symbol % 23 = 4 AND day(trade_date) = 3 THEN 'SPLIT_ADJUSTED' ELSE 'RAW' END AS close_basis, CASE WHEN symbol % 4 = 0 THEN 'SPLIT_ADJUSTED' ELSE 'RAW' END AS volume_basis, CASE symbol % 3 WHEN 0 THEN 'CONSOLIDATED_SIP_REQUESTED' WHEN 1 THEN 'CONSOLIDATED_SIP_VERIFIED' ELSE 'SINGLE_VENUE_OTHER' END AS venue_basis FROM bars)"""


def based(spark, d):
    symbol = F.col("symbol")
    raw = F.lit("RAW")
    close = F.when((symbol % 23 == 4) & (F.dayofmonth("trade_date") == 3), "SPLIT_ADJUSTED").otherwise("RAW")
    return m.bars(spark, d).withColumns({"open_basis": raw, "high_basis": raw, "low_basis": raw, "close_basis": close, "volume_basis": F.when(symbol % 4 == 0, "SPLIT_ADJUSTED").otherwise("RAW"), "venue_basis": F.when(symbol % 3 == 0, "CONSOLIDATED_SIP_REQUESTED").when(symbol % 3 == 1, "CONSOLIDATED_SIP_VERIFIED").otherwise("SINGLE_VENUE_OTHER")})


@query("outcome_bars", f"WITH {BASIS_SQL} SELECT symbol, trade_date, close_basis = 'RAW' AS is_raw, close_basis = 'RAW' AND venue_basis IN {rs.WHOLE_MARKET!r} AS may_resolve FROM bb")
def outcome_bars(spark, d):
    return based(spark, d).select("symbol", "trade_date", rs.is_raw().alias("is_raw"), rs.may_resolve_outcome().alias("may_resolve"))


@query(
    "comparable_series",
    f"""WITH {BASIS_SQL}, bad AS (SELECT DISTINCT symbol FROM acts WHERE mult IS NULL AND ex_date <= DATE '{AS_OF}'), later AS (SELECT DISTINCT symbol FROM acts WHERE ex_date > DATE '{AS_OF}'), flags AS (SELECT symbol, bool_or(volume_basis <> 'RAW') AS adjusted, bool_and(close_basis = 'RAW') AS raw FROM bb WHERE trade_date <= DATE '{AS_OF}' GROUP BY symbol),
    k AS (SELECT b.symbol, b.trade_date, any_value(b.close) AS close, any_value(b.volume) AS volume, any_value(volume_basis) AS volume_basis, coalesce(product(a.mult), 1.0) AS multiplier FROM bb b LEFT JOIN acts a ON a.symbol = b.symbol AND a.ex_date > b.trade_date AND a.ex_date <= DATE '{AS_OF}' AND a.mult IS NOT NULL WHERE b.trade_date <= DATE '{AS_OF}' GROUP BY b.symbol, b.trade_date),
    v AS (SELECT k.*, raw, bad.symbol IS NOT NULL AS refused, NOT (adjusted AND later.symbol IS NOT NULL) AS comparable FROM k JOIN flags ON flags.symbol = k.symbol LEFT JOIN bad ON bad.symbol = k.symbol LEFT JOIN later ON later.symbol = k.symbol)
    SELECT symbol, trade_date, {sq('CASE WHEN raw AND NOT refused THEN close / multiplier END')} AS close, {sq("CASE WHEN raw AND NOT refused AND comparable THEN CASE WHEN volume_basis = 'RAW' THEN volume * multiplier ELSE volume END END")} AS volume, raw AND NOT refused AND comparable AS volume_comparable, CASE WHEN NOT raw THEN 'NOT_RAW' WHEN refused THEN 'UNREADABLE_ACTION' END AS refusal FROM v""",
)
def comparable_series(spark, d):
    rows = rs.comparable_series(based(spark, d), m.actions(spark, d), AS_OF)
    return rows.select("symbol", "trade_date", q("close", "close"), q("volume", "volume"), "volume_comparable", "refusal")


PATH_SQL = f"{m.BARS_SQL}, {SHARE_SQL}, p AS (SELECT symbol, DATE '1996-01-01' + CAST(symbol % 300 AS INTEGER) AS entry_date, trade_date, high, low FROM bars WHERE trade_date > DATE '1996-01-01' + CAST(symbol % 300 AS INTEGER))"


@query(
    "comparable_path",
    f"""WITH {PATH_SQL}, k AS (SELECT p.symbol, entry_date, trade_date, any_value(high) AS high, any_value(low) AS low, CASE WHEN count(a.ex_date) > count(a.mult) THEN NULL ELSE coalesce(product(a.mult), 1.0) END AS ratio, coalesce(string_agg(CAST(a.ex_date AS VARCHAR), ',' ORDER BY a.ex_date), '') AS applied FROM p LEFT JOIN acts a ON a.symbol = p.symbol AND a.ex_date > entry_date AND a.ex_date <= trade_date GROUP BY p.symbol, entry_date, trade_date)
    SELECT symbol, trade_date, {sq('high * ratio')} AS high, {sq('low * ratio')} AS low, applied FROM k""",
)
def comparable_path(spark, d):
    entry = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("symbol") % 300).cast("int"))
    sessions = m.bars(spark, d).select("symbol", entry.alias("entry_date"), "trade_date", "high", "low").where("trade_date > entry_date")
    return rs.comparable_path(sessions, m.actions(spark, d)).select("symbol", "trade_date", q("high", "high"), q("low", "low"), "applied")


@query(
    "as_traded",
    f"""WITH {m.BARS_SQL}, {SHARE_SQL}, k AS (SELECT b.symbol, b.trade_date, any_value(b.close) AS close, any_value(b.volume) AS volume, coalesce(product(a.mult), 1.0) AS factor FROM bars b LEFT JOIN acts a ON a.symbol = b.symbol AND a.ex_date > b.trade_date AND a.mult IS NOT NULL GROUP BY b.symbol, b.trade_date)
    SELECT symbol, trade_date, round(CAST(close AS DECIMAL(20,6)) * CAST(factor AS DECIMAL(12,6)), 1)::DOUBLE AS close, round(CAST(volume / factor AS DECIMAL(30,6)), 0)::DOUBLE AS volume FROM k""",
)
def as_traded(spark, d):
    splits = m.actions(spark, d).where("split_from is not null or adjustment_factor is not null")
    return rs.as_traded(m.bars(spark, d), splits).select("symbol", "trade_date", "close", "volume")


ENTRY_SQL = "e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 50 END AS decision_price, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 45 END AS entry_price, o_orderkey % 7 = 0 AS open_episode, o_orderkey % 5 <> 0 AS session_open, o_orderkey % 17 = 0 AS stale FROM orders)"


@query("entry_decision", f"WITH {ENTRY_SQL} SELECT o_orderkey, CASE WHEN stale THEN 'REFUSED_STALE_INPUT' WHEN decision_price IS NULL THEN 'REFUSED_NO_PRICE' WHEN decision_price > 3000 THEN 'REFUSED_LIMIT_AT_DECISION' WHEN open_episode THEN 'DUPLICATE_OPEN_EPISODE' WHEN NOT session_open THEN 'WAIT_FOR_SESSION' WHEN entry_price IS NULL THEN 'WAIT_FOR_PRICE' WHEN entry_price > 3000 THEN 'REFUSED_LIMIT_AT_ENTRY' ELSE 'ENTER' END AS decision FROM e")
def entry_decision(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = m.table(spark, d, "orders").select(k, F.when(k % 13 != 0, price / 50).alias("decision_price"), F.when(k % 11 != 0, price / 45).alias("entry_price"), (k % 7 == 0).alias("open_episode"), (k % 5 != 0).alias("session_open"), (k % 17 == 0).alias("stale"))
    return de.entry_decision(rows).select("o_orderkey", "decision")


LADDER_SQL = """l AS (SELECT o_orderkey, o_orderkey % 4 <> 0 AS intraday, o_orderkey % 6 <> 0 AS trades, CASE WHEN o_orderkey % 19 <> 0 THEN 100.0 + o_custkey % 13 END AS open, 100.0 + o_custkey % 13 + o_orderkey % 17 AS high, 100.0 + o_custkey % 13 - o_orderkey % 11 AS low, 112.0 AS target, 98.0 AS failure FROM orders),
b AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'BOTH' WHEN o_orderkey % 3 = 1 THEN 'UP' ELSE 'DOWN' END AS bar, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS trade FROM l)"""


@query(
    "session_ladder",
    f"""WITH {LADDER_SQL} SELECT o_orderkey, CASE WHEN open >= target THEN 'TARGET_FIRST' WHEN open <= failure THEN 'FAILURE_FIRST' WHEN open IS NULL THEN 'UNRESOLVED_MISSING_DATA' WHEN high >= target AND low <= failure THEN CASE WHEN NOT intraday THEN 'AMBIGUOUS_PATH' WHEN bar IS NULL THEN 'UNRESOLVED_MISSING_DATA' WHEN bar = 'UP' THEN 'TARGET_FIRST' WHEN bar = 'DOWN' THEN 'FAILURE_FIRST'
    WHEN NOT trades THEN 'AMBIGUOUS_PATH' WHEN trade IS NULL THEN 'UNRESOLVED_MISSING_DATA' WHEN trade = 'UP' THEN 'TARGET_FIRST' ELSE 'FAILURE_FIRST' END WHEN high >= target THEN 'TARGET_FIRST' WHEN low <= failure THEN 'FAILURE_FIRST' ELSE 'NOT_REACHED' END AS resolution FROM b""",
)
def session_ladder(spark, d):
    """The open decides, then the day's range, then intraday bars, then trades."""
    k, customer = F.col("o_orderkey"), F.col("o_custkey")
    base = 100.0 + customer % 13
    target, failure = F.lit(112.0), F.lit(98.0)
    bar = lambda h, low: F.array(F.struct(F.lit(105.0).alias("open"), F.lit(h).alias("high"), F.lit(low).alias("low")))
    no_bars, no_trades = F.array().cast("array<struct<open:double,high:double,low:double>>"), F.array().cast("array<struct<at:int,price:double>>")
    bars = F.when(k % 5 == 0, no_bars).when(k % 3 == 0, bar(113.0, 97.0)).when(k % 3 == 1, bar(113.0, 99.0)).otherwise(bar(111.0, 97.0))
    trade = lambda p: F.array(F.struct(F.lit(1).alias("at"), F.lit(105.0).alias("price")), F.struct(F.lit(2).alias("at"), F.lit(p).alias("price")))
    trades = F.when(k % 8 == 0, no_trades).when(k % 2 == 0, trade(113.0)).otherwise(trade(97.0))
    rows = m.table(spark, d, "orders").select(k, (k % 4 != 0).alias("i"), (k % 6 != 0).alias("t"), bars.alias("bars"), trades.alias("trades"), F.when(k % 19 != 0, base).alias("open"), (base + k % 17).alias("high"), (base - k % 11).alias("low"))
    c = F.col
    return rows.select("o_orderkey", oc.resolve_session(c("i"), c("t"), c("bars"), c("trades"), c("open"), c("high"), c("low"), target, failure).alias("resolution"))


@query("identity_keys", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'registry:' || c_custkey WHEN c_custkey % 3 = 1 THEN 'anchored:' || c_nationkey || ':' || c_custkey ELSE 'provisional:' || lower(replace(c_name, '#', ' ')) END AS identity_key FROM customer")
def identity_keys(spark, d):
    k = F.col("c_custkey")
    rows = m.table(spark, d, "customer").select(k, "c_name", F.when(k % 3 == 0, k.cast("string")).alias("registry"), F.when(k % 3 == 1, F.concat_ws(":", F.col("c_nationkey").cast("string"), k.cast("string"))).alias("anchor"))
    return rows.select("c_custkey", tx.identity_key(F.col("registry"), F.col("anchor"), "c_name").alias("identity_key"))


@query("local_times", "SELECT event_id, ts - INTERVAL 9 HOUR AS instant FROM events")
def local_times(spark, d):
    return m.table(spark, d, "events").select("event_id", tx.local_to_utc(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("instant"))


@query("never_entered_labels", f"WITH {m.BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS k FROM bars WHERE close IS NOT NULL), e AS (SELECT symbol, k AS k0, trade_date AS as_of, close AS reference FROM n WHERE k % 50 = 10), s AS (SELECT e.symbol, as_of, n.k - k0 AS idx, high, low, reference FROM e JOIN n ON n.symbol = e.symbol AND n.k > k0 AND n.k <= k0 + 20) SELECT symbol, as_of, max(high) >= any_value(reference) * 1.1::DOUBLE AS hit_10, max(high) >= any_value(reference) * 1.2::DOUBLE AS hit_20, max(high) >= any_value(reference) * 1.3::DOUBLE AS hit_30, min(CASE WHEN high >= reference * 1.2::DOUBLE THEN idx END) AS days_to_20, {sq('max(high) / any_value(reference) - 1')} AS mfe, {sq('min(low) / any_value(reference) - 1')} AS mae FROM s GROUP BY symbol, as_of")
def never_entered_labels(spark, d):
    """Measures of securities nobody predicted on: no failure line, no path, only what the price did in 20 sessions."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("trade_date")
    ahead = w.rowsBetween(1, 20)
    bars = m.bars(spark, d).where("close is not null").withColumn("k", F.row_number().over(w) - 1)
    target = F.col("close") * 1.2
    rows = bars.withColumns({"up": F.max("high").over(ahead), "down": F.min("low").over(ahead), "path": F.collect_list("high").over(ahead)}).where("k % 50 = 10 and up is not null")
    first = F.array_position(F.transform("path", lambda h: h >= target), True)
    hit = lambda x: F.col("up") >= F.col("close") * x
    return rows.select("symbol", F.col("trade_date").alias("as_of"), hit(1.1).alias("hit_10"), hit(1.2).alias("hit_20"), hit(1.3).alias("hit_30"), F.nullif(first, F.lit(0)).alias("days_to_20"), q(F.col("up") / F.col("close") - 1, "mfe"), q(F.col("down") / F.col("close") - 1, "mae"))




@query("canonical_hashes", """SELECT c_custkey, sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","nation":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || '}') AS digest FROM customer""")
def canonical_hashes(spark, d):
    """SHA-256 of each row's canonical JSON."""
    k = F.col("c_custkey")
    text = tx.canonical_json(name=F.col("c_name"), key=k, nation=F.when(k % 5 != 0, F.col("c_nationkey")))
    return m.table(spark, d, "customer").select(k, F.sha2(text, 256).alias("digest"))
