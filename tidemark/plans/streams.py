"""Streaming queries, replayed over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import market as m
from ..streaming import feeds
from .registry import query


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    rows = feeds.deduplicated(feeds.feed(spark, d))
    return feeds.drain(spark, rows.select("event_id", "user_id", "event_type"))


@query("stream_daily_counts", "WITH c AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(d AS DATE) AS day, event_type, n FROM c WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def stream_daily_counts(spark, d):
    return feeds.drain(spark, feeds.daily_counts(feeds.feed(spark, d))).select(F.to_date("day").alias("day"), "event_type", "n")


@query("stream_revisions", "WITH r AS (SELECT event_id, user_id, ts, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM r WHERE before IS NULL OR before <> props")
def stream_revisions(spark, d):
    return feeds.drain(spark, feeds.revisions(feeds.feed(spark, d)))


WANTED = ("TRIGGER_HIT", "IN_REANALYSIS", "ENTERED", "REARMED", "EXPIRED")


@query(
    "stream_watch_states",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ({list(WANTED)!r})[event_id % 29 % 5 + 1] AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, NULL::VARCHAR AS wanted, NULL::BOOLEAN AS accepted, 'ARMED' AS state FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, k, event_id, before, wanted, accepted, CASE WHEN accepted THEN wanted ELSE before END FROM (SELECT e.user_id, e.k, e.event_id, s.state AS before, e.wanted, {' OR '.join(f"(s.state = '{a}' AND e.wanted IN {b!r})" for a, b in feeds.MOVES.items())} AS accepted FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
    SELECT event_id, user_id, before, wanted, accepted FROM s WHERE k > 0""",
)
def stream_watch_states(spark, d):
    """A watch per user: what each event asks of it, as state per key of a stream."""
    want = F.element_at(F.array(*[F.lit(w) for w in WANTED]), (F.col("event_id") % 29 % 5 + 1).cast("int"))
    rows = feeds.feed(spark, d).select("event_id", "user_id", "ts", want.alias("wanted"))
    return feeds.drain(spark, feeds.watch_states(rows, "user_id", "event_id", "wanted"))


# A page of an index: the items of a day that were there when it was read; one read a day.
@query(
    "feed_cursor",
    """WITH p AS (SELECT CAST(ts AS DATE) AS page, count(*) AS items, max(event_id) AS top FROM events GROUP BY 1), m AS (SELECT *, max(top) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM p)
    SELECT m.page, items, mark, greatest(top, mark) AS advanced, count(event_id) FILTER (WHERE mark IS NULL OR event_id > mark) AS new_items, items >= 400 AS may_be_cut FROM m JOIN events ON CAST(ts AS DATE) = m.page GROUP BY m.page, items, mark, top""",
)
def feed_cursor(spark, d):
    """Per page: the high-water mark before and after it, what is new above the mark, and whether a full page may have been cut."""
    from pyspark.sql import Window

    e = m.table(spark, d, "events").select("event_id", F.to_date("ts").alias("page"))
    # A row per page: days of a feed.
    pages = e.groupBy("page").agg(F.count("*").alias("items"), F.max("event_id").alias("top"))
    mark = F.max("top").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.withColumn("mark", mark)
    new = e.join(F.broadcast(pages), "page").groupBy("page", "items", "mark", "top").agg(F.count_if(F.col("mark").isNull() | (F.col("event_id") > F.col("mark"))).alias("new_items"))
    return new.select("page", "items", "mark", F.greatest("top", "mark").alias("advanced"), "new_items", (F.col("items") >= 400).alias("may_be_cut"))


@query("recovery_windows", "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) END AS last_success, CAST(o_orderdate AS DATE) AS now FROM orders) SELECT o_orderkey, CASE WHEN last_success IS NULL THEN now - 1 ELSE greatest(last_success - 1, now - 14) END AS start, now AS stop FROM r")
def recovery_windows(spark, d):
    key, now = F.col("o_orderkey"), F.to_date("o_orderdate")
    last = F.when(key % 5 != 0, F.date_sub(now, (key % 30).cast("int")))
    return m.table(spark, d, "orders").select("o_orderkey", feeds.recovery_window(last, now).alias("w")).select("o_orderkey", "w.start", "w.stop")


@query(
    "rolling_refetch",
    """WITH k AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderkey % 17 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderkey % 19 <> 0),
    b AS (SELECT coalesce(k.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN k.o_orderkey IS NULL THEN 'NEW' WHEN a.o_orderkey IS NULL THEN 'GONE' WHEN k.o_orderstatus IS DISTINCT FROM a.o_orderstatus OR k.o_totalprice IS DISTINCT FROM a.o_totalprice THEN 'CHANGED' END AS change FROM k FULL JOIN a ON k.o_orderkey = a.o_orderkey) SELECT * FROM b WHERE change IS NOT NULL""",
)
def rolling_refetch(spark, d):
    """Recent days read again: the provider overwrites without saying so, so digests are compared."""
    recent = m.table(spark, d, "orders").where(F.to_date("o_orderdate") >= F.lit("1998-01-01").cast("date")).select("o_orderkey", "o_orderstatus", "o_totalprice")
    again = recent.where("o_orderkey % 19 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return feeds.refetched(recent.where("o_orderkey % 17 <> 0"), again, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
