"""Streams over several batches: a paged source with its own offsets, watches that expire, revisions in order of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import market as m
from ..sources.scratch import scratch_dir
from ..streaming import feeds, pages, states
from .registry import query
from .streams import WANTED

#: Items that fit on a page of the index.
LIMIT = 300
LIFE_DAYS, REMEMBER_DAYS, LATE_DAYS = 2, 3, 1


@query(
    "stream_index_pages",
    f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id DESC) AS r FROM e),
    t AS (SELECT day, max(event_id) AS top, count(*) >= {LIMIT} AS may_be_cut FROM p WHERE r <= {LIMIT} GROUP BY day), k AS (SELECT *, max(top) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM t),
    n AS (SELECT p.event_id, p.day, mark, may_be_cut FROM p JOIN k ON p.day = k.day WHERE r <= {LIMIT} AND (mark IS NULL OR event_id > mark))
    SELECT event_id, day, mark, may_be_cut, 'PAGE' AS origin FROM n UNION ALL
    SELECT event_id, day, NULL, NULL, 'RECOVERY' FROM e WHERE day IN (SELECT day FROM n WHERE may_be_cut) AND event_id NOT IN (SELECT event_id FROM n)""",
)
def stream_index_pages(spark, d):
    """A day's page holds its newest items; half of the pages are there when the stream first runs, the rest at its restart."""
    day = F.to_date("ts").alias("day")
    items = m.table(spark, d, "events").select(F.col("event_id").cast("long"), day)
    page = F.unix_date("day").cast("long")
    newest = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("event_id")))
    fits = items.withColumn("n", newest).where(F.col("n") <= LIMIT).select("event_id", "day", page.alias("number"))
    base = scratch_dir(spark)
    middle = items.agg((F.floor((F.min(page) + F.max(page)) / 2)).alias("p")).first()["p"] or 0
    for part in (F.col("number") <= middle, F.col("number") > middle):
        pages.land(fits.where(part), "number", f"{base}/pages")
        seen = states.run(spark, pages.stream(spark, f"{base}/pages", "event_id long, day date", "event_id", LIMIT), base)
    again = pages.recovered(seen, items, "day", "event_id")
    none = F.lit(None)
    return seen.select("event_id", "day", "mark", "may_be_cut", F.lit("PAGE").alias("origin")).unionByName(again.select("event_id", "day", none.cast("long").alias("mark"), none.cast("boolean").alias("may_be_cut"), F.lit("RECOVERY").alias("origin")))


def replay(spark, d, columns, n=4):
    """The events as a stream of n batches in order of time."""
    rows = m.table(spark, d, "events").select(*columns, F.col("ts").cast("timestamp").alias("ts"))
    folder = scratch_dir(spark)
    states.slices(rows, folder, n)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


PASSED_SQL = f"(SELECT epoch_us(max(ts)) // 1000 - {LATE_DAYS} * 86400000 FROM events)"
_TERMINAL = "state NOT IN ({})".format(", ".join(f"'{a}'" for a in feeds.MOVES))
_LEGAL = " OR ".join(f"(s1 = '{a}' AND wanted IN {b!r})" for a, b in feeds.MOVES.items())


@query(
    "stream_watches",
    f"""WITH RECURSIVE w AS (SELECT {PASSED_SQL} AS wm), e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, ({list(WANTED)!r})[event_id % 29 % 5 + 1] AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events, w WHERE epoch_us(ts) // 1000 < wm),
    s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS us, NULL::VARCHAR AS before, NULL::VARCHAR AS wanted, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS state, NULL::BIGINT AS mark, NULL::VARCHAR AS x_state, NULL::BIGINT AS x_at FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, k, event_id, us, s1, wanted, accepted, after, CASE WHEN accepted AND after IN ('ENTERED', 'REJECTED', 'EXPIRED') THEN ms ELSE m1 END, x_state, x_at FROM (SELECT *, {_LEGAL} AS accepted, CASE WHEN {_LEGAL} THEN wanted ELSE s1 END AS after FROM (
        SELECT *, CASE WHEN gone THEN 'ARMED' ELSE s0 END AS s1, CASE WHEN gone THEN ms + {LIFE_DAYS} * 86400000 ELSE m0 END AS m1 FROM (SELECT *, s0 IS NULL OR (s0 IN ('ENTERED', 'REJECTED', 'EXPIRED') AND ms >= m0 + {REMEMBER_DAYS} * 86400000) AS gone FROM (
        SELECT e.*, CASE WHEN out THEN 'EXPIRED' ELSE state END AS s0, mark AS m0, CASE WHEN out THEN state END AS x_state, CASE WHEN out THEN mark END AS x_at FROM (SELECT s.user_id, s.k, state, mark, e.event_id, e.us, e.ms, e.wanted, NOT ({_TERMINAL}) AND e.ms >= mark AS out FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) x JOIN e ON e.user_id = x.user_id AND e.k = x.k + 1)))))
    SELECT user_id, event_id, us, before, wanted, accepted FROM s WHERE k > 0
    UNION ALL SELECT user_id, NULL, x_at * 1000, x_state, 'EXPIRED', true FROM s WHERE x_at IS NOT NULL
    UNION ALL SELECT user_id, NULL, mark * 1000, state, 'EXPIRED', true FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS back FROM s), w WHERE back = 1 AND NOT ({_TERMINAL}) AND mark < wm""",
)
def stream_watches(spark, d):
    """A watch per user, over four batches: moves asked of it, and its end without an event."""
    want = F.element_at(F.array(*[F.lit(w) for w in WANTED]), (F.col("event_id") % 29 % 5 + 1).cast("int")).alias("wanted")
    rows = states.watches(replay(spark, d, ["event_id", "user_id", want]), "user_id", "event_id", "wanted", LIFE_DAYS * states.DAY_MS, REMEMBER_DAYS * states.DAY_MS, f"{LATE_DAYS} days")
    return states.run(spark, rows, scratch_dir(spark)).select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), "us", "before", "wanted", "accepted")


@query(
    "stream_revisions_in_order",
    f"WITH r AS (SELECT event_id, user_id, ts, event_type, props, lag(event_type) OVER o AS t0, lag(props) OVER o AS p0, row_number() OVER o AS k FROM events WHERE epoch_us(ts) // 1000 < {PASSED_SQL} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM r WHERE k = 1 OR event_type IS DISTINCT FROM t0 OR props IS DISTINCT FROM p0",
)
def stream_revisions_in_order(spark, d):
    """Changes of a user's type and payload, numbered over four batches."""
    rows = states.revised(replay(spark, d, ["event_id", "user_id", "event_type", "props"]), "user_id", "event_id", ["event_type", "props"], f"{LATE_DAYS} days")
    return states.run(spark, rows, scratch_dir(spark)).select(F.col("item").alias("event_id"), F.col("key").alias("user_id"), "revision")
