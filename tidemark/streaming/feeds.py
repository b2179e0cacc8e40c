"""Feeds of events as streams: dedup, daily counts, revisions and a state machine per key.

Each function takes a streaming DataFrame and returns one; `drain` runs what is there to its end
(trigger availableNow) into a table and gives it back, which is how a bounded replay is done.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import market as m
from ..sources.scratch import scratch_dir

LATENESS = "14 days"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a folder of event files; the event time must be a timestamp with a zone for watermarks.

    What is there is one batch, however many files: they are not in order of time, so a watermark or a state
    kept between batches of them would drop or misnumber rows.
    """
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row per (event_id, content): later copies within the lateness bound are dropped."""
    digest = F.sha2(F.concat_ws("\u001f", F.col("user_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))), 256)
    return rows.withColumn("digest", digest).withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id", "digest"])


def daily_counts(rows: DataFrame) -> DataFrame:
    """Counts per type and day, given out when the watermark has passed the day."""
    days = rows.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def revisions(rows: DataFrame) -> DataFrame:
    """Numbers the changes of a key's payload; state per key is the last digest and number."""

    def step(key, batches, state):
        digest, number = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        props = rows["props"].fillna("")
        changed = props != props.shift(fill_value=digest)
        numbers = number + changed.cumsum()
        state.update((props.iloc[-1], int(numbers.iloc[-1])))
        yield pd.DataFrame({"event_id": rows["event_id"][changed], "user_id": key[0], "revision": numbers[changed]})

    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, revision long", "digest string, number long", "append", "NoTimeout")


def new_items(rows: DataFrame, item: str, mark: int | None) -> DataFrame:
    """Items of a page above the high-water mark; ids grow, publication times need not."""
    return rows if mark is None else rows.where(F.col(item) > mark)


def advanced(rows: DataFrame, item: str, mark: int | None) -> int | None:
    """The mark after a page: its highest id, never lower than the mark was."""
    top = rows.agg(F.max(item).alias("top")).first()["top"]
    return top if mark is None or (top is not None and top > mark) else mark


def recovery_window(last_success: Column, now: Column, most: int = 14) -> Column:
    """(start, stop) of the days to read again when a page may have been cut: from a day before the last success, at most so many days."""
    stop = F.to_date(now)
    start = F.when(last_success.isNull(), F.date_sub(stop, 1)).otherwise(F.greatest(F.date_sub(F.to_date(last_success), 1), F.date_sub(stop, most)))
    return F.struct(start.alias("start"), stop.alias("stop"))


def refetched(known: DataFrame, again: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """What a second reading of recent days changes: NEW, CHANGED or GONE keys, by digests of their values."""
    digest = lambda side: F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]), 256).alias(side)
    both = known.select(*key, digest("old")).join(again.select(*key, digest("new")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "GONE").when(F.col("old") != F.col("new"), "CHANGED")
    return both.select(*key, change.alias("change")).where("change is not null")


# The legal moves of a watch; the other states end it.
MOVES = {
    "ARMED": ("TRIGGER_HIT", "EXPIRED"),
    "TRIGGER_HIT": ("IN_REANALYSIS", "EXPIRED"),
    "IN_REANALYSIS": ("ENTERED", "REJECTED", "REARMED", "EXPIRED"),
    "REARMED": ("TRIGGER_HIT", "EXPIRED"),
}
_ORDER = ("ARMED", "TRIGGER_HIT", "IN_REANALYSIS", "ENTERED", "REJECTED", "REARMED", "EXPIRED")


def watch_states(rows: DataFrame, key: str, item: str, wanted: str) -> DataFrame:
    """(item, key, before, wanted, accepted): moves asked of each key's watch in order of time (ts), kept as state per key.

    Watches start ARMED.  A move that isn't legal from the state, such as entering straight from a trigger, is refused
    and changes nothing.
    """
    legal = np.zeros((len(_ORDER), len(_ORDER)), bool)
    for a, to in MOVES.items():
        legal[_ORDER.index(a), [_ORDER.index(b) for b in to]] = True

    def step(keys, batches, state):
        now = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", item])
        before = np.empty(len(rows), np.int64)
        ok = np.empty(len(rows), bool)
        for i, x in enumerate(rows[wanted].map(_ORDER.index).to_numpy()):  # a state machine goes step by step
            before[i], ok[i] = now, legal[now, x]
            now = x if ok[i] else now
        state.update((int(now),))
        yield pd.DataFrame({item: rows[item].to_numpy(), key: keys[0], "before": [_ORDER[i] for i in before], wanted: rows[wanted].to_numpy(), "accepted": ok})

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(step, f"{item} {kinds[item]}, {key} {kinds[key]}, before string, {wanted} string, accepted boolean", "state long", "append", "NoTimeout")


def drain(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    base = scratch_dir(spark)
    rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = m.table(spark, sf_dir, "events").schema
    return event_stream(spark, f"{sf_dir}/events.parquet*", schema)
