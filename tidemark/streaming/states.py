"""State per key that outlives batches: rows are held until the watermark has passed them, then taken in order of time.

A batch may bring a key's rows in any order, and one time span may be spread over batches; what is
given out depends on neither, as long as rows are no later than the watermark allows.  Timers in
event time let a watch expire without an event, and drop what is no longer needed, so the state of
a key is bounded by the lateness and the life of what is watched.  Needs the RocksDB state store,
which `run` sets for its query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .feeds import MOVES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000


class InOrder(StatefulProcessor):
    """Rows (us, item, payload) of a key in order of (us, item), each once the watermark is beyond it.

    Subclasses give KEPT (schema of what is kept, null before the first row) and three functions: step takes what is
    kept and a row, tick what is kept and a time that has come; both return what is kept then and rows to give
    out.  due says when tick is wanted next (milliseconds, or None).

    A call to the state store costs more than the steps of a key's rows.  So all of a key is one value with one timer, and a
    batch that brings rows of a key takes those that the watermark has passed at once: one read, one write, one timer moved.
    """

    KEPT = "value long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"waiting array<struct<{self.HELD}>>, wake long, kept struct<{self.KEPT}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(r["us"], r["item"], r["payload"]) for r in rows]
        return self._advanced(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advanced(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advanced(self, key, rows: list[tuple], now: int, rung: int | None = None) -> Iterator[Row]:
        """Take in rows and go on to the watermark; rung is the timer that has gone off."""
        held, wake, kept = self.state.get() or ([], None, None)
        rows = sorted([tuple(r) for r in held] + rows)
        kept, out, ready = tuple(kept) if kept is not None else None, [], 0
        while ready < len(rows) and rows[ready][0] // 1000 < now:
            kept, given = self._ticked(key, kept, rows[ready][0] // 1000)
            out += given
            kept, given = self.step(key, kept, *rows[ready])
            out += given
            ready += 1
        kept, given = self._ticked(key, kept, now - 1)
        out += given
        times = [rows[ready][0] // 1000] if ready < len(rows) else []
        if kept is not None and self.due(kept) is not None:
            times.append(self.due(kept))
        after = min(times, default=None)
        # A timer that goes off is gone by itself when this is over.  It also goes off at a watermark that has come to its time, but is not beyond it.
        if after is not None and after == rung:
            after += 1
        if wake is not None and wake not in (after, rung):
            self.handle.deleteTimer(wake)
        if after is not None and after != wake:
            self.handle.registerTimer(after)
        if kept is None and ready == len(rows):
            self.state.clear()
        else:
            self.state.update((rows[ready:], after, kept))
        return iter(out)

    def _ticked(self, key, kept, until: int):
        """All ticks due up to a time, in order."""
        out = []
        while kept is not None and (due := self.due(kept)) is not None and due <= until:
            kept, given = self.tick(key, kept, due)
            out += given
        return kept, out

    def due(self, kept: tuple) -> int | None:
        return None

    def tick(self, key, kept: tuple, ms: int):
        return kept, []


class Watches(InOrder):
    """A watch per key: moves are asked of it, it expires when its life is over, and is forgotten some time after its end."""

    HELD, KEPT = "us long, item long, payload string", "state string, mark long"

    def __init__(self, life_ms: int, remember_ms: int):
        self.life_ms, self.remember_ms = life_ms, remember_ms

    def due(self, kept):
        state, mark = kept
        return mark if state in MOVES else mark + self.remember_ms

    def tick(self, key, kept, ms):
        if kept[0] not in MOVES:
            return None, []
        return ("EXPIRED", ms), [Row(key=key[0], item=None, us=ms * 1000, before=kept[0], wanted="EXPIRED", accepted=True)]

    def step(self, key, kept, us, item, wanted):
        state, mark = kept or ("ARMED", us // 1000 + self.life_ms)
        accepted = wanted in MOVES.get(state, ())
        after = wanted if accepted else state
        return (after, us // 1000 if accepted and after not in MOVES else mark), [Row(key=key[0], item=item, us=us, before=state, wanted=wanted, accepted=accepted)]


class Revisions(InOrder):
    """Numbers the changes of a key's payload."""

    HELD, KEPT = "us long, item long, payload string", "digest string, number long"

    def step(self, key, kept, us, item, payload):
        digest, number = kept or (None, 0)
        if payload == digest:
            return kept, []
        return (payload, number + 1), [Row(key=key[0], item=item, revision=number + 1)]


def _keyed(rows: DataFrame, key: str, item: str, payload, lateness: str):
    held = rows.select(F.col(key).cast("long").alias("key"), F.unix_micros("ts").alias("us"), F.col(item).cast("long").alias("item"), payload.alias("payload"), "ts")
    return held.withWatermark("ts", lateness).groupBy("key")


def watches(rows: DataFrame, key: str, item: str, wanted: str, life_ms: int, remember_ms: int, lateness: str) -> DataFrame:
    """(key, item, us, before, wanted, accepted): moves asked of watches, and (item null) those that expired.

    A watch opens ARMED with its key's first row, ends by a move or at the end of its life, refuses
    what comes then, and is forgotten after remember_ms; the next row opens a new one.
    """
    return _keyed(rows, key, item, F.col(wanted), lateness).transformWithState(Watches(life_ms, remember_ms), "key long, item long, us long, before string, wanted string, accepted boolean", "append", "EventTime")


def revised(rows: DataFrame, key: str, item: str, content: list[str], lateness: str) -> DataFrame:
    """(key, item, revision): rows whose content is another than that of the key's row before."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return _keyed(rows, key, item, digest, lateness).transformWithState(Revisions(), "key long, item long, revision long", "append", "EventTime")


def run(spark: SparkSession, rows: DataFrame, base: str) -> DataFrame:
    """Take in what there is now, on from where the last run with the same base stopped; all rows given out so far."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)
    try:
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def slices(rows: DataFrame, folder: str, n: int) -> None:
    """rows (with ts) as n files one after the other in time, each a batch of a stream that reads one file a trigger."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [i / n for i in range(1, n)] or [0.5])).first()[0] or []
    cuts = [None, *cuts[: n - 1], None]
    us = F.unix_micros("ts")
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high))
        part.coalesce(1).write.mode("append").parquet(folder)
