"""Streams over several batches: the same rows however they are cut, on from a checkpoint, and a source that keeps its own mark."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import feeds, pages, states

T0 = dt.datetime(2026, 1, 1)
HOUR = 3_600_000


def plain_watches(rows, life, remember, until):
    """The moves and ends of every key's watch, up to a watermark (milliseconds)."""
    out = []
    for key in {r[0] for r in rows}:
        state, mark = None, None
        steps = sorted((us, item, wanted) for k, us, item, wanted in rows if k == key and us // 1000 < until)
        for us, item, wanted in [*steps, (until * 1000, None, None)]:
            ms = us // 1000
            while state is not None:  # what was due before
                due = mark if state in feeds.MOVES else mark + remember
                if due > ms or (item is None and due >= until):
                    break
                if state in feeds.MOVES:
                    out.append((key, None, due * 1000, state, "EXPIRED", True))
                    state, mark = "EXPIRED", due
                else:
                    state = None
            if item is None:
                break
            if state is None:
                state, mark = "ARMED", ms + life
            ok = wanted in feeds.MOVES.get(state, ())
            out.append((key, item, us, state, wanted, ok))
            if ok:
                state, mark = wanted, mark if wanted in feeds.MOVES else ms
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def moves():
    rng = random.Random(11)
    wanted = ["TRIGGER_HIT", "IN_REANALYSIS", "ENTERED", "REARMED", "REJECTED", "EXPIRED"]
    rows = [(rng.randrange(6), T0 + dt.timedelta(seconds=rng.randrange(12 * 86400)), n, rng.choice(wanted)) for n in range(160)]
    return rows + [(0, rows[0][1], 999, "TRIGGER_HIT"), (77, T0, 1000, "TRIGGER_HIT")]


def rows_of(spark, moves, folder, files):
    """The moves as files in order of time, each with rows an hour or two out of order with its neighbours'."""
    rng = random.Random(files)
    order = sorted(moves, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(150)))
    size = -(-len(order) // files)
    for n in range(files):
        spark.createDataFrame(order[n * size : (n + 1) * size], "key long, ts timestamp, item long, wanted string").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files", [1, 4, 13])
def test_watches_do_not_depend_on_batches(spark, moves, tmp_path, files):
    rows_of(spark, moves, f"{tmp_path}/in", files)
    read = spark.readStream.schema("key long, ts timestamp, item long, wanted string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = states.run(spark, states.watches(read, "key", "item", "wanted", 30 * HOUR, 20 * HOUR, "4 hours"), f"{tmp_path}/out")
    us = lambda ts: int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    plain = [(k, us(ts), item, w) for k, ts, item, w in moves]
    want = plain_watches(plain, 30 * HOUR, 20 * HOUR, max(x[1] for x in plain) // 1000 - 4 * HOUR)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert any(x[1] is None for x in want)


def test_watches_go_on_after_a_stop(spark, moves, tmp_path):
    order = sorted(moves, key=lambda r: r[1])
    schema = "key long, ts timestamp, item long, wanted string"
    build = lambda: states.watches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "key", "item", "wanted", 30 * HOUR, 20 * HOUR, "4 hours")
    for part in (order[:90], order[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = states.run(spark, build(), f"{tmp_path}/out")
    us = lambda ts: int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    plain = [(k, us(ts), item, w) for k, ts, item, w in moves]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_watches(plain, 30 * HOUR, 20 * HOUR, max(x[1] for x in plain) // 1000 - 4 * HOUR)


def test_revisions_in_order(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(hours=h), n, p) for n, (h, p) in enumerate([(0, "a"), (2, "b"), (1, "a"), (3, None), (4, None), (5, "b"), (40, "z")])]
    schema = "key long, ts timestamp, item long, p string"
    for n in range(0, len(rows), 2):
        spark.createDataFrame(rows[n : n + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = states.run(spark, states.revised(read, "key", "item", ["p"], "4 hours"), f"{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1), (1, 1, 2), (1, 3, 3), (1, 5, 4)]


def land(spark, folder, page, ids):
    pages.land(spark.createDataFrame([(i, f"t{i}", page) for i in ids], "item long, title string, number long"), "number", folder)


def test_pages_keep_their_mark(spark, tmp_path):
    """Nothing twice, nothing lost, the mark never moves back, and a full page says so; also after a stop."""
    folder, base = f"file://{tmp_path}/pages", f"{tmp_path}/out"
    run = lambda: {(r.item, r.page, r.mark, r.may_be_cut) for r in states.run(spark, pages.stream(spark, folder, "item long, title string", "item", 3), base).collect()}
    land(spark, folder, 1, [1, 2])
    land(spark, folder, 2, [2, 5, 4])
    first = {(1, 1, None, False), (2, 1, None, False), (5, 2, 2, True), (4, 2, 2, True)}
    assert run() == first
    assert run() == first  # nothing new: nothing again
    land(spark, folder, 3, [1, 3])  # all below the mark
    land(spark, folder, 10, [3, 6])
    assert run() == first | {(6, 10, 5, False)}
    everything = spark.createDataFrame([(i, "d") for i in range(1, 8)], "item long, day string")
    seen = spark.createDataFrame([(5, "d", True), (4, "d", True), (6, "d", False)], "item long, day string, may_be_cut boolean")
    assert sorted(r.item for r in pages.recovered(seen, everything, "day", "item").collect()) == [1, 2, 3, 7]


def test_an_empty_folder_of_pages(spark, tmp_path):
    out = states.run(spark, pages.stream(spark, f"file://{tmp_path}/none", "item long", "item", 3), f"{tmp_path}/out")
    assert out.count() == 0


def test_slices(spark, tmp_path):
    rows = spark.range(100).select("id", (F.lit(T0) + F.make_dt_interval(F.lit(0), (F.col("id") * 7 % 100).cast("int"))).alias("ts"))
    states.slices(rows, f"{tmp_path}/s", 5)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 100


def test_a_batch_calls_the_state_store_a_few_times_per_key():
    """rows of a batch cost a read, a write and at most one timer moved, however many rows wait or pass."""
    from types import SimpleNamespace

    from tidemark.streaming import states

    calls, kept, timers = [], [None], set()
    value = SimpleNamespace(get=lambda: calls.append("get") or kept[0], update=lambda v: calls.append("update") or kept.__setitem__(0, v), clear=lambda: calls.append("clear") or kept.__setitem__(0, None))
    handle = SimpleNamespace(getValueState=lambda name, schema: value, registerTimer=lambda ms: calls.append("register") or timers.add(ms), deleteTimer=lambda ms: calls.append("delete") or timers.remove(ms))
    at = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    watch = states.Watches(1_000, 500)
    watch.init(handle)
    row = lambda ms, n, wanted: {"us": ms * 1000, "item": n, "payload": wanted}
    assert list(watch.handleInputRows((7,), iter([row(30, 2, "IN_REANALYSIS"), row(10, 1, "TRIGGER_HIT"), row(900, 3, "ENTERED")]), at(0))) == []
    assert (calls, timers) == (["get", "register", "update"], {10})
    calls.clear()
    # Rows that came before and rows of this batch pass together, in order of time; the timer moves on.
    out = list(watch.handleInputRows((7,), iter([row(20, 4, "REARMED")]), at(100)))
    assert [(r["item"], r["before"], r["accepted"]) for r in out] == [(1, "ARMED", True), (4, "TRIGGER_HIT", False), (2, "TRIGGER_HIT", True)]
    assert (sorted(calls), timers) == (["delete", "get", "register", "update"], {900})
    calls.clear()
    # The timer goes off: what waited is taken, the watch has ended and is forgotten in time.
    timers.remove(900)
    out = list(watch.handleExpiredTimer((7,), at(950), SimpleNamespace(getExpiryTimeInMs=lambda: 900)))
    assert [(r["item"], r["before"], r["accepted"]) for r in out] == [(3, "IN_REANALYSIS", True)]
    assert (calls, timers) == (["get", "register", "update"], {1_400})
    calls.clear()
    assert list(watch.handleExpiredTimer((7,), at(1_500), SimpleNamespace(getExpiryTimeInMs=lambda: 1_400))) == []
    assert (calls, kept[0]) == (["get", "clear"], None)
    # A timer may go off at a watermark that is not beyond its time: what waits for it gets another, as that one is gone afterwards.
    watch.handleInputRows((8,), iter([row(2_000, 5, "TRIGGER_HIT")]), at(1_500))
    assert list(watch.handleExpiredTimer((8,), at(2_000), SimpleNamespace(getExpiryTimeInMs=lambda: 2_000))) == []
    assert timers >= {2_001}
