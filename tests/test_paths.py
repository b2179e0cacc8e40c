"""Paths: a case for every rung and refusal, and episodes with both layers."""

from datetime import datetime

import pytest

from tidemark.operators import paths as pa

SESSION = "name string, open double, high double, low double, close double, target double, failure double, from_time timestamp, intraday_exists boolean, trades_exist boolean"
T, F, A, M = "TARGET_FIRST", "FAILURE_FIRST", "AMBIGUOUS_PATH", "UNRESOLVED_MISSING_DATA"


def at(h, m=0):
    return datetime(2024, 1, 5, h, m)


WIDE = (100.0, 125.0, 90.0, 110.0)
# name: (open, high, low, close), bars (hour, open, high, low), trades (hour, price), options, what is found
CASES = {
    "day reaches the target alone": ((100.0, 121.0, 99.0, 120.0), [], [], {}, (T, "DAY", None)),
    "day reaches the failure line alone": ((100.0, 110.0, 94.0, 95.0), [], [], {}, (F, "DAY", None)),
    "opens at the target": ((120.0, 125.0, 90.0, 95.0), [], [], {}, (T, "SESSION_OPEN", None)),
    "opens below the failure line": ((93.0, 125.0, 90.0, 95.0), [], [], {}, (F, "SESSION_OPEN", None)),
    "opens beyond a line, rest unknown": ((121.0, None, None, None), [], [], {}, (T, "SESSION_OPEN", None)),
    "neither": ((100.0, 110.0, 96.0, 100.0), [], [], {}, (None, None, None)),
    "no low": ((100.0, 125.0, None, 100.0), [], [], {}, (M, None, None)),
    "no open": ((None, 125.0, 90.0, 100.0), [], [], {}, (M, None, None)),
    "no close": ((100.0, 125.0, 90.0, None), [], [], {}, (M, None, None)),
    "bars order the day": (WIDE, [(11, 100.0, 121.0, 96.0), (10, 100.0, 110.0, 94.0)], [], {}, (F, "INTRADAY_BAR", at(10))),
    "a bar opens beyond a line": (WIDE, [(10, 121.0, 122.0, 90.0)], [], {}, (T, "INTRADAY_BAR", at(10))),
    "a bar opens below the failure line": (WIDE, [(10, 94.0, 122.0, 90.0)], [], {}, (F, "INTRADAY_BAR", at(10))),
    "bars cross neither line": (WIDE, [(10, 100.0, 110.0, 99.0)], [(10, 121.0)], {}, (M, None, None)),
    "a bar spans both, trades decide": (WIDE, [(10, 100.0, 121.0, 94.0)], [(10, 100.0), (12, 94.0), (11, 121.0)], {}, (T, "TRADE", at(11))),
    "trades of one instant reach both": (WIDE, [(10, 100.0, 121.0, 94.0)], [(10, 100.0), (11, 121.0), (11, 94.0)], {}, (A, "TRADE", at(11))),
    "trades reach neither": (WIDE, [(10, 100.0, 121.0, 94.0)], [(10, 100.0)], {}, (None, None, None)),
    "no trades in this market": (WIDE, [(10, 100.0, 121.0, 94.0)], [], {"trades_exist": False}, (A, "INTRADAY_BAR", None)),
    "trades should be there": (WIDE, [(10, 100.0, 121.0, 94.0)], [], {}, (M, None, None)),
    "bars should be there": (WIDE, [], [(11, 121.0)], {}, (M, None, None)),
    "no bars in this market, trades decide": (WIDE, [], [(11, 94.0), (12, 121.0)], {"intraday_exists": False}, (F, "TRADE", at(11))),
    "no bars, no trades in this market": (WIDE, [], [], {"intraday_exists": False, "trades_exist": False}, (A, "INTRADAY_BAR", None)),
    "a null price and a null bar decide nothing": (WIDE, [(9, None, None, None), (10, 100.0, 121.0, 96.0)], [(9, None)], {}, (T, "INTRADAY_BAR", at(10))),
    "lines out of order": (WIDE, [], [], {"failure": 120.0}, ("REFUSED_LINES", None, None)),
    "no line": (WIDE, [], [], {"target": None}, ("REFUSED_LINES", None, None)),
    # The entry session: the day's high came before the entry.
    "entry: the day is not read": (WIDE, [(11, 100.0, 105.0, 99.0)], [], {"from_time": at(10)}, (None, None, None)),
    "entry: an open beyond the target is not read": ((121.0, 125.0, 90.0, 95.0), [], [(11, 94.0)], {"from_time": at(10)}, (F, "TRADE", at(11))),
    "entry: trades after, not at, the entry": (WIDE, [], [(9, 94.0), (10, 94.0), (11, 121.0)], {"from_time": at(10)}, (T, "TRADE", at(11))),
    "entry: trades go before bars": (WIDE, [(11, 94.0, 95.0, 90.0)], [(11, 100.0)], {"from_time": at(10)}, (None, None, None)),
    "entry: a bar that begins at the entry counts": (WIDE, [(9, 94.0, 95.0, 90.0), (10, 100.0, 121.0, 99.0)], [], {"from_time": at(10)}, (T, "INTRADAY_BAR", at(10))),
    "entry: one bar reaches both": (WIDE, [(10, 100.0, 121.0, 90.0)], [], {"from_time": at(10)}, (A, "INTRADAY_BAR", at(10))),
    "entry: nothing after, but there should be": (WIDE, [(9, 100.0, 121.0, 90.0)], [(10, 121.0)], {"from_time": at(10)}, (M, None, None)),
    "entry: nothing after, trades exist": (WIDE, [], [], {"from_time": at(10), "intraday_exists": False}, (M, None, None)),
    "entry: nothing finer in this market": (WIDE, [], [], {"from_time": at(10), "intraday_exists": False, "trades_exist": False}, (A, "INTRADAY_BAR", None)),
}


@pytest.fixture(scope="module")
def resolved(spark):
    sessions, bars, trades = [], [], []
    for name, (day, b, t, options, _) in CASES.items():
        o = {"target": 120.0, "failure": 95.0, "from_time": None, "intraday_exists": True, "trades_exist": True} | options
        sessions.append((name, *day, *o.values()))
        bars += [(name, at(h), *x) for h, *x in b]
        trades += [(name, at(h), p) for h, p in t]
    bars = spark.createDataFrame(bars, "name string, starts_at timestamp, open double, high double, low double")
    out = pa.resolve(spark.createDataFrame(sessions, SESSION), bars, spark.createDataFrame(trades, "name string, at timestamp, price double"), ["name"])
    return {r.name: r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_rung(resolved, name):
    r = resolved[name]
    assert (r.resolution, r.granularity, r.decided_at) == CASES[name][-1]


def test_prices_that_count(resolved):
    for name, want in (("neither", (110.0, 96.0, False)), ("no low", (None, None, True)), ("entry: the day is not read", (105.0, 99.0, False)), ("entry: trades after, not at, the entry", (121.0, 121.0, True)), ("entry: nothing after, trades exist", (None, None, False))):
        assert (resolved[name].top, resolved[name].bottom, resolved[name].touched_target) == want


EPISODE = "episode_id string, idx int, entry double, resolution string, granularity string, decided_at timestamp, top double, bottom double, touched_target boolean, suspected boolean"


def episode(name, n=21, at_idx=None, suspected=False, **decided):
    """Sessions 0 to n-1; decided: s<idx> = (resolution, top, bottom)."""
    rows = []
    for i in range(n):
        resolution, top, bottom = decided.get(f"s{i}", (None, 105.0, 98.0))
        rows.append((name, i, 100.0, resolution, "DAY" if resolution else None, None, top, bottom, top is not None and top >= 120, suspected and i == 3))
    return rows, [(name, at_idx)] if at_idx is not None else []


EPISODES = {
    "expired": (episode("expired"), ("HORIZON_EXPIRED", 20, "NEITHER_BY_HORIZON", None, False, None)),
    "S21 is not waited for": (episode("S21 is not waited for", 22, s21=(T, 130.0, 99.0)), ("HORIZON_EXPIRED", 20, "NEITHER_BY_HORIZON", None, False, None)),
    "short": (episode("short", 20), (None, None, None, "HORIZON_INCOMPLETE", None, None)),
    "first decides": (episode("first decides", 21, s3=(F, 101.0, 90.0), s7=(T, 125.0, 99.0)), ("INITIAL_FAILURE_HIT", 3, F, None, True, 7)),
    "final before S20": (episode("final before S20", 5, s4=(T, 125.0, 99.0)), ("TARGET_HIT", 4, T, None, True, 4)),
    "ambiguous is neither": (episode("ambiguous is neither", 21, s2=(A, 125.0, 90.0)), (A, 2, A, None, True, 2)),
    "missing is neither": (episode("missing is neither", 21, s0=(M, None, None)), (M, 0, M, None, False, None)),
    "called off, then the target": (episode("called off, then the target", 21, at_idx=4, s12=(T, 125.0, 99.0)), ("THESIS_INVALIDATED", 4, None, None, True, 12)),
    "called off after the target": (episode("called off after the target", 21, at_idx=4, s2=(T, 125.0, 99.0)), ("TARGET_HIT", 2, T, None, True, 2)),
    "called off on the day": (episode("called off on the day", 21, at_idx=4, s4=(F, 101.0, 90.0)), ("INITIAL_FAILURE_HIT", 4, F, None, False, None)),
    "called off on the last session seen": (episode("called off on the last session seen", 5, at_idx=4), (None, None, None, "HORIZON_INCOMPLETE", None, None)),
    "suspected split": (episode("suspected split", 21, suspected=True, s4=(F, 52.0, 48.0)), (None, None, None, "CORPORATE_ACTION_SUSPECTED", None, None)),
}


def test_episodes(spark):
    sessions = [r for (rows, _), _ in EPISODES.values() for r in rows]
    off = [r for (_, inv), _ in EPISODES.values() for r in inv]
    out = pa.episodes(spark.createDataFrame(sessions, EPISODE), spark.createDataFrame(off, "episode_id string, at_idx int")).collect()
    got = {r.episode_id: (r.primary, r.stop_idx, r.path_resolution, r.pending, r.later_target_hit, r.hit_idx) for r in out}
    assert got == {k: want for k, (_, want) in EPISODES.items()}
    by = {r.episode_id: r for r in out}
    assert (by["first decides"].mfe, by["first decides"].mae) == (0.25, -0.1) and by["suspected split"].mfe is None
    assert pa.episodes(spark.createDataFrame(sessions, EPISODE).drop("suspected").where("episode_id = 'short'")).first().pending == "HORIZON_INCOMPLETE"


def test_every_rung_stands_in_the_tables(spark):
    from tidemark.plans import QUERIES

    rows = QUERIES["session_paths"](spark, "/root/testdata/sf0.01").groupBy("resolution", "granularity").count().collect()
    assert {(r.resolution, r.granularity) for r in rows} >= {(T, "DAY"), (F, "DAY"), (T, "SESSION_OPEN"), (F, "SESSION_OPEN"), (T, "INTRADAY_BAR"), (F, "INTRADAY_BAR"), (T, "TRADE"), (F, "TRADE"), (A, "INTRADAY_BAR"), (M, None), (None, None), ("REFUSED_LINES", None)}
