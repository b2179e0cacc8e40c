"""Hand-computed facts, and every query against its SQL."""

import datetime as dt
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import indicators as i
from tidemark.operators import evaluation, events, history, matching, outcome, restate
from tidemark.sources import files, store

SF = "/root/testdata/sf0.001"


def frame(spark, closes, **more):
    rows = [(1, dt.date(2026, 1, 5) + dt.timedelta(days=k), None if c is None else float(c)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, close double").select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def last(df, column):
    return df.select("trade_date", column.alias("x")).orderBy(F.desc("trade_date")).first()["x"]


def fold(spark, f, values):
    return spark.createDataFrame([([None if v is None else float(v) for v in values],)], "v array<double>").select(f(F.col("v")).alias("x")).first()["x"]


def test_windows(spark):
    assert last(frame(spark, [1.0, 2, 3, 4, 5]), i.sma("close", 5)) == 3.0
    assert last(frame(spark, [1.0, 2, 3, 4, 5]), i.sma("close", 2)) == 4.5
    assert last(frame(spark, [1.0, 2, 3]), i.sma("close", 5)) is None
    assert last(frame(spark, [1.0, None, 3]), i.sma("close", 3)) is None
    assert last(frame(spark, [1.0, None, 3]), i.rolling_max("close", 3)) is None
    assert last(frame(spark, [0.0, 3]), i.pct_change("close", 1)) is None


def test_folds(spark):
    assert fold(spark, lambda v: i.ema_of(v, 3), [1.0, 2, 3, 4, 5]) == 4.0
    assert fold(spark, lambda v: i.rsi_of(v, 14), [1.0, 2, 3]) is None
    assert fold(spark, lambda v: i.rsi_of(v, 2), [10, 11, 10.5, 11.5, 11.0]) == pytest.approx(100 - 100 / 2.2)
    assert fold(spark, lambda v: i.rsi_of(v, 2), [1.0, 2, 3, 4, 5]) == 100
    assert fold(spark, lambda v: i.rsi_of(v, 2), [5.0, 4, 3, 2, 1]) == 0
    assert fold(spark, lambda v: i.rsi_of(v, 2), [5.0, 5, 5, 5]) == 50
    assert fold(spark, lambda v: i.ema_of(v, 3), [1.0, None, 3, 4]) is None


def test_true_range(spark):
    rows = [(1, dt.date(2026, 1, 5), 10.0, 9.0, 9.5), (1, dt.date(2026, 1, 6), 20.0, 19.0, 19.5)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, high double, low double, close double")
    assert last(df, i.true_range()) == 10.5


def test_recursive_means(spark):
    n = 60
    closes = [100 + 5 * math.sin(k / 3) + k * 0.2 for k in range(n)]
    rows = [(1, dt.date(2026, 1, 1) + dt.timedelta(days=k), c + 1, c - 1, c) for k, c in enumerate(closes)] + [(2, dt.date(2026, 1, 1) + dt.timedelta(days=k), 2.0, 1.0, None if k == 40 else 1.5) for k in range(n)]
    both = i.with_recursive_means(spark.createDataFrame(rows, "symbol long, trade_date date, high double, low double, close double")).toPandas().sort_values(["symbol", "trade_date"])
    out, holed = both[both.symbol == 1], both[both.symbol == 2]
    assert holed.ema_12.notna().sum() == 29 and holed.rsi_14.iloc[20] == 50.0 and holed.atr_14.isna().tolist() == [not 14 <= k < 40 for k in range(n)] and holed.adx_14.iloc[39] == 0.0

    def ema(xs, k):
        a = sum(xs[:k]) / k
        for x in xs[k:]:
            a += (x - a) * 2 / (k + 1)
        return a

    assert out.macd.iloc[-1] == pytest.approx(ema(closes, 12) - ema(closes, 26))
    line = [ema(closes[: k + 1], 12) - ema(closes[: k + 1], 26) for k in range(25, n)]
    assert out.macd_signal.iloc[-1] == pytest.approx(ema(line, 9))
    assert out.macd.isna().sum() == 25 and out.macd_hist.isna().sum() == 33
    assert out.adx_14.isna().sum() == 27 and out.adx_14.dropna().between(0, 100).all()


def test_restate(spark):
    d = dt.date
    bars = spark.createDataFrame([(1, d(2026, 1, 5), 100.0, 10.0), (1, d(2026, 1, 7), 50.0, 20.0), (2, d(2026, 1, 5), 9.0, 1.0)], "symbol long, trade_date date, close double, volume double")
    bars = bars.withColumns({n: F.col("close") for n in ("open", "high", "low")} | {"turnover": F.lit(7.0)})
    kinds = "symbol long, action_type string, ex_date date, split_from double, split_to double, adjustment_factor double"
    acts = spark.createDataFrame([(1, "SPLIT", d(2026, 1, 6), 1.0, 2.0, None), (1, "CASH_DIVIDEND", d(2026, 1, 6), None, None, None), (1, "SPLIT", d(2026, 2, 1), None, None, 0.5), (2, "SPLIT", d(2026, 1, 8), None, None, None)], kinds)
    now = {(r.symbol, r.trade_date.day): r for r in restate.restate(bars, acts, "2026-01-07").collect()}
    assert now[1, 5].close == 50 and now[1, 5].volume == 20 and now[1, 7].close == 50 and now[1, 5].turnover == 7
    assert not now[2, 5].refused and now[2, 5].close == 9
    later = {(r.symbol, r.trade_date.day): r for r in restate.restate(bars, acts, "2026-03-01").collect()}
    assert later[1, 5].close == 25 and later[1, 5].volume == 40
    assert later[2, 5].refused and later[2, 5].close is None
    basis = {(r.symbol, r.trade_date.day): r for r in restate.latest_basis(bars, acts).collect()}
    assert basis[1, 5].close * 4 == 100 and basis[1, 5].to_asof == 4 and not basis[2, 5].blocked


def test_session_ladder(spark):
    bar = "array<struct<starts_at:int,open:double,high:double,low:double>>"
    kinds = f"n int, i boolean, t boolean, bars {bar}, trades array<struct<at:int,price:double>>, o double, h double, l double"
    rows = [
        (1, True, True, [], [], 1250.0, 1300.0, 1200.0),
        (2, True, True, [], [], 1000.0, 1250.0, 990.0),
        (3, True, True, [], [], 1000.0, 1100.0, 930.0),
        (4, True, True, [], [], 1000.0, 1100.0, 990.0),
        (5, False, False, [], [], 1000.0, 1250.0, 930.0),
        (6, True, True, [], [], 1000.0, 1250.0, 930.0),
        (7, True, True, [(1, 1000.0, 1010.0, 995.0), (2, 1010.0, 1210.0, 1000.0)], [], 1000.0, 1250.0, 930.0),
        (8, True, False, [(1, 1000.0, 1210.0, 930.0)], [], 1000.0, 1250.0, 930.0),
        (9, True, True, [(1, 1000.0, 1210.0, 930.0)], [(1, 1000.0), (2, 935.0), (3, 1205.0)], 1000.0, 1250.0, 930.0),
        (10, True, True, [(1, 1000.0, 1210.0, 930.0)], [(1, 1000.0), (2, 935.0), (2, 1205.0)], 1000.0, 1250.0, 930.0),
        (11, True, True, [], [], None, None, None),
    ]
    c = F.col
    df = spark.createDataFrame(rows, kinds)
    got = {r.n: r.x for r in df.select("n", outcome.resolve_session(c("i"), c("t"), c("bars"), c("trades"), c("o"), c("h"), c("l"), F.lit(1200.0), F.lit(940.0)).alias("x")).collect()}
    assert got == {1: "TARGET_FIRST", 2: "TARGET_FIRST", 3: "FAILURE_FIRST", 4: "NOT_REACHED", 5: "AMBIGUOUS_PATH", 6: "UNRESOLVED_MISSING_DATA", 7: "TARGET_FIRST", 8: "AMBIGUOUS_PATH", 9: "FAILURE_FIRST", 10: "AMBIGUOUS_PATH", 11: "UNRESOLVED_MISSING_DATA"}


def test_history(spark):
    d = dt.date
    rows = spark.createDataFrame([("a", d(2026, 1, 1), 1, "X"), ("a", d(2026, 1, 2), 2, "X"), ("a", d(2026, 1, 3), 3, "Y"), ("a", d(2026, 1, 3), 4, "Z"), ("b", d(2026, 1, 1), 5, None)], "k string, day date, id int, v string")
    got = sorted(((r.k, r.v, r.effective_from.day, r.effective_to.day if r.effective_to else None, r.last_confirmed_at.day) for r in history.scd2(rows, "k", "v", "day", "id").collect()), key=str)
    assert got == [("a", "X", 1, 3, 2), ("a", "Z", 3, None, 3), ("b", None, 1, None, 1)]


def test_events(spark):
    import hashlib

    key = spark.range(1).select(events.event_key(F.lit("x"), F.lit(None)).alias("k")).first()["k"]
    assert key == hashlib.sha256("x\u001f".encode()).hexdigest()[:32]
    titles = spark.createDataFrame([(1, "g", "a b c d e"), (2, "g", "a b c d f"), (3, "h", "a b c d e"), (4, "g", "E d c b a"), (5, "g", None)], "id int, g string, t string")
    assert [(r.left, r.right) for r in events.near_pairs(titles, "id", ["g"], "t").collect()] == [(1, 2)]
    demoted = {r.id: r.confidence for r in events.demote_shared(titles, "t").collect()}
    assert demoted == {1: "DEMOTED", 3: "DEMOTED", 2: "ANCHORED", 4: "ANCHORED", 5: "PROVISIONAL"}


def test_metrics(spark):
    rows = spark.createDataFrame([("c", 0.9, 1), ("c", 0.9, 0), ("c", 0.5, 1), ("c", 0.1, 0)], "g string, p double, hit int")
    assert evaluation.average_precision(rows, ["g"]).first()["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert evaluation.brier(rows.where("hit = 1"), ["g"]).first()["skill"] is None
    assert evaluation.spearman(rows.limit(2), ["g"], "p", "hit").first()["rho"] is None


def test_matching(spark):
    kinds = "g string, id int, sample_key string, t1 string, t2 int"
    anchors = spark.createDataFrame([("x", 1, "a", "u", 1), ("x", 2, "b", "u", 1), ("x", 3, "c", "u", 9)], kinds)
    pool = spark.createDataFrame([("x", 10, "k", "u", 1), ("x", 11, "l", "v", 1), ("x", 12, "m", "u", 2)], kinds)
    got = {r.anchor: (r.control, r.tier) for r in matching.match_controls(anchors, pool, ["g"], ["t1", "t2"]).collect()}
    assert got == {1: (10, 0), 2: (12, 1), 3: (11, 2)}


def test_day_store(spark, tmp_path):
    from tidemark.schemas import DAILY_BAR

    def day(close):
        base = {"provider_id": "test", "dataset_key": "EOD", "market_code": "JP", "native_symbol": "1301", "trade_date": dt.date(2026, 1, 5)}
        from decimal import Decimal

        return spark.createDataFrame([tuple((base | {"close": Decimal(close)}).get(f.name) for f in DAILY_BAR.fields)], DAILY_BAR)

    path = str(tmp_path / "bars")
    assert [r.is_new for r in store.append_days(day("10"), path).collect()] == [True]
    assert [r.is_new for r in store.append_days(day("10"), path).collect()] == [False]
    assert [r.is_new for r in store.append_days(day("11"), path).collect()] == [True]
    got = store.read_days(spark, path, "2026-01-01", "2026-01-31", ["1301"]).collect()
    assert [float(r.close) for r in got] == [11.0]
    assert store.read_days(spark, path, "2026-02-01", "2026-02-28").count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Symbol|Name|Test\nAAA|First|N\nBBB|broken\nCCC||Y\nFile Creation Time: 0101|||\n")
    good, bad = files.symbol_directory(spark, str(tmp_path / "d.txt"), ["Symbol", "Name", "Test"])
    assert sorted((r.Symbol, r.Name, r.Test) for r in good.collect()) == [("AAA", "First", "N"), ("CCC", None, "Y")] and bad.count() == 1
    (tmp_path / "fx.csv").write_text("KEY,CURRENCY,TIME_PERIOD,OBS_VALUE\nk,USD,2026-01-05,1.17\nk,USD,2026-01-06,\nk,JPY,2026-01-05,171.2\n")
    assert sorted((r.series, float(r.rate)) for r in files.observations(spark, str(tmp_path / "fx.csv")).collect()) == [("JPY", 171.2), ("USD", 1.17)]
    (tmp_path / "c.json").write_text('{"meta":{"currency":"JPY","symbol":"1301"},"timestamp":[1767571200,1767657600],"indicators":{"quote":[{"open":[1.0,null],"high":[2.0,null],"low":[0.5,null],"close":[1.5,null],"volume":[10,null]}]},"events":{"splits":{"x":{"date":1767657600,"numerator":2,"denominator":1}}}}\n')
    rows = files.chart_bars(spark, str(tmp_path / "c.json")).orderBy("trade_date").collect()
    assert [r.close for r in rows] == [1.5, None] and files.chart_splits(spark, str(tmp_path / "c.json")).first()["split_to"] == 2


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, float) and v == int(v):
        return int(v)
    if isinstance(v, dt.datetime):
        return str(v) if (v.hour, v.minute, v.second, v.microsecond) != (0, 0, 0, 0) else str(v.date())
    return str(v) if isinstance(v, dt.date) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got) and len(got.columns) > 1
        return
    want = duck.sql(plans.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(repr(tuple(norm(v) for v in r)) for r in x[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_rolling_blocks(spark):
    """Windows put together from blocks give what frames of n rows give, holes, offsets and equal highs included, and no frame of n rows is left."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    x = [None if k in (33, 120) else float(rng.randrange(20)) for k in range(230)]
    rows = frame(spark, x).withColumn("seq", F.row_number().over(i.by_symbol()).cast("long"))
    want = {f"{kind}{n}_{o}": (kind, "close", n, o) for kind in ("mean", "max", "min") for n in (1, 2, 5, 7, 20, 25, 60) for o in (0, 1)} | {f"since{n}": ("since_max", "close", n) for n in (5, 20, 60)} | {f"{kind}{n}": (kind, "close", n) for kind in ("deviation", "sample_deviation") for n in (5, 20)}
    plain = {"mean": F.avg, "max": F.max, "min": F.min, "deviation": F.stddev_pop, "sample_deviation": F.stddev_samp}
    got = i.with_rolling(rows, **want)
    assert "specifiedwindowframe(RowFrame, -19" not in got._jdf.queryExecution().optimizedPlan().toString().replace("RowFrame, -19, -19)", "")
    for r, p in zip(got.orderBy("trade_date").collect(), rows.select("trade_date", *[(i.bars_since_max("close", n) if kind == "since_max" else i.guarded(plain[kind]("close").over(i.tail(n, *o)), "close", n, *o)).alias(k) for k, (kind, _, n, *o) in want.items()]).orderBy("trade_date").collect(), strict=True):
        for k in want:
            assert r[k] == pytest.approx(p[k], abs=1e-9), (k, r.trade_date)


def test_close_on_its_mean(spark):
    """A close that equals the mean of its 25 is at 0 whatever the order of adding left, and a gap of a hundredth of a cent is one."""
    import random

    from tidemark.operators import features as ft

    rng, rows = random.Random(5), []
    for symbol in range(80):
        cents = [rng.randrange(1000, 10_000_000) for _ in range(39)]
        cents[-1] -= sum(cents[-24:]) % 24
        mean = sum(cents[-24:]) // 24
        prices = [*(c / 100 for c in cents), mean / 100 if symbol < 40 else (mean * 100 + 1) / 10_000]
        rows += [(symbol, dt.date(2026, 1, 5) + dt.timedelta(days=k), x) for k, x in enumerate(prices)]
    bars = spark.createDataFrame(rows, "symbol long, trade_date date, close double").select("*", *[F.col("close").alias(x) for x in ("open", "high", "low")], F.lit(10.0).alias("volume"), F.lit(10.0).alias("turnover"), F.lit("US").alias("market_code"), F.lit(False).alias("blocked"))
    got = ft.features(bars).withColumn("b", ft.route_predicates()["B"]).where("seq = 40").collect()
    assert len(got) == 80 and all(r.close_vs_sma25 == 0.0 if r.symbol < 40 else 0 < r.close_vs_sma25 < 1e-3 for r in got)
    assert all(r.b == (r.lowest_gap < 0) for r in got)


def test_leakage_partitions_grow(spark, monkeypatch):
    """A task of the join holds a bounded number of lines, so partitions grow with the table."""
    from tidemark.plans import evaluation as ev

    want = sorted(map(tuple, ev.leakage_violations(spark, SF).collect()))
    monkeypatch.setattr(ev, "LINES", 500)
    got = ev.leakage_violations(spark, SF)
    assert got.rdd.getNumPartitions() >= 12 and sorted(map(tuple, got.collect())) == want


def test_feature_row_shuffles_lines_once(spark, monkeypatch):
    """Lines are dealt by symbol once, to partitions that grow with them, and nothing made of them is shuffled again."""
    from tidemark.plans import feature_row as fr

    want = sorted(map(repr, fr.feature_row(spark, SF).collect()))
    monkeypatch.setattr(fr, "LINES", 500)
    got = fr.feature_row(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Exchange hashpartitioning(symbol" in plan and not any("Exchange" in line and "trade_date" in line for line in plan.splitlines())
    assert got.rdd.getNumPartitions() >= 12 and sorted(map(repr, got.collect())) == want


def test_save_leaves_no_shuffle(spark):
    """A saved table's own shuffle files are gone once it stands, the switch is as it was, and drop removes the table."""
    import glob

    from tidemark.sources import scratch

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    files = lambda: set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    before, switch = files(), spark.conf.get(scratch.CLEAN, "false")
    table = scratch.save(spark.range(100000).repartition(7, "id"))
    left = files()
    assert left <= before and table.count() == 100000 and spark.conf.get(scratch.CLEAN, "false") == switch
    path = table.inputFiles()[0].removeprefix("file://")
    scratch.drop(table)
    assert not os.path.exists(path)
