"""Chart measurements on hand-made series, and concepts with what speaks for and against them."""

import datetime as dt

import pytest

from tidemark.operators import concepts as co
from tidemark.operators import features as ft

BAR = "symbol long, trade_date date, open double, high double, low double, close double, volume double, volume_comparable boolean"


def series(symbol, closes, volumes=None, comparable=True, last=None):
    """Bars a unit wide around the closes; last replaces (open, high, low, close) of the last one."""
    out = []
    for k, x in enumerate(closes):
        o, h, l, c = (None, None, None, None) if x is None else (x, x + 1, x - 1, x)
        if x is None:
            h, l = 1000.0, 999.0
        if last and k == len(closes) - 1:
            o, h, l, c = last
        out.append((symbol, dt.date(2026, 1, 1) + dt.timedelta(days=k), o, h, l, c, float(volumes[k]) if volumes and volumes[k] is not None else None if volumes else 100.0, comparable))
    return out


@pytest.fixture(scope="module")
def measured(spark):
    flat = [100.0] * 30
    falls = [100.0] * 26 + [98.0, 96.0, 94.0, 92.0]
    rows = (
        series(1, falls, [100] * 26 + [100, 80, 60, 50], last=(92.0, 93.0, 88.0, 92.0))
        + series(2, [100.0] * 12 + [110.0, 100.0, 100.0] + [100.0] * 7 + [120.0, 121.0, 105.0])
        + series(3, [90.0 + k for k in range(20)] + [106.0, 105.0, 106.0], [100] * 20 + [50, 50, 50])
        + series(4, flat, comparable=False)
        + series(5, [100.0])
        + series(6, [*flat[:-1], None])
        + series(7, flat, [100] * 29 + [30], last=(100.0, 100.2, 99.8, 100.0))
    )
    return {r.symbol: r for r in co.measurements(spark.createDataFrame(rows, BAR)).collect()}


def test_measurements(measured):
    m = measured
    assert (m[1].consecutive_down_days, m[1].down_day_volume_decay) == (4.0, 0.5) and m[1].lower_wick_ratio == pytest.approx(0.8)
    assert m[1].capitulation_volume_ratio == pytest.approx(50 / ((17 * 100 + 100 + 80 + 60) / 20))
    # 110 + 1 and 110 - 1 were pivots: the close at 121 went over them, and 105 is below again.
    assert m[2].breakout_level == 111.0 and m[2].bars_above_breakout == 2.0 and m[2].closed_back_below == 1.0
    assert m[3].pullback_bars == 3.0 and m[3].pullback_volume_contraction == 0.5 and m[3].holding_above_ma20 == 1.0 and m[3].pullback_depth_pct == pytest.approx((1 - 106 / 110) * 100)
    assert m[4].relative_volume_20d is None and m[4].anchored_vwap is None and m[4].capitulation_volume_ratio == 1.0 and "volume not comparable" in m[4].gaps
    assert set(m[5].gaps) == {"short history", "volatility", "support and resistance", "anchored vwap"} and m[5].consecutive_down_days == 0.0 and m[5].breakout_level is None
    assert {"session range", "volatility", "support and resistance"} <= set(m[6].gaps) and m[6].nearest_support is None and m[6].pullback_depth_pct is None
    assert m[7].session_vwap == pytest.approx(100.0) and m[7].relative_volume_20d == 0.3 and m[7].close_position_in_range == pytest.approx(0.5)


def concepts(spark, **values):
    rows = spark.createDataFrame([(1, *[None if values.get(n) is None else float(values[n]) for n in co.MEASURES])], "symbol long, " + ", ".join(f"{n} double" for n in co.MEASURES))
    return {r.concept: r for r in co.match(rows).collect()}


def test_concepts(spark):
    nothing = concepts(spark)
    assert set(nothing) == set(co.SHOWN) and not any(r.fired or r.support or r.against or r.evidence for r in nothing.values())
    assert nothing["HEALTHY_PULLBACK"].missing == ["pullback_depth_pct", "pullback_volume_contraction", "holding_above_ma20"]
    got = concepts(spark, consecutive_down_days=4, down_day_volume_decay=0.5, lower_wick_ratio=0.1, pullback_depth_pct=5, pullback_volume_contraction=1.2, holding_above_ma20=1, distance_from_anchored_vwap_pct=2, relative_volume_20d=0.4, session_range_pct=1, atr_pct=2)
    assert [k for k, r in got.items() if r.fired] == ["VOLUME_DRY_UP"]
    assert got["VOLUME_DRY_UP"].evidence == {"relative_volume_20d": 0.4, "volume_trend_5d": None, "session_range_pct": 1.0, "atr_pct": 2.0}
    # All three measurements are needed; rising volume is no healthy pullback; a thin session reclaims nothing.
    assert [tuple(x) for x in got["SELLER_EXHAUSTION"].against] == [("lower_wick_ratio", 0.1)] and len(got["SELLER_EXHAUSTION"].support) == 2
    assert [tuple(x) for x in got["HEALTHY_PULLBACK"].against] == [("pullback_volume_contraction", 1.2)] and len(got["HEALTHY_PULLBACK"].support) == 2
    assert [tuple(x) for x in got["VWAP_RECLAIM"].against] == [("relative_volume_20d", 0.4)]
    # A level that was tested, not closed above, has not failed.
    assert not concepts(spark, closed_back_below=1, bars_above_breakout=0)["FAILED_BREAKOUT"].fired
    assert concepts(spark, closed_back_below=1, bars_above_breakout=1)["FAILED_BREAKOUT"].fired
    assert concepts(spark, overhead_volume_ratio=1.5, distance_to_heaviest_overhead_pct=3, overhead_levels=2)["SUPPLY_OVERHANG"].evidence["overhead_levels"] == 2.0


def test_levels_against_a_plain_version(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    points = [(k, sorted((round(100 * 1.004 ** rng.randrange(40), 2), float(rng.randrange(5))) for _ in range(rng.randrange(30)))) for k in range(20)]
    got = {r.k: [tuple(x) for x in r.l] for r in spark.createDataFrame(points, "k int, p array<struct<price:double,volume:double>>").select("k", co.levels(F.col("p")).alias("l")).collect()}
    for k, ps in points:
        clusters = []
        for price, volume in ps:
            if clusters and abs(price / clusters[-1][0][0] - 1.0) * 100.0 <= 1.0:
                clusters[-1].append((price, volume))
            else:
                clusters.append([(price, volume)])
        want = [(sum(p for p, _ in c) / len(c), len(c), sum(v for _, v in c)) for c in clusters]
        assert [x[1:] for x in got[k]] == [x[1:] for x in want] and [x[0] for x in got[k]] == pytest.approx([x[0] for x in want])


def test_feature_row(spark):
    from pyspark.sql import functions as F

    rows = [(1, dt.date(2026, 1, 1) + dt.timedelta(days=k), 10.0 + k, 11.0 + k, 9.0 + k, 10.5 + k, 100.0 + k, 1000.0 if k % 2 else None, 2.0, False) for k in range(80)]
    rows += [(2, dt.date(2026, 1, 1) + dt.timedelta(days=k), 10.0, 11.0, 9.0, None if k == 30 else 10.0, 100.0, 1000.0, 1.0, k >= 70) for k in range(80)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, open double, high double, low double, close double, volume double, turnover double, to_asof double, blocked boolean")
    got = {(r.symbol, r.bars_available): r for r in ft.feature_row(df).collect()}
    assert len(got) == 160 and len(ft.MEASUREMENTS) == len(set(ft.MEASUREMENTS)) == 74
    last = got[1, 80]
    # Levels are on the basis of their own date, ratios on any.
    assert (last.close, last.high_5d, last.low_60d, last.support_60d, last.volume, last.sma_5) == (179.0, 180.0, 58.0, 58.0, 89.5, 175.0)
    assert last.range_contraction_ratio == pytest.approx(((90 - 84) / 84) / ((90 - 69) / 69)) and last.close_location_value == pytest.approx(0.5) and last.consecutive_up_days == 79
    assert last.days_since_high_20d == 0 and last.dist_from_high_20d_pct == pytest.approx(0.5 / 90 * 100) and last.warmup_satisfied and last.rsi_14 == 100.0 and last.turnover_avg_20d is None
    assert last.vwap_source == "TURNOVER_OVER_VOLUME" and got[1, 79].vwap_source is None
    # From a hole on, measures of the whole series are missing; those of a window come back when it is full again.
    holed = got[2, 60]
    assert (holed.ema_12, holed.atr_14, holed.bb_mid_20, holed.rv_20d, holed.consecutive_up_days) == (None,) * 5 and holed.sma_25 == 10.0 and got[2, 40].sma_25 is None and got[2, 30].ema_12 == 10.0
    blocked = got[2, 75]
    assert blocked.blocked and all(blocked[n] is None for n in ft.MEASUREMENTS)
    assert ft.feature_row(df.where(F.lit(False))).count() == 0
