"""Small facts of the rule operators: titles, names, groups, draws, agreement, feeds, and the day store's revisions."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import agreement, decisions, disclosures, matching, restate, sampling
from tidemark.operators.components import joined_groups
from tidemark.streaming import feeds


def test_titles(spark):
    rows = [(1, "（訂正）2026年3月期 決算短信"), (2, "配当予想の修正及び業績予想の修正"), (3, "月次売上高"), (4, None), (5, "  "), (6, "(開示事項の経過)子会社の異動"), (7, "自己株式の取得"), (8, "譲渡制限付株式報酬としての自己株式処分")]
    got = {r.id: r for r in disclosures.with_title_features(disclosures.with_title_kind(spark.createDataFrame(rows, "id int, title string"))).collect()}
    assert [got[i].disclosure_type for i in range(1, 9)] == ["EARNINGS_RESULT", "DIVIDEND_FORECAST_REVISION", "MONTHLY_UPDATE", "OTHER", "OTHER", "MA_SUBSIDIARY", "BUYBACK", "TREASURY_DISPOSAL"]
    assert (got[1].is_correction, got[1].matched_text, got[1].novelty, got[6].is_progress) == (True, "決算短信", 0.3, True)
    assert (got[3].novelty, got[4].directness, got[4].matched_text, got[7].novelty, got[7].surprise) == (0.1, 0.5, None, 0.6, None)
    assert len(disclosures.TITLE_RULES) == 36


def test_names(spark):
    names = [("X Inc Common Stock", "N"), ("X ADS", None), ("ADS-TEC Common Stock", None), ("X Depositary Shares", None), ("X 5% Preferred ADS", None), ("X Depositary Shares representing one ordinary share", None), ("Fund", "Y"), ("X Units", None), ("?", None)]
    df = spark.createDataFrame(names, "n string, e string").select(disclosures.name_type(F.col("n"), F.coalesce("e", F.lit(""))).alias("t"))
    assert [(r.t.security_type, r.t.is_adr) for r in df.collect()] == [("COMMON_STOCK", False), ("ADR", True), ("COMMON_STOCK", False), ("UNKNOWN", False), ("PREFERRED", True), ("ADR", True), ("ETF", False), ("UNIT", False), ("UNKNOWN", False)]
    codes = [("1301", "普通"), ("13010", "普通"), ("13015", "普通"), ("1301", "優先株式"), ("1301", "優先出資証券")]
    df = spark.createDataFrame(codes, "c string, n string").select(disclosures.special_share(F.col("c"), F.col("n")).alias("s"))
    assert [r.s.security_type if r.s else None for r in df.collect()] == [None, None, "UNKNOWN", "PREFERRED", "INVESTMENT_CERTIFICATE"]


def test_joined_groups(spark):
    links = [("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(30)]]
    got = {r.key: r.root for r in joined_groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"} | {f"n{i:02}": "n00" for i in range(31)}
    assert joined_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_controls_by_the_number_of_anchors(spark):
    anchors = spark.createDataFrame([("g", i, f"{i:03}", "s") for i in range(30)], "cohort string, id long, sample_key string, sector string")
    pool = spark.createDataFrame([("g", 100 + i, f"{i:03}", "s") for i in range(40)], "cohort string, id long, sample_key string, sector string")
    got = matching.match_controls(anchors, pool, ["cohort"], ["sector"]).collect()
    assert sorted((r.anchor, r.control, r.tier) for r in got) == [(i, 100 + i, 0) for i in range(30)]


def test_draws(spark):
    rows = spark.createDataFrame([("2026-01-05", i, i % 4 != 0) for i in range(200)], "day string, code long, passed boolean")
    pool = sampling.candidate_pool(rows, "day", "code", "passed", "v", "s").collect()
    assert sum(r.is_primary for r in pool) == 60 and sum(r.is_anchor for r in pool) == 20
    assert all(r.probability == 60 / 150 for r in pool if r.passed) and all(r.selection_rank is None for r in pool if not r.passed)
    s = sampling.sensitivity(spark.createDataFrame([("d", f"{i}") for i in range(80)], "day string, sample string"), "day", "sample", "v", "s").collect()
    assert (sum(r.anonymized_pair for r in s), sum(r.drift_repeat for r in s), sum(r.anonymized_pair and r.drift_repeat for r in s)) == (8, 4, 0)
    spaced = sampling.spaced(spark.createDataFrame([("a", i, f"{(i * 7) % 50:02}") for i in range(50)], "code string, at long, key string"), "code", "at", "key").collect()
    at = sorted(r["at"] for r in spaced)
    assert at and all(b - a >= 20 for a, b in zip(at, at[1:], strict=False))
    turns = sampling.round_robin(spark.createDataFrame([(m, f"{i}") for m in "ab" for i in range(5)], "month string, key string"), "month", "key", 5).collect()
    assert sorted((r.turn, r.month) for r in turns) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")]


def test_agreement(spark):
    episodes = spark.createDataFrame([(1, "CLOSED", "HORIZON_EXPIRED"), (2, "OPEN", None), (3, "CLOSED", "TARGET_REACHED"), (4, "CLOSED", "HORIZON_EXPIRED")], "episode_id int, status string, close_reason string")
    outcomes = spark.createDataFrame([(1, "HORIZON_EXPIRED", 21, 20, False), (2, "TARGET_REACHED", 5, 4, None), (3, "FAILURE_REACHED", 5, 4, None), (4, "HORIZON_EXPIRED", 9, 8, False), (5, None, None, None, None)], "episode_id int, outcome string, sessions_observed int, resolved_index int, later_target_hit boolean")
    got = {r.episode_id: r.violation for r in agreement.outcome_violations(outcomes, episodes).collect()}
    assert got == {2: "EPISODE_STILL_OPEN", 3: "OUTCOME_IS_NOT_THE_CLOSE_REASON", 4: "EXPIRY_WITHOUT_THE_WHOLE_HORIZON", 5: "MISSING_EPISODE"}
    left, right = (spark.createDataFrame(x, "k int, a int, b int") for x in ([(1, 1, None), (2, 1, 2), (3, None, None)], [(1, 1, None), (2, 3, None)]))
    assert {r.k: r.differs for r in agreement.disagreements(left, right, "k", ["a", "b"]).collect()} == {2: "a,b", 3: "MISSING"}


def test_stage3(spark):
    rows = [(1, [], [], [], []), (2, [], ["A"], ["M1"], ["POST_CLOSE"]), (3, [], ["A"], ["M1"], [None]), (4, ["FAILED_BREAKOUT"], ["A"], [], []), (5, ["HEALTHY_PULLBACK"], ["A"], [], []), (6, [], ["A"], ["M1"], ["INTRADAY"]), (7, [], ["A"], [], []), (8, [], [], ["M1"], ["INTRADAY"])]
    kind = "array<string>"
    df = spark.createDataFrame(rows, f"id int, concepts {kind}, technical_routes {kind}, material_routes {kind}, timings {kind}")
    assert [r.state for r in decisions.stage3_decision(df).orderBy("id").collect()] == ["REJECT", "POST_CLOSE_CATALYST_SETUP", "WATCH_OTHER", "WATCH_OTHER", "WATCH_PULLBACK", "TECHNICAL_SETUP_EOD", "WATCH_BREAKOUT", "WATCH_OTHER"]


def test_series_rules(spark):
    day = dt.date(2026, 1, 5)
    acts = spark.createDataFrame([("A", "SPLIT", day, 1.0, 5.0, None), ("B", "SPLIT", dt.date(2026, 3, 1), 1.0, 2.0, None)], "symbol string, action_type string, ex_date date, split_from double, split_to double, adjustment_factor double")
    vendor = spark.createDataFrame([("A", dt.date(2026, 1, 2), 2673.05, 500.0), ("A", day, 2700.04, 90.0)], "symbol string, trade_date date, close double, volume double")
    got = sorted((r.trade_date.day, r.close, r.volume) for r in restate.as_traded(vendor, acts).collect())
    assert got == [(2, 13365.3, 100.0), (5, 2700.0, 90.0)]
    raw = {n: "RAW" for n in ("open_basis", "high_basis", "low_basis", "close_basis")}
    rows = [(s, dt.date(2026, 1, 2), 10.0, 10.0, 10.0, 10.0, 100.0, v) for s, v in (("A", "RAW"), ("B", "SPLIT_ADJUSTED"), ("C", "SPLIT_ADJUSTED"))]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, volume_basis string").withColumns({k: F.lit(v) for k, v in raw.items()})
    out = {r.symbol: (r.close, r.volume, r.volume_comparable) for r in restate.comparable_series(bars, acts, "2026-02-01").collect()}
    assert out == {"A": (2.0, 500.0, True), "B": (10.0, None, False), "C": (10.0, 100.0, True)}


def test_feeds_over_many_shuffled_files(spark, tmp_path):
    """Files aren't in order of time: counts, revisions and states don't depend on how many there are."""
    rows = [(i, i % 3, "view" if i % 2 else "click", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), 1.0, f'{{"k":{i % 7 // 3}}}') for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string")
    for k, part in enumerate(df.orderBy(F.xxhash64("event_id")).randomSplit([1.0] * 9, 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "e")) if k else part.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: feeds.event_stream(spark, str(tmp_path / "e"), df.schema)
    assert feeds.drain(spark, feeds.deduplicated(stream()).select("event_id")).count() == 120
    want = {}
    for i, user, _, _, _, props in rows:
        last = want.setdefault(user, [])
        if not last or last[-1][1] != props:
            last.append((i, props))
    got = feeds.drain(spark, feeds.revisions(stream())).toPandas()
    assert {u: [tuple(x) for x in g.sort_values("revision")[["event_id", "revision"]].to_numpy()] for u, g in got.groupby("user_id")} == {u: [(i, n + 1) for n, (i, _) in enumerate(x)] for u, x in want.items()}
    asked = stream().select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, "TRIGGER_HIT").otherwise("ENTERED").alias("wanted"))
    moves = feeds.drain(spark, feeds.watch_states(asked, "user_id", "event_id", "wanted")).toPandas()
    assert len(moves) == 120 and not moves[moves.wanted == "ENTERED"].accepted.any() and (moves[moves.wanted == "TRIGGER_HIT"].groupby("user_id").accepted.sum() == 1).all()


def test_cursor(spark):
    page = spark.createDataFrame([(5,), (9,), (7,)], "id long")
    assert feeds.advanced(page, "id", None) == 9 and feeds.advanced(page, "id", 12) == 12 and feeds.advanced(page.limit(0), "id", 3) == 3
    assert sorted(r.id for r in feeds.new_items(page, "id", 6).collect()) == [7, 9]
    now = dt.datetime(2026, 2, 1, 10)
    df = spark.createDataFrame([(None, now), (dt.datetime(2026, 1, 30, 1), now), (dt.datetime(2025, 12, 1), now)], "a timestamp_ntz, b timestamp_ntz").select(feeds.recovery_window(F.col("a"), F.col("b")).alias("w"))
    assert [str(r.w.start) for r in df.collect()] == ["2026-01-31", "2026-01-29", "2026-01-18"]
