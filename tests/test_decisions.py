import datetime as dt

from tidemark.functions import text
from tidemark.operators import decisions


def test_names(spark):
    rows = [("Ａｃｍｅ　Ｃｏ．, Ltd.",), ("ACME Holdings, Inc.",), ("Acme Class B",), (None,), ("トヨタ自動車 株式会社",)]
    got = spark.createDataFrame(rows, "n string").select(text.normalised_name("n").alias("x"), text.class_token("n").alias("c")).collect()
    assert [r.x for r in got] == ["acme", "acme", "acme class b", None, "トヨタ自動車"] and [r.c for r in got] == [None, None, "B", None, None]
    keys = spark.createDataFrame([("1", "2", "n"), (None, "2", "n"), (None, None, "N Inc")], "r string, a string, n string").select(text.identity_key("r", "a", "n").alias("k"))
    assert [r.k for r in keys.collect()] == ["registry:1", "anchored:2", "provisional:n"]


def test_redaction(spark):
    df = spark.createDataFrame([("Acme (1301) rose 13012, Acme.B 1301", "Acme", None), ("none", "", "x\\E")], "t string, a string, b string")
    assert [r.x for r in df.select(text.redacted("t", "a", "b").alias("x")).collect()] == ["[NAME] ([CODE]) rose 13012, [NAME].B [CODE]", "none"]


def test_entry(spark):
    kinds = "n int, decision_price double, entry_price double, open_episode boolean, session_open boolean, stale boolean"
    rows = [(1, 10.0, 11.0, False, True, False), (2, None, 1.0, False, True, False), (3, 3001.0, 1.0, False, True, False), (4, 10.0, 3001.0, False, True, False), (5, 10.0, 1.0, True, True, False), (6, 10.0, None, False, False, False), (7, 10.0, None, False, True, None), (8, 10.0, 1.0, False, True, True)]
    got = {r.n: r.decision for r in decisions.entry_decision(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: "ENTER", 2: "REFUSED_NO_PRICE", 3: "REFUSED_LIMIT_AT_DECISION", 4: "REFUSED_LIMIT_AT_ENTRY", 5: "DUPLICATE_OPEN_EPISODE", 6: "WAIT_FOR_SESSION", 7: "WAIT_FOR_PRICE", 8: "REFUSED_STALE_INPUT"}


def test_terms(spark):
    t = lambda h: dt.datetime(2026, 1, 5, h)
    kinds = "n int, close double, rate double, rate_at timestamp, session_end timestamp, cutoff timestamp, decided_at timestamp"
    rows = [(1, 10.0, 150.5, t(5), t(6), t(7), t(8)), (2, None, 1.0, t(5), t(6), t(7), t(8)), (3, 10.0, 1.0, t(7), t(6), t(7), t(8)), (4, 10.0, 1.0, t(5), t(6), t(5), t(8)), (5, 100.0, 150.0, t(5), t(6), t(7), t(8)), (6, 2.5, None, None, t(6), t(7), t(8))]
    got = {r.n: (None if r.price_jpy is None else float(r.price_jpy), r.refusal) for r in decisions.prediction_terms(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: (1505.0, None), 2: (None, "NO_CONFIRMED_CLOSE"), 3: (10.0, "RATE_AFTER_CLOSE"), 4: (10.0, "CUTOFF_OUT_OF_ORDER"), 5: (15000.0, "ABOVE_LIMIT"), 6: (2.5, None)}


def test_answers(spark):
    rows = [('{"decision":"BUY","probability":0.4,"basis":"a long enough basis"}',), ('{"decision":"HOLD?","probability":1.4,"basis":"x"}',), ("not json",), ('{"decision":"BUY","probability":"0.4","basis":"As an AI I can not"}',)]
    got = decisions.validate_answers(spark.createDataFrame(rows, "a string"), "a", ["BUY", "PASS"]).collect()
    assert [r.status for r in got] == ["ACCEPTED", "REJECTED", "REJECTED", "ACCEPTED_WITH_WARNINGS"]
    assert got[1].errors == ["UNKNOWN_DECISION", "PROBABILITY_OUT_OF_RANGE"] and got[2].errors == ["NO_DECISION", "NO_PROBABILITY"]


def test_analyses(spark):
    kinds = "n int, state string, rationale string, zone_low double, zone_high double, basis_kinds array<string>, basis string, close double, threshold_price double, obstacles array<struct<price_level:double,weakening_evidence:string>>, missing_sections array<string>"
    good = ("WATCH", "the base holds on volume", 100.0, 110.0, ["SUPPORT_RESISTANCE"], "levels", 99.0, 119.0, [], [])
    change = lambda n, **at: (n, *[at.get(k, v) for k, v in zip(("state", "rationale", "low", "high", "kinds", "basis", "close", "threshold", "obstacles", "missing"), good, strict=True)])
    rows = [
        change(1), change(2, rationale="  "), change(3, rationale="So BUY NOW."), change(4, rationale="it should recover its previous high"), change(5, kinds=[]), change(6, kinds=["PRIOR_HIGH"]), change(7, basis=None), change(8, low=120.0, threshold=110.0),
        change(9, state="REJECT"), change(10, close=111.0), change(11, obstacles=[(105.0, None), (200.0, None)]), change(12, obstacles=[(105.0, "broken")]), change(13, missing=["materials"]), change(14, low=None, high=None, kinds=None, basis=None), change(15, state="REJECT", rationale=None), change(16, rationale="a prior high is resistance"),
    ]
    got = {r.n: (r.status, r.errors, r.warnings, r.repairs, r.zone_high) for r in decisions.validate_analysis(spark.createDataFrame(rows, kinds)).collect()}
    ok = ("PASSED", [], [], [], 110.0)
    assert got[1] == got[12] == got[16] == ok and got[14] == ("PASSED", [], [], [], None)
    assert {n: got[n][1] for n in range(2, 9)} == {2: ["NO_RATIONALE"], 3: ["READS_AS_ENTRY"], 4: ["PRIOR_HIGH_AS_UPSIDE"], 5: ["ZONE_WITHOUT_BASIS_KIND"], 6: ["UNKNOWN_BASIS_KIND"], 7: ["ZONE_WITHOUT_BASIS"], 8: ["ZONE_INVERTED", "ZONE_IS_THRESHOLD"]}
    assert got[9] == ("REPAIRED", [], [], ["ZONE_DROPPED"], None) and got[15] == ("REJECTED", ["NO_RATIONALE"], [], ["ZONE_DROPPED"], None)
    assert got[10][2] == ["ZONE_BELOW_CLOSE"] and got[11][2] == ["ZONE_THROUGH_OBSTACLE"] and got[13][2] == ["MISSING_SECTION:materials"] and got[11][0] == "PASSED"


def test_universe(spark):
    from tidemark.operators import universe

    kinds = "n int, market_code string, is_test_issue boolean, listing_status string, segment string, security_type string, exchange_id string, cik string, is_adr boolean"
    jp = lambda n, segment, kind: (n, "JP", None, "LISTED", segment, kind, None, None, None)
    us = lambda n, exchange, kind, cik="1", adr=False: (n, "US", False, "LISTED", None, kind, exchange, cik, adr)
    rows = [
        (1, "JP", True, "LISTED", "PRIME_DOMESTIC", "COMMON_STOCK", None, None, None), (2, "US", False, "DELISTED", None, "COMMON_STOCK", "XNYS", "1", False), (3, None, None, None, None, None, None, None, None),
        jp(4, "PRO_MARKET", "COMMON_STOCK"), jp(5, "PRIME_DOMESTIC", "COMMON_STOCK"), jp(6, None, "COMMON_STOCK"), jp(7, "GROWTH_DOMESTIC", None), jp(8, "PRIME_FOREIGN", "COMMON_STOCK"), jp(9, "OTHER", "COMMON_STOCK"), jp(10, "UNKNOWN", "COMMON_STOCK"), jp(11, "STANDARD_DOMESTIC", "PREFERRED"), jp(12, "PRIME_DOMESTIC", "ADR"),
        us(20, None, "COMMON_STOCK"), us(21, "OTCM", "COMMON_STOCK"), us(22, "ARCX", "ETF"), us(23, "XNYS", "UNIT"), us(24, "XNYS", "COMMON_STOCK", "77"), us(25, "XNYS", "COMMON_STOCK", "88"), us(26, "XNYS", "COMMON_STOCK", adr=True), us(27, "XNYS", "UNKNOWN"), us(28, "XNYS", "COMMON_STOCK", None), us(29, "XNAS", "COMMON_STOCK"), us(30, "XNAS", "INVESTMENT_CERTIFICATE"),
    ]
    df, lists = spark.createDataFrame(rows, kinds), spark.createDataFrame([("77",), ("77",), (None,)], "cik string")
    got = {r.n: (r.decision[0], r.reason) for r in universe.classify(df, lists, spark.createDataFrame([("88",)], "cik string")).collect()}
    assert got == {
        1: ("E", "TEST_ISSUE"), 2: ("E", "DELISTED"), 3: ("U", "PROVIDER_DATA_MISSING"), 4: ("E", "NOT_TARGET_SEGMENT"), 5: ("I", "TARGET_MARKET_COMMON_STOCK"), 6: ("U", "SEGMENT_RULE_PENDING"), 7: ("E", "NOT_COMMON_STOCK"), 8: ("U", "FOREIGN_STOCK_RULE_PENDING"), 9: ("U", "SEGMENT_RULE_PENDING"), 10: ("U", "TYPE_UNKNOWN"), 11: ("E", "PREFERRED"), 12: ("E", "NOT_COMMON_STOCK"),
        20: ("U", "PROVIDER_DATA_MISSING"), 21: ("E", "OTC"), 22: ("E", "NOT_TARGET_EXCHANGE"), 23: ("E", "UNIT"), 24: ("E", "SPAC_PRE_MERGER"), 25: ("E", "REIT_OR_FUND"), 26: ("U", "ADR_ELIGIBILITY_UNDEFINED"), 27: ("U", "TYPE_UNKNOWN"), 28: ("U", "REIT_DETECTION_INCOMPLETE"), 29: ("I", "TARGET_MARKET_COMMON_STOCK"), 30: ("E", "NOT_COMMON_STOCK"),
    }
    unknown = {r.n: r.reason for r in universe.classify(df.where("n IN (5, 29)"), sic_known=False).collect()}
    assert unknown == {5: "TARGET_MARKET_COMMON_STOCK", 29: "REIT_DETECTION_INCOMPLETE"}


def test_admission_of_examples(spark):
    from tidemark.operators import evaluation as ev

    at = lambda d: dt.datetime(2026, 1, d)
    good = ("SUCCESS", "CONFIRMED", 0.5, at(5), True, at(5), [])
    names = ("label", "review", "confidence", "seen_at", "resolved", "context_at", "gaps")
    changes = [{}, {"label": None}, {"label": "UNCLEAR", "review": None}, {"review": "UNREVIEWED"}, {"confidence": None}, {"confidence": 0.1}, {"seen_at": at(20)}, {"resolved": None}, {"context_at": None}, {"context_at": at(6)}, {"gaps": ["x"]}, {"gaps": None}]
    rows = [(n, *[c.get(k, v) for k, v in zip(names, good, strict=True)]) for n, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "n int, label string, review string, confidence double, seen_at timestamp, resolved boolean, context_at timestamp, gaps array<string>")
    out = ev.admitted(df, ["SUCCESS", "FAILURE"], ["CONFIRMED"], 0.3, "2026-01-10")
    assert [r.reason for r in out.orderBy("n").collect()] == [None, "LABEL_NOT_ADMITTED", "LABEL_NOT_ADMITTED", "REVIEW_STATUS", "NO_CONFIDENCE", "LOW_CONFIDENCE", "SEEN_AFTER_CUTOFF", "PATH_NOT_RESOLVED", "NO_CONTEXT", "CONTEXT_AFTER_JUDGEMENT", "LINEAGE_GAPS", None]
    assert tuple(ev.usable(out).first()) == (2, 10, 1, False)
    research = ev.admitted(df, ["SUCCESS"], None, None, "2026-01-10", lineage=False)
    assert [r.reason for r in research.orderBy("n").collect()] == [None, "LABEL_NOT_ADMITTED", "LABEL_NOT_ADMITTED", None, None, None, "SEEN_AFTER_CUTOFF", "PATH_NOT_RESOLVED", None, None, None, None]


def test_session_times(spark):
    days = [dt.date(2024, 11, 1), dt.date(2024, 11, 5), dt.date(2024, 11, 9), dt.date(2024, 11, 10)]
    got = [tuple(str(x) for x in r) for r in spark.createDataFrame([(d,) for d in days], "day date").select(*[x.cast("timestamp_ntz") for x in text.session_times("day").values()]).collect()]
    assert got == [("2024-11-01 06:00:00", "2024-11-01 06:40:00", "2024-11-04 00:00:00"), ("2024-11-05 06:30:00", "2024-11-05 07:10:00", "2024-11-06 00:00:00"), ("2024-11-09 06:30:00", "2024-11-09 07:10:00", "2024-11-11 00:00:00"), ("2024-11-10 06:30:00", "2024-11-10 07:10:00", "2024-11-11 00:00:00")]


def test_whole_texts_and_members(spark, tmp_path):
    from tidemark.plans import QUERIES

    line = "plain words " * 20
    rows = [(1, f"{line}1234 end", "a", "en"), (2, f"{line}licence\nx", "a", "en"), (3, f"{line}licence\ny", "a", "en"), (4, f"{line} other\nlicence", None, "en"), (5, f"{line} other", None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda q: {r[0]: r[1] for r in QUERIES[q](spark, str(tmp_path)).collect()}
    assert run("redaction_whole") == {r[0]: r[1].replace("1234", "[CODE]") for r in rows}
    assert run("title_line_classify") == {1: "OTHER", 2: "LICENSE", 3: "LICENSE", 4: "OTHER", 5: "OTHER"}
    assert run("near_miss_line_members") == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
    assert run("near_miss_members") == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_near_pairs_send_sets_of_few_pairs(spark):
    """classes that meet on one token and share little else are told apart where they meet; no similar pair is lost."""
    import random

    from tidemark.operators import events

    draw = random.Random(7)
    words = [f"w{n}" for n in range(60)]
    sets = {tuple(sorted(draw.sample(words, draw.randint(1, 14)))) for _ in range(300)}
    near = [tuple(sorted({*t[1:], draw.choice(words)})) for t in list(sets)[:150] if len(t) > 4]
    sets = sorted(sets | set(near))
    rows = spark.createDataFrame([(n, "a", " ".join(t)) for n, t in enumerate(sets)], "id long, g string, title string")
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j]) >= 0.6}
    assert {(r["left"], r["right"]) for r in events.near_pairs(rows, "id", ["g"], "title").collect()} == truth
    met = {tuple(r) for r in events.met_classes(events._classes(rows, "id", ["g"], "title")[1], ["g"], 0.6).collect()}
    assert truth <= met and len(met) < 3 * len(truth) < len(sets) ** 2 / 20
