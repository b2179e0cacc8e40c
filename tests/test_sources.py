import datetime as dt
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.plans import QUERIES
from tidemark.sources import files, records, sinks


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json(spark, tmp_path):
    rows = records.columnar_json(spark, put(tmp_path / "a.json", '{"fields":["cik","ticker"],"data":[[1,"A"],[2,"B"],[3]]}')).orderBy("row").collect()
    assert [r["values"] for r in rows] == [{"cik": "1", "ticker": "A"}, {"cik": "2", "ticker": "B"}]
    for text in ('{"daily_quotes":[{"Code":"1301","Date":"2026-01-05","Close":"10.5"},{"Code":null,"Date":"2026-01-05"}]}', '[{"symbol":"1301","t":"2026-01-05","c":10.5},{"symbol":"x","t":"bad"}]'):
        got = records.bars_json(spark, put(tmp_path / "b.json", text)).collect()
        assert [(r.native_symbol, r.trade_date, r.close, r.open) for r in got] == [("1301", dt.date(2026, 1, 5), 10.5, None)]
    text = '{"items":[{"Tdnet":{"id":"7","company_code":"13010","title":"T","pubdate":"2026-01-05 15:00:00"}},{"TDnet":{"id":"x","pubdate":"2026-01-05 15:00:00"}},{"TDnet":{"id":"9","pubdate":"later"}}]}'
    assert [(r.id, r.code) for r in records.disclosures(spark, put(tmp_path / "c.json", text)).collect()] == [(7, "13010")]


def test_columns(spark):
    df = spark.createDataFrame([("2/1",), ("1",), ("a/b",), (None,)], "s string").withColumns(records.split_ratio("s"))
    assert [(r.split_to, r.split_from) for r in df.collect()] == [(2.0, 1.0), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame([("13010",), ("1301",), ("130A0",)], "c string").select(records.code_keys("c").alias("k"))
    assert [r.k for r in df.collect()] == [["13010", "1301"], ["1301"], ["130A0", "130A"]]
    df = spark.createDataFrame([([1], None), ([1, 2], None), ([], None), (None, None), ([1], "e")], "d array<int>, e string").select(records.mapping_result("d", "e").alias("x"))
    assert [r.x for r in df.collect()] == ["EXACT", "AMBIGUOUS", "UNMAPPED", "UNMAPPED", "ERROR"]
    times = ["2026-01-05", "2026/01/05", "2026-01-05T10:00:00+09:00", "Mon, 5 Jan 2026 10:00:00 +0900", "Mon, 5 Jan 2026 01:00:00 GMT", "soon"]
    got = spark.createDataFrame([(t,) for t in times], "t string").withColumns(records.published("t")).select("precision", F.unix_timestamp("published_at").alias("s")).collect()
    one = 1767574800
    assert [(r.precision, r.s) for r in got] == [("DATE", one - 3600), ("DATE", one - 3600), ("EXACT", one), ("EXACT", one), ("EXACT", one), ("UNKNOWN", None)]


def test_feeds(spark, tmp_path):
    folder = tmp_path / "feeds"
    folder.mkdir()
    put(folder / "a.xml", "<rss><channel><item><guid>1</guid><title><![CDATA[A <b>]]></title><link>http://a</link><pubDate>x</pubDate></item><item ><title>B</title></item><item><title>C&amp;D</title><link> http://d </link></item></channel></rss>")
    put(folder / "b.xml", '<feed><entry><id>e</id><title type="text">C</title><link href="http://c"/><updated>2026-01-05</updated></entry></feed>')
    put(folder / "c.xml", "<!DOCTYPE x><rss><item><title>no</title></item></rss>")
    items, refused = records.feed_items(spark, str(folder))
    assert sorted((r.id, r.title, r.url) for r in items.collect()) == [("1", "A <b>", "http://a"), ("e", "C", "http://c"), ("http://d", "C&D", "http://d")]
    assert [r.reason for r in refused.collect()] == ["DOCTYPE"]
    odd = [(1, "<rss><channel><item><title>cut"), (2, "<html><item><guid>1</guid></item></html>"), (3, ""), (4, None), (5, '<?xml version="1.0"?>\n<!-- x -->\n<feed xmlns="http://www.w3.org/2005/Atom"/>'), (6, '<!DOCTYPE r [<!ENTITY a "b">]><rss/>'), (7, "<rss><channel><item><guid>g</guid><title>  </title></item></channel></rss>"), (8, "plain")]
    items, refused = records.parsed_feeds(spark.createDataFrame(odd, "file int, value string"))
    assert [(r.file, r.id, r.title) for r in items.collect()] == [(7, "g", None)]
    assert {r.file: r.reason for r in refused.collect()} == {1: "NOT_WELL_FORMED", 2: "UNKNOWN_ROOT", 3: "NOT_WELL_FORMED", 4: "NOT_WELL_FORMED", 6: "DOCTYPE", 8: "NOT_WELL_FORMED"}


def test_files(spark, tmp_path):
    good = records.snapshot(spark, put(tmp_path / "s.tsv", "a\t1\nb\n\tx\n"), ["k", "v"]).collect()
    assert [(r.k, r.v) for r in good] == [("a", "1"), (None, "x")]
    page = "<table><tr><td>2026/01/01</td><td><b>New Year</b></td></tr><tr><td>2026/13/01</td><td>None</td></tr></table>"
    assert [(r.day, r.name) for r in records.closed_days(spark, put(tmp_path / "p.html", page)).collect()] == [(dt.date(2026, 1, 1), "New Year")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "banner\nコード,名\nE1,会社\n".encode("cp932"))
    assert [(r.code, r.name) for r in records.zipped_csv(spark, str(tmp_path / "z.zip"), ["code", "name"]).collect()] == [("E1", "会社")]
    folder = tmp_path / "arts"
    folder.mkdir()
    put(folder / "a.jsonl", '{"x":1}\n{"x":2}\n')
    put(folder / "b.jsonl", "{}\n")
    manifest = spark.createDataFrame([("a.jsonl", hashlib.sha256(b'{"x":1}\n{"x":2}\n').hexdigest()), ("b.jsonl", "0"), ("c.jsonl", "1")], "name string, sha256 string")
    lines, bad = records.verified(spark, str(folder), manifest)
    assert [r.value for r in lines.orderBy("line").collect()] == ['{"x":1}', '{"x":2}'] and sorted((r.name, r.reason) for r in bad.collect()) == [("b.jsonl", "DAMAGED"), ("c.jsonl", "MISSING")]


def test_sinks(spark, tmp_path):
    kinds = "k int, v string, at int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, None, 1)], kinds)
    new = spark.createDataFrame([(1, "z", 2), (1, "y", 3), (2, "c", 4), (3, None, 2), (4, "n", 1)], kinds)
    merged, log = sinks.upsert(old, new, ["k"], ["v"], "at")
    assert sorted(map(tuple, merged.collect())) == [(1, "y", 3), (2, "b", 5), (3, None, 2), (4, "n", 1)]
    assert [(r.k, r.before.v, r.after.v) for r in log.collect()] == [(1, "a", "y")]
    assert sorted(map(tuple, sinks.insert_ignore(old, new.unionAll(spark.createDataFrame([(4, "m", 0)], kinds)), ["k"], "at").collect())) == [(4, "m", 0)]
    master = spark.createDataFrame([(1, "a", 1, 2)], "k int, v string, first_seen int, last_seen int")
    assert sorted(map(tuple, sinks.confirm(master, spark.createDataFrame([(1, None, 5), (2, "b", 5)], kinds), ["k"], ["v"], "at").collect())) == [(1, "a", 1, 5), (2, "b", 5, 5)]
    sinks.write_artifacts({"one": sinks.flattened(spark.createDataFrame([(1, [1, 2])], "k int, xs array<int>"))}, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w/manifest")).first()["rows"] == 1 and spark.read.parquet(str(tmp_path / "w/one")).first()["xs"] == "[1,2]"
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_artifacts({"one": old}, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        sinks.write_day(old.withColumn("trade_date", F.lit("2026-01-06").cast("date")), str(tmp_path / "d"), "2026-01-05")


def test_replay_of_many_shuffled_files(spark, tmp_path):
    from tidemark.plans.registry import QUERIES

    rows = [(i, i % 5, "view", f"2024-01-{1 + i % 30:02d} 00:00:{i // 30:02d}", float(i), f"p{(i * 7) % 3}") for i in range(360)]
    for k in range(12):  # the newest days come first, each file with days of its own
        part = sorted(rows, key=lambda r: r[3], reverse=True)[k * 30 : k * 30 + 30]
        df = spark.createDataFrame(part, "event_id long, user_id long, event_type string, ts string, value double, props string")
        df.withColumn("ts", df["ts"].cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["stream_dedup"](spark, str(tmp_path)).count() == 360
    days = {str(r.day): r.n for r in QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()}
    assert days == {f"2024-01-{d:02d}": 12 for d in range(1, 28)}
    want = []
    for user in range(5):
        before, number = None, 0
        for r in sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])):
            if r[5] != before:
                before, number = r[5], number + 1
                want.append((r[0], user, number))
    assert sorted(map(tuple, QUERIES["stream_revisions"](spark, str(tmp_path)).collect())) == sorted(want)


def test_chart_history(spark, tmp_path):
    at = lambda *d: int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp())
    quote = {"open": [10.0, None, 12.0, 13.0], "high": [11.0], "close": [10.5, None, 12.5, 13.0], "volume": [101, 5, None, 7]}
    charts = [
        {"meta": {"currency": "JPY", "symbol": "a"}, "timestamp": [at(2026, 1, 5, 0), at(2026, 1, 6, 0), at(2026, 1, 6, 23), at(2026, 1, 8, 1)], "indicators": {"quote": [quote]}, "events": {"splits": {"x": {"date": at(2026, 1, 8, 0), "numerator": 2, "denominator": 1}}}},
        {"meta": {"currency": "USD", "symbol": "b"}, "timestamp": [at(2026, 1, 5, 0)], "indicators": {"quote": [quote]}}, {"meta": {"symbol": "c"}, "timestamp": None, "indicators": {"quote": []}},
    ]
    bars, splits, refused = files.chart_history(spark, put(tmp_path / "c.json", "\n".join(json.dumps(c) for c in charts)))
    got = sorted((r.symbol, r.trade_date.day, r.open, r.high, r.close, r.volume, r.turnover) for r in bars.collect())
    assert got == [("a", 5, 20.0, 22.0, 21.0, 51.0, 1071.0), ("a", 7, 24.0, None, 25.0, None, None), ("a", 8, 13.0, None, 13.0, 7.0, 91.0)]
    assert [(r.symbol, r.ex_date.day, r.action_type) for r in splits.collect()] == [("a", 8, "SPLIT")] and [tuple(r) for r in refused.collect()] == [("b", "USD")]


def test_bulk(spark):
    files_ = [("a", '[{"code":"X","date":"2026-01-05","close":"1.5","open":"NA","volume":10},{"Code":"Y","Date":"2026-01-06","Close":2,"Ex":"T","Adjusted_close":""},{"date":"2026-01-05"},{"code":"Z","date":"soon"}]'), ("b", '{"data":[{"code":"W","date":"2026-01-05"}]}'), ("c", "not json"), ("d", "[]"), ("e", None)]
    df = spark.createDataFrame(files_, "file string, value string")
    rows, refused = records.bulk(df, records.BULK_BAR, ("code", "trade_date"))
    got = sorted((r.code, r.trade_date.day, r.exchange, None if r.close is None else float(r.close), r.open, r.adjusted_close) for r in rows.collect())
    assert got == [("W", 5, None, None, None, None), ("X", 5, None, 1.5, None, None), ("Y", 6, "T", 2.0, None, None)]
    assert sorted((r.file, r.missing) for r in refused.collect()) == [("a", ["code"]), ("a", ["trade_date"])]
    dividends, _ = records.bulk(spark.createDataFrame([("f", '[{"date":"2026-03-30","value":1.25,"unadjustedValue":"2.5","paymentDate":"2026-06-01"}]')], "file string, value string"), records.BULK_DIVIDEND, ("ex_date",))
    assert [(str(r.ex_date), float(r.value), float(r.unadjusted_value), str(r.payment_date), r.currency) for r in dividends.collect()] == [("2026-03-30", 1.25, 2.5, "2026-06-01", None)]
    symbols, _ = records.bulk(spark.createDataFrame([("g", '[{"Code":"X","Name":"X Inc","Type":"Common Stock","Isin":null}]')], "file string, value string"), records.BULK_SYMBOL, ("code",))
    assert [(r.code, r.name, r.security_type, r.isin) for r in symbols.collect()] == [("X", "X Inc", "Common Stock", None)]


def test_feeds_larger_than_a_file_may_be(spark, tmp_path):
    """All items of 24ths whose one file would be refused for its size."""
    n, long = 1600, "s" * 1800
    spark.range(n).selectExpr("id * 24 as doc_id", "'en' as lang", f"'{long}' as source", "id as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["feed_documents"](spark, str(tmp_path))
    assert n * len(long) * 2 > records.MOST_FEED_BYTES and got.where("file = 0").select("id").distinct().count() == got.count() == n


def test_bulk_parses_a_record_once(spark):
    """Fields come out of one parsed record, not each out of its text again; numbers, nulls, nested values and strays as before."""
    text = '[{"Code":"A","Date":"2026-01-05","Open":1.50,"Close":null,"High":{"x":1}}, 7, {"code":"","date":"2026-01-05"}]'
    files_ = spark.createDataFrame([("f", text), ("g", ' {"data": [{"code":"B","date":"2026-01-06","volume":"12"}]}')], "file string, value string")
    rows, refused = records.bulk(files_, records.BULK_BAR, ("code", "trade_date"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 1
    assert sorted((r.code, float(r.open or 0), r.close, r.high, int(r.volume or 0)) for r in rows.collect()) == [("A", 1.5, None, None, 0), ("B", 0.0, None, None, 12)]
    assert sorted((r.record, r.missing) for r in refused.collect()) == [("7", ["code", "trade_date"]), ('{"code":"","date":"2026-01-05"}', ["code"])]
