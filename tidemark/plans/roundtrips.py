"""Sources and sinks: sample tables written in a source's format and read back, and merges of two readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.disclosures import special_share
from ..schemas import DAILY_BAR
from ..sources import files, records, sinks, store
from ..sources import market as m
from ..sources.scratch import scratch_dir
from .registry import q, query, sq

RANGE = ("1998-03-01", "1998-04-30")


def canonical(bars):
    """Bars in the store's schema."""
    known = {"provider_id": F.lit("sample"), "dataset_key": F.lit("EOD"), "market_code": F.lit("US"), "native_symbol": F.col("symbol").cast("string"), "trade_date": F.col("trade_date"), "currency": F.lit("USD")} | {n: F.col(n) for n in ("open", "high", "low", "close", "volume", "turnover")}
    return bars.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DAILY_BAR.fields])


@query("day_store_range", f"WITH {m.BARS_SQL} SELECT CAST(symbol AS VARCHAR) AS native_symbol, trade_date, {sq('CASE WHEN trade_date = DATE \'1998-04-06\' THEN close + 1 ELSE close END')} AS close, CASE WHEN trade_date = DATE '1998-04-06' THEN 2 ELSE 1 END AS revision_seq FROM bars WHERE trade_date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' AND symbol BETWEEN 1 AND 5")
def day_store_range(spark, d):
    """Days written, written again without effect, one of them revised; a range of some symbols read back."""
    path = scratch_dir(spark)
    bars = m.bars(spark, d).where(F.col("trade_date").between("1998-02-15", "1998-05-15"))
    store.append_days(canonical(bars), path)
    store.append_days(canonical(bars), path)
    revised = bars.where(F.col("trade_date") == F.lit("1998-04-06").cast("date")).withColumn("close", F.col("close") + 1)
    sinks.write_day(canonical(revised), path, "1998-04-06")
    rows = store.read_days(spark, path, *RANGE, symbols=[str(i) for i in range(1, 6)])
    return rows.select("native_symbol", "trade_date", q(F.col("close").cast("double"), "close"), "revision_seq")


@query("symbol_directory", "SELECT CAST(s_suppkey AS VARCHAR) AS \"Symbol\", s_name AS \"Name\", CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'Y' END AS \"ETF\", s_suppkey % 7 = 0 AS refused FROM supplier")
def symbol_directory(spark, d):
    """A pipe-delimited directory with a trailer; lines of a wrong width are told apart."""
    path = scratch_dir(spark)
    s = m.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    line = F.concat_ws("|", key.cast("string"), "s_name", F.when(key % 2 == 0, "N").otherwise("Y"))
    lines = s.select(F.when(key % 7 == 0, F.concat(line, F.lit("|more"))).otherwise(line).alias("value"))
    trailer = spark.createDataFrame([("Symbol|Name|ETF",), ("File Creation Time: 0101199900:00||",)], "value string")
    lines.unionByName(trailer).write.text(path)
    good, bad = files.symbol_directory(spark, path, ["Symbol", "Name", "ETF"])
    part = F.split("line", r"\|")
    return good.withColumn("refused", F.lit(False)).unionByName(bad.select(part[0].alias("Symbol"), part[1].alias("Name"), part[2].alias("ETF"), F.lit(True).alias("refused")))


@query("fx_observations", f"WITH {m.FX_SQL} SELECT series, source_date, rate FROM (SELECT source_date, 'USD' AS series, usd_per_eur AS rate FROM legs UNION ALL SELECT source_date, 'JPY', jpy_per_eur FROM legs) WHERE rate IS NOT NULL")
def fx_observations(spark, d):
    """A statistical CSV whose columns are found by name; blank observations are skipped."""
    path = scratch_dir(spark)
    legs = m.fx_legs(spark, d)
    rows = legs.select("source_date", F.explode(F.array(F.struct(F.lit("USD").alias("CURRENCY"), F.col("usd_per_eur").alias("v")), F.struct(F.lit("JPY").alias("CURRENCY"), F.col("jpy_per_eur").alias("v")))).alias("x"))
    rows.select(F.lit("EXR.D").alias("KEY"), "x.CURRENCY", F.col("source_date").cast("string").alias("TIME_PERIOD"), F.coalesce(F.col("x.v").cast("string"), F.lit("")).alias("OBS_VALUE")).write.option("header", True).csv(path)
    return files.observations(spark, path).select("series", "source_date", F.col("rate").cast("double").alias("rate"))


# Market categories of domestic ordinary shares.
DOMESTIC = ("プライム（内国株式）", "スタンダード（内国株式）", "グロース（内国株式）")
CATEGORIES = (*DOMESTIC, "ETF・ETN", "プライム（外国株式）")
ISSUES_SQL = f"i AS (SELECT CAST(1000 + p_partkey % 9000 AS VARCHAR) || CASE WHEN p_partkey % 6 = 0 THEN '5' ELSE '' END AS code, p_name || CASE WHEN p_partkey % 11 = 0 THEN '優先株式' ELSE '' END AS name, ({list(CATEGORIES)!r})[p_partkey % {len(CATEGORIES)} + 1] AS category FROM part)"


@query("listed_issues", f"WITH {ISSUES_SQL} SELECT code, name, category FROM i WHERE category IN {DOMESTIC!r} AND NOT contains(name, '優先株式') AND length(code) = 4")
def listed_issues(spark, d):
    """The listed-issues workbook as CSV (Spark has no workbook source), down to ordinary domestic shares."""
    path = scratch_dir(spark)
    key = F.col("p_partkey")
    code = F.concat((1000 + key % 9000).cast("string"), F.when(key % 6 == 0, "5").otherwise(""))
    name = F.concat("p_name", F.when(key % 11 == 0, "優先株式").otherwise(""))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (key % len(CATEGORIES) + 1).cast("int"))
    m.table(spark, d, "part").select(code.alias("code"), name.alias("name"), category.alias("category")).write.option("header", True).csv(path)
    rows = spark.read.schema("code string, name string, category string").option("header", True).csv(path)
    return rows.where(F.col("category").isin(*DOMESTIC) & special_share(F.col("code"), F.col("name")).isNull())


@query("columnar_json", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def columnar_json(spark, d):
    """{fields, data}: values by position."""
    path = scratch_dir(spark)
    n = m.table(spark, d, "nation").groupBy((F.col("n_nationkey") % 3).alias("g")).agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))).alias("data"))
    doc = F.to_json(F.struct(F.array(*[F.lit(x) for x in ("key", "name", "region")]).alias("fields"), "data"))
    n.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    v = records.columnar_json(spark, path).select("values")
    return v.select(*[F.col("values")[k].alias(k) for k in ("key", "name", "region")])


@query("bars_json", f"WITH {m.BARS_SQL} SELECT CAST(symbol AS VARCHAR) AS native_symbol, trade_date, {sq('open')} AS open, {sq('close')} AS close, volume FROM bars WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'")
def bars_json(spark, d):
    """Bars under alternative field names and envelopes: every response is a file."""
    path = scratch_dir(spark)
    bars = m.bars(spark, d).where(F.col("trade_date").between("1998-01-01", "1998-03-31"))
    one = F.struct(F.col("symbol").cast("string").alias("Code"), F.col("trade_date").cast("string").alias("Date"), F.col("open").alias("Open"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    two = F.struct(F.col("symbol").cast("string").alias("symbol"), F.col("trade_date").cast("string").alias("t"), F.col("open").alias("o"), F.col("close").alias("c"), F.col("volume").alias("v"))
    by = F.col("symbol") % 20
    a = bars.where("symbol % 2 = 0").groupBy(by.alias("g")).agg(F.to_json(F.struct(F.collect_list(one).alias("daily_quotes"))).alias("value"))
    b = bars.where("symbol % 2 = 1").groupBy(by.alias("g")).agg(F.to_json(F.collect_list(two)).alias("value"))
    a.unionByName(b).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.bars_json(spark, path).select("native_symbol", "trade_date", q("open", "open"), q("close", "close"), "volume")


@query("disclosure_index", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) || '0' AS code, o_orderpriority AS title, CAST(o_orderdate AS TIMESTAMP) AS published_local FROM orders WHERE o_orderkey % 9 <> 0")
def disclosure_index(spark, d):
    """An index whose items nest under either spelling; bad ids are skipped."""
    path = scratch_dir(spark)
    k = F.col("o_orderkey")
    item = F.struct(F.when(k % 9 != 0, k.cast("string")).otherwise("x").alias("id"), F.concat(F.col("o_custkey").cast("string"), F.lit("0")).alias("company_code"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("pubdate"))
    nested = F.when(k % 2 == 0, F.to_json(F.struct(item.alias("Tdnet")))).otherwise(F.to_json(F.struct(item.alias("TDnet"))))
    pages = m.table(spark, d, "orders").select((k % 24).alias("g"), nested.alias("i")).groupBy("g").agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list("i"), ","), F.lit("]}")).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.disclosures(spark, path)


@query("snapshot_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '') AS segment FROM customer WHERE c_custkey % 8 <> 0")
def snapshot_tsv(spark, d):
    """A positional bulk file; lines of a wrong width are dropped, empty fields are null."""
    path = scratch_dir(spark)
    k = F.col("c_custkey")
    line = F.concat_ws("\t", k.cast("string"), "c_name", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    m.table(spark, d, "customer").select(F.when(k % 8 == 0, F.concat(line, F.lit("\tmore"))).otherwise(line).alias("value")).write.text(path)
    return records.snapshot(spark, path, ["key", "name", "segment"])


MERGE_SQL = "cur AS (SELECT o_orderkey AS k, o_totalprice AS price, CAST(o_orderdate AS DATE) AS seen FROM orders WHERE o_orderkey % 3 <> 0), inc AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 7 = 0 THEN -2 ELSE 2 END AS seen FROM orders WHERE o_orderkey % 4 <> 0)"


def readings(spark, d):
    o = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("seen"))
    again = o.where("k % 4 <> 0").select("k", F.when(F.col("k") % 5 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.date_add("seen", F.when(F.col("k") % 7 == 0, -2).otherwise(2)).alias("seen"))
    return o.where("k % 3 <> 0"), again


@query("upserted", f"WITH {MERGE_SQL} SELECT coalesce(cur.k, inc.k) AS k, CASE WHEN cur.k IS NULL OR inc.seen >= cur.seen THEN inc.price ELSE cur.price END AS price, CASE WHEN cur.k IS NULL OR inc.seen >= cur.seen THEN inc.seen ELSE cur.seen END AS seen FROM cur FULL JOIN inc ON cur.k = inc.k")
def upserted(spark, d):
    return sinks.upsert(*readings(spark, d), ["k"], ["price"], "seen")[0]


@query("upsert_revisions", f"WITH {MERGE_SQL} SELECT cur.k, cur.price AS before, inc.price AS after, inc.seen AS changed_at FROM cur JOIN inc ON cur.k = inc.k WHERE inc.seen >= cur.seen AND cur.price IS DISTINCT FROM inc.price")
def upsert_revisions(spark, d):
    """Old and new values of the keys that an upsert changed."""
    log = sinks.upsert(*readings(spark, d), ["k"], ["price"], "seen")[1]
    return log.select("k", F.col("before.price").alias("before"), F.col("after.price").alias("after"), "changed_at")


@query("inserted_new", f"WITH {MERGE_SQL} SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.k = inc.k)")
def inserted_new(spark, d):
    return sinks.insert_ignore(*readings(spark, d), ["k"], "seen")


@query("confirmed_master", f"WITH {MERGE_SQL}, c AS (SELECT k, price, seen AS first_seen, seen + 1 AS last_seen FROM cur) SELECT coalesce(inc.k, c.k) AS k, coalesce(inc.price, c.price) AS price, coalesce(first_seen, inc.seen) AS first_seen, greatest(last_seen, inc.seen) AS last_seen FROM c FULL JOIN inc ON c.k = inc.k")
def confirmed_master(spark, d):
    """Known rows keep their first sighting and move their last; new ones start."""
    current, snapshot = readings(spark, d)
    current = current.select("k", "price", F.col("seen").alias("first_seen"), F.date_add("seen", 1).alias("last_seen"))
    return sinks.confirm(current, snapshot, ["k"], ["price"], "seen")


@query("flattened", "SELECT o_custkey AS customer, count(*) AS n, '{\"from\":\"' || min(CAST(o_orderdate AS DATE)) || '\",\"to\":\"' || max(CAST(o_orderdate AS DATE)) || '\"}' AS span FROM orders GROUP BY 1")
def flattened(spark, d):
    """Nested columns as JSON text."""
    day = F.to_date("o_orderdate")
    rows = m.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.struct(F.min(day).cast("string").alias("from"), F.max(day).cast("string").alias("to")).alias("span"))
    return sinks.flattened(rows)


@query("artifact_manifest", "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'nations', count(*) FROM nation")
def artifact_manifest(spark, d):
    """Artifacts written once, with the manifest as the one point of commit."""
    manifest = sinks.write_artifacts({"orders": m.table(spark, d, "orders"), "nations": m.table(spark, d, "nation")}, scratch_dir(spark))
    return manifest.select("name", "rows")
