"""Sampling, metrics, data quality, leakage and read contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import matching, sampling
from ..sources import market as m
from . import outcomes as oc
from . import technical as tech
from .registry import q, query, sq

PRED_SQL = "pred AS (SELECT doc_id, lang AS cohort, source AS subgroup, n_chars, quality AS hit, (doc_id * 7919 % 101) / 100.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"


def predictions(spark, d):
    """A label is an outcome; the probability comes from a fixed rule on the id."""
    rows = m.table(spark, d, "labels").join(m.table(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("cohort"), F.col("source").alias("subgroup"), "n_chars", F.col("quality").alias("hit"), (F.col("doc_id") * 7919 % 101 / 100.0).alias("p"))


@query("brier_by_group", f"WITH {PRED_SQL}, g AS (SELECT cohort, count(*) AS n, avg((p - hit) ** 2) AS brier, avg(hit) AS base_rate FROM pred GROUP BY cohort) SELECT cohort, n, {sq('brier')} AS brier, {sq('base_rate')} AS base_rate, {sq('1 - brier / nullif(base_rate * (1 - base_rate), 0)')} AS skill FROM g")
def brier_by_group(spark, d):
    return ev.brier(predictions(spark, d), ["cohort"]).select("cohort", "n", q("brier", "brier"), q("base_rate", "base_rate"), q("skill", "skill"))


@query(
    "average_precision",
    f"""WITH {PRED_SQL}, a AS (SELECT cohort, p, count(*) AS n, sum(hit) AS hits FROM pred GROUP BY cohort, p),
    c AS (SELECT *, sum(n) OVER o AS seen, sum(hits) OVER o AS found, sum(hits) OVER (PARTITION BY cohort) AS all_hits FROM a WINDOW o AS (PARTITION BY cohort ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
    SELECT cohort, {sq('sum(hits / nullif(all_hits, 0)::DOUBLE * found / seen)')} AS average_precision, CAST(max(all_hits) AS BIGINT) AS positives FROM c GROUP BY cohort""",
)
def average_precision(spark, d):
    return ev.average_precision(predictions(spark, d), ["cohort"]).select("cohort", q("average_precision", "average_precision"), "positives")


@query("calibration_bins", f"WITH {PRED_SQL} SELECT cohort, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, {sq('avg(p)')} AS mean_p, {sq('avg(hit)')} AS rate FROM pred GROUP BY 1, 2")
def calibration_bins(spark, d):
    return ev.calibration(predictions(spark, d), ["cohort"]).select("cohort", "bin", "n", q("mean_p", "mean_p"), q("rate", "rate"))


@query(
    "spearman",
    f"""WITH {PRED_SQL}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY p) + (count(*) OVER (PARTITION BY cohort, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY cohort ORDER BY n_chars) + (count(*) OVER (PARTITION BY cohort, n_chars) - 1) / 2.0 AS b FROM pred)
    SELECT cohort, count(*) AS n, {sq('corr(a, b)')} AS rho FROM r GROUP BY cohort HAVING count(*) >= 3""",
)
def spearman(spark, d):
    return ev.spearman(predictions(spark, d), ["cohort"], "p", "n_chars").where("n >= 3").select("cohort", "n", q("rho", "rho"))


@query(
    "paired_variants",
    f"""WITH {PRED_SQL}, v AS (SELECT doc_id, cohort, p, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 7907 % 101) / 100.0::DOUBLE END AS other FROM pred)
    SELECT cohort, count(*) AS n, count(other) AS comparable, {sq('avg(other - p)')} AS mean_delta, {sq('max(abs(other - p))')} AS max_abs_delta FROM v GROUP BY cohort""",
)
def paired_variants(spark, d):
    """The main answer against a variant's; rows whose variant is missing stay, as not comparable."""
    main = predictions(spark, d)
    variant = main.where("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") * 7907 % 101 / 100.0).alias("other"))
    both = main.join(variant, "doc_id", "left").withColumn("delta", F.col("other") - F.col("p"))
    return both.groupBy("cohort").agg(F.count("*").alias("n"), F.count("other").alias("comparable"), q(F.avg("delta"), "mean_delta"), q(F.max(F.abs("delta")), "max_abs_delta"))


@query("primary_sample", "WITH k AS (SELECT doc_id, lang, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang)) AS sample_key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sample_key) AS draw FROM k) SELECT doc_id, lang, substr(sample_key, 1, 16) AS sample_id, draw FROM r WHERE draw <= 60")
def primary_sample(spark, d):
    rows = ev.hash_top(m.table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ev.sample_key(F.col("doc_id"), F.col("lang")), 60)
    return rows.select("doc_id", "lang", F.substring("sample_key", 1, 16).alias("sample_id"), F.col("draw").cast("long").alias("draw"))


MATCH_SQL = f"""{PRED_SQL}, rows_ AS (SELECT doc_id AS id, cohort, subgroup, floor(n_chars / 1000) AS size, hit, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), cohort)) AS sample_key FROM pred),
a AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sample_key) AS k FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sample_key) AS draw FROM rows_ WHERE hit = 0) WHERE draw <= 20),
s AS (SELECT cohort, 0::BIGINT AS k, NULL::BIGINT AS anchor, NULL::BIGINT AS control, NULL::INTEGER AS tier, []::BIGINT[] AS taken FROM (SELECT DISTINCT cohort FROM a)
  UNION ALL SELECT cohort, k, anchor, control[2].id, control[1], CASE WHEN control IS NULL THEN taken ELSE list_append(taken, control[2].id) END FROM (
    SELECT s.cohort, s.k + 1 AS k, a.id AS anchor, s.taken, (SELECT min((CASE WHEN c.subgroup = a.subgroup AND c.size = a.size THEN 0 WHEN c.subgroup = a.subgroup THEN 1 ELSE 2 END, {{'key': c.sample_key, 'id': c.id}})) FROM rows_ c WHERE c.hit = 1 AND c.cohort = a.cohort AND NOT list_contains(s.taken, c.id)) AS control
    FROM s JOIN a ON a.cohort = s.cohort AND a.k = s.k + 1))"""


@query("control_match", f"WITH RECURSIVE {MATCH_SQL} SELECT cohort, anchor, control, CAST(tier AS BIGINT) AS tier FROM s WHERE control IS NOT NULL")
def control_match(spark, d):
    rows = predictions(spark, d).select(F.col("doc_id").alias("id"), "cohort", "subgroup", F.floor(F.col("n_chars") / 1000).alias("size"), "hit", ev.sample_key(F.col("doc_id"), F.col("cohort")).alias("sample_key"))
    anchors = ev.hash_top(rows.where("hit = 0"), ["cohort"], F.col("sample_key"), sampling.CONTROL)
    return matching.match_controls(anchors, rows.where("hit = 1"), ["cohort"], ["subgroup", "size"])


@query("price_bands", f"WITH {m.BARS_SQL}, b AS (SELECT CASE WHEN close <= 500 THEN '(0,500]' WHEN close <= 1000 THEN '(500,1000]' WHEN close <= 2000 THEN '(1000,2000]' WHEN close <= 3000 THEN '(2000,3000]' ELSE 'ABOVE' END AS band FROM bars WHERE close > 0) SELECT band, count(*) AS n FROM b GROUP BY band")
def price_bands(spark, d):
    c = F.col("close")
    band = F.when(c <= 500, "(0,500]").when(c <= 1000, "(500,1000]").when(c <= 2000, "(1000,2000]").when(c <= 3000, "(2000,3000]").otherwise("ABOVE")
    return m.bars(spark, d).where("close > 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


FOLDS_SQL = "folds AS (SELECT k AS fold, DATE '1995-01-01' AS train_from, DATE '1996-01-01' + CAST(k * 180 AS INTEGER) AS train_to, DATE '1996-01-01' + CAST(k * 180 + 30 AS INTEGER) AS test_from, DATE '1996-01-01' + CAST(k * 180 + 120 AS INTEGER) AS test_to FROM range(0, 10) t(k))"


def folds(spark):
    """Expanding training windows; 30 days are purged before each test window."""
    start = F.lit("1996-01-01").cast("date")
    k = F.col("id").cast("int")
    return spark.range(10).select(F.col("id").alias("fold"), F.lit("1995-01-01").cast("date").alias("train_from"), F.date_add(start, k * 180).alias("train_to"), F.date_add(start, k * 180 + 30).alias("test_from"), F.date_add(start, k * 180 + 120).alias("test_to"))


@query("walk_forward_split", f"WITH {FOLDS_SQL}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT fold, CAST(sum(n) FILTER (WHERE day >= train_from AND day < train_to) AS BIGINT) AS train, CAST(sum(n) FILTER (WHERE day >= train_to AND day < test_from) AS BIGINT) AS purged, CAST(sum(n) FILTER (WHERE day >= test_from AND day < test_to) AS BIGINT) AS test FROM folds JOIN o ON day >= train_from AND day < test_to GROUP BY fold")
def walk_forward_split(spark, d):
    """Ten folds (broadcast) meet one row per day, not one per order."""
    days = m.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    rows = days.join(F.broadcast(folds(spark)), (F.col("day") >= F.col("train_from")) & (F.col("day") < F.col("test_to")))
    part = lambda a, b: F.sum(F.when((F.col("day") >= F.col(a)) & (F.col("day") < F.col(b)), F.col("n")))
    return rows.groupBy("fold").agg(part("train_from", "train_to").alias("train"), part("train_to", "test_from").alias("purged"), part("test_from", "test_to").alias("test"))


REASONS_SQL = "CASE WHEN text IS NULL THEN 'NO_TEXT' WHEN n_chars < 100 THEN 'TOO_SHORT' WHEN quality IS NULL THEN 'UNLABELLED' WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 0 THEN 'LOW_QUALITY' ELSE 'ADMITTED' END"


@query("admission", f"WITH r AS (SELECT lang, {REASONS_SQL} AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, reason, count(*) AS n FROM r GROUP BY lang, reason")
def admission(spark, d):
    rows = m.table(spark, d, "documents").join(m.table(spark, d, "labels"), "doc_id", "left")
    rules = [(F.col("text").isNull(), "NO_TEXT"), (F.col("n_chars") < 100, "TOO_SHORT"), (F.col("quality").isNull(), "UNLABELLED"), (F.col("toxic") == 1, "TOXIC"), (F.col("quality") == 0, "LOW_QUALITY")]
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in rules], F.lit("ADMITTED"))
    return rows.groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("dq_bars", f"WITH {m.BARS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE low > least(open, close)) AS low_above, count(*) FILTER (WHERE high < greatest(open, close)) AS high_below, count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE close IS NULL) AS no_close, count(*) FILTER (WHERE turnover IS NULL) AS no_turnover FROM bars")
def dq_bars(spark, d):
    return m.bars(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("low") > F.least("open", "close")).alias("low_above"), F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_below"), F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("close").isNull()).alias("no_close"), F.count_if(F.col("turnover").isNull()).alias("no_turnover"))


#: Lines that a task of a join with their orders sorts.
LINES = 1_000_000


@query(
    "leakage_violations",
    "SELECT l.l_orderkey, l.l_linenumber, count(*) AS n, min(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days FROM lineitem l JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) GROUP BY 1, 2",
)
def leakage_violations(spark, d):
    """Lines that were shipped before their order was known."""
    line, orders = m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship")), m.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("known"))
    # Both sides are sorted in the join: so many partitions that a task sorts LINES lines, whatever the table.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // LINES))
    bad = line.repartition(parts, "l_orderkey").join(orders.repartition(parts, "l_orderkey"), "l_orderkey").where("ship < known")
    return bad.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min(F.datediff("ship", "known")).cast("long").alias("days"))


@query("dates_after_cutoff", "WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b')) AS found FROM documents) SELECT doc_id, count(*) AS n FROM f WHERE try_cast(found AS DATE) > DATE '2020-01-01' GROUP BY doc_id")
def dates_after_cutoff(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    rows = m.table(spark, d, "documents").select("doc_id", F.explode(found).alias("found"))
    return rows.where(F.expr("try_cast(found AS date) > date '2020-01-01'")).groupBy("doc_id").agg(F.count("*").alias("n"))


DAY = "1997-06-30"
UNION_SQL = f"""{tech.CANDIDATES_SQL}, a AS (SELECT symbol AS security, codes FROM candidates WHERE trade_date BETWEEN DATE '1997-06-01' AND DATE '{DAY}' AND codes <> ''),
t AS (SELECT security, string_agg(DISTINCT c, ',' ORDER BY c) AS technical FROM (SELECT security, unnest(string_split(codes, ',')) AS c FROM a) GROUP BY security),
mt AS (SELECT user_id AS security, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS material FROM events WHERE value > 100 GROUP BY user_id),
merged AS (SELECT coalesce(t.security, mt.security) AS security, technical, material, CASE WHEN t.security IS NOT NULL AND mt.security IS NOT NULL THEN 'BOTH' WHEN t.security IS NOT NULL THEN 'TECHNICAL' ELSE 'MATERIAL' END AS origin FROM t FULL JOIN mt ON t.security = mt.security)"""


def candidate_rows(spark, d):
    from ..operators import features as ft

    rows = ft.evaluate_routes(tech.feature_rows(spark, d)).where(F.col("trade_date").between("1997-06-01", DAY) & (F.size("routes") > 0))
    technical = rows.select(F.col("symbol").alias("security"), F.explode("routes").alias("c")).groupBy("security").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("technical"))
    material = m.table(spark, d, "events").where("value > 100").groupBy(F.col("user_id").alias("security")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("material"))
    both = technical.withColumn("has_t", F.lit(True)).join(material.withColumn("has_m", F.lit(True)), "security", "full_outer")
    origin = F.when(F.col("has_t") & F.col("has_m"), "BOTH").when(F.col("has_t"), "TECHNICAL").otherwise("MATERIAL")
    return both.select("security", "technical", "material", origin.alias("origin"))


@query("candidate_union", f"WITH {UNION_SQL} SELECT * FROM merged")
def candidate_union(spark, d):
    return candidate_rows(spark, d)


@query(
    "dashboard_daily",
    f"""WITH {tech.CANDIDATES_SQL}, {oc.SESSIONS_SQL}, c AS (SELECT trade_date AS day, count(*) AS screened, count(*) FILTER (WHERE codes <> '') AS candidates FROM candidates GROUP BY 1),
    o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS runs FROM orders GROUP BY 1) SELECT coalesce(c.day, o.day) AS day, screened, candidates, runs, s.trade_date IS NOT NULL AS is_session FROM c FULL JOIN o ON c.day = o.day LEFT JOIN sessions s ON s.trade_date = coalesce(c.day, o.day)""",
)
def dashboard_daily(spark, d):
    """One pass over the bars gives what was screened and which days were sessions (30 % of all symbols have a bar)."""
    from ..operators import features as ft

    rows = ft.evaluate_routes(tech.feature_rows(spark, d)).groupBy(F.col("trade_date").alias("day")).agg(F.count("*").alias("screened"), F.count_if(F.size("routes") > 0).alias("candidates"))
    # One row: how many symbols there are.
    symbols = m.table(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("n"))
    least = F.greatest(F.lit(1), F.floor(F.col("n") * 0.3))
    rows = rows.join(F.broadcast(symbols), F.lit(True)).select("day", "screened", "candidates", (F.col("screened") >= least).alias("s"))
    runs = m.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("runs"))
    return rows.join(runs, "day", "full_outer").select("day", "screened", "candidates", "runs", F.coalesce("s", F.lit(False)).alias("is_session"))


@query("coverage_summary", f"WITH {m.BARS_SQL} SELECT 'bars' AS dataset, count(*) AS n, CASE WHEN count(close) = count(*) THEN 'COMPLETE' ELSE 'GAPS' END AS quality FROM bars UNION ALL SELECT 'turnover', count(*), CASE WHEN count(turnover) = count(*) THEN 'COMPLETE' ELSE 'GAPS' END FROM bars UNION ALL SELECT 'orders', count(*), CASE WHEN count(o_totalprice) = count(*) THEN 'COMPLETE' ELSE 'GAPS' END FROM orders")
def coverage_summary(spark, d):
    def one(rows, name, column):
        return rows.agg(F.count("*").alias("n"), F.when(F.count(column) == F.count("*"), "COMPLETE").otherwise("GAPS").alias("quality")).select(F.lit(name).alias("dataset"), "n", "quality")

    bars = m.bars(spark, d)
    return one(bars, "bars", "close").unionByName(one(bars, "turnover", "turnover")).unionByName(one(m.table(spark, d, "orders"), "orders", "o_totalprice"))


@query("top_movers", f"WITH {m.BARS_SQL}, r AS (SELECT symbol, trade_date, {sq('(close - lag(close) OVER o) / nullif(lag(close) OVER o, 0) * 100')} AS ret1 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)) SELECT * FROM r WHERE ret1 IS NOT NULL ORDER BY ret1 DESC, symbol, trade_date LIMIT 50")
def top_movers(spark, d):
    """The report of the 50 largest moves (a top-k without a full sort)."""
    from ..functions import indicators as i

    rows = m.bars(spark, d).select("symbol", "trade_date", q(i.pct_change("close", 1), "ret1")).where("ret1 is not null")
    return rows.orderBy(F.desc("ret1"), "symbol", "trade_date").limit(50)


@query("symbol_coverage", f"WITH {m.BARS_SQL} SELECT symbol, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS n, count(close) AS priced FROM bars GROUP BY symbol")
def symbol_coverage(spark, d):
    return m.bars(spark, d).groupBy("symbol").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count("*").alias("n"), F.count("close").alias("priced"))


@query("event_windows", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, floor(sum(floor(value * 100 + 0.5))) / 100 AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return m.table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), (F.sum(F.floor(F.col("value") * 100 + 0.5)) / 100).alias("total"), F.count_distinct("user_id").alias("users"))


@query("event_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def event_props(spark, d):
    return m.table(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("open_runs", "WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS status, max(CAST(o_orderdate AS DATE)) AS since FROM orders GROUP BY o_custkey) SELECT c_custkey, c_name, status, since FROM customer LEFT JOIN r ON c_custkey = o_custkey WHERE status IS DISTINCT FROM 'F'")
def open_runs(spark, d):
    """The latest state per customer by an aggregate, not by a subquery per row."""
    last = m.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct(F.to_date("o_orderdate"), "o_orderkey")).alias("status"), F.max(F.to_date("o_orderdate")).alias("since"))
    return m.table(spark, d, "customer").join(last, "c_custkey", "left").where(~F.col("status").eqNullSafe("F")).select("c_custkey", "c_name", "status", "since")


@query("run_diff", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'ONLY_LEFT' WHEN a.k IS NULL THEN 'ONLY_RIGHT' ELSE 'CHANGED' END AS what FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def run_diff(spark, d):
    o = m.table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    a = o.where(F.col("o_orderdate") < cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = o.where(F.col("o_orderdate") >= cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("k", F.when(F.col("b").isNull(), "ONLY_LEFT").when(F.col("a").isNull(), "ONLY_RIGHT").otherwise("CHANGED").alias("what"))


@query("business_days", "WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE dayofweek(CAST(o_orderdate AS DATE)) NOT IN (0, 6)), n AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM days) SELECT a.day, b.day AS fifth_after FROM n a LEFT JOIN n b ON b.k = a.k + 5")
def business_days(spark, d):
    """A calendar of open days (thousands of rows) and the fifth open day after each."""
    days = m.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().where(~F.dayofweek("day").isin(1, 7))
    return days.select("day", F.lead("day", 5).over(Window.orderBy("day")).alias("fifth_after"))


@query("nearest_rank", f"WITH {PRED_SQL} SELECT cohort, {', '.join(f'quantile_disc(n_chars, {v}) AS q{int(v * 100)}' for v in (0.1, 0.5, 0.9))} FROM pred GROUP BY cohort")
def nearest_rank(spark, d):
    """Nearest-rank quantiles from counts per value: a group's values are never gathered."""
    per = predictions(spark, d).groupBy("cohort", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("cohort")
    per = per.withColumns({"upto": F.sum("k").over(w.orderBy("n_chars")), "n": F.sum("k").over(w)})
    return per.groupBy("cohort").agg(*[F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("n") * v)), F.col("n_chars"))).alias(f"q{int(v * 100)}") for v in (0.1, 0.5, 0.9)])
