"""Report and ledger summaries, and the deterministic last decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.decisions import stage3_decision
from ..sources import market as m
from .evaluation import PRED_SQL, predictions
from .registry import q, query, sq

VERDICTS = ("QUALIFIES", "QUALIFIES_WITH_CAVEAT", "UNRESOLVED", "REJECTED_COST", "REJECTED_TERMS")


@query("zero_cost_status", f"WITH p AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS role, ({list(VERDICTS)!r})[p_partkey % 5 + 1] AS verdict FROM part) SELECT role, count(*) FILTER (WHERE verdict = 'QUALIFIES') AS qualifies, count(*) FILTER (WHERE verdict = 'QUALIFIES_WITH_CAVEAT') AS qualifies_with_caveat, count(*) FILTER (WHERE verdict = 'UNRESOLVED') AS unresolved, count(*) FILTER (WHERE verdict LIKE 'REJECTED%') AS rejected, count(*) AS evaluated FROM p WHERE role IS NOT NULL GROUP BY role")
def zero_cost_status(spark, d):
    key = F.col("p_partkey")
    rows = m.table(spark, d, "part").select(F.when(key % 13 != 0, F.col("p_brand")).alias("role"), F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), (key % 5 + 1).cast("int")).alias("verdict")).where("role is not null")
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return rows.groupBy("role").agg(is_("QUALIFIES").alias("qualifies"), is_("QUALIFIES_WITH_CAVEAT").alias("qualifies_with_caveat"), is_("UNRESOLVED").alias("unresolved"), F.count_if(F.col("verdict").startswith("REJECTED")).alias("rejected"), F.count("*").alias("evaluated"))


@query("recurring_cost", "WITH p AS (SELECT s_suppkey, s_nationkey, s_suppkey * 10 AS monthly, CASE WHEN s_suppkey % 3 = 0 THEN 'OPTIONAL_PAID' ELSE 'FREE' END AS cost_class FROM supplier) SELECT coalesce(sum(monthly), 0)::BIGINT AS monthly_cost, count(*) AS providers, count(DISTINCT s_nationkey) AS nations FROM p WHERE cost_class = 'OPTIONAL_PAID' AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def recurring_cost(spark, d):
    """Paid providers that have a role in force, by a semi-join on the bindings."""
    key = F.col("s_suppkey")
    paid = m.table(spark, d, "supplier").where(key % 3 == 0)
    bound = m.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    rows = paid.join(bound, "s_suppkey", "left_semi")
    return rows.agg(F.coalesce(F.sum(key * 10), F.lit(0)).alias("monthly_cost"), F.count("*").alias("providers"), F.count_distinct("s_nationkey").alias("nations"))


TECH, MATERIAL = "list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'A' END, CASE WHEN o_orderkey % 3 = 0 THEN 'D' END], lambda x: x IS NOT NULL)", "list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'M1' END], lambda x: x IS NOT NULL)"
STATE_SQL = f"""s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {TECH} AS tech, {MATERIAL} AS material, list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED_BREAKOUT' END, CASE WHEN o_orderkey % 5 = 0 THEN 'HEALTHY_PULLBACK' END], lambda x: x IS NOT NULL) AS concepts,
  [CASE WHEN o_orderkey % 7 = 0 THEN 'POST_CLOSE' WHEN o_orderkey % 13 <> 0 THEN 'INTRADAY' END] AS timings FROM orders), c AS (SELECT *, CASE WHEN len(tech) = 0 AND len(material) = 0 THEN 'REJECT' WHEN len(material) > 0 AND list_contains(timings, 'POST_CLOSE') THEN 'POST_CLOSE_CATALYST_SETUP' WHEN len(material) > 0 AND timings[1] IS NULL THEN 'WATCH_OTHER'
  WHEN list_contains(concepts, 'FAILED_BREAKOUT') THEN 'WATCH_OTHER' WHEN list_contains(concepts, 'HEALTHY_PULLBACK') THEN 'WATCH_PULLBACK' WHEN len(tech) > 0 AND len(material) > 0 THEN 'TECHNICAL_SETUP_EOD' WHEN len(tech) > 0 THEN 'WATCH_BREAKOUT' ELSE 'WATCH_OTHER' END AS state FROM s)"""


def stage3_rows(spark, d):
    k, customer = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    rows = m.table(spark, d, "orders").select(
        k, F.to_date("o_orderdate").alias("day"), some(F.when(k % 2 == 0, "A"), F.when(k % 3 == 0, "D")).alias("technical_routes"), some(F.when(customer % 2 == 0, "M1")).alias("material_routes"),
        some(F.when(k % 11 == 0, "FAILED_BREAKOUT"), F.when(k % 5 == 0, "HEALTHY_PULLBACK")).alias("concepts"), F.array(F.when(k % 7 == 0, "POST_CLOSE").when(k % 13 != 0, "INTRADAY")).alias("timings"),
    )
    return stage3_decision(rows)


@query("stage3_decision", f"WITH {STATE_SQL} SELECT o_orderkey, state FROM c")
def stage3(spark, d):
    return stage3_rows(spark, d).select("o_orderkey", "state")


@query("stage3_state_counts", f"WITH {STATE_SQL} SELECT day, state, count(*) AS outputs FROM c GROUP BY day, state")
def stage3_state_counts(spark, d):
    return stage3_rows(spark, d).groupBy("day", "state").agg(F.count("*").alias("outputs"))


@query("chunk_merge", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey % 16) AS chunks, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2")
def chunk_merge(spark, d):
    """Counts of each chunk, then their sums: what Spark's partial aggregates do, here with the chunks told."""
    part = m.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_orderkey") % 16).alias("chunk")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    return part.groupBy("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.count("chunk").alias("chunks"), F.sum("lines").alias("lines"))


REQUESTS_SQL = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status, o_orderkey % 23 <> 0 AS complete, CASE o_custkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'anonymized' ELSE 'drift' END AS variant,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 900 + 100 END AS input_tokens, o_orderkey % 50 AS output_tokens, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey % 97 END AS latency, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 31)::DOUBLE / 8 END AS cost, o_orderpriority AS served FROM orders), s AS (SELECT * FROM r WHERE status IS NOT NULL)"""


@query(
    "pipeline_summary",
    f"""WITH {REQUESTS_SQL} SELECT (SELECT count(*) FROM r) AS planned, count(*) AS sent, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS errors, count(*) FILTER (WHERE status = 'ok' AND NOT complete) AS incomplete,
    {', '.join(f"count(*) FILTER (WHERE variant = '{v}') AS {v}" for v in ('main', 'anonymized', 'drift'))}, sum(cost) AS cost_total, count(*) - count(cost) AS without_cost, {sq('avg(cost)')} AS cost_mean, {sq('avg(input_tokens)')} AS input_mean, min(input_tokens) AS input_min,
    quantile_disc(input_tokens, 0.5) AS input_p50, quantile_disc(input_tokens, 0.9) AS input_p90, max(input_tokens) AS input_max, CAST(sum(output_tokens) AS BIGINT) AS output_total, quantile_disc(latency, 0.5) AS latency_p50, quantile_disc(latency, 0.9) AS latency_p90, max(latency) AS latency_max, count(DISTINCT served) AS served_models FROM s""",
)
def pipeline_summary(spark, d):
    """One row of counts, costs, tokens and latencies; quantiles are of nearest rank, over counts per value."""
    k, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = m.table(spark, d, "orders").select(
        F.when(k % 19 != 0, F.when(k % 11 == 0, "error").otherwise("ok")).alias("status"), (k % 23 != 0).alias("complete"), F.when(customer % 3 == 0, "main").when(customer % 3 == 1, "anonymized").otherwise("drift").alias("variant"),
        F.when(k % 17 != 0, customer % 900 + 100).alias("input_tokens"), (k % 50).alias("output_tokens"), F.when(k % 29 != 0, k % 97).alias("latency"), F.when(k % 13 != 0, k % 31 / 8.0).alias("cost"), F.col("o_orderpriority").alias("served"),
    )
    sent = F.col("status").isNotNull()
    ok = F.col("status") == "ok"
    if_sent = lambda c: F.when(sent, F.col(c))
    at = lambda c, p: F.expr(f"percentile_disc({p}) within group (order by case when status is not null then {c} end)")  # noqa: E731  values are few: a count per value is kept
    return rows.agg(
        F.count("*").alias("planned"), F.count("status").alias("sent"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.count_if(ok & ~F.col("complete")).alias("incomplete"), *[F.count_if(sent & (F.col("variant") == v)).alias(v) for v in ("main", "anonymized", "drift")],
        F.sum(if_sent("cost")).alias("cost_total"), (F.count("status") - F.count(if_sent("cost"))).alias("without_cost"), q(F.avg(if_sent("cost")), "cost_mean"), q(F.avg(if_sent("input_tokens")), "input_mean"), F.min(if_sent("input_tokens")).alias("input_min"),
        at("input_tokens", 0.5).alias("input_p50"), at("input_tokens", 0.9).alias("input_p90"), F.max(if_sent("input_tokens")).alias("input_max"), F.sum(if_sent("output_tokens")).alias("output_total"), at("latency", 0.5).alias("latency_p50"), at("latency", 0.9).alias("latency_p90"), F.max(if_sent("latency")).alias("latency_max"), F.count_distinct(if_sent("served")).alias("served_models"),
    )


CHOICES = ("BUY", "WATCH", "SKIP")


@query("answers_summary", f"WITH {PRED_SQL}, a AS (SELECT cohort, ({list(CHOICES)!r})[doc_id % 3 + 1] AS decision, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS score FROM pred) SELECT cohort, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE decision = '{c}') AS {c.lower()}" for c in CHOICES)}, count(score) AS score_n, min(score) AS score_min, median(score) AS score_median, max(score) AS score_max FROM a GROUP BY cohort")
def answers_summary(spark, d):
    """What the answers of each cohort look like: choices, zero ones too, and the spread of a score."""
    choice = F.element_at(F.array(*[F.lit(c) for c in CHOICES]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = predictions(spark, d).select("cohort", choice.alias("decision"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("score"))
    return rows.groupBy("cohort").agg(F.count("*").alias("n"), *[F.count_if(F.col("decision") == c).alias(c.lower()) for c in CHOICES], F.count("score").alias("score_n"), F.min("score").alias("score_min"), F.median("score").alias("score_median"), F.max("score").alias("score_max"))


@query("sync_counters", "WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'EXCLUDED' WHEN c_acctbal < 500 THEN 'UNRESOLVED' ELSE 'INCLUDED' END AS decision, CASE WHEN c_custkey % 4 = 0 THEN 'PROVISIONAL' ELSE 'ANCHORED' END AS confidence, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS shared FROM customer) SELECT c_mktsegment AS market, decision, confidence, count(*) AS n, count(*) FILTER (WHERE shared > 1) AS collisions FROM c GROUP BY 1, 2, 3")
def sync_counters(spark, d):
    """Decisions, confidences and identity collisions of a sync."""
    c = m.table(spark, d, "customer")
    shared = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("shared"))
    balance = F.col("c_acctbal")
    rows = c.join(shared, ["c_nationkey", "c_mktsegment"]).select(F.col("c_mktsegment").alias("market"), F.when(balance < 0, "EXCLUDED").when(balance < 500, "UNRESOLVED").otherwise("INCLUDED").alias("decision"), F.when(F.col("c_custkey") % 4 == 0, "PROVISIONAL").otherwise("ANCHORED").alias("confidence"), "shared")
    return rows.groupBy("market", "decision", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("shared") > 1).alias("collisions"))


@query("predictions_and_outcomes", f"WITH {PRED_SQL}, o AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'PENDING' ELSE 'RESOLVED' END AS resolution FROM labels WHERE doc_id % 8 <> 0), p AS (SELECT doc_id, cohort FROM pred WHERE doc_id % 6 <> 0), r AS (SELECT * FROM o WHERE resolution = 'RESOLVED') SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'NO_OUTCOME' WHEN p.doc_id IS NULL THEN 'NO_PREDICTION' ELSE 'PAIRED' END AS pairing FROM p FULL JOIN r ON p.doc_id = r.doc_id")
def predictions_and_outcomes(spark, d):
    """Complete predictions with resolved outcomes, and what is missing on either side."""
    p = predictions(spark, d).where("doc_id % 6 <> 0").select("doc_id", F.lit(True).alias("p"))
    r = m.table(spark, d, "labels").where("doc_id % 8 <> 0 and doc_id % 9 <> 0").select("doc_id", F.lit(True).alias("r"))
    return p.join(r, "doc_id", "full_outer").select("doc_id", F.when(F.col("r").isNull(), "NO_OUTCOME").when(F.col("p").isNull(), "NO_PREDICTION").otherwise("PAIRED").alias("pairing"))


@query(
    "disclosure_windows",
    """WITH w AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30'),
    page AS (SELECT code, count(*) AS returned, min(day) AS oldest FROM w WHERE rn <= 8 GROUP BY code), s AS (SELECT code, count(*) FILTER (WHERE day >= DATE '1998-06-30' - 600 AND day <= DATE '1998-06-30' - 1) AS selected FROM w WHERE rn <= 8 GROUP BY code)
    SELECT code, selected, returned, CASE WHEN returned < 8 OR oldest <= DATE '1998-06-30' - 600 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS coverage FROM page JOIN s USING (code)""",
)
def disclosure_windows(spark, d):
    """Per code: what a page of the newest 8 rows gives of the window before the cutoff, less the margin, and whether it covers it.

    The page's bound of 8 rows is that of the index asked, not of this query.
    """
    from pyspark.sql import Window

    cutoff = F.lit("1998-06-30").cast("date")
    rows = m.table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderdate").where(F.col("day") <= cutoff)
    page = rows.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("rn <= 8")
    since = F.date_sub(cutoff, 600)
    out = page.groupBy("code").agg(F.count_if(F.col("day").between(since, F.date_sub(cutoff, 1))).alias("selected"), F.count("*").alias("returned"), F.min("day").alias("oldest"))
    return out.select("code", "selected", "returned", F.when((F.col("returned") < 8) | (F.col("oldest") <= since), "COMPLETE").otherwise("INCOMPLETE").alias("coverage"))
