"""Read contracts: one query per view, each side aggregated before it is joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import market as m
from .registry import q, query, sq
from .reports import STATE_SQL, stage3_rows

VALIDATED_SQL = f"{STATE_SQL}, o AS (SELECT o_orderkey, day, state, CASE WHEN o_orderkey % 10 = 0 THEN 'REJECTED' WHEN o_orderkey % 4 = 0 THEN 'ACCEPTED_WITH_WARNINGS' ELSE 'ACCEPTED' END AS validation, CASE WHEN o_orderkey % 6 = 0 THEN 'DETERMINISTIC_MOCK' ELSE 'MODEL' END AS provider_kind FROM c)"


def outputs(spark, d):
    k = F.col("o_orderkey")
    validation = F.when(k % 10 == 0, "REJECTED").when(k % 4 == 0, "ACCEPTED_WITH_WARNINGS").otherwise("ACCEPTED")
    return stage3_rows(spark, d).select(k, "day", "state", validation.alias("validation"), F.when(k % 6 == 0, "DETERMINISTIC_MOCK").otherwise("MODEL").alias("provider_kind"))


@query("watch_and_setup", f"WITH {VALIDATED_SQL} SELECT o_orderkey, day, state, validation FROM o WHERE validation <> 'REJECTED'")
def watch_and_setup(spark, d):
    return outputs(spark, d).where("validation <> 'REJECTED'").select("o_orderkey", "day", "state", "validation")


@query("judgement_audit", f"WITH {VALIDATED_SQL} SELECT day, provider_kind, state, validation, count(*) AS answers, count(*) FILTER (WHERE provider_kind = 'DETERMINISTIC_MOCK') AS from_a_stand_in FROM o GROUP BY 1, 2, 3, 4")
def judgement_audit(spark, d):
    """What was said, how often, how often it was refused, and how much of it came from a stand-in."""
    return outputs(spark, d).groupBy("day", "provider_kind", "state", "validation").agg(F.count("*").alias("answers"), F.count_if(F.col("provider_kind") == "DETERMINISTIC_MOCK").alias("from_a_stand_in"))


@query(
    "open_episodes",
    """WITH e AS (SELECT o_orderkey AS episode_id, o_custkey AS security_id, o_totalprice AS entry_price FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT l_orderkey AS episode_id, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS current_risk_line, count(*) AS transitions FROM lineitem GROUP BY 1)
    SELECT e.episode_id, security_id, entry_price, current_risk_line, coalesce(transitions, 0) AS transitions FROM e LEFT JOIN u ON u.episode_id = e.episode_id""",
)
def open_episodes(spark, d):
    """Open episodes with their latest risk line, by an aggregate of the updates instead of a subquery per row."""
    e = m.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("security_id"), F.col("o_totalprice").alias("entry_price"))
    u = m.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.max_by("l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("current_risk_line"), F.count("*").alias("transitions"))
    return e.join(u, "episode_id", "left").select("episode_id", "security_id", "entry_price", "current_risk_line", F.coalesce("transitions", F.lit(0)).alias("transitions"))


@query("entry_attempt_ledger", "SELECT o_orderkey AS attempt_id, o_custkey AS security_id, o_orderstatus AS status, p.k IS NOT NULL AS produced_a_prediction FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') p ON p.k = o_orderkey")
def entry_attempt_ledger(spark, d):
    made = m.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("p", F.lit(True))
    rows = m.table(spark, d, "orders").join(made, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("security_id"), F.col("o_orderstatus").alias("status"), F.col("p").isNotNull().alias("produced_a_prediction"))


@query("analysis_in_flight", "SELECT o_orderkey AS execution_id, c_name AS watch, CASE WHEN o_orderkey % 3 = 0 THEN 'RETRY_PENDING' ELSE 'STARTED' END AS status, CAST(DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS age_days, o_orderkey % 4 <> 0 AS has_a_stored_answer FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def analysis_in_flight(spark, d):
    o = m.table(spark, d, "orders").where("o_orderstatus = 'P'")
    age = F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("o_orderdate")).cast("long")
    rows = o.join(m.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.col("o_orderkey").alias("execution_id"), F.col("c_name").alias("watch"), F.when(F.col("o_orderkey") % 3 == 0, "RETRY_PENDING").otherwise("STARTED").alias("status"), age.alias("age_days"), (F.col("o_orderkey") % 4 != 0).alias("has_a_stored_answer"))


FOLD_SQL = f"f AS (SELECT doc_id % 6 AS run_id, doc_id % 10 AS fold, {sq('avg((((doc_id * 7919) % 101) / 100.0 - quality) ** 2)')} AS score, count(*) AS n FROM labels GROUP BY 1, 2)"


def fold_scores(spark, d):
    rows = m.table(spark, d, "labels")
    score = F.avg(F.pow(F.col("doc_id") * 7919 % 101 / 100.0 - F.col("quality"), 2))
    return rows.groupBy((F.col("doc_id") % 6).alias("run_id"), (F.col("doc_id") % 10).alias("fold")).agg(q(score, "score"), F.count("*").alias("n"))


@query("model_versions", f"WITH {FOLD_SQL} SELECT run_id, count(*) AS folds, count(*) FILTER (WHERE score IS NULL) AS folds_without_a_score, {sq('avg(score)')} AS mean_score, CAST(sum(n) AS BIGINT) AS labels FROM f GROUP BY run_id")
def model_versions(spark, d):
    return fold_scores(spark, d).groupBy("run_id").agg(F.count("*").alias("folds"), F.count_if(F.col("score").isNull()).alias("folds_without_a_score"), q(F.avg("score"), "mean_score"), F.sum("n").alias("labels"))


# Reasons for which a challenger stays one, in order.
@query(
    "promotion_audit",
    f"""WITH {FOLD_SQL}, g AS (SELECT run_id, avg(score) AS mean_score, count(score) AS scored, min(n) AS least FROM f GROUP BY run_id), c AS (SELECT mean_score AS champion FROM g WHERE run_id = 0)
    SELECT run_id AS attempt_id, {sq('mean_score')} AS mean_score, concat_ws(',', CASE WHEN scored < 5 THEN 'TOO_FEW_FOLDS' END, CASE WHEN least < 20 THEN 'FOLD_TOO_SMALL' END, CASE WHEN floor(mean_score * 1e6 + 0.5) >= floor(champion * 1e6 + 0.5) THEN 'NOT_BETTER' END, CASE WHEN run_id % 2 = 1 THEN 'NOT_APPROVED' END) AS refusal_reasons,
    NOT (scored < 5 OR least < 20 OR floor(mean_score * 1e6 + 0.5) >= floor(champion * 1e6 + 0.5) OR run_id % 2 = 1) AS promoted FROM g, c WHERE run_id <> 0""",
)
def promotion_audit(spark, d):
    """Challengers against the champion on the same folds, with every reason that keeps one from taking its place."""
    g = fold_scores(spark, d).groupBy("run_id").agg(F.avg("score").alias("mean"), F.count("score").alias("scored"), F.min("n").alias("least"))
    champion = g.where("run_id = 0").select(q("mean", "champion"))
    rows = g.where("run_id <> 0").withColumn("mean_score", q("mean")).join(F.broadcast(champion), F.lit(True))
    tests = {"TOO_FEW_FOLDS": F.col("scored") < 5, "FOLD_TOO_SMALL": F.col("least") < 20, "NOT_BETTER": F.col("mean_score") >= F.col("champion"), "NOT_APPROVED": F.col("run_id") % 2 == 1}
    reasons = F.array_join(F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull()), ",")
    return rows.select(F.col("run_id").alias("attempt_id"), "mean_score", reasons.alias("refusal_reasons"), (reasons == "").alias("promoted"))


STATUSES = ("EXACT", "AMBIGUOUS", "UNMAPPED", "ERROR")


@query("mapping_coverage", f"WITH x AS (SELECT l_orderkey % 8 AS run_id, l_partkey, l_suppkey, l_linenumber, ({list(STATUSES)!r})[l_partkey % 4 + 1] AS status FROM lineitem) SELECT run_id, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) AS inputs, {', '.join(f"count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in STATUSES)} FROM x GROUP BY run_id")
def mapping_coverage(spark, d):
    """Distinct inputs of each mapping run, in all and by what came of them."""
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = m.table(spark, d, "lineitem").select((F.col("l_orderkey") % 8).alias("run_id"), "l_partkey", "l_suppkey", "l_linenumber", status.alias("status")).distinct()
    return rows.groupBy("run_id").agg(F.count("*").alias("inputs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


@query("unfilled_roles", "SELECT n_nationkey AS role FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey AND l_quantity > 49)")
def unfilled_roles(spark, d):
    """Roles that no provider in force fills."""
    bound = m.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    filled = m.table(spark, d, "supplier").join(bound, "s_suppkey", "left_semi").select(F.col("s_nationkey").alias("role")).distinct()
    return m.table(spark, d, "nation").select(F.col("n_nationkey").alias("role")).join(filled, "role", "left_anti")
