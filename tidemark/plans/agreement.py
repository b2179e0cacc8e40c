"""Agreement of records with each other, lineage, and registered roles, from rules over orders, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..sources import market as m
from .registry import query

REASONS = ("TARGET_REACHED", "FAILURE_REACHED", "HORIZON_EXPIRED", "THESIS_INVALIDATED")
EPISODES_SQL = f"""episodes AS (SELECT o_orderkey AS episode_id, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status, ({list(REASONS)!r})[o_custkey % 4 + 1] AS close_reason FROM orders WHERE o_orderkey % 53 <> 0),
outcomes AS (SELECT o_orderkey AS episode_id, CASE WHEN o_orderkey % 11 = 0 THEN 'TARGET_REACHED' ELSE ({list(REASONS)!r})[o_custkey % 4 + 1] END AS outcome, 21 - CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS sessions_observed, 20 - CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS resolved_index, CASE WHEN o_orderkey % 31 = 0 THEN true WHEN o_orderkey % 37 <> 0 THEN false END AS later_target_hit FROM orders)"""


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


@query(
    "outcome_agreement",
    f"""WITH {EPISODES_SQL}, v AS (SELECT o.episode_id, CASE WHEN e.episode_id IS NULL THEN 'MISSING_EPISODE' WHEN status IS DISTINCT FROM 'CLOSED' THEN 'EPISODE_STILL_OPEN' WHEN outcome IS DISTINCT FROM close_reason THEN 'OUTCOME_IS_NOT_THE_CLOSE_REASON'
    WHEN outcome = 'HORIZON_EXPIRED' AND NOT (sessions_observed = 21 AND resolved_index = 20) THEN 'EXPIRY_WITHOUT_THE_WHOLE_HORIZON' WHEN outcome = 'HORIZON_EXPIRED' AND later_target_hit IS DISTINCT FROM false THEN 'EXPIRY_WITH_TARGET_REACHED' END AS violation FROM outcomes o LEFT JOIN episodes e ON e.episode_id = o.episode_id) SELECT * FROM v WHERE violation IS NOT NULL""",
)
def outcome_agreement(spark, d):
    o = m.table(spark, d, "orders")
    key = F.col("o_orderkey")
    reason = _pick(REASONS, F.col("o_custkey"))
    episodes = o.where("o_orderkey % 53 <> 0").select(key.alias("episode_id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"), reason.alias("close_reason"))
    one = lambda n: F.when(key % n == 0, 1).otherwise(0)
    outcomes = o.select(key.alias("episode_id"), F.when(key % 11 == 0, "TARGET_REACHED").otherwise(reason).alias("outcome"), (21 - one(23)).alias("sessions_observed"), (20 - one(29)).alias("resolved_index"), F.when(key % 31 == 0, True).when(key % 37 != 0, False).alias("later_target_hit"))
    return ag.outcome_violations(outcomes, episodes)


LABELS = (*ag.SUCCESS, *ag.MISS, "PRICED_IN_ERROR", "NO_EDGE")
KINDS = ("PREDICTED", "SETUP_NOT_ENTERED", "ELIGIBLE_ONLY")
PATHS = ("TARGET_FIRST", "FAILURE_FIRST", "AMBIGUOUS_PATH", "NOT_REACHED", "UNRESOLVED_MISSING_DATA")
OUTCOMES = ("TARGET_REACHED", "THESIS_INVALIDATED", "CORPORATE_ACTION_SUSPECTED", "HORIZON_EXPIRED", "FAILURE_REACHED")
LABEL_SQL = f"""objectives AS (SELECT o_orderkey AS objective_id, o_custkey AS security_id, ({list(KINDS)!r})[o_orderkey % 3 + 1] AS observation_kind, ({list(PATHS)!r})[o_custkey % 5 + 1] AS path_resolution, ({list(OUTCOMES)!r})[(o_orderkey + o_custkey) % 5 + 1] AS primary_outcome, o_totalprice > 150000 AS hit_20 FROM orders WHERE o_orderkey % 59 <> 0),
labels_ AS (SELECT o_orderkey AS objective_id, o_custkey + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS security_id, ({list(LABELS)!r})[o_orderkey % {len(LABELS)} + 1] AS label FROM orders)"""


@query(
    "label_agreement",
    f"""WITH {LABEL_SQL}, v AS (SELECT l.objective_id, label, CASE WHEN o.objective_id IS NULL THEN 'MISSING_OBJECTIVE' WHEN o.security_id IS DISTINCT FROM l.security_id THEN 'OTHER_SECURITY' WHEN path_resolution IN {ag.UNRESOLVED!r} OR primary_outcome = 'CORPORATE_ACTION_SUSPECTED' THEN 'PATH_NOT_RESOLVED'
    WHEN label IN {ag.SUCCESS!r} AND path_resolution IS DISTINCT FROM 'TARGET_FIRST' THEN 'SUCCESS_WITHOUT_TARGET_FIRST' WHEN label IN {ag.SUCCESS!r} AND primary_outcome = 'THESIS_INVALIDATED' THEN 'SUCCESS_OF_AN_INVALIDATED_THESIS' WHEN label = 'PRICED_IN_ERROR' AND path_resolution = 'TARGET_FIRST' THEN 'PRICED_IN_BUT_TARGET_FIRST'
    WHEN label IN {ag.MISS!r} AND observation_kind = 'PREDICTED' THEN 'MISS_OF_A_PREDICTION' WHEN label IN {ag.MISS!r} AND hit_20 IS DISTINCT FROM true THEN 'MISS_WITHOUT_THE_MOVE' WHEN label NOT IN {ag.MISS!r} AND observation_kind <> 'PREDICTED' THEN 'JUDGEMENT_WITHOUT_PREDICTION' END AS violation FROM labels_ l LEFT JOIN objectives o ON o.objective_id = l.objective_id) SELECT * FROM v WHERE violation IS NOT NULL""",
)
def label_agreement(spark, d):
    o = m.table(spark, d, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    objectives = o.where("o_orderkey % 59 <> 0").select(key.alias("objective_id"), customer.alias("security_id"), _pick(KINDS, key).alias("observation_kind"), _pick(PATHS, customer).alias("path_resolution"), _pick(OUTCOMES, key + customer).alias("primary_outcome"), (F.col("o_totalprice") > 150000).alias("hit_20"))
    labels = o.select(key.alias("objective_id"), (customer + F.when(key % 41 == 0, 1).otherwise(0)).alias("security_id"), _pick(LABELS, key).alias("label"))
    return ag.label_violations(labels, objectives)


@query(
    "prediction_attempt_agreement",
    """WITH p AS (SELECT o_orderkey AS attempt_id, o_custkey AS security_id, o_totalprice AS price, o_orderpriority AS bundle FROM orders),
    a AS (SELECT o_orderkey AS attempt_id, o_custkey AS security_id, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS bundle FROM orders WHERE o_orderkey % 61 <> 0),
    v AS (SELECT p.attempt_id, CASE WHEN a.attempt_id IS NULL THEN 'MISSING' ELSE concat_ws(',', CASE WHEN p.security_id IS DISTINCT FROM a.security_id THEN 'security_id' END, CASE WHEN p.price IS DISTINCT FROM a.price THEN 'price' END, CASE WHEN p.bundle IS DISTINCT FROM a.bundle THEN 'bundle' END) END AS differs FROM p LEFT JOIN a ON a.attempt_id = p.attempt_id) SELECT * FROM v WHERE differs <> ''""",
)
def prediction_attempt_agreement(spark, d):
    o = m.table(spark, d, "orders")
    key = F.col("o_orderkey")
    made = o.select(key.alias("attempt_id"), F.col("o_custkey").alias("security_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("bundle"))
    attempts = made.where("attempt_id % 61 <> 0")
    k = F.col("attempt_id")
    attempts = attempts.withColumns({"price": F.when(k % 13 == 0, F.col("price") + 1).when(k % 17 != 0, F.col("price")), "bundle": F.when(k % 19 != 0, F.col("bundle"))})
    return ag.disagreements(made, attempts, "attempt_id", ["security_id", "price", "bundle"])


@query(
    "unregistered_roles",
    """WITH s AS (SELECT event_type AS source_key, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)), r AS (SELECT source_key, k % 2 = 1 AS discovery_role, k % 3 <> 0 AS verification_role FROM s WHERE k <> 4),
    u AS (SELECT event_id, event_type AS source_key, CASE event_id % 3 WHEN 0 THEN 'DISCOVERY' WHEN 1 THEN 'VERIFICATION' ELSE 'CORROBORATION' END AS role FROM events),
    v AS (SELECT event_id, u.source_key, role, CASE WHEN r.source_key IS NULL THEN 'UNKNOWN_SOURCE' WHEN role = 'DISCOVERY' AND NOT discovery_role THEN 'NOT_REGISTERED_FOR_DISCOVERY' WHEN role = 'VERIFICATION' AND NOT verification_role THEN 'NOT_REGISTERED_FOR_VERIFICATION' END AS violation FROM u LEFT JOIN r ON r.source_key = u.source_key) SELECT * FROM v WHERE violation IS NOT NULL""",
)
def unregistered_roles(spark, d):
    from pyspark.sql import Window

    e = m.table(spark, d, "events")
    # The kinds of events are a handful.
    k = e.select(F.col("event_type").alias("source_key")).distinct().withColumn("k", F.row_number().over(Window.orderBy("source_key")))
    sources = k.where("k <> 4").select("source_key", (F.col("k") % 2 == 1).alias("discovery_role"), (F.col("k") % 3 != 0).alias("verification_role"))
    role = F.when(F.col("event_id") % 3 == 0, "DISCOVERY").when(F.col("event_id") % 3 == 1, "VERIFICATION").otherwise("CORROBORATION")
    return ag.unregistered_roles(e.select("event_id", F.col("event_type").alias("source_key"), role.alias("role")), sources).select("event_id", "source_key", "role", "violation")


EXAMPLES_SQL = "x AS (SELECT event_type AS concept_key, CASE WHEN event_id % 5 = 0 AND event_type <> 'view' THEN 'FAILURE' WHEN event_id % 7 = 0 AND event_type <> 'view' THEN 'COUNTEREXAMPLE' ELSE 'SUCCESS' END AS outcome, CASE WHEN event_type < 'd' THEN 'SYNTHETIC' WHEN event_id % 4 = 0 THEN 'SYNTHETIC' ELSE 'HISTORICAL_OBSERVED' END AS example_source FROM events), c AS (SELECT DISTINCT event_type AS concept_key FROM events UNION ALL SELECT 'never shown')"


def examples(spark, d):
    e = m.table(spark, d, "events")
    bad = F.col("event_type") != "view"
    outcome = F.when((F.col("event_id") % 5 == 0) & bad, "FAILURE").when((F.col("event_id") % 7 == 0) & bad, "COUNTEREXAMPLE").otherwise("SUCCESS")
    source = F.when(F.col("event_type") < "d", "SYNTHETIC").when(F.col("event_id") % 4 == 0, "SYNTHETIC").otherwise("HISTORICAL_OBSERVED")
    concepts = e.select(F.col("event_type").alias("concept_key")).distinct().unionByName(spark.createDataFrame([("never shown",)], "concept_key string"))
    return concepts, e.select(F.col("event_type").alias("concept_key"), outcome.alias("outcome"), source.alias("example_source"))


@query(
    "concept_evidence_grade",
    f"""WITH {EXAMPLES_SQL} SELECT c.concept_key, count(*) FILTER (WHERE outcome = 'SUCCESS' AND example_source = 'HISTORICAL_OBSERVED') AS observed_successes, count(*) FILTER (WHERE outcome <> 'SUCCESS' AND example_source = 'HISTORICAL_OBSERVED') AS observed_failures,
    count(*) FILTER (WHERE outcome = 'SUCCESS' AND example_source = 'SYNTHETIC') AS synthetic_successes, count(*) FILTER (WHERE outcome <> 'SUCCESS' AND example_source = 'SYNTHETIC') AS synthetic_failures,
    CASE WHEN count(*) FILTER (WHERE outcome = 'SUCCESS' AND example_source = 'HISTORICAL_OBSERVED') > 0 AND count(*) FILTER (WHERE outcome <> 'SUCCESS' AND example_source = 'HISTORICAL_OBSERVED') > 0 THEN 'OBSERVED_BOTH_WAYS' WHEN count(*) FILTER (WHERE example_source = 'HISTORICAL_OBSERVED') > 0 THEN 'OBSERVED_PARTIAL' ELSE 'SYNTHETIC_ONLY' END AS evidence_grade
    FROM c LEFT JOIN x ON x.concept_key = c.concept_key GROUP BY c.concept_key""",
)
def concept_evidence_grade(spark, d):
    """Examples are counted per concept before they meet the concepts."""
    concepts, shown = examples(spark, d)
    won, seen = F.col("outcome") == "SUCCESS", F.col("example_source") == "HISTORICAL_OBSERVED"
    names = {"observed_successes": won & seen, "observed_failures": ~won & seen, "synthetic_successes": won & ~seen, "synthetic_failures": ~won & ~seen}
    counts = shown.groupBy("concept_key").agg(*[F.count_if(test).alias(n) for n, test in names.items()])
    rows = concepts.join(counts, "concept_key", "left").select("concept_key", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    grade = F.when((F.col("observed_successes") > 0) & (F.col("observed_failures") > 0), "OBSERVED_BOTH_WAYS").when(F.col("observed_successes") + F.col("observed_failures") > 0, "OBSERVED_PARTIAL").otherwise("SYNTHETIC_ONLY")
    return rows.withColumn("evidence_grade", grade)


@query("concepts_without_failures", f"WITH {EXAMPLES_SQL} SELECT c.concept_key, count(*) FILTER (WHERE outcome = 'SUCCESS') AS successes, count(*) FILTER (WHERE outcome IN ('FAILURE', 'COUNTEREXAMPLE')) AS failures FROM c LEFT JOIN x ON x.concept_key = c.concept_key GROUP BY c.concept_key HAVING count(*) FILTER (WHERE outcome = 'SUCCESS') < 1 OR count(*) FILTER (WHERE outcome IN ('FAILURE', 'COUNTEREXAMPLE')) < 1")
def concepts_without_failures(spark, d):
    """Concepts that may not be enabled: none that worked, or none that failed."""
    concepts, shown = examples(spark, d)
    counts = shown.groupBy("concept_key").agg(F.count_if(F.col("outcome") == "SUCCESS").alias("successes"), F.count_if(F.col("outcome").isin("FAILURE", "COUNTEREXAMPLE")).alias("failures"))
    rows = concepts.join(counts, "concept_key", "left").select("concept_key", F.coalesce("successes", F.lit(0)).alias("successes"), F.coalesce("failures", F.lit(0)).alias("failures"))
    return rows.where("successes < 1 or failures < 1")


FIELDS = {"verification_status": 7, "coverage_snapshot": 11, "feature_version": 13, "feature_snapshot": 5, "no_feature_reason": 2, "production_run_id": 17, "universe_run_id": 19, "market_data_run_id": 23, "episode_id": 3, "entry_attempt_id": 4, "stage3_output_id": 2, "input_bundle_sha256": 3, "setup_id": 4}
CONTEXT_SQL = f"ctx AS (SELECT o_orderkey AS objective_id, ({list(KINDS)!r})[o_custkey % 3 + 1] AS observation_kind, {', '.join(f'CASE WHEN o_orderkey % {n} <> 0 THEN o_custkey END AS {f}' for f, n in FIELDS.items())} FROM orders)"


def contexts(spark, d):
    key = F.col("o_orderkey")
    return m.table(spark, d, "orders").select(key.alias("objective_id"), _pick(KINDS, F.col("o_custkey")).alias("observation_kind"), *[F.when(key % n != 0, F.col("o_custkey")).alias(f) for f, n in FIELDS.items()])


GAPS_SQL = """list_filter([CASE WHEN verification_status IS NULL THEN 'verification_status' END, CASE WHEN coverage_snapshot IS NULL THEN 'coverage_snapshot' END, CASE WHEN feature_version IS NULL AND no_feature_reason IS NULL THEN 'feature_version' END,
CASE WHEN feature_version IS NOT NULL AND feature_snapshot IS NULL THEN 'feature_snapshot' END, CASE WHEN production_run_id IS NULL THEN 'production_run_id' END, CASE WHEN universe_run_id IS NULL THEN 'universe_run_id' END, CASE WHEN market_data_run_id IS NULL THEN 'market_data_run_id' END,
CASE WHEN observation_kind = 'PREDICTED' AND episode_id IS NULL THEN 'episode_id' END, CASE WHEN observation_kind = 'PREDICTED' AND entry_attempt_id IS NULL THEN 'entry_attempt_id' END, CASE WHEN observation_kind = 'PREDICTED' AND stage3_output_id IS NULL AND input_bundle_sha256 IS NULL THEN 'decision_reference' END,
CASE WHEN observation_kind = 'SETUP_NOT_ENTERED' AND setup_id IS NULL THEN 'setup_id' END], lambda x: x IS NOT NULL)"""


@query("lineage_gaps", f"WITH {CONTEXT_SQL} SELECT objective_id, observation_kind, array_to_string({GAPS_SQL}, ',') AS gaps, len({GAPS_SQL}) = 0 AS admissible FROM ctx")
def lineage_gaps(spark, d):
    rows = ag.lineage_gaps(contexts(spark, d))
    return rows.select("objective_id", "observation_kind", F.array_join("gaps", ",").alias("gaps"), (F.size("gaps") == 0).alias("admissible"))


@query("lineage_coverage", f"WITH {CONTEXT_SQL} SELECT observation_kind, count(*) AS observations, count(*) FILTER (WHERE objective_id % 6 <> 0) AS with_context, count(*) FILTER (WHERE objective_id % 6 <> 0 AND input_bundle_sha256 IS NOT NULL) AS with_a_bundle_hash, count(*) FILTER (WHERE objective_id % 6 <> 0 AND coverage_snapshot IS NOT NULL) AS with_coverage, count(*) FILTER (WHERE objective_id % 6 <> 0 AND stage3_output_id IS NOT NULL) AS with_the_analysis FROM ctx GROUP BY 1")
def lineage_coverage(spark, d):
    """Observations of each kind, and how many have a context and its parts."""
    rows = contexts(spark, d)
    told = rows.where("objective_id % 6 <> 0").select("objective_id", F.lit(True).alias("c"), "input_bundle_sha256", "coverage_snapshot", "stage3_output_id")
    both = rows.select("objective_id", "observation_kind").join(told, "objective_id", "left")
    return both.groupBy("observation_kind").agg(F.count("*").alias("observations"), F.count("c").alias("with_context"), F.count("input_bundle_sha256").alias("with_a_bundle_hash"), F.count("coverage_snapshot").alias("with_coverage"), F.count("stage3_output_id").alias("with_the_analysis"))


@query("lineage_admission", f"WITH {CONTEXT_SQL}, g AS (SELECT observation_kind, len({GAPS_SQL}) = 0 AS admitted FROM ctx), n AS (SELECT unnest(['PREDICTED', 'SETUP_NOT_ENTERED', 'ELIGIBLE_ONLY', 'RETIRED']) AS dataset) SELECT dataset, count(*) FILTER (WHERE admitted) AS admitted, count(*) FILTER (WHERE NOT admitted) AS rejected FROM n LEFT JOIN g ON observation_kind = dataset GROUP BY 1")
def lineage_admission(spark, d):
    g = ag.lineage_gaps(contexts(spark, d)).groupBy(F.col("observation_kind").alias("dataset")).agg(F.count_if(F.size("gaps") == 0).alias("admitted"), F.count_if(F.size("gaps") > 0).alias("rejected"))
    names = spark.createDataFrame([(k,) for k in (*KINDS, "RETIRED")], "dataset string")
    return names.join(g, "dataset", "left").select("dataset", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("context_agreement", f"WITH {CONTEXT_SQL}, o AS (SELECT objective_id, episode_id, setup_id, CASE WHEN objective_id % 43 = 0 THEN -1 ELSE entry_attempt_id END AS entry_attempt_id FROM ctx WHERE objective_id % 47 <> 0), v AS (SELECT ctx.objective_id, CASE WHEN o.objective_id IS NULL THEN 'MISSING' ELSE concat_ws(',', CASE WHEN ctx.episode_id IS DISTINCT FROM o.episode_id THEN 'episode_id' END, CASE WHEN ctx.setup_id IS DISTINCT FROM o.setup_id THEN 'setup_id' END, CASE WHEN ctx.entry_attempt_id IS DISTINCT FROM o.entry_attempt_id THEN 'entry_attempt_id' END) END AS differs FROM ctx LEFT JOIN o ON o.objective_id = ctx.objective_id) SELECT * FROM v WHERE differs <> ''")
def context_agreement(spark, d):
    """Contexts that point at another episode, setup or attempt than the observation they describe."""
    rows = contexts(spark, d)
    names = ["episode_id", "setup_id", "entry_attempt_id"]
    objectives = rows.where("objective_id % 47 <> 0").select("objective_id", *names).withColumn("entry_attempt_id", F.when(F.col("objective_id") % 43 == 0, F.lit(-1)).otherwise(F.col("entry_attempt_id")))
    return ag.disagreements(rows, objectives, "objective_id", names)
