"""Rows that contradict each other, and what is missing before an example may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of success, of misses, and how a path may have ended without an answer.
SUCCESS = ("PREDICTIVE_SUCCESS", "STATE_CONFIRMED_SUCCESS", "PRICE_SUCCESS_EXOGENOUS")
MISS = ("ACTIONABLE_FALSE_NEGATIVE", "PIPELINE_MISSED_ACTIONABLE_SIGNAL", "OUT_OF_SCOPE_SHOCK", "OUT_OF_SCOPE_LATE")
UNRESOLVED = ("AMBIGUOUS_PATH", "UNRESOLVED_MISSING_DATA")
#: Sessions of a whole horizon, the entry's own included.
HORIZON = 21


def _is(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def first_violation(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """rows that break a rule, with the first one broken (violation)."""
    return rows.withColumn("violation", F.coalesce(*[F.when(_is(test), F.lit(name)) for test, name in rules])).where("violation is not null")


def outcome_violations(outcomes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Outcomes (episode_id, outcome, sessions_observed, resolved_index, later_target_hit) that their episodes (episode_id, status, close_reason) contradict."""
    c = F.col
    expired = c("outcome") == "HORIZON_EXPIRED"
    rows = outcomes.join(episodes.withColumn("__there", F.lit(True)), "episode_id", "left")
    found = first_violation(
        rows,
        (c("__there").isNull(), "MISSING_EPISODE"),
        (~c("status").eqNullSafe("CLOSED"), "EPISODE_STILL_OPEN"),
        (~c("outcome").eqNullSafe(c("close_reason")), "OUTCOME_IS_NOT_THE_CLOSE_REASON"),
        (expired & ~(c("sessions_observed").eqNullSafe(HORIZON) & c("resolved_index").eqNullSafe(HORIZON - 1)), "EXPIRY_WITHOUT_THE_WHOLE_HORIZON"),
        (expired & ~c("later_target_hit").eqNullSafe(False), "EXPIRY_WITH_TARGET_REACHED"),
    )
    return found.select("episode_id", "violation")


def label_violations(labels: DataFrame, objectives: DataFrame) -> DataFrame:
    """Labels (objective_id, label, security_id) that their objective rows don't allow."""
    c = F.col
    o = objectives.withColumnRenamed("security_id", "o_security").withColumn("__there", F.lit(True))
    miss, success = c("label").isin(*MISS), c("label").isin(*SUCCESS)
    found = first_violation(
        labels.join(o, "objective_id", "left"),
        (c("__there").isNull(), "MISSING_OBJECTIVE"),
        (~c("o_security").eqNullSafe(c("security_id")), "OTHER_SECURITY"),
        (c("path_resolution").isin(*UNRESOLVED) | (c("primary_outcome") == "CORPORATE_ACTION_SUSPECTED"), "PATH_NOT_RESOLVED"),
        (success & ~c("path_resolution").eqNullSafe("TARGET_FIRST"), "SUCCESS_WITHOUT_TARGET_FIRST"),
        (success & (c("primary_outcome") == "THESIS_INVALIDATED"), "SUCCESS_OF_AN_INVALIDATED_THESIS"),
        ((c("label") == "PRICED_IN_ERROR") & (c("path_resolution") == "TARGET_FIRST"), "PRICED_IN_BUT_TARGET_FIRST"),
        (miss & (c("observation_kind") == "PREDICTED"), "MISS_OF_A_PREDICTION"),
        (miss & ~c("hit_20").eqNullSafe(True), "MISS_WITHOUT_THE_MOVE"),
        (~miss & (c("observation_kind") != "PREDICTED"), "JUDGEMENT_WITHOUT_PREDICTION"),
    )
    return found.select("objective_id", "label", "violation")


def disagreements(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of left without a row of right, and the columns in which two rows of a key differ (nulls are equal), comma-joined."""
    other = right.select(key, F.lit(True).alias("__there"), *[F.col(n).alias(f"__{n}") for n in columns])
    differ = F.array_join(F.filter(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"__{n}")), F.lit(n)) for n in columns]), lambda x: x.isNotNull()), ",")
    rows = left.join(other, key, "left").withColumn("differs", F.when(F.col("__there").isNull(), "MISSING").otherwise(differ))
    return rows.where("differs <> ''").select(key, "differs")


def unregistered_roles(used: DataFrame, sources: DataFrame) -> DataFrame:
    """Uses (source_key, role) that the source (source_key, discovery_role, verification_role) isn't registered for."""
    rows = used.join(F.broadcast(sources.withColumn("__there", F.lit(True))), "source_key", "left")
    found = first_violation(
        rows,
        (F.col("__there").isNull(), "UNKNOWN_SOURCE"),
        ((F.col("role") == "DISCOVERY") & ~F.col("discovery_role"), "NOT_REGISTERED_FOR_DISCOVERY"),
        ((F.col("role") == "VERIFICATION") & ~F.col("verification_role"), "NOT_REGISTERED_FOR_VERIFICATION"),
    )
    return found


def lineage_gaps(rows: DataFrame) -> DataFrame:
    """rows with gaps: what is missing before the example may be learned from, which depends on its observation_kind."""
    c = F.col
    kind = c("observation_kind")
    blank = lambda n: c(n).isNull() | (c(n).cast("string") == "")
    rules = [
        (blank("verification_status"), "verification_status"),
        (blank("coverage_snapshot"), "coverage_snapshot"),
        (blank("feature_version") & blank("no_feature_reason"), "feature_version"),
        (~blank("feature_version") & blank("feature_snapshot"), "feature_snapshot"),
        *[(blank(n), n) for n in ("production_run_id", "universe_run_id", "market_data_run_id")],
        ((kind == "PREDICTED") & blank("episode_id"), "episode_id"),
        ((kind == "PREDICTED") & blank("entry_attempt_id"), "entry_attempt_id"),
        ((kind == "PREDICTED") & blank("stage3_output_id") & blank("input_bundle_sha256"), "decision_reference"),
        ((kind == "SETUP_NOT_ENTERED") & blank("setup_id"), "setup_id"),
    ]
    return rows.withColumn("gaps", F.filter(F.array(*[F.when(_is(test), F.lit(name)) for test, name in rules]), lambda x: x.isNotNull()))
