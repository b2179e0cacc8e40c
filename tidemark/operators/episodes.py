"""Episodes: from an entry over its horizon of sessions to the first decided one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZON = 20
DECIDED = ("TARGET_FIRST", "FAILURE_FIRST", "AMBIGUOUS_PATH", "UNRESOLVED_MISSING_DATA")


def evaluate(sessions: DataFrame, invalidations: DataFrame | None = None) -> DataFrame:
    """Per episode_id: the primary result, when it fell, and the excursions over all observed sessions.

    sessions: (episode_id, idx, resolution, up, down), idx 0 to HORIZON, excursions as fractions of the entry; an
    AMBIGUOUS_PATH or UNRESOLVED_MISSING_DATA session decides like any other.  invalidations: (episode_id, at_idx);
    one at session k loses to a decision at a session up to k and wins against later ones, once a session after
    k was observed.  HORIZON_EXPIRED needs all sessions, else HORIZON_INCOMPLETE is pending.
    """
    rows = sessions.where(F.col("idx") <= HORIZON)
    decided = F.when(F.col("resolution").isin(*DECIDED), F.col("idx"))
    hit = F.when(F.col("resolution") == "TARGET_FIRST", F.col("idx"))
    out = rows.groupBy("episode_id").agg(
        F.count("*").alias("observed"), F.max("idx").alias("last_idx"), F.min(decided).alias("decided_idx"), F.min_by("resolution", decided).alias("decided"),
        F.max("up").alias("mfe"), F.min("down").alias("mae"), F.max(hit).alias("last_hit"),
    )
    if invalidations is not None:
        out = out.join(invalidations.groupBy("episode_id").agg(F.min("at_idx").alias("at_idx")), "episode_id", "left")
    else:
        out = out.withColumn("at_idx", F.lit(None).cast("int"))
    first = F.col("decided_idx").isNotNull() & (F.col("at_idx").isNull() | (F.col("decided_idx") <= F.col("at_idx")))
    invalid = F.col("at_idx").isNotNull() & ((F.col("last_idx") > F.col("at_idx")) | F.col("decided_idx").isNotNull())
    primary = F.when(first, F.col("decided")).when(invalid, "THESIS_INVALIDATED").when(F.col("observed") > HORIZON, "HORIZON_EXPIRED")
    stop = F.when(first, F.col("decided_idx")).when(invalid, F.col("at_idx")).when(F.col("observed") > HORIZON, F.lit(HORIZON))
    later = F.when(F.col("last_hit") > stop, True).when(F.col("observed") > HORIZON, False)
    return out.select("episode_id", primary.alias("primary"), stop.cast("long").alias("stop_idx"), F.when(primary.isNull(), "HORIZON_INCOMPLETE").alias("pending"), later.alias("later_target_hit"), "mfe", "mae", "observed")


def illegal(log: DataFrame, key: str, order: str, state: str, edges: list[tuple[str, str]]) -> DataFrame:
    """Moves of a state log that no edge allows."""
    moves = log.select(key, order, F.lag(state).over(Window.partitionBy(key).orderBy(order)).alias("before"), F.col(state).alias("after")).where("before is not null")
    allowed = log.sparkSession.createDataFrame(edges, "before string, after string")
    return moves.join(F.broadcast(allowed), ["before", "after"], "left_anti").select(key, order, "before", "after")
