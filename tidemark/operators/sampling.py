"""Draws by hash order: a day's samples with matched controls, and a population spread over months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Samples and controls a day, and the sensitivity samples of them.
PRIMARY, CONTROL, ANONYMIZED, DRIFT = 60, 20, 8, 4
#: Sessions between two samples of one security.
SPACING = 20


def draw_key(*parts: Column | str) -> Column:
    """The ordering key of a draw: SHA-256 of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def candidate_pool(rows: DataFrame, day: str, code: str, passed: str, version: str, seed: str) -> DataFrame:
    """rows with pool, selection_key, selection_rank (of those that passed), is_primary, probability, anchor_rank and anchors wanted.

    One control for every three samples, rounded up, at most CONTROL; anchors are the samples of lowest anchor key.
    """
    parts = (F.lit(version), F.lit(seed), F.col(day).cast("string"))
    ok = F.col(passed)
    rows = rows.withColumns({"pool": F.when(ok, "PRIMARY_POOL").otherwise("CONTROL_POOL"), "selection_key": draw_key(*parts, F.when(ok, "PRIMARY").otherwise("CONTROL"), F.col(code).cast("string"))})
    rank = F.row_number().over(Window.partitionBy(day, "pool").orderBy("selection_key"))
    n = F.count("*").over(Window.partitionBy(day, "pool"))
    rows = rows.withColumns({"__rank": rank, "__n": n})
    rows = rows.withColumns({"selection_rank": F.when(ok, F.col("__rank")), "is_primary": ok & (F.col("__rank") <= PRIMARY), "probability": F.when(ok, F.least(F.lit(1.0), F.lit(float(PRIMARY)) / F.col("__n")))})
    chosen = F.least(F.col("__n"), F.lit(PRIMARY))
    anchor = F.row_number().over(Window.partitionBy(day, "is_primary").orderBy(draw_key(*parts, "ANCHOR", F.col(code).cast("string"))))
    wanted = F.least(F.lit(CONTROL), F.ceil(chosen * CONTROL / PRIMARY))
    return rows.withColumns({"anchor_rank": F.when(F.col("is_primary"), anchor), "is_anchor": F.col("is_primary") & (anchor <= wanted)}).drop("__rank", "__n")


def sensitivity(samples: DataFrame, day: str, sample: str, version: str, seed: str) -> DataFrame:
    """samples with anonymized_pair and drift_repeat: a tenth and a twentieth of the day's, disjoint, within their bounds."""
    key = draw_key(version, seed, F.col(day).cast("string"), "SENSITIVITY", F.col(sample))
    rank = F.row_number().over(Window.partitionBy(day).orderBy(key))
    n = F.count("*").over(Window.partitionBy(day))
    a, b = F.least(F.lit(ANONYMIZED), F.floor(n / 10)), F.least(F.lit(DRIFT), F.floor(n / 20))
    return samples.withColumns({"anonymized_pair": rank <= a, "drift_repeat": (rank > a) & (rank <= a + b)})


def month_dates(sessions: DataFrame, day: str, each: int, seed: str) -> DataFrame:
    """At most so many sessions of each month, those of lowest key."""
    key = draw_key(seed, F.col(day).cast("string"))
    rank = F.row_number().over(Window.partitionBy(F.date_trunc("month", F.col(day))).orderBy(key))
    return sessions.withColumn("draw", rank).where(F.col("draw") <= each)


def spaced(rows: DataFrame, code: str, at: str, key: str, spacing: int = SPACING) -> DataFrame:
    """rows that may be drawn together: in order of key, each at least spacing sessions (at, a number) from those of its code before it.

    A fold over a security's rows in order of key.  What is taken is kept by stretches of spacing sessions: of one stretch
    no two can be taken, and only its own and its two neighbours' can stand too near.  Of rows of equal key and session one is
    taken.  A security's rows are one for a session at most, so an array is as long as its history.
    """
    kind = "struct<by:map<bigint,bigint>,rows:array<int>>"
    inner = rows.groupBy(code).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.struct(*[x for x in rows.columns if x != code]).alias("row")))).alias("all"))

    def take(done, n):
        x = F.col("all")[n]["at"]
        own = F.floor(x / spacing).cast("long")
        near = lambda k: F.coalesce(F.abs(F.try_element_at(done["by"], own + k) - x) < spacing, F.lit(False))
        more = F.struct(F.map_concat(done["by"], F.create_map(own, x)).alias("by"), F.concat(done["rows"], F.array(n)).alias("rows"))
        return F.when(x.isNull() | near(-1) | near(0) | near(1), done).otherwise(more).cast(kind)

    start = F.struct(F.create_map().cast("map<bigint,bigint>").alias("by"), F.array().cast("array<int>").alias("rows")).cast(kind)
    kept = F.aggregate(F.sequence(F.lit(0), F.size("all") - 1), start, take)["rows"]
    return inner.select(code, F.explode(F.transform(kept, lambda n: F.col("all")[n]["row"])).alias("row")).select(code, "row.*").select(*rows.columns)


def round_robin(rows: DataFrame, month: str, key: str, most: int) -> DataFrame:
    """At most so many rows, one of each month in turn: every month's first by key, then every month's second, ..."""
    turn = F.row_number().over(Window.partitionBy(month).orderBy(key))
    # No month gives more than all asked for, so only so many of each are moved.  Ordered by turn, then month: a top-k, without a sort of all rows.
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", month, key).limit(most)


def reduced(samples: DataFrame, cohort: str, sample: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """So many samples of each cohort, those of lowest key of sample and seed; nothing else enters.

    The largest size bounds every cohort's rank by a number, so each task gives on that many rows of a cohort, not all of them.
    """
    rank = F.row_number().over(Window.partitionBy(cohort).orderBy(draw_key(seed, F.col(sample))))
    most = F.coalesce(*[F.when(F.col(cohort) == k, n) for k, n in sizes.items()], F.lit(0))
    return samples.withColumn("draw", rank).where((F.col("draw") <= max(sizes.values(), default=0)) & (F.col("draw") <= most))

