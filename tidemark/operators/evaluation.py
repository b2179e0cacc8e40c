"""Sampling by hash order, and metrics of predictions against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def hash_top(rows: DataFrame, group: list[str], key: Column, n: int) -> DataFrame:
    """The n rows per group with the smallest hash: a draw that anyone can repeat."""
    return rows.withColumn("sample_key", key).withColumn("draw", F.row_number().over(Window.partitionBy(*group).orderBy("sample_key"))).where(F.col("draw") <= n)


def brier(rows: DataFrame, group: list[str]) -> DataFrame:
    """Brier score, that of the base rate, and skill (null at base rate 0 or 1) of (p, hit)."""
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("hit"), 2)).alias("brier"), F.avg("hit").alias("base_rate"))
    reference = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumns({"reference": reference, "skill": 1 - F.try_divide("brier", F.nullif(reference, F.lit(0.0)))})


def average_precision(rows: DataFrame, group: list[str]) -> DataFrame:
    """Average precision of (p, hit), tied scores as one threshold."""
    at = rows.groupBy(*group, "p").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    w = Window.partitionBy(*group).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"seen": F.sum("n").over(w), "found": F.sum("hits").over(w), "all": F.sum("hits").over(Window.partitionBy(*group))})
    return at.groupBy(*group).agg(F.sum(F.try_divide("hits", F.nullif("all", F.lit(0))) * F.col("found") / F.col("seen")).alias("average_precision"), F.max("all").alias("positives"))


def calibration(rows: DataFrame, group: list[str]) -> DataFrame:
    bins = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long")
    return rows.groupBy(*group, bins.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("rate"))


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mid-ranks; null for fewer than 3 pairs or without variance.  Ranks come from counts per value."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        per = known.groupBy(*group, c).agg(F.count("*").alias("k"))
        below = F.sum("k").over(Window.partitionBy(*group).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
        return per.select(*group, c, (below + (F.col("k") + 1) / 2).alias(f"rank_{c}"))

    both = known.join(ranks(x), [*group, x]).join(ranks(y), [*group, y])
    out = both.groupBy(*group).agg(F.count("*").alias("n"), F.covar_pop(f"rank_{x}", f"rank_{y}").alias("cov"), F.stddev_pop(f"rank_{x}").alias("sx"), F.stddev_pop(f"rank_{y}").alias("sy"))
    return out.select(*group, "n", F.when(F.col("n") >= 3, F.try_divide("cov", F.col("sx") * F.col("sy"))).alias("rho"))


def quartile_bands(rows: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """Bands 1 to 4 by cuts at the values of rank floor(n * q / 4): not ntile, so equal values share a band."""
    w = Window.partitionBy(*group).orderBy(value, key)
    known = rows.where(F.col(value).isNotNull()).withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*group))})
    cuts = known.groupBy(*group).agg(*[F.max(F.when(F.col("__r") == F.floor(F.col("__n") * k / 4), F.col(value))).alias(f"__c{k}") for k in (1, 2, 3)])
    out = known.join(cuts, group)
    band = sum((F.when(F.col(value) >= F.col(f"__c{k}"), 1).otherwise(0) for k in (1, 2, 3)), F.lit(1))
    return out.withColumn("band", band).drop("__r", "__n", "__c1", "__c2", "__c3")


def admitted(rows: DataFrame, labels: list[str], reviews: list[str] | None, least: float | None, cutoff: str, lineage: bool = True) -> DataFrame:
    """rows with reason, the first that keeps an example out of a training set; null: it is admitted.

    rows: label, review, confidence, seen_at (what its judgement had seen), resolved, context_at (null: its inputs were never
    recorded) and gaps (what is missing of them).  Lineage is asked of production sets, not of research.
    """
    c, never = F.col, F.lit(False)
    rules = [
        (~F.coalesce(c("label").isin(labels), never), "LABEL_NOT_ADMITTED"),
        (~F.coalesce(c("review").isin(reviews), never) if reviews else never, "REVIEW_STATUS"),
        (c("confidence").isNull() if least is not None else never, "NO_CONFIDENCE"),
        (c("confidence") < least if least is not None else never, "LOW_CONFIDENCE"),
        (c("seen_at") > F.lit(cutoff).cast("timestamp"), "SEEN_AFTER_CUTOFF"),
        (~F.coalesce("resolved", never), "PATH_NOT_RESOLVED"),
        *([(c("context_at").isNull(), "NO_CONTEXT"), (c("context_at") > c("seen_at"), "CONTEXT_AFTER_JUDGEMENT"), (F.size(F.coalesce("gaps", F.array().cast("array<string>"))) > 0, "LINEAGE_GAPS")] if lineage else []),
    ]
    return rows.withColumn("reason", F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules]))


def usable(rows: DataFrame, classes: int = 3) -> DataFrame:
    """(admitted, rejected, n_classes, usable) of admitted's rows: a target of too few classes is recorded, and not trained on."""
    ok = F.col("reason").isNull()
    out = rows.agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"), F.count_distinct(F.when(ok, F.col("label"))).alias("n_classes"))
    return out.withColumn("usable", (F.col("admitted") > 0) & (F.col("n_classes") >= classes))
