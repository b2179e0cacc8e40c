"""Material events: relevance, routes with their refusals, and the strongest relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the most direct to the weakest; the order is the rank.
RELATIONS = ("DIRECT", "SUBSIDIARY", "CUSTOMER", "SUPPLIER", "COMPETITOR", "SECTOR", "WEAK_ASSOCIATION")
#: Per route: the relations it accepts, and its threshold on a feature.
ROUTES = {
    "M1": (("DIRECT", "SUBSIDIARY"), "novelty", 0.6),
    "M2": (("DIRECT",), "magnitude", 0.5),
    "M3": (("DIRECT", "SUBSIDIARY"), "surprise", 0.5),
    "M4": (("CUSTOMER", "SUPPLIER"), "magnitude", 0.4),
    "M5": (("COMPETITOR", "SECTOR"), "magnitude", 0.6),
    "M6": (("DIRECT", "SUBSIDIARY", "CUSTOMER", "SUPPLIER"), "priced_in", None),
}
CAUSAL = ("M4", "M5")
MOST_PRICED_IN = 0.3


def rank(relation: Column) -> Column:
    return F.coalesce(*[F.when(relation == r, F.lit(i)) for i, r in enumerate(RELATIONS)], F.lit(len(RELATIONS)))


def relations_per_event(relations: DataFrame) -> DataFrame:
    """(event_id, security_id, relations, causal, strongest); weak associations carry no route."""
    real = relations.where(F.col("relation") != "WEAK_ASSOCIATION")
    return real.groupBy("event_id", "security_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"), F.bool_or(F.col("causal_path").isNotNull()).alias("causal"), F.min_by("relation", rank(F.col("relation"))).alias("strongest"))


def routes(rows: DataFrame) -> DataFrame:
    """rows (relations, causal, features) with routes and refusals: a route never fires on a missing measurement."""
    fired, refused = [], []
    for code, (accepted, feature, least) in ROUTES.items():
        related = F.arrays_overlap("relations", F.array(*[F.lit(a) for a in accepted]))
        measured = F.col(feature).isNotNull()
        enough = F.col(feature) <= MOST_PRICED_IN if least is None else F.col(feature) >= least
        path = F.col("causal") if code in CAUSAL else F.lit(True)
        fired.append(F.when(F.coalesce(related & path & measured & enough, F.lit(False)), F.lit(code)))
        refused.append(F.when(related & ~measured, F.lit(f"{code}:UNMEASURED")).when(related & ~path, F.lit(f"{code}:NO_CAUSAL_PATH")))
    present = lambda x: F.filter(F.array(*x), lambda v: v.isNotNull())
    return rows.withColumns({"routes": present(fired), "refusals": present(refused)})


def candidates(rows: DataFrame) -> DataFrame:
    """Per security the union of its events' routes and the strongest relation."""
    return rows.groupBy("security_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"), F.min_by("strongest", rank(F.col("strongest"))).alias("strongest"), F.count("*").alias("events"))


def relevance(independent: Column, has_primary: Column, directness: Column) -> Column:
    return F.when(has_primary & (independent >= 2), "CONFIRMED").when(has_primary, "PRIMARY_ONLY").when(independent >= 3, "CORROBORATED").when(directness.isNull(), "UNMEASURED").when(directness >= 0.5, "REVIEW").otherwise("BACKGROUND")
