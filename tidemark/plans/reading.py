"""What could be read at a cutoff: published runs, documents, provenance, run validation and purges."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from ..sources import market as m
from .registry import query

# An order is a run of a market and day; its lines are the decisions it published.
RUNS_SQL = "runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 0 THEN 'JP' ELSE 'US' END AS market_code, CAST(o_orderdate AS DATE) AS as_of_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS published_at FROM orders WHERE o_orderstatus <> 'P')"
ELIGIBLE_SQL = f"""{RUNS_SQL}, latest AS (SELECT market_code, as_of_date, arg_max(run_id, (published_at, run_id)) AS run_id FROM runs WHERE published_at <= as_of_date + 1 GROUP BY 1, 2),
e AS (SELECT latest.run_id, market_code, as_of_date, l_linenumber AS line, l_suppkey AS symbol, CASE WHEN l_quantity > 40 THEN 'ABOVE_LIMIT' WHEN l_quantity < 5 THEN 'PRICE_MISSING' ELSE 'PRICE_ELIGIBLE' END AS decision, CASE WHEN l_linenumber % 3 = 0 THEN 'REVIEW' ELSE 'INCLUDED' END AS universe_decision FROM latest JOIN lineitem ON l_orderkey = run_id)"""


def price_eligibility(spark, d):
    """Per market and day the decisions of the run that was the authoritative one a day later; later runs don't flow back."""
    o = m.table(spark, d, "orders").where("o_orderstatus <> 'P'")
    day = F.to_date("o_orderdate")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 4 == 0, "JP").otherwise("US").alias("market_code"), day.alias("as_of_date"), F.date_add(day, (F.col("o_orderkey") % 3).cast("int")).alias("published_at"))
    known = runs.where(F.col("published_at") <= F.date_add("as_of_date", 1))
    latest = known.groupBy("market_code", "as_of_date").agg(F.max_by("run_id", F.struct("published_at", "run_id")).alias("run_id"))
    amount = F.col("l_quantity")
    decision = F.when(amount > 40, "ABOVE_LIMIT").when(amount < 5, "PRICE_MISSING").otherwise("PRICE_ELIGIBLE")
    lines = m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("symbol"), decision.alias("decision"), F.when(F.col("l_linenumber") % 3 == 0, "REVIEW").otherwise("INCLUDED").alias("universe_decision"))
    return lines.join(latest, "run_id").select("run_id", "market_code", "as_of_date", "line", "symbol", "decision", "universe_decision")


@query("price_eligibility_asof", f"WITH {ELIGIBLE_SQL} SELECT * FROM e")
def price_eligibility_asof(spark, d):
    return price_eligibility(spark, d)


@query("prediction_universe", f"WITH {ELIGIBLE_SQL} SELECT run_id, market_code, as_of_date, line, symbol FROM e WHERE decision = 'PRICE_ELIGIBLE' AND universe_decision = 'INCLUDED'")
def prediction_universe(spark, d):
    return price_eligibility(spark, d).where("decision = 'PRICE_ELIGIBLE' and universe_decision = 'INCLUDED'").select("run_id", "market_code", "as_of_date", "line", "symbol")


@query("documents_asof", "WITH k AS (SELECT event_id AS document_id, event_type AS source_key, user_id, ts AS published_at, ts + INTERVAL 1 DAY * (event_id % 5) AS available_at, sha256(coalesce(props, '')) AS content_sha256 FROM events) SELECT document_id, source_key, published_at, available_at, content_sha256, row_number() OVER (PARTITION BY user_id, source_key ORDER BY available_at, document_id) AS revision_seq FROM k WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00'")
def documents_asof(spark, d):
    """Documents that could be read at the cutoff, without the columns of a replay, and their revisions so far."""
    from pyspark.sql import Window

    e = m.table(spark, d, "events")
    at = F.expr("ts + make_dt_interval(event_id % 5)")
    rows = e.select(F.col("event_id").alias("document_id"), F.col("event_type").alias("source_key"), "user_id", F.col("ts").alias("published_at"), at.alias("available_at"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("content_sha256"))
    rows = rows.where(F.col("available_at") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    number = F.row_number().over(Window.partitionBy("user_id", "source_key").orderBy("available_at", "document_id"))
    return rows.withColumn("revision_seq", number.cast("long")).drop("user_id")


@query("dependency_available_at", "SELECT user_id AS run_id, count(*) AS dependencies, min(ts) AS first_available_at, max(ts) AS available_at FROM events GROUP BY user_id")
def dependency_available_at(spark, d):
    """A run can be known when the last thing it depends on could be."""
    return m.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("dependencies"), F.min("ts").alias("first_available_at"), F.max("ts").alias("available_at"))


KINDS = {"NAME": "c_name", "BALANCE": "c_acctbal", "SEGMENT": "c_mktsegment", "NATION": "c_nationkey"}
IDENT_SQL = "src AS (SELECT o_custkey % 7 AS source_id, min(CAST(o_orderdate AS DATE)) AS first_available, max(CAST(o_orderdate AS DATE)) AS last_available, count(*) AS fetches FROM orders GROUP BY 1)"


@query(
    "identifier_provenance",
    f"""WITH {IDENT_SQL}, i AS ({' UNION ALL '.join(f"SELECT c_custkey AS listing_id, '{k}' AS kind, {"CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)" if k == "BALANCE" else f"CAST({c} AS VARCHAR)"} AS value, (c_custkey + {n}) % 8 AS source_id FROM customer" for n, (k, c) in enumerate(KINDS.items()))})
    SELECT listing_id, kind, value, i.source_id, first_available, last_available, (SELECT max(last_available) FROM src) AS dependency_available_at FROM i LEFT JOIN src ON src.source_id = i.source_id WHERE value IS NOT NULL""",
)
def identifier_provenance(spark, d):
    """Identifiers of four kinds with when their source could be read, and when the whole run could."""
    o = m.table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    sources = o.groupBy((F.col("o_custkey") % 7).alias("source_id")).agg(F.min(day).alias("first_available"), F.max(day).alias("last_available"))
    # At most seven sources, and one row of the run.
    run = sources.agg(F.max("last_available").alias("dependency_available_at"))
    c = m.table(spark, d, "customer")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.floor(v) if k == "BALANCE" else F.col(v)).cast("string").alias("value"), ((F.col("c_custkey") + n) % 8).alias("source_id")) for n, (k, v) in enumerate(KINDS.items())]))
    rows = c.select(F.col("c_custkey").alias("listing_id"), each.alias("i")).select("listing_id", "i.*").where("value is not null")
    return rows.join(F.broadcast(sources), "source_id", "left").join(F.broadcast(run), how="cross").select("listing_id", "kind", "value", "source_id", "first_available", "last_available", "dependency_available_at")


CONFIDENCE = ("REGISTRY_ANCHORED", "MARKET_ANCHORED", "PROVISIONAL")


@query(
    "issuer_rollup",
    f"""WITH r AS (SELECT o_custkey AS issuer, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, o_orderkey AS name FROM orders),
    s AS (SELECT source, min(day) AS source_from, max(day) AS source_to FROM r GROUP BY source), i AS (SELECT issuer, min(source) AS source, arg_min(name, (source, day, name)) AS name, max(rank) AS rank, count(DISTINCT source) AS sources FROM r GROUP BY issuer)
    SELECT issuer, i.source, name, ({list(CONFIDENCE)!r})[rank + 1] AS confidence, sources, source_from, source_to FROM i JOIN s ON s.source = i.source""",
)
def issuer_rollup(spark, d):
    """One row per issuer: the first source's order, the least sure of its confidences, and the source's provenance."""
    day = F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    rows = m.table(spark, d, "orders").select(F.col("o_custkey").alias("issuer"), F.col("o_orderpriority").alias("source"), day.alias("day"), F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("rank"), F.col("o_orderkey").alias("name"))
    sources = rows.groupBy("source").agg(F.min("day").alias("source_from"), F.max("day").alias("source_to"))
    each = rows.groupBy("issuer").agg(F.min("source").alias("source"), F.min_by("name", F.struct("source", "day", "name")).alias("name"), F.max("rank").alias("rank"), F.count_distinct("source").alias("sources"))
    confidence = F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col("rank") + 1)
    # Sources are a handful.
    return each.join(F.broadcast(sources), "source").select("issuer", "source", "name", confidence.alias("confidence"), "sources", "source_from", "source_to")


CHECKS = (
    "status_succeeded", "finished_at_present", "git_sha_present", "config_hash_present", "job_version_present", "universe_version_present", "identity_version_present", "provider_bindings_present", "source_fetches_present", "market_coverage_present",
    "no_fatal_errors", "counts_consistent", "snapshot_market_consistent", "snapshot_data_version_single", "snapshot_data_version_matches_run", "snapshot_identity_version_matches_run", "evaluation_universe_version_matches_run",
    "source_available_at_complete", "required_sources_hashed", "data_cutoff_covers_sources", "critical_sources_complete",
)
REQUIRED = ("click", "purchase")
VALID_SQL = f"""run AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 9 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, c_custkey % 31 <> 0 AS finished, CASE WHEN c_custkey % 37 <> 0 THEN 'sha' END AS git_sha, CASE WHEN c_custkey % 41 <> 0 THEN 'hash' END AS config_hash,
  CASE WHEN c_custkey % 43 <> 0 THEN 'v1' END AS job_version, CASE WHEN c_custkey % 47 <> 0 THEN 'u1' END AS universe_version, CASE WHEN c_custkey % 53 <> 0 THEN 'i1' END AS identity_version, c_custkey % 59 <> 0 AS bound, 'd1' AS data_version, DATE '1998-12-31' AS data_cutoff FROM customer),
snap AS (SELECT o_custkey AS run_id, count(*) AS snapshot, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS foreign_market, count(DISTINCT CASE WHEN o_orderkey % 89 = 0 THEN 'd2' ELSE 'd1' END) AS versions, min(CASE WHEN o_orderkey % 89 = 0 THEN 'd2' ELSE 'd1' END) AS data_version,
  count(DISTINCT CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE 'i1' END) AS identities, min(CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE 'i1' END) AS identity, count(*) FILTER (WHERE o_orderstatus = 'F') AS included, count(*) FILTER (WHERE o_orderstatus = 'O') AS excluded, count(*) FILTER (WHERE o_orderstatus = 'P') AS unresolved,
  count(*) - count(*) FILTER (WHERE o_orderkey % 79 = 0) AS evaluations, count(DISTINCT CASE WHEN o_orderkey % 73 = 0 THEN 'u2' ELSE 'u1' END) AS universes, min(CASE WHEN o_orderkey % 73 = 0 THEN 'u2' ELSE 'u1' END) AS universe, count(*) FILTER (WHERE o_orderkey % 71 = 0) AS fatal, count(*) FILTER (WHERE o_orderkey % 67 = 0) AS incomplete, max(CAST(o_orderdate AS DATE)) AS last_available FROM orders GROUP BY 1),
fetched AS (SELECT user_id AS run_id, count(*) AS fetches, count(*) FILTER (WHERE event_id % 101 = 0) AS undated, {', '.join(f"bool_or(event_type = '{t}' AND event_id % 3 <> 0) AS has_{t}" for t in REQUIRED)} FROM events GROUP BY 1),
v AS (SELECT run.run_id, status = 'SUCCEEDED' AS status_succeeded, finished AS finished_at_present, git_sha IS NOT NULL AS git_sha_present, config_hash IS NOT NULL AS config_hash_present, job_version IS NOT NULL AS job_version_present, universe_version IS NOT NULL AS universe_version_present, identity_version IS NOT NULL AS identity_version_present, bound AS provider_bindings_present,
  coalesce(fetches, 0) > 0 AS source_fetches_present, snapshot IS NOT NULL AS market_coverage_present, coalesce(fatal, 0) = 0 AS no_fatal_errors, coalesce(evaluations = snapshot AND included + excluded + unresolved = snapshot, false) AS counts_consistent, coalesce(foreign_market, 0) = 0 AS snapshot_market_consistent, coalesce(versions, 0) = 1 AS snapshot_data_version_single,
  coalesce(versions = 1 AND snap.data_version = run.data_version, false) AS snapshot_data_version_matches_run, coalesce(identities = 1 AND identity = identity_version, false) AS snapshot_identity_version_matches_run, coalesce(evaluations, 0) = 0 OR coalesce(universes = 1 AND universe = universe_version, false) AS evaluation_universe_version_matches_run,
  coalesce(undated, 0) = 0 AS source_available_at_complete, {' AND '.join(f'coalesce(has_{t}, false)' for t in REQUIRED)} AS required_sources_hashed, coalesce(data_cutoff >= last_available, false) AS data_cutoff_covers_sources, coalesce(incomplete, 0) = 0 AS critical_sources_complete FROM run LEFT JOIN snap ON snap.run_id = run.run_id LEFT JOIN fetched ON fetched.run_id = run.run_id)"""


@query("run_checks", f"WITH {VALID_SQL} SELECT *, {' AND '.join(CHECKS)} AS ok FROM v")
def run_checks(spark, d):
    """All checks of a run: what it says of itself, and whether its snapshot, evaluations and fetches agree with that."""
    c = F.col
    key = c("c_custkey")
    unless = lambda n, x: F.when(key % n != 0, x)
    run = m.table(spark, d, "customer").select(key.alias("run_id"), F.when(key % 9 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"), (key % 31 != 0).alias("finished"), unless(37, "sha").alias("git_sha"), unless(41, "hash").alias("config_hash"), unless(43, "v1").alias("job_version"), unless(47, "u1").alias("universe_version"), unless(53, "i1").alias("identity_version"), (key % 59 != 0).alias("bound"), F.lit("d1").alias("data_version"), F.lit("1998-12-31").cast("date").alias("data_cutoff"))
    k, s = c("o_orderkey"), c("o_orderstatus")
    version = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    data, identity, universe = version(89, "d2", "d1"), version(83, "", "i1"), version(73, "u2", "u1")
    snap = m.table(spark, d, "orders").groupBy(c("o_custkey").alias("run_id")).agg(
        F.count("*").alias("snapshot"), F.count_if(k % 97 == 0).alias("foreign_market"), F.count_distinct(data).alias("versions"), F.min(data).alias("seen_version"), F.count_distinct(identity).alias("identities"), F.min(identity).alias("identity"),
        F.count_if(s == "F").alias("included"), F.count_if(s == "O").alias("excluded"), F.count_if(s == "P").alias("unresolved"), F.count_if(k % 79 != 0).alias("evaluations"), F.count_distinct(universe).alias("universes"), F.min(universe).alias("universe"),
        F.count_if(k % 71 == 0).alias("fatal"), F.count_if(k % 67 == 0).alias("incomplete"), F.max(F.to_date("o_orderdate")).alias("last_available"),
    )
    fetch = m.table(spark, d, "events").groupBy(c("user_id").alias("run_id")).agg(F.count("*").alias("fetches"), F.count_if(c("event_id") % 101 == 0).alias("undated"), *[F.bool_or((c("event_type") == t) & (c("event_id") % 3 != 0)).alias(f"has_{t}") for t in REQUIRED])
    yes = lambda x: F.coalesce(x, F.lit(False))
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    tests = (
        c("status") == "SUCCEEDED", c("finished"), c("git_sha").isNotNull(), c("config_hash").isNotNull(), c("job_version").isNotNull(), c("universe_version").isNotNull(), c("identity_version").isNotNull(), c("bound"), ~none("fetches"), c("snapshot").isNotNull(),
        none("fatal"), yes((c("evaluations") == c("snapshot")) & (c("included") + c("excluded") + c("unresolved") == c("snapshot"))), none("foreign_market"), F.coalesce("versions", F.lit(0)) == 1, yes((c("versions") == 1) & (c("seen_version") == c("data_version"))),
        yes((c("identities") == 1) & (c("identity") == c("identity_version"))), none("evaluations") | yes((c("universes") == 1) & (c("universe") == c("universe_version"))), none("undated"), functools.reduce(operator.and_, [yes(c(f"has_{t}")) for t in REQUIRED]), yes(c("data_cutoff") >= c("last_available")), none("incomplete"),
    )
    out = run.join(snap, "run_id", "left").join(fetch, "run_id", "left").select("run_id", *[x.alias(n) for x, n in zip(tests, CHECKS, strict=True)])
    return out.withColumn("ok", functools.reduce(operator.and_, [c(n) for n in CHECKS]))


# Obligations to purge: orders of a customer; objects: lines; a line of 7 is under hold.
PURGE_SQL = "ob AS (SELECT o_orderkey AS object_id, o_custkey AS holder, CAST(o_orderdate AS DATE) AS due FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0), objects AS (SELECT DISTINCT l_orderkey AS object_id, l_linenumber AS part FROM lineitem)"


@query("outstanding_purges", f"WITH {PURGE_SQL} SELECT object_id, holder, due, count(*) AS parts, row_number() OVER (PARTITION BY holder ORDER BY due, object_id) AS plan_rank FROM ob JOIN objects USING (object_id) GROUP BY object_id, holder, due")
def outstanding_purges(spark, d):
    """Obligations whose object is still there, in the order in which a holder's are to be done."""
    from pyspark.sql import Window

    ob, objects = _purges(spark, d)
    rows = objects.join(ob, "object_id").groupBy("object_id", "holder", "due").agg(F.count("*").alias("parts"))
    return rows.withColumn("plan_rank", F.row_number().over(Window.partitionBy("holder").orderBy("due", "object_id")).cast("long"))


@query("purge_survivors", f"WITH {PURGE_SQL} SELECT object_id, part FROM objects WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.object_id = objects.object_id)")
def purge_survivors(spark, d):
    """What is left when the obligations are done: the table is rewritten without them."""
    ob, objects = _purges(spark, d)
    return objects.join(ob, "object_id", "left_anti")


def _purges(spark, d):
    o = m.table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderkey % 7 <> 0")
    ob = o.select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("holder"), F.to_date("o_orderdate").alias("due"))
    return ob, m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("part")).distinct()
