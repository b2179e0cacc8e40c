"""Histories by two clocks, publication, identities, events and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as evt
from ..operators import history as h
from ..sources import market as m
from .registry import query

EFFECTIVE, KNOWN = "1999-01-01", "1999-06-30"


def states(spark, d):
    """An order is a customer's status report of its day, with the priority as what is tracked."""
    return m.table(spark, d, "orders").select(F.col("o_custkey").alias("listing_id"), F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("status"))


SCD_SQL = """r AS (SELECT o_custkey AS listing_id, CAST(o_orderdate AS DATE) AS day, arg_max(o_orderpriority, o_orderkey) AS state FROM orders GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN lag(state) OVER o IS NULL OR lag(state) OVER o <> state THEN 1 ELSE 0 END AS changed FROM r WINDOW o AS (PARTITION BY listing_id ORDER BY day)),
e AS (SELECT *, sum(changed) OVER (PARTITION BY listing_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS ep FROM c),
s AS (SELECT listing_id, ep, any_value(state) AS state, min(day) AS effective_from, max(day) AS last_confirmed_at FROM e GROUP BY 1, 2),
history AS (SELECT listing_id, state, effective_from, last_confirmed_at, lead(effective_from) OVER (PARTITION BY listing_id ORDER BY effective_from) AS effective_to FROM s)"""


@query("scd2_history", f"WITH {SCD_SQL} SELECT * FROM history")
def scd2_history(spark, d):
    return h.scd2(states(spark, d), "listing_id", "state", "day", "o_orderkey")


@query(
    "listings_asof",
    f"""WITH {SCD_SQL}, k AS (SELECT *, effective_from + CAST(listing_id % 40 AS INTEGER) AS available_at FROM history),
    v AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY effective_from DESC, available_at DESC) AS rn FROM k WHERE available_at <= DATE '{KNOWN}' AND effective_from <= DATE '{EFFECTIVE}' AND (effective_to IS NULL OR effective_to > DATE '{EFFECTIVE}'))
    SELECT listing_id, state, effective_from, effective_to, available_at FROM v WHERE rn = 1""",
)
def listings_asof(spark, d):
    rows = h.scd2(states(spark, d), "listing_id", "state", "day", "o_orderkey").withColumn("available_at", F.date_add("effective_from", (F.col("listing_id") % 40).cast("int")))
    return h.as_of(rows, "listing_id", EFFECTIVE, KNOWN).select("listing_id", "state", "effective_from", "effective_to", "available_at")


@query("authoritative_run", f"SELECT o_custkey AS job, arg_max(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS run_id, max(CAST(o_orderdate AS DATE)) AS published_at FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= DATE '{KNOWN}' GROUP BY o_custkey")
def authoritative_run(spark, d):
    runs = states(spark, d).where("status = 'F'").select(F.col("listing_id").alias("job"), F.col("day").alias("published_at"), F.col("o_orderkey").alias("publication_seq"))
    return h.authoritative(runs, "job", KNOWN).select("job", F.col("publication_seq").alias("run_id"), "published_at")


@query(
    "run_validation",
    """SELECT o_orderpriority AS run, count(*) AS n, bool_and(o_totalprice > 0) AS positive, count(*) = count(DISTINCT o_orderkey) AS unique_ids, bool_and(o_custkey IN (SELECT c_custkey FROM customer)) AS known_customers,
    bool_and(o_totalprice > 0) AND count(*) = count(DISTINCT o_orderkey) AND bool_and(o_custkey IN (SELECT c_custkey FROM customer)) AS ok FROM orders GROUP BY o_orderpriority""",
)
def run_validation(spark, d):
    known = m.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    rows = m.table(spark, d, "orders").join(known, "o_custkey", "left")
    out = rows.groupBy(F.col("o_orderpriority").alias("run")).agg(F.count("*").alias("n"), F.bool_and(F.col("o_totalprice") > 0).alias("positive"), (F.count("*") == F.count_distinct("o_orderkey")).alias("unique_ids"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known_customers"))
    return out.withColumn("ok", F.col("positive") & F.col("unique_ids") & F.col("known_customers"))


@query(
    "revision_log",
    """WITH r AS (SELECT user_id, event_type, ts, event_id, props, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events),
    c AS (SELECT * FROM r WHERE before IS NULL OR before <> props) SELECT event_id, user_id, event_type, sha256(props) AS digest, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS revision FROM c""",
)
def revision_log(spark, d):
    rows = h.revisions(m.table(spark, d, "events"), ["user_id", "event_type"], "ts", ["props"])
    return rows.select("event_id", "user_id", "event_type", "digest", F.col("revision").cast("long").alias("revision"))


@query(
    "coverage_scopes",
    """SELECT CASE WHEN grouping(r_name) = 1 THEN 'MARKET' WHEN grouping(n_name) = 1 THEN 'EXCHANGE' ELSE 'SEGMENT' END AS scope, r_name AS exchange, n_name AS segment, count(*) AS retrieved, count(DISTINCT c_mktsegment || '|' || c_nationkey) AS unique_keys, count(*) - count(DISTINCT c_mktsegment || '|' || c_nationkey) AS duplicates
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name))""",
)
def coverage_scopes(spark, d):
    place = m.table(spark, d, "nation").join(F.broadcast(m.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = m.table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("key", F.concat_ws("|", "c_mktsegment", "c_nationkey"))
    sets = rows.groupingSets([[], ["r_name"], ["r_name", "n_name"]], "r_name", "n_name").agg(F.grouping("r_name").alias("g1"), F.grouping("n_name").alias("g2"), F.count("*").alias("retrieved"), F.count_distinct("key").alias("unique_keys"))
    scope = F.when(F.col("g1") == 1, "MARKET").when(F.col("g2") == 1, "EXCHANGE").otherwise("SEGMENT")
    return sets.select(scope.alias("scope"), F.col("r_name").alias("exchange"), F.col("n_name").alias("segment"), "retrieved", "unique_keys", (F.col("retrieved") - F.col("unique_keys")).alias("duplicates"))


@query(
    "universe_classify",
    """SELECT p_partkey, CASE WHEN p_type IS NULL OR p_name IS NULL THEN 'UNKNOWN' WHEN p_type = 'PROMO' THEN 'EXCLUDED' WHEN p_size < 5 THEN 'EXCLUDED' WHEN p_retailprice > 1500 THEN 'REVIEW' ELSE 'INCLUDED' END AS decision,
    CASE WHEN p_type IS NULL OR p_name IS NULL THEN 'MISSING_FIELD' WHEN p_type = 'PROMO' THEN 'TYPE' WHEN p_size < 5 THEN 'SIZE' WHEN p_retailprice > 1500 THEN 'PRICE' ELSE 'COMMON' END AS reason FROM part""",
)
def universe_classify(spark, d):
    rules = [(F.col("p_type").isNull() | F.col("p_name").isNull(), "UNKNOWN", "MISSING_FIELD"), (F.col("p_type") == "PROMO", "EXCLUDED", "TYPE"), (F.col("p_size") < 5, "EXCLUDED", "SIZE"), (F.col("p_retailprice") > 1500, "REVIEW", "PRICE")]
    first = F.coalesce(*[F.when(test, F.struct(F.lit(a).alias("decision"), F.lit(b).alias("reason"))) for test, a, b in rules], F.struct(F.lit("INCLUDED").alias("decision"), F.lit("COMMON").alias("reason")))
    return m.table(spark, d, "part").select("p_partkey", first.alias("r")).select("p_partkey", "r.*")


@query("identity_demotion", "WITH k AS (SELECT p_partkey, p_name || '|' || p_brand AS identity_key FROM part) SELECT p_partkey, identity_key, CASE WHEN count(*) OVER (PARTITION BY identity_key) > 1 THEN 'DEMOTED' ELSE 'ANCHORED' END AS confidence FROM k")
def identity_demotion(spark, d):
    return evt.demote_shared(m.table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("identity_key")), "identity_key")


@query("deterministic_ids", "WITH k AS (SELECT s_suppkey, md5('tidemark|' || s_name) AS d FROM supplier) SELECT s_suppkey, concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4), substr(d, 21, 12)) AS id FROM k")
def deterministic_ids(spark, d):
    return m.table(spark, d, "supplier").select("s_suppkey", evt.deterministic_uuid("tidemark", F.col("s_name")).alias("id"))


KEYED_SQL = "k AS (SELECT event_id AS document_id, event_type AS source_key, ts AS available_at, substr(sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), strftime(date_trunc('day', ts), '%Y-%m-%d'))), 1, 32) AS event_key FROM events)"


def keyed(spark, d):
    e = m.table(spark, d, "events")
    return e.select(F.col("event_id").alias("document_id"), F.col("event_type").alias("source_key"), F.col("ts").alias("available_at"), evt.event_key(F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("event_key"))


ROLES_SQL = f"{KEYED_SQL}, roles AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_key ORDER BY available_at, document_id) = 1 THEN 'DISCOVERY' WHEN row_number() OVER (PARTITION BY event_key, source_key ORDER BY available_at, document_id) = 1 THEN 'VERIFICATION' ELSE 'CORROBORATION' END AS role FROM k)"


@query("source_roles", f"WITH {ROLES_SQL} SELECT document_id, event_key, source_key, role FROM roles")
def source_roles(spark, d):
    return evt.source_roles(keyed(spark, d)).select("document_id", "event_key", "source_key", "role")


@query("event_merge", f"WITH {ROLES_SQL} SELECT event_key, count(*) AS documents, count(DISTINCT source_key) AS publishers, count(DISTINCT source_key) FILTER (WHERE role <> 'CORROBORATION') AS independent, min(available_at) AS first_known_at FROM roles GROUP BY event_key")
def event_merge(spark, d):
    return evt.source_roles(keyed(spark, d)).groupBy("event_key").agg(F.count("*").alias("documents"), F.count_distinct("source_key").alias("publishers"), F.count_distinct(F.when(F.col("role") != "CORROBORATION", F.col("source_key"))).alias("independent"), F.min("available_at").alias("first_known_at"))


def first_lines(spark, d):
    return m.table(spark, d, "documents").select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("title"))


FIRST_LINE_SQL = "f AS (SELECT doc_id, source, lang, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS ts FROM documents WHERE text IS NOT NULL)"


@query(
    "near_miss_pairs",
    f"""WITH {FIRST_LINE_SQL}, c AS (SELECT source, lang, ts, min(doc_id) AS id FROM f WHERE len(ts) > 0 GROUP BY source, lang, ts)
    SELECT l.id AS "left", r.id AS "right", len(list_intersect(l.ts, r.ts)) / (len(l.ts) + len(r.ts) - len(list_intersect(l.ts, r.ts)))::DOUBLE AS similarity FROM c l JOIN c r ON l.source = r.source AND l.lang = r.lang AND l.id < r.id WHERE len(list_intersect(l.ts, r.ts)) >= 0.6 * (len(l.ts) + len(r.ts) - len(list_intersect(l.ts, r.ts)))""",
)
def near_miss_pairs(spark, d):
    """Pairs of similar titles, which are the whole first lines of documents, between representatives of equal token sets."""
    return evt.near_pairs(first_lines(spark, d), "doc_id", ["source", "lang"], "title")


@query("near_miss_members", f"WITH {FIRST_LINE_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY source, lang, ts) AS id FROM f WHERE len(ts) > 0")
def near_miss_members(spark, d):
    """Whom the representatives of near_miss_pairs stand for."""
    return evt.near_members(first_lines(spark, d), "doc_id", ["source", "lang"], "title")


RULES = [("LICENSE", "licen[cs]e"), ("CONTACT", "@|tel\\.|phone"), ("CORRECTION", "^(re|korrek|corr)"), ("TABLE", "\\|"), ("SHORT", "^.{0,40}$")]


@query("title_classify", f"WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title FROM documents) SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(title, '{r}') THEN '{k}'" for k, r in RULES)} ELSE 'OTHER' END AS kind FROM t")
def title_classify(spark, d):
    """The kind of a document by its title, its whole first line."""
    title = F.lower("title")
    kind = F.coalesce(*[F.when(title.rlike(r), F.lit(k)) for k, r in RULES], F.lit("OTHER"))
    return first_lines(spark, d).select("doc_id", kind.alias("kind"))


@query("content_fingerprint", "SELECT doc_id, sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) AS fingerprint FROM documents")
def content_fingerprint(spark, d):
    return m.table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(evt.UNIT, *[F.coalesce(c, F.lit("")) for c in ("source", "lang", "text")]), 256).alias("fingerprint"))


@query(
    "code_resolution",
    """WITH q AS (SELECT o_orderkey, CAST(o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS code FROM orders),
    keys AS (SELECT CAST(c_custkey AS VARCHAR) AS lookup, c_custkey FROM customer)
    SELECT q.o_orderkey, q.code, coalesce(a.c_custkey, b.c_custkey) AS listing_id, CASE WHEN a.c_custkey IS NOT NULL THEN 'EXACT' WHEN b.c_custkey IS NOT NULL THEN 'BASE' ELSE 'UNRESOLVED' END AS match
    FROM q LEFT JOIN keys a ON a.lookup = q.code LEFT JOIN keys b ON b.lookup = substr(q.code, length(q.code) - 3)""",
)
def code_resolution(spark, d):
    """Exact code first, else its last four characters: keys with a priority, the best that is known wins."""
    orders = m.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 10_000_000).otherwise(0)).cast("string").alias("code"))
    keys = m.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("lookup"), "c_custkey")
    tail = F.when(F.length("code") <= 4, F.col("code")).otherwise(F.substring("code", -4, 4))
    tries = orders.select("o_orderkey", "code", F.posexplode(F.array("code", tail)).alias("rank", "lookup")).join(keys, "lookup", "left")
    best = tries.groupBy("o_orderkey", "code").agg(F.min_by("c_custkey", F.when(F.col("c_custkey").isNotNull(), F.col("rank"))).alias("listing_id"), F.min(F.when(F.col("c_custkey").isNotNull(), F.col("rank"))).alias("rank"))
    return best.select("o_orderkey", "code", "listing_id", F.when(F.col("rank") == 0, "EXACT").when(F.col("rank") == 1, "BASE").otherwise("UNRESOLVED").alias("match"))


@query(
    "materials_asof",
    f"""WITH {ROLES_SQL}, a AS (SELECT * FROM roles WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00') SELECT event_key, count(*) FILTER (WHERE role = 'DISCOVERY') AS discoveries, count(DISTINCT source_key) FILTER (WHERE role = 'VERIFICATION') AS verifying, count(*) FILTER (WHERE role = 'CORROBORATION') AS corroborations, min(available_at) AS first_known_at, max(available_at) AS last_known_at FROM a GROUP BY event_key""",
)
def materials_asof(spark, d):
    """Roles first, then what was available at the cutoff; each side counts its own rows, so nothing multiplies."""
    rows = evt.source_roles(keyed(spark, d)).where(F.col("available_at") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("event_key").agg(F.count_if(F.col("role") == "DISCOVERY").alias("discoveries"), F.count_distinct(F.when(F.col("role") == "VERIFICATION", F.col("source_key"))).alias("verifying"), F.count_if(F.col("role") == "CORROBORATION").alias("corroborations"), F.min("available_at").alias("first_known_at"), F.max("available_at").alias("last_known_at"))


TRANSITIONS = {("user", "assistant"), ("assistant", "user"), ("system", "user")}


@query("illegal_transitions", f"WITH t AS (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role FROM conversations) SELECT conv_id, turn, before, role FROM t WHERE before IS NOT NULL AND NOT ({' OR '.join(f"(before = '{a}' AND role = '{b}')" for a, b in sorted(TRANSITIONS))})")
def illegal_transitions(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = m.table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), "role").where("before is not null")
    legal = spark.createDataFrame(sorted(TRANSITIONS), "before string, role string")
    return rows.join(F.broadcast(legal), ["before", "role"], "left_anti").select("conv_id", "turn", "before", "role")
