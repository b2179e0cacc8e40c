"""Disclosures, names and merged events, from rules over orders, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosures as dc
from ..operators import events as evt
from ..operators.components import joined_groups
from ..sources import market as m
from .records import KEYED_SQL, keyed
from .registry import query

TITLES = (
    "日々の開示事項に関するお知らせ", "収益分配金に関するお知らせ", "自己株式の消却に関するお知らせ", "譲渡制限付株式報酬としての自己株式処分", "自己株式の取得状況に関するお知らせ",
    "公開買付けの開始に関するお知らせ", "配当予想の修正に関するお知らせ", "業績予想の修正に関するお知らせ", "業績予想及び配当の公表", "剰余金の配当に関するお知らせ",
    "2026年3月期 決算短信", "決算説明会資料", "特別利益の計上に関するお知らせ", "減損損失の計上に関するお知らせ", "工場の火災に関するお知らせ",
    "株式併合に関するお知らせ", "株式分割に関するお知らせ", "譲渡制限付株式報酬制度の導入", "新株予約権の発行に関するお知らせ", "第三者割当による増資",
    "公認会計士等の異動に関するお知らせ", "子会社の異動を伴う株式譲渡", "主要株主の異動に関するお知らせ", "代表取締役の異動に関するお知らせ", "資本業務提携に関するお知らせ",
    "特別調査委員会の設置に関するお知らせ", "訴訟の提起に関するお知らせ", "製造販売承認取得のお知らせ", "大型契約の締結に関するお知らせ", "資金の借入に関するお知らせ",
    "固定資産の譲渡に関するお知らせ", "上場維持基準への適合に向けた計画", "定時株主総会招集通知", "株主優待制度の変更", "月次売上高のお知らせ",
    "資本コストや株価を意識した経営", "その他のお知らせ", "", "   ", "配当予想の修正及び業績予想の修正",
)
FLAGS = "CASE WHEN o_orderkey % 7 = 0 THEN '（訂正）' WHEN o_orderkey % 11 = 0 THEN '(開示事項の経過)' ELSE '' END"
D_SQL = f"""d AS (SELECT o_orderkey AS id, 'tdnet:' || o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS published, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS security_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'PROVISIONAL' WHEN o_custkey % 3 = 1 THEN 'REGISTRY_ANCHORED' END AS mapping_confidence, {FLAGS} || ([{', '.join(f"'{t}'" for t in TITLES)}])[o_orderkey % {len(TITLES)} + 1] AS title FROM orders),
body AS (SELECT *, trim(regexp_replace(regexp_replace(title, '{dc.CORRECTION}', '', 'g'), '{dc.PROGRESS}', '', 'g')) AS body FROM d),
k AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(body, '{r}') THEN '{n}'" for n, r in dc.TITLE_RULES)} ELSE 'OTHER' END AS disclosure_type,
  CASE {' '.join(f"WHEN regexp_matches(body, '{r}') THEN regexp_extract(body, '{r}')" for n, r in dc.TITLE_RULES)} END AS matched_text,
  regexp_matches(title, '{dc.CORRECTION}') AS is_correction, regexp_matches(title, '{dc.PROGRESS}') AS is_progress FROM body),
t AS (SELECT *, disclosure_type IN {dc.ROUTINE!r} AS is_routine FROM k),
f AS (SELECT *, CASE WHEN is_routine THEN 0.1 WHEN is_correction OR is_progress THEN 0.3 ELSE 0.6 END::DOUBLE AS novelty, CASE WHEN disclosure_type = 'OTHER' THEN 0.5 ELSE 1.0 END::DOUBLE AS directness FROM t)"""


def disclosures(spark, d):
    o = m.table(spark, d, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (key % len(TITLES) + 1).cast("int"))
    flag = F.when(key % 7 == 0, "（訂正）").when(key % 11 == 0, "(開示事項の経過)").otherwise("")
    confidence = F.when(customer % 3 == 0, "PROVISIONAL").when(customer % 3 == 1, "REGISTRY_ANCHORED")
    rows = o.select(key.alias("id"), F.concat(F.lit("tdnet:"), key.cast("string")).alias("event_id"), F.to_date("o_orderdate").alias("published"), F.when(customer % 5 != 0, customer).alias("security_id"), confidence.alias("mapping_confidence"), F.concat(flag, title).alias("title"))
    return dc.with_title_features(dc.with_title_kind(rows))


@query("disclosure_types", f"WITH {D_SQL} SELECT id, disclosure_type, matched_text, is_correction, is_progress, is_routine FROM f")
def disclosure_types(spark, d):
    return disclosures(spark, d).select("id", "disclosure_type", "matched_text", "is_correction", "is_progress", "is_routine")


KINDS = (*[k for k, _ in dc.TITLE_RULES], "OTHER")


@query(
    "disclosure_summary",
    f"""WITH {D_SQL}, names AS (SELECT unnest([{', '.join(f"'{k}'" for k in KINDS)}]) AS name), c AS (SELECT disclosure_type AS name, count(*) AS n FROM f GROUP BY 1)
    SELECT name, coalesce(n, 0) AS n FROM names LEFT JOIN c USING (name) UNION ALL SELECT '_corrections', count(*) FILTER (WHERE is_correction) FROM f UNION ALL SELECT '_progress_updates', count(*) FILTER (WHERE is_progress) FROM f UNION ALL SELECT '_routine', count(*) FILTER (WHERE is_routine) FROM f""",
)
def disclosure_summary(spark, d):
    """Counts of every kind, zero ones too, and of the flags, in one pass."""
    flags = {"_corrections": "is_correction", "_progress_updates": "is_progress", "_routine": "is_routine"}
    one = disclosures(spark, d).agg(*[F.count_if(F.col("disclosure_type") == k).alias(k) for k in KINDS], *[F.count_if(F.col(c)).alias(n) for n, c in flags.items()])
    return one.unpivot([], [*KINDS, *flags], "name", "n")


@query("disclosure_features", f"WITH {D_SQL} SELECT event_id, security_id, novelty, directness, NULL::DOUBLE AS surprise, NULL::DOUBLE AS magnitude, NULL::DOUBLE AS persistence, NULL::DOUBLE AS market_reaction, NULL::DOUBLE AS priced_in FROM f WHERE security_id IS NOT NULL")
def disclosure_features(spark, d):
    return disclosures(spark, d).where("security_id is not null").select("event_id", "security_id", "novelty", "directness", *dc.UNMEASURED)


@query("disclosure_relations", f"WITH {D_SQL} SELECT event_id, security_id, 'DIRECT_COMPANY' AS relation_type, coalesce(mapping_confidence, 'PROVISIONAL') AS confidence, disclosure_type FROM f WHERE security_id IS NOT NULL")
def disclosure_relations(spark, d):
    return dc.relations(disclosures(spark, d))


@query("disclosure_evaluations", f"WITH {D_SQL} SELECT security_id, count(*) AS events, count(*) FILTER (WHERE is_routine) AS routine, max(novelty) AS novelty, max(directness) AS directness, min(event_id) AS first_event, max(event_id) AS last_event FROM f WHERE security_id IS NOT NULL GROUP BY security_id")
def disclosure_evaluations(spark, d):
    return dc.evaluations(disclosures(spark, d))


NAMES = (
    "Common Stock", "Common Shares", "Ordinary Shares", "Class A Ordinary Shares", "Warrant", "Rights", "Units", "Depositary Shares", "American Depositary Shares", "ADS", "ADS-TEC Holding Common Stock",
    "Depositary Shares each representing one common share", "5.5% Preferred Stock", "Pfd Series B", "Preferred ADS", "Closed-End Fund", "Real Estate Investment Trust", "ETNs linked to an index",
    "6% Notes due 2030", "Senior Notes", "Common Units", "Trust Certificates", "New York Registry Shares", "Global Depository Receipts", "Subordinated Debentures",
)
NAMED_SQL = f"""n AS (SELECT s_suppkey AS symbol, s_name || ' - ' || ([{', '.join(f"'{t}'" for t in NAMES)}])[s_suppkey % {len(NAMES)} + 1] AS name, CASE WHEN s_suppkey % 17 = 0 THEN 'Y' WHEN s_suppkey % 3 = 0 THEN 'N' END AS etf_flag FROM supplier), l AS (SELECT *, ' ' || lower(name) || ' ' AS low FROM n),
y AS (SELECT *, CASE WHEN etf_flag = 'Y' THEN 'ETF' {' '.join(f"WHEN regexp_matches(low, '{r}') THEN '{k}'" for k, r in dc.NAME_RULES)} ELSE 'UNKNOWN' END AS security_type FROM l)"""


@query("security_name_types", f"WITH {NAMED_SQL} SELECT symbol, name, security_type, CASE WHEN security_type IN ('ETF', 'COMMON_STOCK') THEN false WHEN security_type = 'ADR' THEN true ELSE regexp_matches(low, '{dc.DEPOSITARY}|{dc.DEPOSITARY_TOKEN}') END AS is_adr FROM y")
def security_name_types(spark, d):
    key = F.col("s_suppkey")
    label = F.element_at(F.array(*[F.lit(t) for t in NAMES]), (key % len(NAMES) + 1).cast("int"))
    rows = m.table(spark, d, "supplier").select(key.alias("symbol"), F.concat("s_name", F.lit(" - "), label).alias("name"), F.when(key % 17 == 0, "Y").when(key % 3 == 0, "N").alias("etf_flag"))
    return rows.select("symbol", "name", dc.name_type(F.col("name"), F.coalesce("etf_flag", F.lit(""))).alias("t")).select("symbol", "name", "t.*")


SHARES = ("普通株式", "優先株式", "第1回社債型種類株式", "新株予約権証券", "優先出資証券", "優先出資")


@query(
    "special_shares",
    f"""WITH p AS (SELECT p_partkey, CAST(1000 + p_partkey % 9000 AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '5' ELSE '00' END AS code, p_name || ([{', '.join(f"'{t}'" for t in SHARES)}])[p_partkey % {len(SHARES)} + 1] AS name FROM part)
    SELECT p_partkey, code, CASE {' '.join(f"WHEN contains(name, '{w}') THEN '{k}'" for w, k in dc.SPECIAL_SHARES)} WHEN length(code) > 4 AND replace(substr(code, 5), '0', '') <> '' THEN 'UNKNOWN' END AS security_type,
    CASE {' '.join(f"WHEN contains(name, '{w}') THEN 'name contains {w}'" for w, k in dc.SPECIAL_SHARES)} WHEN length(code) > 4 AND replace(substr(code, 5), '0', '') <> '' THEN 'code ' || code || ' is not an ordinary share code' END AS evidence FROM p""",
)
def special_shares(spark, d):
    key = F.col("p_partkey")
    code = F.concat((1000 + key % 9000).cast("string"), F.when(key % 4 == 0, "").when(key % 4 == 1, "0").when(key % 4 == 2, "5").otherwise("00"))
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(t) for t in SHARES]), (key % len(SHARES) + 1).cast("int")))
    rows = m.table(spark, d, "part").select(key, code.alias("code"), name.alias("name"))
    return rows.select("p_partkey", "code", dc.special_share(F.col("code"), F.col("name")).alias("s")).select("p_partkey", "code", "s.security_type", "s.evidence")


# A document refers to one of an earlier number; groups by key that a reference joins are one event.
GROUPS_SQL = f"""{KEYED_SQL}, ref AS (SELECT a.event_key AS a, b.event_key AS b FROM k a JOIN k b ON a.document_id % 40 = 0 AND b.document_id = a.document_id - 37 WHERE a.event_key <> b.event_key),
l AS (SELECT a, b FROM ref UNION SELECT b, a FROM ref)"""
MERGED_SQL = f"""{GROUPS_SQL}, reach AS (SELECT a AS key, b FROM l UNION SELECT reach.key, l.b FROM reach JOIN l ON reach.b = l.a), root AS (SELECT key, least(key, min(b)) AS root FROM reach GROUP BY key),
g AS (SELECT document_id, source_key, available_at, coalesce(root, event_key) AS event_key FROM k LEFT JOIN root ON key = event_key)"""


def merged(spark, d):
    """Documents with the key of their event: groups of equal key, joined wherever a document refers to another."""
    rows = keyed(spark, d)
    told = rows.where("document_id % 40 = 0").select(F.col("event_key").alias("a"), (F.col("document_id") - 37).alias("document_id"))
    links = told.join(rows.select("document_id", F.col("event_key").alias("b")), "document_id").select("a", "b")
    roots = joined_groups(links).select(F.col("key").alias("event_key"), "root")
    return rows.join(roots, "event_key", "left").withColumn("event_key", F.coalesce("root", "event_key")).drop("root")


ROLE = "CASE WHEN row_number() OVER (PARTITION BY event_key ORDER BY available_at, document_id) = 1 THEN 'DISCOVERY' WHEN row_number() OVER (PARTITION BY event_key, source_key ORDER BY available_at, document_id) = 1 THEN 'VERIFICATION' ELSE 'CORROBORATION' END"


@query("event_groups", f"WITH RECURSIVE {MERGED_SQL}, r AS (SELECT *, {ROLE} AS role FROM g) SELECT event_key, count(*) AS documents, count(DISTINCT source_key) AS publishers, count(DISTINCT source_key) FILTER (WHERE role <> 'CORROBORATION') AS independent, min(available_at) AS first_known_at, arg_min(document_id, (available_at, document_id)) AS headline FROM r GROUP BY event_key")
def event_groups(spark, d):
    rows = evt.source_roles(merged(spark, d))
    return rows.groupBy("event_key").agg(F.count("*").alias("documents"), F.count_distinct("source_key").alias("publishers"), F.count_distinct(F.when(F.col("role") != "CORROBORATION", F.col("source_key"))).alias("independent"), F.min("available_at").alias("first_known_at"), F.min_by("document_id", F.struct("available_at", "document_id")).alias("headline"))


@query("event_group_roles", f"WITH RECURSIVE {MERGED_SQL} SELECT document_id, event_key, source_key, {ROLE} AS role FROM g")
def event_group_roles(spark, d):
    return evt.source_roles(merged(spark, d)).select("document_id", "event_key", "source_key", "role")
