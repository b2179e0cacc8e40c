"""Rules by their definition and sources by their format: the universe, analyses, feeds, mappings, codes and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import decisions as de
from ..operators import evaluation as ev
from ..operators import universe as un
from ..sources import commits, files
from ..sources import market as m
from ..sources import records
from ..sources.scratch import scratch_dir
from .registry import q, query, sq

SEGMENTS = ("PRIME_DOMESTIC", "STANDARD_DOMESTIC", "GROWTH_DOMESTIC", "PRIME_FOREIGN", "PRO_MARKET", "UNKNOWN", "OTHER_BOARD")
KINDS = ("COMMON_STOCK", "COMMON_STOCK", "COMMON_STOCK", "ETF", "ETN", "REIT_OR_FUND", "INVESTMENT_CERTIFICATE", "PREFERRED", "WARRANT", "OTHER", "FOREIGN_COMMON_STOCK", "UNKNOWN", "ADR", "UNIT", "RIGHT")
EXCHANGES = ("XNYS", "XNAS", "XASE", "OTCM", "ARCX", "XXXX")


def pick(values: tuple, k):
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


def pick_sql(values: tuple, k: str) -> str:
    return f"({list(values)!r})[{k} % {len(values)} + 1]"


# Parts stand for securities: their key deals out markets, segments, types and exchanges.
_K = "p_partkey"
_ROWS_SQL = f"""r AS (SELECT {_K} AS k, CASE {_K} % 5 WHEN 0 THEN NULL WHEN 1 THEN 'JP' WHEN 2 THEN 'JP' ELSE 'US' END AS market_code, {_K} % 97 = 3 AS test, {_K} % 89 = 4 AS delisted, CASE WHEN {_K} % 83 <> 5 THEN {pick_sql(SEGMENTS, f'({_K} // 5)')} END AS seg, {pick_sql(KINDS, f'({_K} // 7)')} AS kind, CASE WHEN {_K} % 79 <> 6 THEN {pick_sql(EXCHANGES, f'({_K} // 3)')} END AS ex,
  CASE WHEN {_K} % 13 <> 0 THEN 'c' || {_K} END AS cik, {_K} % 13 <> 0 AND {_K} % 31 = 0 AS spac, {_K} % 13 <> 0 AND {_K} % 37 = 0 AS reit, {_K} % 41 = 0 AS adr FROM part)"""
_TARGET, _FOREIGN = "seg IN ('PRIME_DOMESTIC', 'STANDARD_DOMESTIC', 'GROWTH_DOMESTIC')", "seg LIKE '%FOREIGN'"


@query(
    "universe_definition",
    f"""WITH {_ROWS_SQL}, d AS (SELECT k, CASE WHEN test THEN 'EXCLUDED:TEST_ISSUE' WHEN delisted THEN 'EXCLUDED:DELISTED' WHEN market_code IS NULL THEN 'UNRESOLVED:PROVIDER_DATA_MISSING'
      WHEN market_code = 'JP' THEN CASE WHEN seg = 'PRO_MARKET' THEN 'EXCLUDED:NOT_TARGET_SEGMENT' WHEN kind IN ('ETF', 'ETN', 'REIT_OR_FUND') THEN 'EXCLUDED:' || kind WHEN kind = 'INVESTMENT_CERTIFICATE' THEN 'UNRESOLVED:INVESTMENT_CERTIFICATE_RULE_PENDING' WHEN kind IN ('PREFERRED', 'WARRANT') THEN 'EXCLUDED:' || kind WHEN kind = 'OTHER' THEN 'EXCLUDED:NOT_COMMON_STOCK'
        WHEN kind = 'FOREIGN_COMMON_STOCK' OR {_FOREIGN} THEN 'UNRESOLVED:FOREIGN_STOCK_RULE_PENDING' WHEN kind = 'UNKNOWN' OR seg = 'UNKNOWN' THEN 'UNRESOLVED:TYPE_UNKNOWN' WHEN {_TARGET} AND kind = 'COMMON_STOCK' THEN 'INCLUDED:TARGET_MARKET_COMMON_STOCK' WHEN seg IS NULL OR NOT {_TARGET} THEN 'UNRESOLVED:SEGMENT_RULE_PENDING' ELSE 'EXCLUDED:NOT_COMMON_STOCK' END
      WHEN ex IS NULL THEN 'UNRESOLVED:PROVIDER_DATA_MISSING' WHEN ex = 'OTCM' THEN 'EXCLUDED:OTC' WHEN ex NOT IN ('XNYS', 'XNAS', 'XASE') THEN 'EXCLUDED:NOT_TARGET_EXCHANGE' WHEN kind = 'OTHER' THEN 'EXCLUDED:NOT_COMMON_STOCK' WHEN kind IN ('ETF', 'ETN', 'REIT_OR_FUND', 'PREFERRED', 'WARRANT', 'RIGHT', 'UNIT') THEN 'EXCLUDED:' || kind
      WHEN spac THEN 'EXCLUDED:SPAC_PRE_MERGER' WHEN reit THEN 'EXCLUDED:REIT_OR_FUND' WHEN kind = 'ADR' OR adr THEN 'UNRESOLVED:ADR_ELIGIBILITY_UNDEFINED' WHEN kind = 'UNKNOWN' THEN 'UNRESOLVED:TYPE_UNKNOWN' WHEN kind = 'COMMON_STOCK' AND cik IS NULL THEN 'UNRESOLVED:REIT_DETECTION_INCOMPLETE' WHEN kind = 'COMMON_STOCK' THEN 'INCLUDED:TARGET_MARKET_COMMON_STOCK' ELSE 'EXCLUDED:NOT_COMMON_STOCK' END AS x FROM r)
    SELECT k AS p_partkey, split_part(x, ':', 1) AS decision, split_part(x, ':', 2) AS reason FROM d""",
)
def universe_definition(spark, d):
    """The definition's rules for both markets, with shells and funds told by lists of a registry."""
    k = F.col("p_partkey")
    parts = m.table(spark, d, "part").select(k)
    rows = parts.select(
        k, pick((None, "JP", "JP", "US", "US"), k).alias("market_code"), (k % 97 == 3).alias("is_test_issue"), F.when(k % 89 == 4, "DELISTED").otherwise("LISTED").alias("listing_status"), F.when(k % 83 != 5, pick(SEGMENTS, F.floor(k / 5))).alias("segment"), pick(KINDS, F.floor(k / 7)).alias("security_type"),
        F.when(k % 79 != 6, pick(EXCHANGES, F.floor(k / 3))).alias("exchange_id"), F.when(k % 13 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("cik"), (k % 41 == 0).alias("is_adr"),
    )
    listed = lambda n: parts.where(k % n == 0).select(F.concat(F.lit("c"), k.cast("string")).alias("cik"))
    return un.classify(rows, listed(31), listed(37)).select("p_partkey", "decision", "reason")


#: Documents of one page of a feed: some 200 kB.
FEED_PAGE = 500
PHRASES = ("volume confirms the base", "enter now at market", "should return to its prior high", "", "a measured advance", "support held twice")


@query(
    "analysis_validation",
    f"""WITH a AS (SELECT o_orderkey AS k, {pick_sql(PHRASES, 'o_orderkey')} AS rationale, CASE WHEN o_orderkey % 5 = 0 THEN 'REJECT' ELSE 'WATCH' END AS state, CASE WHEN o_orderkey % 4 <> 0 THEN 100.0 + o_orderkey % 30 END AS high, CASE WHEN o_orderkey % 3 <> 0 THEN 95.0 + o_orderkey % 23 END AS low, o_orderkey % 7 AS basis, CASE WHEN o_orderkey % 11 <> 0 THEN 104.0 END AS close, o_orderkey % 6 = 0 AS weak, o_orderkey % 8 = 1 AS missing FROM orders),
    e AS (SELECT *, concat_ws(',', CASE WHEN rationale = '' THEN 'NO_RATIONALE' END, CASE WHEN contains(rationale, 'enter now') THEN 'READS_AS_ENTRY' END, CASE WHEN contains(rationale, 'prior high') THEN 'PRIOR_HIGH_AS_UPSIDE' END, CASE WHEN high IS NOT NULL AND basis = 0 THEN 'ZONE_WITHOUT_BASIS_KIND' END, CASE WHEN high IS NOT NULL AND basis = 1 THEN 'UNKNOWN_BASIS_KIND' END, CASE WHEN high IS NOT NULL AND basis = 2 THEN 'ZONE_WITHOUT_BASIS' END, CASE WHEN high < low THEN 'ZONE_INVERTED' END, CASE WHEN high = 120 THEN 'ZONE_IS_THRESHOLD' END) AS errors,
      concat_ws(',', CASE WHEN high < close THEN 'ZONE_BELOW_CLOSE' END, CASE WHEN high > 110 AND close < 110 AND NOT weak THEN 'ZONE_THROUGH_OBSTACLE' END, CASE WHEN missing THEN 'MISSING_SECTION:materials' END) AS warnings, state = 'REJECT' AND (high IS NOT NULL OR low IS NOT NULL) AS dropped FROM a)
    SELECT k AS o_orderkey, errors, warnings, CASE WHEN dropped THEN 'ZONE_DROPPED' ELSE '' END AS repairs, CASE WHEN errors <> '' THEN 'REJECTED' WHEN dropped THEN 'REPAIRED' ELSE 'PASSED' END AS status, CASE WHEN NOT dropped THEN high END::DOUBLE AS zone_high, CASE WHEN NOT dropped THEN low END::DOUBLE AS zone_low FROM e""",
)
def analysis_validation(spark, d):
    """Errors, warnings and repairs of an analysis for every order; the zone as it is after the repair."""
    k = F.col("o_orderkey")
    kinds = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("PRIOR_HIGH"))).otherwise(F.array(F.lit("SUPPORT_RESISTANCE"), F.lit("SECTOR_MOVE")))
    obstacles = F.array(F.struct(F.lit(110.0).alias("price_level"), F.when(k % 6 == 0, "broken on volume").alias("weakening_evidence")))
    rows = m.table(spark, d, "orders").select(
        k, F.when(k % 5 == 0, "REJECT").otherwise("WATCH").alias("state"), pick(PHRASES, k).alias("rationale"), F.when(k % 4 != 0, 100.0 + k % 30).alias("zone_high"), F.when(k % 3 != 0, 95.0 + k % 23).alias("zone_low"), kinds.alias("basis_kinds"), F.when(k % 7 != 2, "levels").alias("basis"),
        F.when(k % 11 != 0, 104.0).alias("close"), F.lit(120.0).alias("threshold_price"), obstacles.alias("obstacles"), F.when(k % 8 == 1, F.array(F.lit("materials"))).alias("missing_sections"),
    )
    joined = lambda n: F.array_join(n, ",").alias(n)
    return de.validate_analysis(rows).select("o_orderkey", joined("errors"), joined("warnings"), joined("repairs"), "status", "zone_high", "zone_low")


@query(
    "feed_documents",
    """WITH f AS (SELECT doc_id, doc_id % 24 AS g, coalesce(lang, '') || ' & ' || coalesce(source, '') || ' <' || coalesce(CAST(n_chars AS VARCHAR), '') || '>' AS title FROM documents WHERE doc_id IS NOT NULL)
    SELECT g AS file, 'd' || doc_id AS id, title, CASE WHEN doc_id % 5 <> 0 OR g % 3 = 1 THEN 'http://x/' || doc_id || '?a=1&b=2' END AS url, CASE WHEN doc_id % 7 <> 0 THEN '<b>' || title || '</b>' END AS summary, CASE g % 3 WHEN 0 THEN 'Mon, 05 Jan 2026 10:00:00 +0900' WHEN 1 THEN '2026-01-05' ELSE '2026-01-05T01:02:03Z' END AS published FROM f WHERE g NOT IN (5, 7, 11)""",
)
def feed_documents(spark, d):
    """Feeds of three kinds, by 24ths of the documents; a document type, text cut off and another root refuse theirs.

    A feed comes in pages of FEED_PAGE ids, each a document of its own: so none nears the cap on a file, however many documents there are.
    """
    k, g = F.col("doc_id"), F.col("doc_id") % 24
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    title = F.concat(part("lang"), F.lit(" & "), part("source"), F.lit(" <"), part("n_chars"), F.lit(">"))
    id_, url = F.concat(F.lit("d"), k.cast("string")), F.concat(F.lit("http://x/"), k.cast("string"), F.lit("?a=1&b=2"))
    tag = lambda name, x, attr="": F.concat(F.lit(f"<{name}{attr}>"), x, F.lit(f"</{name}>"))
    some = lambda test, x: F.when(test, x).otherwise("")
    cdata = F.concat(F.lit("<![CDATA[<b>"), title, F.lit("</b>]]>"))
    rss = F.concat(F.lit("<item>"), tag("title", esc(title)), tag("media:title", F.lit("other")), some(k % 5 != 0, tag("link", esc(url))), tag("guid", id_, ' isPermaLink="false"'), tag("pubDate", F.lit("Mon, 05 Jan 2026 10:00:00 +0900")), some(k % 7 != 0, tag("description", cdata)), F.lit("</item>"))
    rdf = F.concat(F.lit('<item rdf:about="'), id_, F.lit('">'), tag("title", esc(title)), tag("link", esc(url)), tag("dc:date", F.lit("2026-01-05")), some(k % 7 != 0, tag("content:encoded", cdata)), F.lit("</item>"))
    links = F.concat(F.lit('<link rel="self" href="no"/>'), F.lit('<link href="'), esc(url), F.lit('"/>'))
    atom = F.concat(F.lit("<entry>"), tag("id", id_), tag("title", esc(title), ' type="html"'), some(k % 5 != 0, links), tag("updated", F.lit("2026-02-01T00:00:00Z")), tag("published", F.lit("2026-01-05T01:02:03Z")), some(k % 7 != 0, tag("content", cdata, ' type="html"')), F.lit("</entry>"))
    each = F.when(g % 3 == 0, rss).when(g % 3 == 1, rdf).otherwise(atom)
    body = m.table(spark, d, "documents").where("doc_id is not null").select(g.alias("g"), F.floor(k / (24 * FEED_PAGE)).alias("page"), each.alias("x")).groupBy("g", "page").agg(F.array_join(F.collect_list("x"), "\n").alias("b"))
    head = F.when(F.col("g") % 3 == 0, F.lit('<?xml version="1.0"?>\n<!-- a feed --><rss version="2.0" xmlns:media="m"><channel><title>c</title>')).when(F.col("g") % 3 == 1, F.lit('<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d" xmlns:content="c">')).otherwise(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'))
    foot = F.when(F.col("g") % 3 == 0, F.lit("</channel></rss>")).when(F.col("g") % 3 == 1, F.lit("</rdf:RDF>")).otherwise(F.lit("</feed>"))
    whole = F.concat(head, "b", foot)
    text = F.when(F.col("g") == 5, F.concat(F.lit("<!DOCTYPE feed>"), whole)).when(F.col("g") == 7, F.substring(whole, 1, 1 << 20).substr(F.lit(1), F.length(whole) - 9)).when(F.col("g") == 11, F.concat(F.lit("<html>"), whole, F.lit("</html>"))).otherwise(whole)
    items, _ = records.parsed_feeds(body.select(F.col("g").alias("file"), text.alias("value")))
    return items


@query("id_mapping", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'ERROR' WHEN p_partkey % 4 = 0 THEN 'UNMAPPED' WHEN p_partkey % 4 = 1 THEN 'EXACT' ELSE 'AMBIGUOUS' END AS outcome FROM part")
def id_mapping(spark, d):
    """How a mapping response reads: an error, nothing, one, or several."""
    k = F.col("p_partkey")
    rows = m.table(spark, d, "part").select(k, F.when(k % 8 != 0, F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 4).cast("int"))).alias("data"), F.when(k % 6 == 5, "no such type").alias("error"))
    return rows.select(k, records.mapping_result("data", "error").alias("outcome"))


@query("code_lookup_keys", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '0,' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN c_custkey % 3 = 1 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') ELSE lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '5' END AS keys FROM customer")
def code_lookup_keys(spark, d):
    k = F.col("c_custkey")
    code = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 3 == 0, "0").when(k % 3 == 1, "").otherwise("5"))
    return m.table(spark, d, "customer").select(k, code.alias("code")).select(k, F.array_join(records.code_keys("code"), ",").alias("keys"))


@query(
    "published_times",
    "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END AS published_at, CASE event_id % 5 WHEN 4 THEN 'UNKNOWN' WHEN 0 THEN 'DATE' WHEN 1 THEN 'DATE' ELSE 'EXACT' END AS precision FROM events",
)
def published_times(spark, d):
    """Dates alone by two spellings, ISO instants, RFC 822 with an offset, and what can't be read."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    text = F.when(k % 5 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(ts, "yyyy/MM/dd")).when(k % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 5 == 3, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0900"))).otherwise("soon")
    rows = m.table(spark, d, "events").select(k, text.alias("text"))
    told = records.published("text")
    return rows.select(k, told["published_at"].cast("timestamp_ntz").alias("published_at"), told["precision"].alias("precision"))


@query(
    "prediction_terms",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 400 * 5 END AS close, CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS rate, o_orderkey % 24 AS rate_h, 15 AS end_h, o_orderkey % 7 + 13 AS cut_h, 18 AS dec_h FROM orders)
    SELECT o_orderkey, CAST(close * coalesce(rate, 1) AS DOUBLE) AS price_jpy, CASE WHEN close IS NULL THEN 'NO_CONFIRMED_CLOSE' WHEN cut_h < end_h OR cut_h > dec_h THEN 'CUTOFF_OUT_OF_ORDER' WHEN rate IS NOT NULL AND rate_h > end_h THEN 'RATE_AFTER_CLOSE' WHEN close * coalesce(rate, 1) > 3000 THEN 'ABOVE_LIMIT' END AS refusal FROM o""",
)
def prediction_terms(spark, d):
    """A confirmed close, a cutoff between the session's end and the decision, a rate known by then, and the limit."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("timestamp")
    at = lambda h: F.timestamp_add("HOUR", h if not isinstance(h, int) else F.lit(h), day)
    rate = k % 2 == 0
    rows = m.table(spark, d, "orders").select(k, F.when(k % 13 != 0, (k % 400 * 5).cast("double")).alias("close"), F.when(rate, 3.0).alias("rate"), F.when(rate, at((k % 24).cast("int"))).alias("rate_at"), at(15).alias("session_end"), at((k % 7 + 13).cast("int")).alias("cutoff"), at(18).alias("decided_at"))
    return de.prediction_terms(rows).select(k, F.col("price_jpy").cast("double").alias("price_jpy"), "refusal")


@query("calendar_page", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, 'Holiday ' || dayofyear(CAST(o_orderdate AS DATE)) AS name FROM orders WHERE dayofyear(CAST(o_orderdate AS DATE)) % 40 = 7")
def calendar_page(spark, d):
    """Closed days of HTML pages, a page a year, dates and names in cells of their own; what is no date is skipped."""
    path = scratch_dir(spark)
    day = F.to_date("o_orderdate")
    days = m.table(spark, d, "orders").select(day.alias("day")).distinct().where(F.dayofyear("day") % 40 == 7)
    row = F.concat(F.lit("<tr><td>"), F.date_format("day", "yyyy/MM/dd"), F.lit("</td><td class='x'><b>Holiday "), F.dayofyear("day").cast("string"), F.lit("</b></td></tr>"))
    pages = days.groupBy(F.year("day").alias("y")).agg(F.concat(F.lit("<html><table><tr><th>Date</th><th>Name</th></tr><tr><td>2026/13/01</td><td>None</td></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table></html>")).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.closed_days(spark, path)


@query(
    "committed_artifacts",
    """WITH c AS (SELECT c_custkey, c_custkey // 50 AS part, '{"key":' || c_custkey || ',"name":"' || c_name || '","nation":' || coalesce(CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS VARCHAR), 'null') || '}' || chr(10) AS line FROM customer),
    v AS (SELECT 1 AS version, * FROM c WHERE part % 2 = 0 UNION ALL SELECT 2, * FROM c WHERE part % 2 = 1)
    SELECT version, version - 1 AS parent, part, sum(octet_length(encode(line)))::BIGINT AS bytes, sha256(string_agg(line, '' ORDER BY c_custkey)) AS sha256, count(*) AS n FROM v GROUP BY version, part""",
)
def committed_artifacts(spark, d):
    """Customers as JSON lines, 50 keys a file, in two commits; the second writer first tries to build on a head that has moved."""
    log = scratch_dir(spark)
    key = F.col("c_custkey")
    rows = m.table(spark, d, "customer").select(F.floor(key / 50).alias("part"), key.alias("key"), F.col("c_name").alias("name"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("nation"))
    for name, odd in (("first", 0), ("second", 1)):
        commits.jsonl(rows.where(F.col("part") % 2 == odd), f"{log}/{name}", "part", "key")
    commits.commit(spark, log, "first", "2026-01-05", on=0)
    try:
        commits.commit(spark, log, "second", "2026-01-05", on=0)
        raise AssertionError("two writers made one commit")
    except commits.Conflict:
        pass
    # The loser has nothing recorded or described; it offers its files again, on whatever head there is.
    commits.commit(spark, log, "second", "2026-01-05")
    out = None
    for version in (1, 2):
        files, problems = commits.verified(spark, log, version)
        if not problems.isEmpty():
            raise ValueError(f"commit {version} is damaged")
        one = files.select(F.lit(version).alias("version"), F.regexp_extract("name", "part=([0-9]+)", 1).cast("long").alias("part"), "bytes", "sha256", (F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    told = commits.history(spark, log).select(F.col("version").cast("int").alias("version"), F.col("parent").cast("int").alias("parent"))
    return out.join(F.broadcast(told), "version").select("version", "parent", "part", "bytes", "sha256", "n")


@query(
    "session_windows",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 * 11000 AS INTEGER) AS day FROM orders), e AS (SELECT day, day + CASE WHEN day >= DATE '2024-11-05' THEN INTERVAL 930 MINUTE ELSE INTERVAL 900 MINUTE END - INTERVAL 9 HOUR AS session_end, day + CAST(CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS next FROM d)
    SELECT day, session_end, session_end + INTERVAL 40 MINUTE AS confirmed_at, next::TIMESTAMP AS send_by FROM e""",
)
def session_windows(spark, d):
    """When a day's bars are final, and until when something may be sent on them."""
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2 * 11000).cast("int"))
    rows = m.table(spark, d, "orders").select(day.alias("day")).distinct()
    return rows.select("day", *[x.cast("timestamp_ntz").alias(n) for n, x in tx.session_times("day").items()])


@query(
    "dataset_admission",
    """WITH j AS (SELECT o_orderkey, (['SUCCESS', 'FAILURE', 'AMBIGUOUS', 'UNCLEAR'])[o_orderkey % 4 + 1] AS label, (['CONFIRMED', 'UNREVIEWED', 'CORRECTED'])[o_orderkey % 3 + 1] AS review, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 10) / 10.0 END AS confidence, o_orderdate::TIMESTAMP AS seen_at, o_orderkey % 11 <> 0 AS resolved, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_orderdate::TIMESTAMP + INTERVAL 1 HOUR ELSE o_orderdate::TIMESTAMP END AS context_at, o_orderkey % 13 = 0 AS gap FROM orders)
    SELECT o_orderkey, label, CASE WHEN label = 'UNCLEAR' THEN 'LABEL_NOT_ADMITTED' WHEN review = 'UNREVIEWED' THEN 'REVIEW_STATUS' WHEN confidence IS NULL THEN 'NO_CONFIDENCE' WHEN confidence < 0.3 THEN 'LOW_CONFIDENCE' WHEN seen_at > TIMESTAMP '1997-06-30' THEN 'SEEN_AFTER_CUTOFF' WHEN NOT resolved THEN 'PATH_NOT_RESOLVED' WHEN context_at IS NULL THEN 'NO_CONTEXT' WHEN context_at > seen_at THEN 'CONTEXT_AFTER_JUDGEMENT' WHEN gap THEN 'LINEAGE_GAPS' END AS reason FROM j""",
)
def dataset_admission(spark, d):
    """The first reason that keeps each example out of a production set."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = m.table(spark, d, "orders").select(
        k, pick(("SUCCESS", "FAILURE", "AMBIGUOUS", "UNCLEAR"), k).alias("label"), pick(("CONFIRMED", "UNREVIEWED", "CORRECTED"), k).alias("review"), F.when(k % 7 != 0, (k % 10) / 10.0).alias("confidence"), at.alias("seen_at"), (k % 11 != 0).alias("resolved"),
        F.when(k % 5 == 1, F.timestamp_add("HOUR", F.lit(1), at)).when(k % 5 != 0, at).alias("context_at"), F.when(k % 13 == 0, F.array(F.lit("prices"))).alias("gaps"),
    )
    return ev.admitted(rows, ["SUCCESS", "FAILURE", "AMBIGUOUS"], ["CONFIRMED", "CORRECTED"], 0.3, "1997-06-30").select("o_orderkey", "label", "reason")


@query(
    "chart_history",
    f"""WITH {m.BARS_SQL}, b AS (SELECT symbol, trade_date, round(floor(open) / 2)::DOUBLE AS o, round(floor(close) / 2)::DOUBLE AS c, volume::BIGINT AS v FROM bars WHERE close IS NOT NULL AND symbol % 9 <> 2)
    SELECT 's' || symbol AS symbol, trade_date, CASE WHEN symbol % 4 = 0 AND trade_date < DATE '1996-01-01' THEN o * 2 ELSE o END AS open, CASE WHEN symbol % 4 = 0 AND trade_date < DATE '1996-01-01' THEN c * 2 ELSE c END AS close, CASE WHEN symbol % 4 = 0 AND trade_date < DATE '1996-01-01' THEN floor(v / 2.0 + 0.5) ELSE v END::DOUBLE AS volume,
      (CASE WHEN symbol % 4 = 0 AND trade_date < DATE '1996-01-01' THEN c * 2 ELSE c END) * (CASE WHEN symbol % 4 = 0 AND trade_date < DATE '1996-01-01' THEN floor(v / 2.0 + 0.5) ELSE v END)::DOUBLE AS turnover FROM b""",
)
def chart_history(spark, d):
    """Parallel-array charts, adjusted for a split on 1996-01-01 of every fourth symbol, back to bars as they traded; charts in dollars are refused."""
    path, s = scratch_dir(spark), F.col("symbol")
    bars = m.bars(spark, d).select("symbol", (F.unix_timestamp(F.col("trade_date").cast("timestamp")) + 3600).alias("at"), F.round(F.floor("open") / 2).cast("double").alias("open"), F.round(F.floor("close") / 2).cast("double").alias("close"), F.col("volume").cast("long").alias("volume"))
    split = F.create_map(F.lit("a"), F.struct(F.unix_timestamp(F.lit("1996-01-01").cast("timestamp")).alias("date"), F.lit(2.0).alias("numerator"), F.lit(1.0).alias("denominator")))
    x = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("at", "open", "close", "volume"))).alias("b"))
    quote = F.struct(*[F.col(f"b.{n}").alias(n) for n in ("open", "close", "volume")])
    doc = F.to_json(F.struct(F.struct(F.when(s % 9 == 2, "USD").otherwise("JPY").alias("currency"), F.concat(F.lit("s"), s.cast("string")).alias("symbol")).alias("meta"), F.col("b.at").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"), F.struct(F.when(s % 4 == 0, split).alias("splits")).alias("events")), {"ignoreNullFields": "false"})
    x.select(doc.alias("value")).write.text(path)
    out, _, _ = files.chart_history(spark, path)
    return out.select("symbol", "trade_date", "open", "close", "volume", "turnover")


@query(
    "bulk_bars",
    f"""WITH {m.BARS_SQL} SELECT 'S' || symbol AS code, trade_date, CASE WHEN symbol % 2 = 0 THEN 'X' END AS exchange, {sq('open')} AS open, CASE WHEN symbol % 13 <> 3 THEN {sq('high')} END AS high, {sq('close')} AS close, volume::DOUBLE AS volume FROM bars WHERE symbol % 17 <> 4""",
)
def bulk_bars(spark, d):
    """A bulk response for each day, half of its records under other names; a record without its code is refused, NA is no number."""
    s, text = F.col("symbol"), lambda n: F.col(n).cast("string")
    bars = m.bars(spark, d)
    one = F.struct(F.when(s % 17 != 4, F.concat(F.lit("S"), text("symbol"))).alias("code"), text("trade_date").alias("date"), F.lit("X").alias("exchange_short_name"), "open", F.when(s % 13 == 3, "NA").otherwise(text("high")).alias("high"), "low", "close", "volume")
    two = F.struct(F.when(s % 17 != 4, F.concat(F.lit("S"), text("symbol"))).alias("Code"), text("trade_date").alias("Date"), text("open").alias("Open"), F.when(s % 13 == 3, "").otherwise(text("high")).alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    record = F.when(s % 2 == 0, F.to_json(one)).otherwise(F.to_json(two))
    days = bars.groupBy(F.col("trade_date").cast("string").alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    rows, _ = records.bulk(days, records.BULK_BAR, ("code", "trade_date"))
    return rows.select("code", "trade_date", "exchange", *[q(F.col(n).cast("double"), n) for n in ("open", "high", "close")], F.col("volume").cast("double").alias("volume"))
