"""Episodes, material routes, chart readings, gates, ledgers and label views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as i
from ..functions.text import redacted
from ..operators import redaction as rd
from ..operators import episodes as ep
from ..operators import material as mt
from ..sources import market as m
from .outcomes import AS_OF, eligible
from .registry import q, query, sq
from .technical import CANDIDATES_SQL, feature_rows

SESSIONS_SQL = f"""{m.BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS k FROM bars WHERE close IS NOT NULL),
e AS (SELECT symbol * 1000 + k // 40 AS episode_id, symbol, k AS k0, close AS entry FROM n WHERE k % 40 = 0 AND close > 0),
s AS (SELECT e.episode_id, n.k - e.k0 AS idx, high / entry - 1 AS up, low / entry - 1 AS down,
  CASE WHEN open >= entry * 1.2::DOUBLE THEN 'TARGET_FIRST' WHEN open <= entry * 0.94::DOUBLE THEN 'FAILURE_FIRST' WHEN high >= entry * 1.2::DOUBLE AND low <= entry * 0.94::DOUBLE THEN 'AMBIGUOUS_PATH' WHEN high >= entry * 1.2::DOUBLE THEN 'TARGET_FIRST' WHEN low <= entry * 0.94::DOUBLE THEN 'FAILURE_FIRST' ELSE 'NOT_REACHED' END AS resolution
  FROM e JOIN n ON n.symbol = e.symbol AND n.k BETWEEN e.k0 AND e.k0 + 20),
inv AS (SELECT DISTINCT episode_id, CAST(episode_id % 7 AS INTEGER) AS at_idx FROM e WHERE episode_id % 3 = 0),
g AS (SELECT episode_id, count(*) AS observed, max(idx) AS last_idx, min(CASE WHEN resolution <> 'NOT_REACHED' THEN idx END) AS di, arg_min(resolution, idx) FILTER (WHERE resolution <> 'NOT_REACHED') AS dec, max(up) AS mfe, min(down) AS mae, max(CASE WHEN resolution = 'TARGET_FIRST' THEN idx END) AS last_hit FROM s GROUP BY episode_id),
h AS (SELECT *, di IS NOT NULL AND (at_idx IS NULL OR di <= at_idx) AS first, at_idx IS NOT NULL AND (last_idx > at_idx OR di IS NOT NULL) AS invalid FROM g LEFT JOIN inv USING (episode_id)),
r AS (SELECT *, CASE WHEN first THEN dec WHEN invalid THEN 'THESIS_INVALIDATED' WHEN observed > 20 THEN 'HORIZON_EXPIRED' END AS prim, CASE WHEN first THEN di WHEN invalid THEN at_idx WHEN observed > 20 THEN 20 END AS stop FROM h)"""


@query(
    "episode_evaluation",
    f"""WITH {SESSIONS_SQL} SELECT episode_id, prim AS "primary", CAST(stop AS BIGINT) AS stop_idx, CASE WHEN prim IS NULL THEN 'HORIZON_INCOMPLETE' END AS pending, CASE WHEN last_hit > stop THEN true WHEN observed > 20 THEN false END AS later_target_hit, {sq('mfe')} AS mfe, {sq('mae')} AS mae, observed FROM r""",
)
def episode_evaluation(spark, d):
    """An entry every 40 bars; a third of them are called off at a fixed session."""
    known = m.bars(spark, d).where("close is not null").withColumn("k", F.row_number().over(i.by_symbol()) - 1)
    # Sessions belong to the entry at the start of their block of 40; those beyond the horizon are left out.
    block = Window.partitionBy("symbol", F.floor(F.col("k") / 40))
    rows = known.withColumns({"entry": F.first("close").over(block.orderBy("k")), "idx": F.col("k") % 40, "episode_id": F.col("symbol") * 1000 + F.floor(F.col("k") / 40)}).where("idx <= 20 and entry > 0")
    target, failure = F.col("entry") * 1.2, F.col("entry") * 0.94
    up, down = F.col("high") >= target, F.col("low") <= failure
    day = F.when(F.col("open") >= target, "TARGET_FIRST").when(F.col("open") <= failure, "FAILURE_FIRST").when(up & down, "AMBIGUOUS_PATH").when(up, "TARGET_FIRST").when(down, "FAILURE_FIRST").otherwise("NOT_REACHED")
    sessions = rows.select("episode_id", "idx", day.alias("resolution"), (F.col("high") / F.col("entry") - 1).alias("up"), (F.col("low") / F.col("entry") - 1).alias("down"))
    called_off = sessions.where("episode_id % 3 = 0").select("episode_id", (F.col("episode_id") % 7).cast("int").alias("at_idx")).distinct()
    return ep.evaluate(sessions, called_off).withColumns({"mfe": q("mfe"), "mae": q("mae")})


REL_SQL = """rel AS (SELECT event_id, user_id AS security_id, CASE event_id % 8 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'SUBSIDIARY' WHEN 2 THEN 'CUSTOMER' WHEN 3 THEN 'SUPPLIER' WHEN 4 THEN 'COMPETITOR' WHEN 5 THEN 'SECTOR' ELSE 'WEAK_ASSOCIATION' END AS relation, event_id % 16 < 8 AS causal,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 11 / 10.0::DOUBLE END AS novelty, CASE WHEN event_id % 7 <> 0 THEN event_id % 13 / 12.0::DOUBLE END AS magnitude, event_id % 17 / 16.0::DOUBLE AS surprise, CASE WHEN event_id % 3 <> 0 THEN event_id % 19 / 18.0::DOUBLE END AS priced_in FROM events)"""
_M = {k: (" OR ".join(f"relation = '{a}'" for a in v[0]), f"{v[1]} {'<= 0.3' if v[2] is None else f'>= {v[2]}'}", k in mt.CAUSAL) for k, v in mt.ROUTES.items()}
_MROUTES = f"concat_ws(',', {', '.join(f"CASE WHEN ({a}) AND {b}{' AND causal' if c else ''} THEN '{k}' END" for k, (a, b, c) in _M.items())})"


def related(spark, d):
    e = m.table(spark, d, "events")
    k = F.col("event_id")
    part = lambda n, by, skip: F.when(k % skip != 0, k % n / float(by)) if skip else k % n / float(by)
    relation = F.coalesce(*[F.when(k % 8 == j, F.lit(r)) for j, r in enumerate(mt.RELATIONS[:6])], F.lit("WEAK_ASSOCIATION"))
    rows = e.select("event_id", F.col("user_id").alias("security_id"), relation.alias("relation"), F.when(k % 16 < 8, "path").alias("causal_path"), part(11, 10, 5).alias("novelty"), part(13, 12, 7).alias("magnitude"), part(17, 16, 0).alias("surprise"), part(19, 18, 3).alias("priced_in"))
    features = rows.select("event_id", "security_id", "novelty", "magnitude", "surprise", "priced_in")
    return mt.routes(mt.relations_per_event(rows).join(features, ["event_id", "security_id"]))


@query("material_routes", f"WITH {REL_SQL} SELECT event_id, security_id, {_MROUTES} AS routes, relation AS strongest FROM rel WHERE relation <> 'WEAK_ASSOCIATION'")
def material_routes(spark, d):
    return related(spark, d).select("event_id", "security_id", F.array_join("routes", ",").alias("routes"), "strongest")


@query("material_candidates", f"WITH {REL_SQL}, k AS (SELECT security_id, relation, {_MROUTES} AS routes FROM rel WHERE relation <> 'WEAK_ASSOCIATION'), u AS (SELECT security_id, string_agg(DISTINCT r, ',' ORDER BY r) AS routes FROM (SELECT security_id, unnest(string_split(routes, ',')) AS r FROM k WHERE routes <> '') GROUP BY 1) SELECT k.security_id, coalesce(any_value(u.routes), '') AS routes, arg_min(relation, CASE relation {' '.join(f"WHEN '{r}' THEN {n}" for n, r in enumerate(mt.RELATIONS))} END) AS strongest, count(*) AS events FROM k LEFT JOIN u ON u.security_id = k.security_id GROUP BY k.security_id")
def material_candidates(spark, d):
    return mt.candidates(related(spark, d)).withColumn("routes", F.array_join("routes", ","))


@query("relevance", f"WITH {REL_SQL}, k AS (SELECT security_id, count(DISTINCT relation) AS n, bool_or(relation = 'DIRECT') AS p, max(novelty) AS dd FROM rel GROUP BY 1) SELECT security_id, CASE WHEN p AND n >= 2 THEN 'CONFIRMED' WHEN p THEN 'PRIMARY_ONLY' WHEN n >= 3 THEN 'CORROBORATED' WHEN dd IS NULL THEN 'UNMEASURED' WHEN dd >= 0.5 THEN 'REVIEW' ELSE 'BACKGROUND' END AS relevance FROM k")
def relevance(spark, d):
    e = m.table(spark, d, "events")
    k = F.col("event_id") % 8
    per = e.groupBy(F.col("user_id").alias("security_id")).agg(F.count_distinct(F.least(k, F.lit(6))).alias("n"), F.bool_or(k == 0).alias("p"), F.max(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 11 / 10.0)).alias("dd"))
    return per.select("security_id", mt.relevance(F.col("n"), F.col("p"), F.col("dd")).alias("relevance"))


@query("universe_gate", f"WITH {CANDIDATES_SQL}, c AS (SELECT symbol, max(trade_date) AS day FROM candidates WHERE codes <> '' AND trade_date <= DATE '{AS_OF}' GROUP BY 1), l AS (SELECT symbol, max(trade_date) AS priced FROM bars WHERE close IS NOT NULL AND trade_date <= DATE '{AS_OF}' GROUP BY 1) SELECT c.symbol, c.day, CASE WHEN l.symbol IS NULL THEN 'NOT_IN_UNIVERSE' WHEN DATE '{AS_OF}' - priced > 5 THEN 'STALE' ELSE 'PROMOTED' END AS gate FROM c LEFT JOIN l ON l.symbol = c.symbol")
def universe_gate(spark, d):
    """A candidate is promoted only if the universe of the day holds it with a fresh price."""
    from ..operators import features as ft

    found = ft.evaluate_routes(feature_rows(spark, d)).where((F.size("routes") > 0) & (F.col("trade_date") <= F.lit(AS_OF).cast("date"))).groupBy("symbol").agg(F.max("trade_date").alias("day"))
    universe = eligible(spark, d).where("price_date is not null").select("symbol", "price_date")
    gate = F.when(F.col("price_date").isNull(), "NOT_IN_UNIVERSE").when(F.datediff(F.lit(AS_OF).cast("date"), "price_date") > 5, "STALE").otherwise("PROMOTED")
    return found.join(universe, "symbol", "left").select("symbol", "day", gate.alias("gate"))


@query(
    "volume_trend",
    f"""WITH {m.BARS_SQL}, k AS (SELECT symbol, trade_date, volume, coalesce(close > lag(close) OVER o, false) AS up FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
    w AS (SELECT symbol, trade_date, count(*) OVER f20 AS n, avg(volume) OVER f5 AS v5, avg(volume) OVER p5 AS v5b, sum(CASE WHEN up THEN volume ELSE 0 END) OVER f20 AS upv, sum(volume) OVER f20 AS v FROM k
      WINDOW f5 AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), p5 AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), f20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING))
    SELECT symbol, trade_date, {sq('CASE WHEN n = 20 THEN v5 / nullif(v5b, 0) END')} AS volume_trend, {sq('CASE WHEN n = 20 THEN upv / nullif(v, 0) END')} AS up_volume_ratio FROM w""",
)
def volume_trend(spark, d):
    rows = m.bars(spark, d).withColumn("up", F.coalesce(F.col("close") > F.lag("close").over(i.by_symbol()), F.lit(False)))
    full = F.count(F.lit(1)).over(i.tail(20)) == 20
    trend = F.try_divide(F.avg("volume").over(i.tail(5)), F.nullif(F.avg("volume").over(i.tail(5, 5)), F.lit(0.0)))
    up = F.try_divide(F.sum(F.when(F.col("up"), F.col("volume")).otherwise(0)).over(i.tail(20)), F.nullif(F.sum("volume").over(i.tail(20)), F.lit(0.0)))
    return rows.select("symbol", "trade_date", q(F.when(full, trend), "volume_trend"), q(F.when(full, up), "up_volume_ratio"))


@query(
    "exhaustion",
    f"""WITH {m.BARS_SQL}, k AS (SELECT symbol, trade_date, volume, row_number() OVER o AS seq, coalesce(close < lag(close) OVER o, false) AS down FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY trade_date)),
    r AS (SELECT *, max(CASE WHEN NOT down THEN seq ELSE 0 END) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS start FROM k),
    f AS (SELECT *, first_value(volume) OVER (PARTITION BY symbol, start ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS at_start, nth_value(volume, 2) OVER (PARTITION BY symbol, start ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM r)
    SELECT symbol, trade_date, seq - start AS run, {sq('volume / nullif(CASE WHEN start = 0 THEN at_start ELSE second END, 0)')} AS volume_decay FROM f WHERE seq - start >= 3""",
)
def exhaustion(spark, d):
    """Runs of falling closes: length so far, and volume against the run's first bar."""
    w = i.by_symbol()
    rows = m.bars(spark, d).withColumns({"seq": F.row_number().over(w).cast("long"), "down": F.coalesce(F.col("close") < F.lag("close").over(w), F.lit(False))})
    rows = rows.withColumn("start", F.coalesce(F.max(F.when(~F.col("down"), F.col("seq"))).over(i.upto()), F.lit(0)))
    rows = rows.withColumn("first_volume", F.first(F.when(F.col("seq") == F.col("start") + 1, F.col("volume")), ignorenulls=True).over(Window.partitionBy("symbol", "start").orderBy("seq")))
    return rows.where("seq - start >= 3").select("symbol", "trade_date", (F.col("seq") - F.col("start")).alias("run"), q(F.try_divide("volume", F.nullif("first_volume", F.lit(0.0))), "volume_decay"))


@query(
    "pullback",
    f"""WITH {m.BARS_SQL}, k AS (SELECT symbol, trade_date, high, close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars WHERE close IS NOT NULL), p AS (SELECT * FROM k WHERE back <= 20),
    t AS (SELECT symbol, arg_max(back, (high, -back)) AS peak, max(high) AS top, avg(close) AS ma20, arg_min(close, back) AS last, count(*) AS n FROM p GROUP BY symbol)
    SELECT symbol, peak - 1 AS bars_since_peak, {sq('(top - last) / top * 100')} AS depth_pct, last >= ma20 AS holds_ma20 FROM t WHERE n = 20""",
)
def pullback(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    p = m.bars(spark, d).where("close is not null").withColumn("back", F.row_number().over(w).cast("long")).where("back <= 20")
    t = p.groupBy("symbol").agg(F.max_by("back", F.struct("high", -F.col("back"))).alias("peak"), F.max("high").alias("top"), F.avg("close").alias("ma20"), F.min_by("close", "back").alias("last"), F.count("*").alias("n")).where("n = 20")
    return t.select("symbol", (F.col("peak") - 1).alias("bars_since_peak"), q((F.col("top") - F.col("last")) / F.col("top") * 100, "depth_pct"), (F.col("last") >= F.col("ma20")).alias("holds_ma20"))


@query("name_classifier", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(small|tiny)') THEN 'UNIT' WHEN regexp_matches(p_name, 'ring$') THEN 'NOTE' WHEN regexp_matches(p_name, 'gear|widget') THEN 'COMMON' ELSE 'OTHER' END AS kind FROM part")
def name_classifier(spark, d):
    n = F.col("p_name")
    return m.table(spark, d, "part").select("p_partkey", F.when(n.rlike("^(small|tiny)"), "UNIT").when(n.rlike("ring$"), "NOTE").when(n.rlike("gear|widget"), "COMMON").otherwise("OTHER").alias("kind"))


@query("spend_ledger", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS cohort, floor(sum(floor(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice * 2 END, 100.0) * 100 + 0.5))) / 100 AS charged FROM orders GROUP BY 1, 2")
def spend_ledger(spark, d):
    """The first known of ledger, cost and estimate, summed per day and cohort (in cents, so sums are exact)."""
    k = F.col("o_orderkey") % 3
    charged = F.coalesce(F.when(k == 0, F.col("o_totalprice")), F.when(k == 1, F.col("o_totalprice") * 2), F.lit(100.0))
    return m.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("cohort")).agg((F.sum(F.floor(charged * 100 + 0.5)) / 100).alias("charged"))


@query("misses", "WITH d AS (SELECT user_id, ts, ts + INTERVAL 1 HOUR * (event_id % 30) AS known, event_type FROM events) SELECT user_id, count(*) FILTER (WHERE known <= TIMESTAMP '2024-01-20') AS visible, count(*) FILTER (WHERE known > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-20') AS late, CASE WHEN bool_or(known <= TIMESTAMP '2024-01-20' AND event_type = 'purchase') THEN 'A' WHEN bool_or(known <= TIMESTAMP '2024-01-20') THEN 'B' WHEN bool_or(ts <= TIMESTAMP '2024-01-20') THEN 'LATE' ELSE 'SHOCK' END AS miss FROM d GROUP BY user_id")
def misses(spark, d):
    """What a cutoff could see, what was published but came late, and the class of a miss that follows."""
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    rows = m.table(spark, d, "events").withColumn("known", F.expr("ts + make_dt_interval(0, cast(event_id % 30 as int), 0, 0)"))
    seen, out = F.col("known") <= cut, F.col("ts") <= cut
    return rows.groupBy("user_id").agg(F.count_if(seen).alias("visible"), F.count_if(~seen & out).alias("late"), F.when(F.bool_or(seen & (F.col("event_type") == "purchase")), "A").when(F.bool_or(seen), "B").when(F.bool_or(out), "LATE").otherwise("SHOCK").alias("miss"))


@query("provider_for_role", "WITH p AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0) SELECT n_name AS role, arg_min(s_suppkey, (-s_acctbal, s_suppkey)) AS provider, count(s_suppkey) AS n FROM nation LEFT JOIN p ON n_nationkey = s_nationkey GROUP BY n_name")
def provider_for_role(spark, d):
    """The enabled provider of the best priority per role; roles that nobody fills stay, with none."""
    p = m.table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")
    rows = m.table(spark, d, "nation").join(p, "n_nationkey", "left")
    return rows.groupBy(F.col("n_name").alias("role")).agg(F.min_by("s_suppkey", F.when(F.col("s_suppkey").isNotNull(), F.struct(-F.col("s_acctbal"), F.col("s_suppkey")))).alias("provider"), F.count("s_suppkey").alias("n"))


@query("missed_schedules", "WITH e AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1997-12-31', INTERVAL 7 DAY)) AS DATE) AS due), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT') SELECT due FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE day = due)")
def missed_schedules(spark, d):
    due = spark.range(1).select(F.explode(F.expr("sequence(date'1995-01-01', date'1997-12-31', interval 7 days)")).alias("due"))
    done = m.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("due")).distinct()
    return due.join(done, "due", "left_anti")


@query("label_counts", "SELECT lang, coalesce(CAST(quality AS VARCHAR), 'UNLABELLED') AS label, count(*) AS n, floor(avg(n_chars)) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_counts(spark, d):
    rows = m.table(spark, d, "documents").join(m.table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("UNLABELLED")).alias("label")).agg(F.count("*").alias("n"), F.floor(F.avg("n_chars")).cast("double").alias("mean_chars"))


@query("champion", "WITH p AS (SELECT doc_id % 10 AS fold, quality AS hit, (doc_id * 7919 % 101) / 100.0::DOUBLE AS a, (doc_id * 7907 % 101) / 100.0::DOUBLE AS b FROM labels), f AS (SELECT fold, avg((a - hit) ** 2) AS champion, avg((b - hit) ** 2) AS challenger FROM p GROUP BY fold) SELECT fold, floor(champion * 1e6 + 0.5) / 1e6 AS champion, floor(challenger * 1e6 + 0.5) / 1e6 AS challenger, challenger < champion AS better FROM f")
def champion(spark, d):
    """Two models on the same folds."""
    p = m.table(spark, d, "labels").select((F.col("doc_id") % 10).alias("fold"), F.col("quality").alias("hit"), (F.col("doc_id") * 7919 % 101 / 100.0).alias("a"), (F.col("doc_id") * 7907 % 101 / 100.0).alias("b"))
    f = p.groupBy("fold").agg(F.avg(F.pow(F.col("a") - F.col("hit"), 2)).alias("champion"), F.avg(F.pow(F.col("b") - F.col("hit"), 2)).alias("challenger"))
    return f.select("fold", q("champion", "champion"), q("challenger", "challenger"), (F.col("challenger") < F.col("champion")).alias("better"))


# Every 40th document's first word is a name; a text's own code is the first free-standing one in it.
OWN_CODE = "(?:^|[^0-9A-Za-z])([0-9]{4})(?:$|[^0-9A-Za-z])"


@query(
    "redaction_names",
    rf"""WITH n AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]{{4,}}') AS name FROM documents WHERE doc_id % 40 = 0 AND text IS NOT NULL), p AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS names FROM n WHERE name <> ''),
    d AS (SELECT doc_id, regexp_replace(text, names, '[NAME]', 'g') AS text, regexp_extract(text, '{OWN_CODE}', 1) AS code FROM documents, p WHERE text IS NOT NULL),
    r AS (SELECT doc_id, text, code, '(^|[^0-9A-Za-z０-９Ａ-Ｚａ-ｚ])' || code || '($|[^0-9A-Za-z０-９Ａ-Ｚａ-ｚ])' AS pattern FROM d)
    SELECT doc_id, CASE WHEN code = '' THEN text ELSE regexp_replace(regexp_replace(text, pattern, '\1[CODE]\2', 'g'), pattern, '\1[CODE]\2', 'g') END AS text FROM r""",
)
def redaction_names(spark, d):
    """All names out of every text by one dictionary, and each text's own code; other numbers stay."""
    docs = m.table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.regexp_extract("text", OWN_CODE, 1).alias("code"))
    names = m.table(spark, d, "documents").where("doc_id % 40 = 0").select(F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("name"))
    return rd.redact(docs, "text", names, "name", "code").select("doc_id", "text")


@query("redaction", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^0-9A-Za-z])[0-9]{4}($|[^0-9A-Za-z])', '\1[CODE]\2', 'g'), '(^|[^0-9A-Za-z])[0-9]{4}($|[^0-9A-Za-z])', '\1[CODE]\2', 'g') AS text FROM documents WHERE text IS NOT NULL")
def redaction(spark, d):
    """Free-standing codes are masked in the whole text."""
    return m.table(spark, d, "documents").where("text is not null").select("doc_id", redacted("text").alias("text"))


@query("open_episode_conflicts", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1")
def open_episode_conflicts(spark, d):
    return m.table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query("stock_detail", f"WITH {m.BARS_SQL}, b AS (SELECT symbol, count(*) AS n, arg_max(close, trade_date) AS last FROM bars GROUP BY 1), a AS (SELECT l_suppkey AS symbol, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT symbol, s_name AS name, coalesce(n, 0) AS bars, last AS last_close, coalesce(parts, 0) AS parts FROM (SELECT s_suppkey AS symbol, s_name FROM supplier) LEFT JOIN b USING (symbol) LEFT JOIN a USING (symbol)")
def stock_detail(spark, d):
    """One row per symbol from several sides, each aggregated before the join."""
    s = m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"))
    b = m.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("trade_date"))).alias("last_close"))
    a = m.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count_distinct("l_partkey").alias("parts"))
    return s.join(b, "symbol", "left").join(a, "symbol", "left").select("symbol", "name", F.coalesce("n", F.lit(0)).alias("bars"), "last_close", F.coalesce("parts", F.lit(0)).alias("parts"))
