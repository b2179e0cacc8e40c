"""Cascades that decide: entries, terms of a prediction, and answers of a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 3000.0


def first_of(*rules: tuple[Column, str], default: str) -> Column:
    """The name of the first rule that holds; a rule on a missing value does not hold."""
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules], F.lit(default))


def entry_decision(rows: DataFrame) -> DataFrame:
    """rows (decision_price, entry_price, open_episode, session_open, stale) with decision; the limit holds at both prices."""
    c = F.col
    decision = first_of(
        (c("stale") == True, "REFUSED_STALE_INPUT"),  # noqa: E712
        (c("decision_price").isNull(), "REFUSED_NO_PRICE"),
        (c("decision_price") > LIMIT, "REFUSED_LIMIT_AT_DECISION"),
        (c("open_episode") == True, "DUPLICATE_OPEN_EPISODE"),  # noqa: E712
        (c("session_open") == False, "WAIT_FOR_SESSION"),  # noqa: E712
        (c("entry_price").isNull(), "WAIT_FOR_PRICE"),
        (c("entry_price") > LIMIT, "REFUSED_LIMIT_AT_ENTRY"),
        default="ENTER",
    )
    return rows.withColumn("decision", decision)


def prediction_terms(rows: DataFrame) -> DataFrame:
    """rows (close, rate, rate_at, session_end, cutoff, decided_at) with price_jpy (half up, 6 decimals) and refusal."""
    c = F.col
    price = F.round((c("close").cast("decimal(20,6)") * F.coalesce(c("rate"), F.lit(1)).cast("decimal(20,10)")).cast("decimal(38,12)"), 6)
    refusal = F.coalesce(
        F.when(c("close").isNull(), "NO_CONFIRMED_CLOSE"),
        F.when((c("cutoff") < c("session_end")) | (c("cutoff") > c("decided_at")), "CUTOFF_OUT_OF_ORDER"),
        F.when(c("rate_at") > c("session_end"), "RATE_AFTER_CLOSE"),
        F.when(price > LIMIT, "ABOVE_LIMIT"),
    )
    return rows.withColumns({"price_jpy": price, "refusal": refusal})


def validate_answers(rows: DataFrame, answer: str, decisions: list[str]) -> DataFrame:
    """rows with errors, warnings and status of a judge's JSON answer."""
    get = lambda k: F.get_json_object(answer, f"$.{k}")
    p = get("probability").try_cast("double")
    present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    errors = present([
        F.when(get("decision").isNull(), "NO_DECISION"),
        F.when(~get("decision").isin(decisions), "UNKNOWN_DECISION"),
        F.when(p.isNull(), "NO_PROBABILITY"),
        F.when((p < 0) | (p > 1), "PROBABILITY_OUT_OF_RANGE"),
    ])
    warnings = present([F.when(F.coalesce(F.length(get("basis")), F.lit(0)) < 10, "SHORT_BASIS"), F.when(get("basis").rlike(r"(?i)as an? (ai|language model)"), "BOILERPLATE")])
    status = F.when(F.size("errors") > 0, "REJECTED").when(F.size("warnings") > 0, "ACCEPTED_WITH_WARNINGS").otherwise("ACCEPTED")
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("status", status)


# Wordings that an end-of-day analysis may not have, and what a reachable zone may rest on.
ENTRY_WORDS = r"(?i)\b(enter now|buy now|place (the |an )?order|execute (the )?entry|go long now|entry price is|take the entry)\b"
OLD_HIGH_WORDS = r"(?i)(back (up )?to|retrace to|recover( to)?|return to|upside to|target(s|ing)?) (its |the )?(previous|prior|former|old) high"
ZONE_BASES = ("CURRENT_MATERIAL", "SUPPLY_STRUCTURE", "VOLUME_STRUCTURE", "SUPPORT_RESISTANCE", "VOLATILITY_RANGE", "SECTOR_MOVE")


def validate_analysis(rows: DataFrame) -> DataFrame:
    """rows with errors, warnings, repairs, status, and the zone as repaired, of an end-of-day analysis.

    rows: state, rationale, zone_low, zone_high, basis_kinds, basis, close, threshold_price, obstacles
    (array of price_level and weakening_evidence), missing_sections.  Errors reject; a repair changes the answer
    and is told (a rejected security has no zone, so its zone is dropped).
    """
    c = F.col
    zone, words = c("zone_high").isNotNull(), F.coalesce("rationale", F.lit(""))
    kinds = F.coalesce("basis_kinds", F.array().cast("array<string>"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    errors = F.array_compact(F.array(
        F.when(blank(c("rationale")), "NO_RATIONALE"),
        F.when(words.rlike(ENTRY_WORDS), "READS_AS_ENTRY"),
        F.when(words.rlike(OLD_HIGH_WORDS), "PRIOR_HIGH_AS_UPSIDE"),
        F.when(zone & (F.size(kinds) == 0), "ZONE_WITHOUT_BASIS_KIND"),
        F.when(zone & F.exists(kinds, lambda k: F.coalesce(~k.isin(*ZONE_BASES), F.lit(True))), "UNKNOWN_BASIS_KIND"),
        F.when(zone & blank(c("basis")), "ZONE_WITHOUT_BASIS"),
        F.when(c("zone_high") < c("zone_low"), "ZONE_INVERTED"),
        F.when(F.abs(c("threshold_price") - c("zone_high")) < 1e-9, "ZONE_IS_THRESHOLD"),
    ))
    between = F.exists("obstacles", lambda o: F.coalesce((c("close") < o["price_level"]) & (o["price_level"] < c("zone_high")), F.lit(False)) & blank(o["weakening_evidence"]))
    missing = F.transform(F.coalesce("missing_sections", F.array().cast("array<string>")), lambda x: F.concat(F.lit("MISSING_SECTION:"), x))
    warnings = F.concat(F.array_compact(F.array(F.when(c("zone_high") < c("close"), "ZONE_BELOW_CLOSE"), F.when(between, "ZONE_THROUGH_OBSTACLE"))), missing)
    dropped = (c("state") == "REJECT") & (zone | c("zone_low").isNotNull())
    repairs = F.array_compact(F.array(F.when(dropped, "ZONE_DROPPED")))
    status = F.when(F.size(errors) > 0, "REJECTED").when(F.size(repairs) > 0, "REPAIRED").otherwise("PASSED")
    # The zone is replaced after the rules have read it: in one projection a lambda would see the new one.
    told = rows.withColumns({"errors": errors, "warnings": warnings, "repairs": repairs, "status": status})
    kept = lambda n: F.when(F.size("repairs") == 0, c(n))
    return told.withColumns({"zone_low": kept("zone_low"), "zone_high": kept("zone_high")})


def stage3_decision(rows: DataFrame) -> DataFrame:
    """rows (concepts, technical_routes, material_routes, timings: arrays of names) with state, the first rule that holds.

    A material after the close is a catalyst; one whose timing is not known (null or UNKNOWN) can be neither that nor a
    chart setup, so it is watched.
    """
    has = lambda column, name: F.coalesce(F.array_contains(column, name), F.lit(False))
    technical, material = F.size("technical_routes") > 0, F.size("material_routes") > 0
    unknown = F.exists("timings", lambda x: F.coalesce(x, F.lit("UNKNOWN")) == "UNKNOWN")
    state = first_of(
        (~technical & ~material, "REJECT"),
        (material & has("timings", "POST_CLOSE"), "POST_CLOSE_CATALYST_SETUP"),
        (material & unknown, "WATCH_OTHER"),
        (has("concepts", "FAILED_BREAKOUT"), "WATCH_OTHER"),
        (has("concepts", "HEALTHY_PULLBACK"), "WATCH_PULLBACK"),
        (technical & material, "TECHNICAL_SETUP_EOD"),
        (technical, "WATCH_BREAKOUT"),
        default="WATCH_OTHER",
    )
    return rows.withColumn("state", state)
