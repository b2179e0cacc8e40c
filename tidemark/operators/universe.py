"""Whether a security belongs to the universe: one ordered list of rules for both markets, the first that holds decides.

A rule pending a decision leaves a security UNRESOLVED and visible: it is neither in nor out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Segments, exchanges, and the types that are out by their kind.
JP_TARGET = ("PRIME_DOMESTIC", "STANDARD_DOMESTIC", "GROWTH_DOMESTIC")
JP_FOREIGN = ("PRIME_FOREIGN", "STANDARD_FOREIGN", "GROWTH_FOREIGN")
JP_EXCLUDED = ("PRO_MARKET",)
US_TARGET = ("XNYS", "XNAS", "XASE")
TYPE_OUT = {"ETF": "ETF", "ETN": "ETN", "REIT_OR_FUND": "REIT_OR_FUND", "PREFERRED": "PREFERRED", "WARRANT": "WARRANT", "RIGHT": "RIGHT", "UNIT": "UNIT", "OTHER": "NOT_COMMON_STOCK"}


def rules() -> list[tuple[Column, str, str]]:
    """(when, decision, reason) in order; rows have market_code, listing_status, is_test_issue, segment, security_type, exchange_id, cik, is_adr, spac, reit, sic_known."""
    c = F.col
    jp, us, kind, segment = c("market_code") == "JP", c("market_code") == "US", c("security_type"), c("segment")
    out: list[tuple[Column, str, str]] = [
        (c("is_test_issue"), "EXCLUDED", "TEST_ISSUE"),
        (c("listing_status") == "DELISTED", "EXCLUDED", "DELISTED"),
        (~(jp | us) | c("market_code").isNull(), "UNRESOLVED", "PROVIDER_DATA_MISSING"),
        (jp & segment.isin(*JP_EXCLUDED), "EXCLUDED", "NOT_TARGET_SEGMENT"),
        *[(jp & (kind == k), "EXCLUDED", k) for k in ("ETF", "ETN", "REIT_OR_FUND")],
        (jp & (kind == "INVESTMENT_CERTIFICATE"), "UNRESOLVED", "INVESTMENT_CERTIFICATE_RULE_PENDING"),
        *[(jp & (kind == k), "EXCLUDED", k) for k in ("PREFERRED", "WARRANT")],
        (jp & (kind == "OTHER"), "EXCLUDED", "NOT_COMMON_STOCK"),
        (jp & ((kind == "FOREIGN_COMMON_STOCK") | segment.isin(*JP_FOREIGN)), "UNRESOLVED", "FOREIGN_STOCK_RULE_PENDING"),
        (jp & ((kind == "UNKNOWN") | (segment == "UNKNOWN")), "UNRESOLVED", "TYPE_UNKNOWN"),
        (jp & segment.isin(*JP_TARGET) & (kind == "COMMON_STOCK"), "INCLUDED", "TARGET_MARKET_COMMON_STOCK"),
        (jp & ~F.coalesce(segment.isin(*JP_TARGET), F.lit(False)), "UNRESOLVED", "SEGMENT_RULE_PENDING"),
        (jp, "EXCLUDED", "NOT_COMMON_STOCK"),
        (c("exchange_id").isNull(), "UNRESOLVED", "PROVIDER_DATA_MISSING"),
        (c("exchange_id") == "OTCM", "EXCLUDED", "OTC"),
        (~c("exchange_id").isin(*US_TARGET), "EXCLUDED", "NOT_TARGET_EXCHANGE"),
        *[(kind == k, "EXCLUDED", reason) for k, reason in TYPE_OUT.items()],
        (c("spac"), "EXCLUDED", "SPAC_PRE_MERGER"),
        (c("reit"), "EXCLUDED", "REIT_OR_FUND"),
        ((kind == "ADR") | c("is_adr"), "UNRESOLVED", "ADR_ELIGIBILITY_UNDEFINED"),
        (kind == "UNKNOWN", "UNRESOLVED", "TYPE_UNKNOWN"),
        # Without the registry's number, or its codes, a fund or a shell can't be told from a company.
        ((kind == "COMMON_STOCK") & (~c("sic_known") | (F.coalesce("cik", F.lit("")) == "")), "UNRESOLVED", "REIT_DETECTION_INCOMPLETE"),
        (kind == "COMMON_STOCK", "INCLUDED", "TARGET_MARKET_COMMON_STOCK"),
    ]
    return out


def classify(records: DataFrame, spac_ciks: DataFrame | None = None, reit_ciks: DataFrame | None = None, sic_known: bool = True) -> DataFrame:
    """records with decision (INCLUDED, EXCLUDED, UNRESOLVED) and reason; the lists (cik) come from a registry of their own."""
    rows = records
    for name, ciks in (("spac", spac_ciks), ("reit", reit_ciks)):
        if ciks is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            rows = rows.join(ciks.select("cik").distinct().withColumn(name, F.lit(True)), "cik", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = rows.withColumn("sic_known", F.lit(sic_known))
    pair = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("reason"))
    found = F.coalesce(*[F.when(test, pair(a, b)) for test, a, b in rules()], pair("EXCLUDED", "NOT_COMMON_STOCK"))
    return rows.withColumn("found", found).select(*records.columns, "found.*")
