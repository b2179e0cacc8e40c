"""What a title or a name alone says: kinds of disclosures, kinds of securities, and the features drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import first_of

# Kinds of disclosures and their patterns; the order decides, the first that matches wins.
TITLE_RULES = (
    ("ETF_DAILY", "日々の開示事項"),
    ("ETF_DISTRIBUTION", "(?:収益分配金|分配金(?:見込|予想))"),
    ("TREASURY_CANCELLATION", "自己株式.{0,6}消却"),
    ("TREASURY_DISPOSAL", "自己株式.{0,6}処分"),
    ("BUYBACK", "自己株式.{0,8}(?:取得|買付|買受)"),
    ("TENDER_OFFER", "公開買付|ＴＯＢ|TOB"),
    ("DIVIDEND_FORECAST_REVISION", "配当予想.{0,4}(?:修正|変更)"),
    ("EARNINGS_FORECAST_REVISION", "業績予想.{0,6}(?:修正|変更)"),
    ("EARNINGS_FORECAST", "業績予想.{0,6}(?:公表|開示|発表)"),
    ("DIVIDEND", "剰余金の配当|(?:中間|期末|普通|特別|記念)配当|配当予想"),
    ("EARNINGS_RESULT", "決算短信"),
    ("EARNINGS_MATERIAL", "決算(?:説明|補足|参考|概要|情報)|業績概要|決算を終えて"),
    ("EXTRAORDINARY_GAIN", "特別利益|売却益|補助金収入|(?:営業外)?収益.{0,6}計上"),
    ("EXTRAORDINARY_LOSS", "特別損失|減損損失|評価損|売却損"),
    ("INCIDENT", "火災|事故|不適切|不正行為|継続企業の前提|債務超過|お詫び"),
    ("SHARE_CONSOLIDATION", "株式併合"),
    ("SHARE_SPLIT", "株式分割"),
    ("EMPLOYEE_SHARE_PLAN", "ＥＳＯＰ|ESOP|株式付与|譲渡制限付株式(?:制度|報酬制度)|株式報酬制度"),
    ("STOCK_OPTION", "新株予約権|ストック・?オプション"),
    ("EQUITY_ISSUANCE", "第三者割当|募集株式|新株式発行|公募増資|投資口の発行|資本金の額の減少"),
    ("AUDITOR_CHANGE", "公認会計士等の異動|会計監査人"),
    ("MA_SUBSIDIARY", "子会社.{0,12}(?:異動|取得|譲渡|設立|解散|清算|化|商号変更|移転)|(?:持分法適用)?関連会社.{0,10}異動|株式取得|合併|会社分割|株式交換|事業譲渡"),
    ("MAJOR_SHAREHOLDER_CHANGE", "(?:主要株主|支配株主|筆頭株主).{0,10}(?:異動|に関する事項)"),
    ("MANAGEMENT_CHANGE", "(?:代表取締役|取締役|執行役員|役員|人事|使用人).{0,12}(?:異動|変更|選任|辞任|退任|新設|導入)|役員報酬|指名報酬委員会"),
    ("ALLIANCE", "(?:資本)?業務提携|事業提携|協業|覚書|ＭＯＵ|MOU"),
    ("INVESTIGATION", "(?:特別調査委員会|第三者委員会|調査委員会).{0,12}(?:設置|報告|公表)"),
    ("LEGAL", "独占禁止法|訴訟|判決|更生計画|上告|court|課徴金"),
    ("PRODUCT_APPROVAL", "(?:製造販売)?承認(?:取得|申請)|薬事承認|一部変更承認|認定に関する"),
    ("CONTRACT", "契約.{0,6}締結|受注|販売許諾|ライセンス契約|特許(?:出願|取得)"),
    ("FINANCING", "資金の借入|借入の決定|コミットメントライン|社債の発行|投資法人債"),
    ("ASSET_TRANSACTION", "(?:販売用)?不動産の(?:売却|取得|譲渡)|固定資産の(?:取得|譲渡|売却)|事業の(?:取得|譲受)"),
    ("LISTING_CHANGE", "上場(?:承認|廃止|申請|維持基準)|上場に伴う|市場(?:変更|区分の?変更)|整理銘柄|監理銘柄|重複上場|株式上場"),
    ("SHAREHOLDER_MEETING", "株主総会"),
    ("SHAREHOLDER_PERK", "(?:株主|投資主)優待"),
    ("MONTHLY_UPDATE", "月次|月度|売上(?:概況|報告|進捗)|営業報告|売上収益報告|ＫＰＩ|KPI|投資資産残高"),
    ("GOVERNANCE", "資本コスト|事業計画及び成長可能性|コーポレートガバナンス|支配株主等に関する"),
)
# Kinds published at a fixed pace, and the flags in a title.
ROUTINE = ("ETF_DAILY", "ETF_DISTRIBUTION", "MONTHLY_UPDATE")
CORRECTION = "[（(]\\s*訂正\\s*[）)]"
PROGRESS = "[（(]\\s*(?:開示事項の経過|経過開示|開示事項の変更)\\s*[）)]"
# Novelty of a routine title, of an update, and of a first disclosure; directness by kind known or not.
NOVELTY = {"routine": 0.1, "update": 0.3, "first": 0.6}
DIRECT, UNKNOWN_DIRECTNESS = 1.0, 0.5
UNMEASURED = ("surprise", "magnitude", "persistence", "market_reaction", "priced_in")

# Wordings of share classes that aren't ordinary shares, and the length of an ordinary code.
SPECIAL_SHARES = (("優先出資証券", "INVESTMENT_CERTIFICATE"), ("優先株式", "PREFERRED"), ("種類株式", "OTHER"), ("新株予約権", "WARRANT"), ("優先出資", "INVESTMENT_CERTIFICATE"))
ORDINARY_CODE = 4

# Wordings in security names.
DEPOSITARY = "american depositary|american depository|global depositary|global depository|depositary receipt|depository receipt|new york registry shares"
DEPOSITARY_TOKEN = "(?:^|[^\\w-])ad[rs]s?(?:$|[^\\w-])"
FUND = "\\bclosed[- ]end fund\\b|\\breal estate investment trust\\b"
OVER_COMMON = "represent\\w*\\s+[^.]*\\b(?:common|ordinary)\\b"
COMMON = "\\bcommon stocks?\\b|\\bcommon shares?\\b|\\bordinary shares?\\b|\\bclass [a-z] ordinary\\b|\\bcommon units?\\b"
NAME_RULES = (
    ("REIT_OR_FUND", FUND),
    ("WARRANT", "warrant"),
    ("RIGHT", "\\brights?\\b"),
    ("UNIT", "\\bunits?\\b"),
    ("PREFERRED", "preferred|\\bpfd\\b"),
    ("ADR", f"{DEPOSITARY}|{DEPOSITARY_TOKEN}|{OVER_COMMON}"),
    ("UNKNOWN", "\\bdeposit[ao]ry\\b"),
    ("ETN", "exchange traded note|\\betns?\\b"),
    ("OTHER", "notes due|debenture|subordinated note|senior note"),
    ("COMMON_STOCK", COMMON),
)


def with_title_kind(rows: DataFrame, title: str = "title") -> DataFrame:
    """rows with disclosure_type, matched_text, is_correction, is_progress and is_routine.

    Flags are read and taken out first, so a corrected release is a release that is a correction.  A null, empty or
    unmatched title is OTHER, with no matched text.
    """
    text = F.coalesce(F.col(title), F.lit(""))
    body = F.trim(F.regexp_replace(F.regexp_replace(text, CORRECTION, ""), PROGRESS, ""))
    matched = F.coalesce(*[F.when(body.rlike(rule), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(body, rule, 0).alias("text"))) for kind, rule in TITLE_RULES])
    rows = rows.withColumns({"__m": matched, "is_correction": text.rlike(CORRECTION), "is_progress": text.rlike(PROGRESS)})
    rows = rows.withColumns({"disclosure_type": F.coalesce("__m.kind", F.lit("OTHER")), "matched_text": F.col("__m.text")}).drop("__m")
    return rows.withColumn("is_routine", F.col("disclosure_type").isin(*ROUTINE))


def with_title_features(rows: DataFrame) -> DataFrame:
    """with_title_kind's rows with novelty and directness; what a title can't tell is null, not zero."""
    novelty = F.when(F.col("is_routine"), NOVELTY["routine"]).when(F.col("is_correction") | F.col("is_progress"), NOVELTY["update"]).otherwise(NOVELTY["first"])
    direct = F.when(F.col("disclosure_type") == "OTHER", UNKNOWN_DIRECTNESS).otherwise(DIRECT)
    return rows.withColumns({"novelty": novelty, "directness": direct} | {n: F.lit(None).cast("double") for n in UNMEASURED})


def relations(rows: DataFrame) -> DataFrame:
    """One relation per disclosure of a known security, with the mapping's confidence as it came (PROVISIONAL without one)."""
    known = rows.where("security_id is not null")
    return known.select("event_id", "security_id", F.lit("DIRECT_COMPANY").alias("relation_type"), F.coalesce("mapping_confidence", F.lit("PROVISIONAL")).alias("confidence"), "disclosure_type")


def evaluations(rows: DataFrame) -> DataFrame:
    """Per security what was disclosed of it: one candidate, however many events; unmapped rows are left out."""
    known = rows.where("security_id is not null").groupBy("security_id")
    return known.agg(F.count("*").alias("events"), F.count_if(F.col("is_routine")).alias("routine"), F.max("novelty").alias("novelty"), F.max("directness").alias("directness"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def name_type(name: Column, etf_flag: Column) -> Column:
    """(security_type, is_adr) of a security's published name; what the name does not say stays UNKNOWN."""
    lowered = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    kind = F.when(etf_flag == "Y", "ETF").otherwise(first_of(*[(lowered.rlike(rule), kind) for kind, rule in NAME_RULES], default="UNKNOWN"))
    adr = lowered.rlike(f"{DEPOSITARY}|{DEPOSITARY_TOKEN}")
    is_adr = F.when(kind.isin("ETF", "COMMON_STOCK"), False).when(kind == "ADR", True).otherwise(adr)
    return F.struct(kind.alias("security_type"), is_adr.alias("is_adr"))


def special_share(code: Column, name: Column) -> Column:
    """(security_type, evidence) of what is not an ordinary share, else null; never says that something is one."""
    longer = F.length(code) > ORDINARY_CODE
    padded = longer & (F.regexp_replace(F.substring(code, ORDINARY_CODE + 1, 100), "0", "") == "")
    told = [F.when(name.contains(w), F.struct(F.lit(k).alias("security_type"), F.lit(f"name contains {w}").alias("evidence"))) for w, k in SPECIAL_SHARES]
    shape = F.when(longer & ~padded, F.struct(F.lit("UNKNOWN").alias("security_type"), F.concat(F.lit("code "), code, F.lit(" is not an ordinary share code")).alias("evidence")))
    return F.coalesce(*told, shape)
