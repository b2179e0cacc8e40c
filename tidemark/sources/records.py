"""JSON, XML, TSV, HTML and zip sources: read by Spark's readers, shaped by column expressions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FEED_BYTES = 5 << 20


def columnar_json(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of documents {"fields": [...], "data": [[...], ...]}: a map from field to text per row."""
    rows = spark.read.schema("fields array<string>, data array<array<string>>").json(path, multiLine=True)
    each = rows.select("fields", F.posexplode("data").alias("row", "d")).where(F.size("d") == F.size("fields"))
    return each.select("row", F.map_from_arrays("fields", "d").alias("values"))


def first_of(document: str, *names: str) -> Column:
    """The first of alternative fields that a JSON text has."""
    return F.coalesce(*[F.get_json_object(document, f"$.{n}") for n in names])


def envelope(document: Column, *names: str) -> Column:
    """The records of a response, whichever envelope they come in; a bare array counts."""
    bare = F.when(document.rlike(r"^\s*\["), document)
    inside = F.coalesce(bare, *[F.get_json_object(document, f"$.{n}") for n in names], document)
    return F.from_json(inside, "array<string>")


def bars_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars of responses whose fields go by several names; rows without a code or day are skipped."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(envelope(F.col("value"), "daily_quotes", "bars", "data")).alias("r"))
    number = lambda *n: first_of("r", *n).try_cast("double")
    out = rows.select(
        first_of("r", "Code", "code", "symbol").alias("native_symbol"),
        first_of("r", "Date", "date", "t").try_cast("date").alias("trade_date"),
        *[number(*names).alias(k) for k, names in {"open": ("Open", "open", "O", "o"), "high": ("High", "high", "H", "h"), "low": ("Low", "low", "L", "l"), "close": ("Close", "close", "C", "c"), "volume": ("Volume", "volume", "Vo", "v"), "turnover": ("TurnoverValue", "turnover", "Va")}.items()],
    )
    return out.where("native_symbol is not null and trade_date is not null")


# The names that a bulk response's fields go by; those of the first entry must be there.
BULK_BAR = {"code": ("code", "Code"), "trade_date": ("date", "Date"), "exchange": ("exchange_short_name", "Ex", "exchange"), "open": ("open", "Open"), "high": ("high", "High"), "low": ("low", "Low"), "close": ("close", "Close"), "adjusted_close": ("adjusted_close", "Adjusted_close"), "volume": ("volume", "Volume")}
BULK_DIVIDEND = {"ex_date": ("date",), "value": ("value",), "unadjusted_value": ("unadjustedValue",), "currency": ("currency",), "declaration_date": ("declarationDate",), "record_date": ("recordDate",), "payment_date": ("paymentDate",), "period": ("period",)}
BULK_SYMBOL = {"code": ("Code", "code"), "name": ("Name", "name"), "exchange": ("Exchange", "exchange"), "country": ("Country", "country"), "currency": ("Currency", "currency"), "security_type": ("Type", "type"), "isin": ("Isin", "isin")}
_NUMBERS = ("open", "high", "low", "close", "adjusted_close", "volume", "value", "unadjusted_value")


def bulk(files: DataFrame, names: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, refused: file, record, missing) of bulk responses (file, value): JSON arrays, fields under any of their names.

    A number that can't be read, NA and empty text among them, is null; a record without a required field is told, not guessed.
    """
    records = files.select("file", F.explode(envelope(F.col("value"), "data")).alias("r"))
    # A record is parsed once, for all its fields: the row is made before they are taken out of it.
    records = records.select("file", "r", F.explode(F.array(F.coalesce(F.from_json("r", "map<string,string>"), F.create_map().cast("map<string,string>")))).alias("m"))

    def field(name: str) -> Column:
        x = F.nullif(F.trim(F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names[name]])), F.lit(""))
        return x.try_cast("decimal(30,10)") if name in _NUMBERS else x.try_cast("date") if name.endswith("date") else x

    rows = records.select("file", F.col("r").alias("record"), *[field(n).alias(n) for n in names])
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in required]))
    rows = rows.withColumn("missing", missing)
    return rows.where(F.size("missing") == 0).drop("record", "missing"), rows.where(F.size("missing") > 0).select("file", "record", "missing")


def split_ratio(text: str) -> dict[str, Column]:
    """split_to and split_from of "new/old"; null where it can't be read."""
    parts = F.split(text, "/")
    two = F.size(parts) == 2
    return {"split_to": F.when(two, F.trim(F.get(parts, F.lit(0))).try_cast("double")), "split_from": F.when(two, F.trim(F.get(parts, F.lit(1))).try_cast("double"))}


_ITEM = "array<struct<title:string,link:string,guid:string,pubDate:string,`dc:date`:string,description:string,`content:encoded`:string,`_rdf:about`:string>>"
_ENTRY = "array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string,content:string>>"
FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}, entry {_ENTRY}, broken string"


def feed_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, refused) of RSS 2.0, RSS 1.0 and Atom files."""
    return parsed_feeds(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def parsed_feeds(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: file, id, title, url, summary, published; refused: file, reason) of feeds as text (file, value).

    Read by the XML parser: entities, CDATA and attributes are its business; names of Dublin Core, RDF and the content module go by
    their usual prefixes.  RSS 2.0 nests its items in the channel, RSS 1.0 puts them beside it.  A document type, a
    size over the cap, text that is not well-formed, or another root refuses the file; an item that nothing identifies is skipped.
    An Atom entry's link is its first alternate one, its time that of its release, not of its last change.
    """
    root = F.regexp_extract("value", r"(?s)^\s*(?:<\?xml.*?\?>)?(?:\s|<!--.*?-->)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    bad = F.when(F.octet_length("value") > MOST_FEED_BYTES, "TOO_LARGE").when(F.col("value").rlike("(?i)<!(?:doctype|entity)"), "DOCTYPE")
    rows = files.select("file", bad.alias("bad"), root.alias("root"), F.when(bad.isNull(), F.from_xml("value", FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})).alias("x"))
    reason = F.coalesce("bad", F.when(F.col("x").isNull() | F.col("x.broken").isNotNull(), "NOT_WELL_FORMED"), F.when(~F.col("root").isin("rss", "RDF", "feed"), "UNKNOWN_ROOT"))
    rows = rows.withColumn("reason", reason)
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(n, r"^\s+|\s+$", "")), F.lit("")) for n in names])
    good = rows.where("reason IS NULL")
    rss = good.where("root <> 'feed'").select("file", F.explode(F.concat(F.coalesce("x.channel.item", F.array().cast(_ITEM)), F.coalesce("x.item", F.array().cast(_ITEM)))).alias("i")).select("file", "i.*")
    rss = rss.select("file", text("guid", "`_rdf:about`", "link").alias("id"), text("title").alias("title"), text("link").alias("url"), text("description", "`content:encoded`").alias("summary"), text("pubDate", "`dc:date`").alias("published"))
    atom = good.where("root = 'feed'").select("file", F.explode("x.entry").alias("e")).select("file", "e.*")
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    atom = atom.withColumn("url", link).select("file", text("id", "url").alias("id"), text("title").alias("title"), text("url").alias("url"), text("summary", "content").alias("summary"), text("published", "updated").alias("published"))
    return rss.unionByName(atom).where("id IS NOT NULL"), rows.where("reason IS NOT NULL").select("file", "reason")


def published(text: str) -> dict[str, Column]:
    """The instant of a feed's date and how precise it is; what can't be read stays null, as UNKNOWN."""
    day = F.col(text).rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")
    # RFC 822 without the day's name, which need not fit the date.
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    instant = F.coalesce(
        F.when(day, F.try_to_timestamp(F.regexp_replace(text, "/", "-"), F.lit("yyyy-MM-dd"))),
        F.col(text).try_cast("timestamp"),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")),
    )
    return {"published_at": instant, "precision": F.when(instant.isNull(), "UNKNOWN").when(day, "DATE").otherwise("EXACT")}


def disclosures(spark: SparkSession, path: str) -> DataFrame:
    """(id, code, title, published_local) of an index whose items nest under either spelling; bad ids and days are skipped."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(envelope(F.col("value"), "items")).alias("i")).select(F.coalesce(F.get_json_object("i", "$.Tdnet"), F.get_json_object("i", "$.TDnet"), F.col("i")).alias("r"))
    out = rows.select(first_of("r", "id").try_cast("long").alias("id"), first_of("r", "company_code").alias("code"), first_of("r", "title").alias("title"), first_of("r", "pubdate").try_cast("timestamp_ntz").alias("published_local"))
    return out.where("id is not null and published_local is not null")


def code_keys(code: str) -> Column:
    """Lookup keys of a five-character code in order: itself, and without a closing 0 its four."""
    return F.when(F.col(code).rlike("^[0-9A-Z]{4}0$"), F.array(F.col(code), F.substring(code, 1, 4))).otherwise(F.array(F.col(code)))


def mapping_result(data: str, error: str) -> Column:
    n = F.size(data)
    return F.when(F.col(error).isNotNull(), "ERROR").when(F.coalesce(n, F.lit(0)) < 1, "UNMAPPED").when(n == 1, "EXACT").otherwise("AMBIGUOUS")


def snapshot(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A positional TSV; lines of a wrong width are dropped."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == len(columns))
    return parts.select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(columns)])


def verified(spark: SparkSession, folder: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of artifacts whose SHA-256 is the manifest's, those missing or damaged): manifest (name, sha256)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"), "content")
    both = manifest.join(files, "name", "left")
    good = both.where(F.col("found") == F.col("sha256"))
    lines = good.select("name", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "value")).where("value <> ''")
    return lines, both.where(~F.col("found").eqNullSafe(F.col("sha256"))).select("name", F.when(F.col("found").isNull(), "MISSING").otherwise("DAMAGED").alias("reason"))


def closed_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, name) of a calendar page: dates in the text without tags, the name on the next line."""
    page = spark.read.text(path, wholetext=True)
    text = F.regexp_replace(F.regexp_replace("value", r"(?i)<br[^>]*>|</(td|tr|p|li)>", "\n"), "<[^>]*>", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = page.select(lines.alias("l")).select("l", F.posexplode("l").alias("k", "x"))
    day = F.regexp_extract("x", r"^(\d{4}/\d{2}/\d{2})", 1)
    return rows.where(day != "").select(F.to_date(F.try_to_timestamp(day, F.lit("yyyy/MM/dd"))).alias("day"), F.get("l", F.col("k") + 1).alias("name")).where("day is not null")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "cp932") -> DataFrame:
    """CSV members of zip files, a banner line and a header before the rows; values as text."""

    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".csv"):
                            rows = pd.read_csv(io.BytesIO(z.read(name)), encoding=encoding, skiprows=1, dtype=str, keep_default_na=False)
                            yield rows.iloc[:, : len(columns)].set_axis(columns, axis=1)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in columns))
