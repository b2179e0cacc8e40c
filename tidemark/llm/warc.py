"""WARC archives: an index of every record, and coalesced byte-range reads of the records it selects.

1.  A task writes its records to archives of its own, each record a gzip member as usual, and
    gives out an index row per record: archive, offset, length, URL, digest, page and kind.
    The index is written before anything is read.  An archive's name is new for each attempt of
    a task, and only the index rows of the attempt that ended well are kept, so a lost
    task leaves at most a file that nothing points to.
2.  Reading takes index rows (all, or a selection), orders them by archive and offset, joins
    ranges whose gap is at most GAP bytes into reads of at most READ bytes (one longer record is a read of
    its own), cuts the records out and unpacks them.  Files are reached through the file
    system that their URI names.

Equal payloads of at least REVISIT bytes are stored once: the record of the largest page_id is
the response, the others are revisit records with the digest and no payload.

Defined cases: null html is an empty payload; rows without page_id are responses with an empty
record id part and are not revisited; rows that repeat the largest page_id of a payload are
responses all; line ends in an URL become a space, a null URL is left out; an empty table gives
an empty index and no rows.  Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
GAP, READ = 64 << 10, 8 << 20
#: Digests shared by several pages (48 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, kind, refers_to, bytes, body): what each record holds."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\r\n]+", " ").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    shared = own.where((F.col("bytes") >= REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = c.save(shared)
    own = own.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "digest", "left")
    again = F.col("page_id") < F.col("first")
    return own.select("page_id", "url", "digest", "bytes", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, "").otherwise(F.col("html")).alias("body"))


def _urn(page: str) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value) -> F.Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def with_record(rows: DataFrame) -> DataFrame:
    """Adds the record: WARC header, empty line, body and the two CR LF that end it."""
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", _urn("page_id")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("kind") == "revisit", F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn("refers_to")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length("body").cast("string")),
        F.lit(END),
    )
    return rows.withColumn("record", F.concat(head, "body", F.lit(END + END)))


INDEX = "archive string, offset long, length long, page_id long, url string, digest string, kind string"


def _writer(folder: str):
    def run(batches):
        system, path = c.file_system(folder)
        system.create_dir(path, recursive=True)
        out = name = None
        offset = 0
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("archive", "offset", "length")}
            for record in batch.column(batch.schema.get_field_index("record")).to_pylist():
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                raw = gzip.compress(record.encode(), 6, mtime=0)
                out.write(raw)
                for n, x in zip(rows, (f"{folder}/{name}", offset, len(raw)), strict=True):
                    rows[n].append(x)
                offset += len(raw)
                if offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            rest = {n: batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "digest", "kind")}
            yield pa.RecordBatch.from_pydict({"archive": pa.array(rows["archive"], pa.string()), "offset": pa.array(rows["offset"], pa.int64()), "length": pa.array(rows["length"], pa.int64())} | rest)
        if out is not None:
            out.close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below folder, and the index beside them; gives the index as read back."""
    c.small_batches(pages.sparkSession)
    rows = with_record(records(pages)).select("page_id", "url", "digest", "kind", "record")
    index = rows.mapInArrow(_writer(f"{folder}/archives"), INDEX)
    index.write.option("compression", "zstd").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, read: int = READ) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges as fewer (start, stop) reads: small gaps are read over, reads stay bounded."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= read:
            out[-1][1] = max(out[-1][1], offset + length)
        else:
            out.append([offset, offset + length])
    return [tuple(x) for x in out]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no record at the index's offset: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode()
    return fields, rest[: int(fields["content-length"])]


def read(index: DataFrame, bodies: bool = True) -> DataFrame:
    """The records that index rows select: (page_id, url, kind, digest, refers_to, bytes, body_sha1, body).

    bytes is the length of a response's body as read back, and what a revisit record says of its payload.  Without
    bodies, they are read and checked in the tasks and left there.
    """
    picked = index.select("archive", "offset", "length").repartition(c.partitions(index.sparkSession, 0, 1), "archive").sortWithinPartitions("archive", "offset")

    def run(batches):
        for batch in batches:
            names, *ranges = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("archive", "offset", "length"))
            start = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[start]:
                    yield from _fetch(names[start], list(zip(*(x[start:i] for x in ranges), strict=True)), bodies)
                    start = i

    return picked.mapInArrow(run, "page_id long, url string, kind string, digest string, refers_to long, bytes long, body_sha1 string, body binary")


def _fetch(file: str, ranges: list[tuple[int, int]], bodies: bool):
    names = ["page_id", "url", "kind", "digest", "refers_to", "bytes", "body_sha1", "body"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    at = 0
    system, path = c.file_system(file)
    with system.open_input_file(path) as f:
        for start, stop in coalesced(ranges):
            f.seek(start)
            raw = f.read(stop - start)
            out = []
            while at < len(ranges) and ranges[at][0] + ranges[at][1] <= stop and ranges[at][0] >= start:
                offset, length = ranges[at]
                fields, body = parse(gzip.decompress(raw[offset - start : offset - start + length]))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                sha1 = hashlib.sha1(body).hexdigest()
                if fields["warc-type"] == "response" and sha1 != digest:
                    raise ValueError(f"damaged record at {offset} of {file}")
                out.append((number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], digest, number(fields.get("warc-refers-to")), len(body) if fields["warc-type"] == "response" else int(fields["x-payload-length"]), sha1, body if bodies else None))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    back = read(write(pages, c.scratch_dir(spark)), bodies=False)
    return back.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
