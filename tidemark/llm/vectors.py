"""Vector codes by product quantisation, with codebooks fitted by Lloyd's rounds that move only what changed.

Components become integers floor(scale * x); a vector is cut into equal consecutive parts, and each
part position has a codebook of its own.  Vectors are packed once into slabs (a row holds some
thousand vectors), in a table bucketed by slab.  A round joins the slabs to the assignments of the
round before, which are a table bucketed alike, so neither side is shuffled; it writes the new
assignments, and beside them, per slab, what parts that changed their entry take from the sums of
the old one and give to the new one.  Only these differences are shuffled.  The running sums are
integers in a written table of their own; with 16 entries they are some thousand rows at any size
of the input, and the only thing the driver gathers.  A round in which no part moves ends the loop:
all later ones would give the same.

All arithmetic is exact: doubles where every sum stays below 2**53, longs below 2**62, Python's
integers beyond.  Sums travel as 60-bit limbs, summed as decimals.

Defined cases: a vector that is null, or holds a null or non-finite component, is left out.  The
dimension is that of the longest vector, up to a multiple of the number of parts; shorter vectors
count as followed by zeros, so an empty one is the zero vector.  Codebooks start as the vectors of the smallest different ids (of a
repeated id the vector that is first component by component; null counts as the last id); with
fewer ids there are fewer entries.  Repeated rows stay and count each time.  A squared distance over the largest long
counts as that.  No row left: no rows.  Only the named columns are read; others, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Vectors, and bytes of their integers, of a slab at most (one longer vector is a slab of its own).
SLAB_ROWS, SLAB_BYTES = 4096, 4 << 20
#: Bytes of slabs that a bucket should hold, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 50_000
LIMB = 60
LONG = (1 << 63) - 1

MOVES = "moves array<struct<cell:int,at:int,limb:int,value:long>>"


def valid(column: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    x = F.col(column).cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def integers(x, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: longs, or Python's integers where some don't fit 62 bits."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() * scale < 2.0**53:
        return np.floor(x * scale).astype(np.int64) if math.log2(scale).is_integer() else _exactly(x, scale)
    return _exactly(x, scale)


def _exactly(x: np.ndarray, scale: int) -> np.ndarray:
    out = np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)
    return out.astype(np.int64) if not out.size or max(map(abs, out.ravel().tolist())) < 1 << 62 else out


def _size(*arrays: np.ndarray) -> int:
    return sum(max(int(a.max()), -int(a.min())) if a.size else 0 for a in arrays)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry of a codebook, ties to the lower index, and the squared distance, exact."""
    most = _size(x, book) ** 2 * max(1, x.shape[1])
    if most < 1 << 53:
        rows, entries = x.astype(np.float64), book.astype(np.float64)
        score = (entries * entries).sum(1) - 2 * (rows @ entries.T)
        at = score.argmin(1)
        return at, (score[np.arange(len(x)), at] + (rows * rows).sum(1)).astype(np.int64)
    if most >= 1 << 62:
        x, book = x.astype(object), book.astype(object)
    far = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _limbs(value: int):
    k = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value >>= LIMB
        k += 1
    yield k, value


def moves(x: np.ndarray, was: np.ndarray, now: np.ndarray, part: int, entries: int) -> list[tuple[int, int, int, int]]:
    """What the parts that changed their entry (was -1: had none) add to counts (at -1) and sums: (cell, at, limb, value)."""
    changed = np.flatnonzero(was != now)
    if not len(changed):
        return []
    rows = x[changed] if _size(x) * (len(x) + 1) < LONG else x[changed].astype(object)
    rows = np.concatenate([np.ones((len(rows), 1), rows.dtype), rows], 1)
    sums = np.zeros((entries, rows.shape[1]), rows.dtype)
    np.add.at(sums, now[changed], rows)
    had = was[changed] >= 0
    np.subtract.at(sums, was[changed][had], rows[had])
    touched = np.unique(np.concatenate([now[changed], was[changed][had]]))
    return [(part * entries + e, at - 1, limb, v) for e in touched.tolist() for at, value in enumerate(sums[e].tolist()) for limb, v in _limbs(int(value)) if v]


# --------------------------------------------------------------------------- slabs
def _pack(id_: str, column: str, label: str, scale: int, schema: pa.Schema):
    from pyspark import TaskContext

    def slab(number: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, labels, lengths, values = (x[0] if len(x) == 1 else pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*rows, strict=True))
        width = int(lengths.max())
        x = np.zeros((len(lengths), width))
        x[np.arange(width) < lengths[:, None]] = values
        whole = integers(x, scale)
        kind = "f8" if whole.dtype == object else next(k for k in ("i2", "i4", "i8") if _size(whole) <= np.iinfo(k).max)
        raw = x if kind == "f8" else whole.astype(kind)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([number, len(x), width, kind, np.ascontiguousarray(raw).tobytes()], schema.types, strict=False)] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), v) for v in (ids, labels)], names=schema.names)

    def run(batches):
        number, rows, count, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            get = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            vectors = get(column)
            lengths = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            start = 0
            while start < len(vectors):
                stop = start + max(1, min(SLAB_ROWS - count, int(np.searchsorted(ends, ends[start] + (SLAB_BYTES - size) // 8, side="right")) - 1 - start))
                rows.append((get(id_).slice(start, stop - start), get(label).slice(start, stop - start), lengths[start:stop], values[ends[start] : ends[stop]]))
                count, size = count + stop - start, size + 8 * int(ends[stop] - ends[start])
                start = stop
                if count >= SLAB_ROWS or size >= SLAB_BYTES:
                    yield slab(number, rows)
                    number, rows, count, size = number + 1, [], 0, 0
        if rows:
            yield slab(number, rows)

    return run


def _bucketed(df: DataFrame, buckets: int) -> str:
    """df as a table in the shared folder whose files are dealt by slab; its name in the catalog."""
    name = f"slabs_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "slab").option("path", c.scratch_dir(df.sparkSession)).option("compression", "zstd").saveAsTable(name)
    return name


def _unpack(batch: pa.RecordBatch, i: int, dims: int, scale: int) -> np.ndarray:
    get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_py()
    x = np.frombuffer(get("vectors"), get("kind")).reshape(get("n"), get("width"))
    x = integers(x, scale) if x.dtype == np.float64 else x.astype(np.int64)
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def firsts(kept: DataFrame, id_: str, column: str, entries: int) -> list[list[float]]:
    """The vectors of the smallest different ids in order; of a repeated id, the smallest vector."""
    found: list[tuple] = []
    rows = kept.select(F.col(id_).alias("i"), F.col(column).alias("v"))
    while len(found) < entries:
        after = F.lit(True)
        if found:
            after = F.lit(False) if found[-1][0] is None else F.col("i").isNull() | (F.col("i") > F.lit(found[-1][0]))
        # A task sends its first rows alone; an id repeated more often than that is passed over in the next round.
        new = rows.where(after).orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()
        if not new:
            break
        for r in new:
            if len(found) < entries and (not found or found[-1][0] != r["i"]):
                found.append((r["i"], r["v"]))
    return [v for _, v in found]


# --------------------------------------------------------------------------- fit, assign
@dataclass
class Fitted:
    """Slabs (name of a table), and the codebooks: an array (entries, part's length) for each part position."""

    slabs: str
    scale: int
    codebooks: list[np.ndarray]
    rounds: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for entry in book.tolist() for v in entry).encode()).hexdigest()


def fit(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Fitted:
    """Codebooks after the given rounds over all valid vectors."""
    spark = vectors.sparkSession
    c.small_batches(spark)
    kept = vectors.where(valid(column)).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("x"))
    kind = T.StructType([T.StructField("slab", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("vectors", T.BinaryType()), T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType))])
    arrow = pa.schema([("slab", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("ids", pa.null()), ("labels", pa.null())])
    packed = c.save(kept.mapInArrow(_pack("id", "x", "label", scale, arrow), kind))
    size = packed.agg(F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0)).alias("bytes"), F.coalesce(F.max("width"), F.lit(0)).alias("width")).first()
    buckets = min(MOST_BUCKETS, c.partitions(spark, size["bytes"], BUCKET_BYTES))
    slabs = _bucketed(packed.repartition(buckets, "slab"), buckets)
    dims = parts * max(1, -(-size["width"] // parts))
    first = np.array([v + [0.0] * (dims - len(v)) for v in firsts(kept, "id", "x", entries)], np.float64).reshape(-1, dims)
    whole, k = integers(first, scale), len(first)
    books = [whole[:, p * (dims // parts) : (p + 1) * (dims // parts)] for p in range(parts)]
    before, sums, done = None, None, 0
    while k and done < rounds:
        done += 1
        now = _bucketed(_assigned(spark, slabs, before, books, dims, scale), buckets)
        if before:
            spark.sql(f"DROP TABLE {before}")
        before = now
        moved = spark.table(now).select(F.inline("moves")).select("cell", "at", "limb", F.col("value").cast("decimal(20,0)").alias("value"))
        moved = moved.groupBy("cell", "at", "limb").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
        if sums is not None:
            moved = sums.unionByName(moved).groupBy("cell", "at", "limb").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
        moved = c.save(moved)
        new = _means(moved, books, k)
        still = all((a == b).all() for a, b in zip(new, books, strict=True))
        books, sums = new, moved
        if still:  # no entry moves, so no part will
            break
    if before:
        spark.sql(f"DROP TABLE {before}")
    return Fitted(slabs, scale, books, done)


def _assigned(spark, slabs: str, before: str | None, books: list[np.ndarray], dims: int, scale: int) -> DataFrame:
    parts, k = len(books), len(books[0])
    rows = spark.table(slabs).select("slab", "n", "width", "kind", "vectors")
    if before:  # both tables are dealt by slab alike: a join without an exchange, the narrow side hashed
        rows = rows.join(spark.table(before).select("slab", "codes").hint("shuffle_hash"), "slab")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpack(batch, i, dims, scale)
                was = np.full((len(x), parts), -1) if not before else np.frombuffer(batch.column(batch.schema.get_field_index("codes"))[i].as_py(), np.uint16).reshape(-1, parts).astype(np.int64)
                now = np.empty((len(x), parts), np.uint16)
                changes = []
                for p, book in enumerate(books):
                    part = x[:, p * book.shape[1] : (p + 1) * book.shape[1]]
                    now[:, p] = nearest(part, book)[0]
                    changes += moves(part, was[:, p], now[:, p].astype(np.int64), p, k)
                cells = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(zip(*changes, strict=True) if changes else [[]] * 4, [pa.int32()] * 3 + [pa.int64()], strict=True)], names=["cell", "at", "limb", "value"])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("slab")).slice(i, 1), pa.array([now.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), cells)], names=["slab", "codes", "moves"])

    return rows.mapInArrow(run, f"slab long, codes binary, {MOVES}")


def _means(sums: DataFrame, books: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Codebooks of the running sums; an entry without parts stays."""
    total: dict[tuple[int, int], int] = {}
    for r in sums.collect():  # a row for each entry's count and components, as many at any size of the input
        total[r["cell"], r["at"]] = total.get((r["cell"], r["at"]), 0) + (int(r["value"]) << LIMB * r["limb"])
    out = []
    for p, book in enumerate(books):
        rows = [[total.get((cell, i), 0) // total[cell, -1] for i in range(book.shape[1])] if total.get((cell := p * k + e, -1), 0) else book[e].tolist() for e in range(k)]
        new = np.array(rows, object).reshape(book.shape)
        out.append(new.astype(np.int64) if _size(new) < 1 << 62 else new)
    return out


def assign(spark, fitted: Fitted) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distances summed over parts) of every kept vector."""
    books, scale = fitted.codebooks, fitted.scale
    dims = sum(b.shape[1] for b in books)
    slabs = spark.table(fitted.slabs)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpack(batch, i, dims, scale)
                codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), object)
                for p, book in enumerate(books):
                    codes[:, p], far = nearest(x[:, p * book.shape[1] : (p + 1) * book.shape[1]], book)
                    error += far
                raw, width = codes.tobytes().hex(), 2 * len(books)
                ids, labels = (batch.column(batch.schema.get_field_index(n))[i].values for n in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([raw[j * width : (j + 1) * width] for j in range(len(x))], pa.string()), pa.array([min(int(e), LONG) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    kind = T.StructType([T.StructField("id", slabs.schema["ids"].dataType.elementType), T.StructField("label", slabs.schema["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return slabs.select("n", "width", "kind", "vectors", "ids", "labels").mapInArrow(run, kind)


def encode(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", label: str = "label", **how) -> DataFrame:
    """Every kept vector's id, label, code, error, its label's summed error, and a digest of the codebooks."""
    spark = vectors.sparkSession
    fitted = fit(vectors, id, column, label, **how)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("__label")  # nulls are one label
    rows = c.save(assign(spark, fitted).select("*", key))
    spark.sql(f"DROP TABLE {fitted.slabs}")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = c.save(rows.groupBy("__label").agg(total.alias("label_error")))
    return c.join_split(rows, sums, "__label").select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", F.lit(fitted.sha256()).alias("codebooks_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return encode(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out one after the other, all parts assigned anew in each."""
    near = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, e, d FROM (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM x JOIN b{r} USING (p, i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""  # noqa: E731
    mean = lambda r: f"""b{r + 1} AS MATERIALIZED (
  SELECT p, e, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS c
  FROM b{r} LEFT JOIN (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL) USING (p, e, i))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{mean(r)}" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, j // (len(v) // {parts}) AS p, j % (len(v) // {parts}) AS i, v[j + 1] AS x FROM kept, unnest(range(len(v))) AS t(j)
), b0 AS MATERIALIZED (
  SELECT p, e, i, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {entries}
),
{steps},
{near(rounds)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label
"""


OP11_SQL = _lloyd_sql()
