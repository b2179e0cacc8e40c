"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then doc_id, so equal texts lie together.
Size-weighted samples of keys are drawn (each record with a chance in proportion to its size,
decided by a hash, so a task that runs again draws the same); their quantiles cut the key space
into ranges, many more than shards.  Exact totals per range find overfull ranges, which are
subdivided by denser samples of their own.  Within a range records are ordered and their sizes
summed; with the totals of the ranges before it every record knows how many bytes lie before it,
and so its shard: shards hold near-equal bytes and consecutive keys.  A shard's edge moves to
the nearest end of the group of equal texts it falls into if that costs at most EDGE of a
shard; larger groups are split there.

Law: `bytes`.  A shard's size differs from total / shards by less than EDGE of it at each end, or by
less than the size of the largest text.  A group of equal texts is split only where keeping it whole
would cost more than that: kept whole, a group of a third of all bytes would fill two shards and leave
others short by the same.

What comes to the driver is bounded whatever the input: at most MOST_RANGES ranges (of more bytes
each then), SAMPLES_PER_RANGE keys for each of them on average (24 bytes a key), eight times that in
the ranges that are subdivided, and one row of totals per range.

Defined cases: null text has size 1 and groups with empty text; rows without doc_id order first
within their text; equal rows take consecutive slots in any order, and as no key can part them, rows of
one doc_id and text that are repeated very often stay in one range, however large; very long texts may leave
shards empty (a text is never split); an empty table gives an empty table.  Columns pass
through; columns named size, text_crc32, shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SHARDS = 8
#: Samples a range gets on average.
SAMPLES_PER_RANGE = 8
#: Sum of sizes that a range should have, and the least and greatest number of ranges.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 64 << 20, 1024, 32_768
#: Part of a shard by which its edge may move so that equal texts stay together.
EDGE = 0.005


Keys = tuple[np.ndarray, np.ndarray]


def _draw(rows: DataFrame, rate, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys drawn with chance size * rate (at most 1), and their weights; the draw is a hash, not a random number."""
    u = F.pmod(F.xxhash64("__h", "__id", "text_crc32", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(u < F.col("__w") * rate).select("__h", "__id", F.greatest(F.lit(1.0), F.col("__w") * rate).alias("w")).toArrow()
    h, i, w = (got.column(k).to_numpy() for k in range(3))
    order = np.lexsort((w, i, h))
    return h[order], i[order], w[order]


def _quantiles(h: np.ndarray, i: np.ndarray, w: np.ndarray, ranges: int) -> Keys:
    """The keys (in order) at the ends of equal shares of their weight."""
    if not len(h) or ranges < 2:
        return h[:0], i[:0]
    total = np.cumsum(w)
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return _distinct(h[at], i[at])


def _distinct(h: np.ndarray, i: np.ndarray) -> Keys:
    order = np.lexsort((i, h))
    h, i = h[order], i[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
    return h[new], i[new]


def _below(splitters: Keys, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many splitters are at most each key."""
    h, i = splitters
    out = np.searchsorted(h, x, side="left")
    top = np.searchsorted(h, x, side="right")
    for j in np.flatnonzero(out < top):  # the hash of a group that has splitters inside
        out[j] += np.searchsorted(i[out[j] : top[j]], y[j], side="right")
    return out.astype(np.int32)


def _locate(splitters: Keys):
    """A column function: the range of a key."""

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_below(splitters, a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return place


def _totals(rows: DataFrame, splitters: Keys) -> dict[int, tuple[int, int, float]]:
    by = rows.groupBy(_locate(splitters)("__h", "__id").alias("r")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum("__w").alias("w"))
    return {r["r"]: (r["size"], r["n"], r["w"]) for r in by.collect()}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, shard (0 to shards - 1, near-equal bytes) and slot (gapless from 0 in each shard)."""
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(raw), "__h": F.xxhash64(raw), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))})
    keys = c.save(rows.select("__h", "__id", "size", "text_crc32"))
    all_ = keys.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not all_["n"]:
        return docs.withColumns({"size": F.lit(0).cast("long"), "text_crc32": F.lit(0).cast("long"), "shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)

    # Weight: the size, and a mean size for the record itself, so that no range has very many small records.
    weight = F.col("size") + F.lit(all_["size"] / all_["n"])
    rows, keys = rows.withColumn("__w", weight), keys.withColumn("__w", weight)
    total = 2.0 * all_["size"]
    ranges = min(MOST_RANGES, max(LEAST_RANGES, all_["size"] // RANGE_BYTES))
    splitters = _quantiles(*_draw(keys, F.lit(SAMPLES_PER_RANGE * ranges / total), 1), ranges)
    totals = _totals(keys, splitters)
    for attempt in range(2, 5):  # subdivide overfull ranges by samples of their own
        over = {r: min(64, int(np.ceil(w * ranges / total))) for r, (_, n, w) in totals.items() if w > 2 * total / ranges and n > 1}
        if not over:
            break
        part = keys.withColumn("r", _locate(splitters)("__h", "__id")).where(F.col("r").isin(list(over)))
        h, i, w = _draw(part.select("__h", "__id", "text_crc32", "__w"), F.lit(8 * SAMPLES_PER_RANGE * ranges / total), attempt)
        of = _below(splitters, h, i)  # in order, as the keys are
        cuts = [_quantiles(*(x[slice(*np.searchsorted(of, [r, r + 1]))] for x in (h, i, w)), n) for r, n in over.items()]
        more = _distinct(*(np.concatenate([a, *b]) for a, b in zip(splitters, zip(*cuts, strict=True), strict=True)))
        if len(more[0]) == len(splitters[0]):
            break
        splitters = more
        totals = _totals(keys, splitters)

    before, starts = (0, 0), {}
    for r in sorted(totals):
        starts[r] = before
        before = (before[0] + totals[r][0], before[1] + totals[r][1])
    edges = _edges(keys, splitters, starts, all_["size"], all_["n"], shards)

    spark = docs.sparkSession
    base = spark.createDataFrame([(r, *x) for r, x in starts.items()], "__r int, __b long, __n long")
    order = Window.partitionBy("__r").orderBy("__h", "__id", "text_crc32", "size")
    placed = rows.withColumn("__r", _locate(splitters)("__h", "__id"))
    placed = placed.withColumns({"__in": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "__k": F.row_number().over(order) - 1})
    placed = placed.join(F.broadcast(base), "__r").withColumn("__at", F.col("__b") + F.col("__in"))
    index = sum((F.when(F.col("__at") >= e, 1).otherwise(0) for e, _ in edges), F.lit(0))
    first = F.element_at(F.array(F.lit(0).cast("long"), *[F.lit(n).cast("long") for _, n in edges]), (index + 1).cast("int"))
    return placed.select(*docs.columns, "size", "text_crc32", index.cast("int").alias("shard"), (F.col("__n") + F.col("__k") - first).cast("long").alias("slot"))


def _edges(keys: DataFrame, splitters, starts, size: int, rows: int, shards: int) -> list[tuple[int, int]]:
    """Bytes and rows before each shard but the first, moved to a group's end where that is near."""
    place = _locate(splitters)
    order = Window.partitionBy("__r").orderBy("__h", "__id", "text_crc32", "size")
    wanted = [size * (i + 1) // shards for i in range(shards - 1)]
    ranges = sorted(starts)
    tops = {r: (starts[ranges[i + 1]][0] if i + 1 < len(ranges) else size) for i, r in enumerate(ranges)}
    near = [r for r in ranges if any(starts[r][0] - size * EDGE / shards <= w <= tops[r] + size * EDGE / shards for w in wanted)]
    here = keys.withColumn("__r", place("__h", "__id")).where(F.col("__r").isin(near))
    base = keys.sparkSession.createDataFrame([(r, *starts[r]) for r in near], "__r int, __b long, __n long")
    here = here.withColumns({"__in": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "__k": F.row_number().over(order) - 1, "__new": F.coalesce(F.lag("__h").over(order) != F.col("__h"), F.lit(False))})
    here = here.join(F.broadcast(base), "__r").select((F.col("__b") + F.col("__in")).alias("at"), (F.col("__n") + F.col("__k")).alias("n"), "__new")
    here = c.save(here)
    out = []
    for w in wanted:
        best = here.agg(
            F.min(F.struct(F.abs(F.col("at") - w).alias("d"), "at", "n")).alias("near"),
            F.min(F.when(F.col("__new") & (F.abs(F.col("at") - w) <= size * EDGE / shards), F.struct(F.abs(F.col("at") - w).alias("d"), "at", "n"))).alias("whole"),
        ).first()
        if best["whole"]:
            out.append((best["whole"]["at"], best["whole"]["n"]))
        else:  # the record that begins nearest, which may be the first of a later range
            ends = [*starts.values(), (size + 1, rows), *([(best["near"]["at"], best["near"]["n"])] if best["near"] else [])]
            out.append(min(ends, key=lambda x: (abs(x[0] - w), x)))
    return sorted(out)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
