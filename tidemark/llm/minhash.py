"""Near duplicates by b-bit MinHash: bands propose, packed low bits estimate, full sets decide.

1.  One pass gives every document the number of its distinct word shingles, a digest of its
    normalised words, BANDS band keys (each of ROWS minima), and a signature: the smallest shingle
    code in each of BINS bins of the code space, of which BITS low bits are kept and packed (1 to 15;
    0: an empty bin).  The minima themselves are not kept.
2.  Documents of equal words (by BLAKE2b of them) become one class; from here on only classes travel.
3.  In each band bucket every member is paired with the bucket's smallest member (an aggregate,
    combined before the shuffle, joined back; no bucket is gathered and no bucket emits all its
    pairs).  Bit counts of the packed signatures give the similarity, corrected for the one in
    15 of low bits that agree by chance; pairs SIGMAS standard deviations below the threshold go.
4.  For each member one hub is confirmed on full shingle sets, and components are formed.
5.  Where a bucket still holds members of several components, its members outside the bucket's
    commonest component meet all members of other components (in lanes of LANE members, so that
    a large bucket is spread over many tasks), so every pair of classes that shares a bucket ends in
    one component or is compared.  A pair is put out in the first bucket that it shares, if the
    estimate does not rule it out; full sets confirm it: first the likeliest pair of each two
    components, then those whose components that has not joined.

Shingle codes are 64-bit hashes and only find what may be equal: full sets are compared by the words'
bytes, and shingles are counted by them.  Buckets, hubs and classes of very many rows are joined by
common.join_split and don't meet in one task.  Steps 3 and 4 leave few components in a bucket where
texts are alike; m members of small components in a bucket of n cost m * n comparisons of signatures.

With 32 bands of 4 rows a pair at similarity 0.75 shares no bucket with a chance of 5e-6; the estimate
rules out a pair at the threshold with a chance of about 3e-5, and less above it.

Defined cases: text null, empty or without words: an empty set, linked with nothing.  Fewer
words than a shingle: the whole sequence is the one shingle.  Rows with equal doc_id count as one
document for links (they are in one component).  Rows without doc_id link nothing, have no
component and are kept.  Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .graph import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
PERMS = BANDS * ROWS
BINS, BITS = 512, 4
#: Standard deviations of the estimate by which a pair may miss the threshold and still be confirmed.
SIGMAS = 4.0
#: Members of one side that a task holds while those of the other pass by.
LANE = 4096
#: Up to so many ids (8 bytes each) are broadcast to pick texts by id; beyond it ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members that one task compares with a hub before the hub's members are spread over more.
HUB_MEMBERS = 400

_random = np.random.default_rng(977)
FACTORS = _random.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 1 << 63, PERMS, dtype=np.uint64)
SIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
)


class Shingles:
    """The distinct shingles of each text of a block, one text after another: codes, their bounds, first words, exact counts."""

    def __init__(self, raw: list[bytes], k: int = SHINGLE):
        self.k = k
        self.words = words = c.Words(raw, lower=True)
        at, code = words.windows(k)
        doc = words.doc_of()[at]
        n = words.counts
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([c.roll(words.codes[words.first[i] : words.first[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
            doc, code, at = np.concatenate([doc, short]), np.concatenate([code, whole]), np.concatenate([at, words.first[short]])
        order = np.lexsort((code, doc))
        doc, code, at = doc[order], code[order], at[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        again = np.flatnonzero(~new)
        differ = again[~self._same(at[again], self, at[again - 1])]
        self.code, self.at = code[new], at[new]
        self.bounds = np.searchsorted(doc[new], np.arange(len(raw) + 1))
        self.count = np.diff(self.bounds)
        for i in np.unique(doc[differ]).tolist():  # one code of several shingles
            self.count[i] = len(self.exact(i))

    def _same(self, i: np.ndarray, other: Shingles, j: np.ndarray) -> np.ndarray:
        """Whether the shingles at these words are equal, for shingles of k words."""
        step = np.arange(self.k)
        return c.same_words(self.words, (i[:, None] + step).ravel(), other.words, (j[:, None] + step).ravel()).reshape(-1, self.k).all(1)

    def exact(self, i: int) -> set[tuple[bytes, ...]]:
        w = [self.words.word(x) for x in range(self.words.first[i], self.words.first[i + 1])]
        return {tuple(w[x : x + self.k]) for x in range(max(len(w) - self.k + 1, 1))} if w else set()

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.bounds[i], self.bounds[i + 1])
        return self.code[own], self.at[own]

    def common(self, i: int, other: Shingles, j: int) -> int:
        """How many shingles texts i and j of two blocks share, by their words."""
        (x, at), (y, there) = self.of(i), other.of(j)
        if not len(x) or not len(y):
            return 0
        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = y[place] == x
        if not both.any():
            return 0
        if min(self.words.counts[i], other.words.counts[j]) >= self.k and len(x) == self.count[i] and len(y) == other.count[j] and self._same(at[both], other, there[place[both]]).all():
            return int(both.sum())
        return len(self.exact(i) & other.exact(j))


def sign(k: int = SHINGLE):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for part, raw in c.blocks(batches, limit=c.BLOCK_BYTES // 2):
            own = Shingles(raw, k)
            code, bounds, n = own.code, own.bounds, own.count
            has = n > 0
            low = np.zeros((PERMS, len(raw)), np.uint64)
            if has.any():
                cuts = bounds[:-1][has]
                for i in range(PERMS):
                    low[i, has] = np.minimum.reduceat(code * FACTORS[i] + ADDENDS[i], cuts)
            keys = np.zeros((BANDS, len(raw)), np.uint64)
            for i in range(PERMS):
                keys[i // ROWS] = c.mix(keys[i // ROWS] * c.STEP + low[i] + np.uint64(i + 1))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)), pa.array(keys.T[has].ravel().view(np.int64)))
            same = [hashlib.blake2b(b" ".join(x.translate(c.LOWER).split()), digest_size=16).digest() for x in raw]
            ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(same, pa.binary()), bands, pa.array([x.tobytes() if h else None for x, h in zip(_signatures(code, bounds), has, strict=True)], pa.binary())], schema=schema)

    return run


def _signatures(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text of a block the low bits of its bins' minima, two bins to a byte."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    place = doc * BINS + (code >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(code), bool)  # codes of a text are in order, so a bin's first is its smallest
    first[1:] = place[1:] != place[:-1]
    value = np.zeros(n * BINS, np.uint8)
    value[place[first]] = c.mix(code[first]) % np.uint64((1 << BITS) - 1) + np.uint64(1)
    value = value.reshape(n, BINS)
    return value[:, 0::2] | (value[:, 1::2] << 4)


_MASK = np.uint64(int("0001" * 16, 2))


def _marks(x: np.ndarray) -> np.ndarray:
    """One bit for each group of BITS that is not zero."""
    x = x | (x >> np.uint64(1))
    return (x | (x >> np.uint64(2))) & _MASK


def _likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity from packed signatures (rows of 64-bit words), and whether it may reach the threshold.

    Of the bins that either fills, those filled by both with equal bits agree; of different minima one in 15 agrees
    by chance.  The deviation is that of a sample of the union without replacement, and of the chance agreements.
    """
    count = lambda m: np.bitwise_count(m).sum(-1, dtype=np.int64)
    mx, my = _marks(x), _marks(y)
    both = mx & my
    differ = count(_marks(x ^ y) & both)
    seen = np.maximum(count(mx | my), 1)
    others = (1 << BITS) - 2
    est = (count(both) - differ - differ / others) / seen
    j = PERCENT / 100
    sampled = np.minimum(seen * (1 + j) / (nx + ny), 1)
    spread = np.sqrt((j * (1 - j) * np.maximum(1 - sampled, 0.02) + (1 - j) / (others + 1)) / seen)
    return est, est >= j - SIGMAS * spread


def _words64(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _weigh(batches):
    """(a, b, sa, sb, na, nb) to (a, b, est) where the estimate does not rule the pair out."""
    for part in batches:
        if part.num_rows:
            na, nb = (part.column(i).to_numpy().astype(np.float64) for i in (4, 5))
            est, ok = _likely(_words64(part.column(2), BINS * BITS // 64), _words64(part.column(3), BINS * BITS // 64), na, nb)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(est[ok])], names=["a", "b", "est"])


def _meet(batches):
    """Lanes of mixed buckets, minor members first: pairs of different components, in the first bucket they share."""
    width = BINS * BITS // 64
    key, held = None, []

    def pairs(hold, rows):
        ids, comp, n, sig, bands = (np.concatenate([x[i] for x in hold]) for i in range(5))
        oid, ocomp, on, osig, obands, omain = rows
        for s in range(0, len(oid), 1024):
            e = slice(s, s + 1024)
            ok = (comp[:, None] != ocomp[None, e]) & (omain[None, e] | (ids[:, None] < oid[None, e]))
            i, j = np.nonzero(ok)
            for t in range(0, len(i), 1 << 16):
                x, y = i[t : t + (1 << 16)], j[t : t + (1 << 16)] + s
                est, fine = _likely(sig[x], osig[y], n[x], on[y])
                x, y, est = x[fine], y[fine], est[fine]
                first = (bands[x] == obands[y]).argmax(1) == key[2]
                x, y = x[first], y[first]
                yield ids[x], oid[y], est[first], comp[x], ocomp[y]

    for part in batches:
        col = {n: part.column(i) for i, n in enumerate(part.schema.names)}
        band, lane, kind, at = (col[n].to_numpy(zero_copy_only=False) for n in ("band", "lane", "kind", "at"))
        change = np.flatnonzero((np.diff(band) != 0) | (np.diff(lane) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *change], [*change, len(band)], strict=True):
            if s == e:
                continue
            here = (int(band[s]), int(lane[s]), int(at[s]))
            if here != key:
                key, held = here, []
            own = part.slice(s, e - s)
            own = {n: own.column(i) for i, n in enumerate(own.schema.names)}
            ids, comp = own["doc_id"].to_numpy(), own["component"].to_numpy()
            n, sig = own["n_shingles"].to_numpy().astype(np.float64), _words64(own["sig"], width)
            bands = own["bands"].flatten().to_numpy().reshape(-1, BANDS)
            if kind[s] == 0:
                held.append((ids, comp, n, sig, bands))
            elif held:
                for found in pairs(held, (ids, comp, n, sig, bands, own["is_main"].to_numpy(zero_copy_only=False))):
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "est", "ca", "cb"])


def _confirm(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Those of the pairs (a, b; a saved table) whose full shingle sets are similar enough.  b: the side with many partners."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bounded = pairs.count() <= BROADCAST_IDS // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if bounded else ids.hint("shuffle_hash"), "doc_id", "left_semi")
    rows = c.save(rows)
    spread = c.save(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("lanes")))
    member = c.join_split(pairs, spread, "b").select("a", "b", F.pmod(F.xxhash64("a"), "lanes").cast("int").alias("lane"))
    member = member.join(rows, member.a == rows.doc_id).select("b", "lane", F.lit(1).alias("kind"), "a", "text")
    hub = spread.join(rows, spread.b == rows.doc_id).select("b", F.explode(F.sequence(F.lit(0), (F.col("lanes") - 1).cast("int"))).alias("lane"), F.lit(0).alias("kind"), F.col("b").alias("a"), "text")
    both = hub.unionAll(member)
    both = both.repartition(c.partitions(spark, 0, 1), "b", "lane").sortWithinPartitions("b", "lane", "kind")

    def run(batches):
        key, base = None, []
        for part, raw in c.blocks(batches):
            own = Shingles(raw, k)
            b, lane, kind, a = (part.column(i).to_pylist() for i in range(4))
            found = []
            for i in range(len(raw)):
                if kind[i] == 0:  # rows with one doc_id have a hub row each
                    base = [*(base if key == (b[i], lane[i]) else []), (own, i)]
                    key = b[i], lane[i]
                elif key == (b[i], lane[i]):
                    for other, j in base:
                        both_ = own.common(i, other, j)
                        if both_ and 100 * both_ >= PERCENT * (int(own.count[i]) + int(other.count[j]) - both_):
                            found.append((a[i], b[i]))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return c.save(both.mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs; see the module for the method and defined cases."""
    spark = docs.sparkSession
    c.small_batches(spark)
    signed = c.save(docs.select("doc_id", "text").mapInArrow(sign(k), SIGNED))

    # Classes of equal words.
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = c.save(classes)
    copied = c.often_keys(some, "same")

    # Rows with one doc_id but different texts are one document: link their classes.
    twice = some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = some.join(twice, "doc_id", "left_semi").join(classes.select("same", F.col("doc_id").alias("rep")), "same")
    again = again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    keys = classes.select("doc_id", F.posexplode("bands").alias("at", "band"))
    buckets = c.save(keys.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    filled = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    full = [r["band"] for r in buckets.where(F.col("n") > max(filled // c.OFTEN, 100)).select("band").collect()]
    members = c.save(c.join_split(keys, buckets.select("band", "hub"), "band", full))
    pairs = members.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = c.save(pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a"))
    pairs = c.join_split(pairs, classes.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b")
    hubs = pairs.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_weigh, "a long, b long, est double")
    # First the smallest hub that is very likely a link, else the likeliest.
    rank = F.when(F.col("est") >= PERCENT / 100 + 0.05, F.struct(F.lit(1).alias("sure"), (-F.col("b")).alias("by"))).otherwise(F.struct(F.lit(0).alias("sure"), (F.col("est") * 1_000_000).cast("long").alias("by")))
    best = c.save(hubs.groupBy("a").agg(F.max_by("b", rank).alias("b")))
    links = _confirm(docs, best, k).unionAll(again)
    comp = components(links)

    # Buckets of several components: those outside the commonest, against all the others.
    placed = c.save(members.select("band", "at", "doc_id").join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most").withColumn("lanes", F.ceil((F.col("all") - F.col("most")) / LANE).cast("int")).drop("all", "most")
    there = c.join_split(placed, c.save(mixed), "band", full).join(classes.select("doc_id", "n_shingles", "sig", "bands"), "doc_id")
    there = there.withColumn("is_main", F.col("component") == F.col("main"))
    rest = ["doc_id", "component", "n_shingles", "sig", "bands", "is_main"]
    minor = there.where("not is_main").select("band", F.pmod(F.xxhash64("doc_id"), "lanes").cast("int").alias("lane"), "at", F.lit(0).alias("kind"), *rest)
    others = there.select("band", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "at", F.lit(1).alias("kind"), *rest)
    lanes = minor.unionAll(others).repartition(c.partitions(spark, 0, 1), "band", "lane").sortWithinPartitions("band", "lane", "kind")
    met = c.save(lanes.mapInArrow(_meet, "a long, b long, est double, ca long, cb long").join(best, ["a", "b"], "left_anti"))
    if not met.isEmpty():
        two = (F.least("ca", "cb"), F.greatest("ca", "cb"))
        likeliest = c.save(met.groupBy(*two).agg(F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b"))
        links = links.unionAll(_confirm(docs, likeliest, k))
        comp = components(links)
        now = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"now_{x}"))
        left = met.select("a", "b").join(likeliest, ["a", "b"], "left_anti").join(now("a"), "a", "left").join(now("b"), "b", "left")
        left = c.save(left.where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b"))
        if not left.isEmpty():
            links = links.unionAll(_confirm(docs, left, k))
            comp = components(links)

    reps = classes.select("same", F.col("doc_id").alias("rep")).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    reps = c.save(reps.select("same", F.coalesce("component", "rep").alias("component")))
    alone = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") <= 0), F.col("doc_id")).alias("component_id"))
    own = c.join_split(some.select("doc_id", "n_shingles", "same"), reps, "same", copied).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
