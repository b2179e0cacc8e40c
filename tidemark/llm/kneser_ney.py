"""Quality by an interpolated modified Kneser-Ney model of trusted text, over pairs of words.

Words: runs of letters and digits as they are (nothing is folded), runs of marks, and single characters
of scripts written without blanks; every text has an opening before its first word.

1.  Slabs of trusted documents count their pairs.  Shards, dealt by the pair's context (those of often
    words by the pair), add them up, and give out pairs seen CUT times or more, what each word and each
    context has, and how many pairs were seen 1, 2, 3, 4 times: tables that grow with the trusted text.
    Counts of counts give the discounts.  Pairs below CUT give their whole count to the lower order.
2.  With them, a text's log probability is the unknown word's for each of its words, plus a gain for each
    known word and pair, plus the log back-off weight of each known word that stands before another: words,
    pairs and contexts (grams) are looked up independently, and only sums meet.
3.  Every document's grams, with how often each document of a slab has them, are dealt to the model's
    shards, joined there, and come back as sums per document of the slab.  Two things of bounded size go
    to the tasks before, so that less is dealt: the HOT grams most often said, and a Bloom filter of
    2**FILTER_BITS bits, by which grams that the model can't know are left out (a model of very many
    grams fills it, and it lets through what the join then finds unknown; the sums are the same).
4.  The nats per word of short documents are drawn to the language's median, as if PRIOR words of it came
    with them: the score, whose exponential is the smoothed perplexity.  A document is rejected if its
    score is above the QUANTILE of its language's trusted documents (counted in bins of 0.001, so
    nothing is gathered).

Which documents are trusted: labels.quality = 1.  A trusted document's own grams count as unknown if no
other trusted text has them.  Languages with fewer than LEAST trusted documents use the distribution of
all languages.  Repeated words and lines have low perplexity, and are not this model's business.

Defined cases: null or empty text has no words, no perplexity, and is kept; a null language is a
language of its own; repeated labels count once; unlabelled rows and rows without doc_id are
scored like others; without any trusted text all is kept; an empty table gives an empty table.
Columns pass through; those named like a new one (n_words, nats, perplexity, score, threshold, kept)
are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

QUANTILE, PRIOR, LEAST = 0.998, 20, 30
#: Pairs must be seen so often in trusted text to have a probability of their own.
CUT = 2
#: Trusted ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Languages whose bounds (a row each) may be broadcast.
BROADCAST_LANGUAGES = 10_000
#: Words of the model (40 bytes each, as words and as contexts) that may be broadcast to its pairs; more are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
#: Grams (24 bytes each) whose gains go to all tasks, and the bits of the filter of all grams.
HOT, FILTER_BITS = 1 << 19, 26
#: Bytes of the filter that are put together at once.
PIECE = 1 << 16
#: Text bytes whose grams a task joins before it gives them out.
SLAB_BYTES = 3 << 20
#: Pairs and grams that a shard should hold, and text bytes whose sums a task brings together.
SHARD_ROWS, SUM_BYTES = 1_000_000, 64 << 20
#: Text bytes sampled to find often words (it only plans).
PLAN_BYTES = 8 << 20

#: Kinds of bytes: 1 letters, digits and all beyond ASCII; 2 marks.
KINDS = c.ALNUM.astype(np.uint8)
KINDS[~(c.ALNUM | c.SPACES)] = 2
#: Characters of scripts written without blanks (East and South-East Asian): each is a word of its own.
UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")
#: Words are told apart by 40 bits of their codes, and a shard's grams too, so that they travel in five bytes: of a
#: billion words one in a thousand shares its code with another, and both then have the probability of the two.
SHORT = np.uint64((1 << 40) - 1)
#: The word before each text, and what tells contexts from words.
OPENING, CONTEXT = np.uint64(0x6C63D0876A), np.uint64(0x51D7348F7C2A6E03)


# --------------------------------------------------------------------------- words and grams
def units(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of a block: the code of the word before, its own, and its text's index."""
    w = c.Words([UNSPACED.sub(rb" \g<0> ", x) for x in raw], kind=KINDS)
    codes = w.codes & SHORT
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[w.first[:-1][w.counts > 0]] = OPENING
    return before, codes, w.doc_of()


def as_context(before: np.ndarray) -> np.ndarray:
    """The gram of a word as what stands before another."""
    return c.mix(before ^ CONTEXT)


def _five(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def pair_code(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x << np.uint64(1) | x >> np.uint64(63)) ^ b


def _sql_pair(x, b):
    return F.shiftleft(x, 1).bitwiseOR(F.shiftrightunsigned(x, 63)).bitwiseXOR(b)  # as pair_code


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _packed(part: int, *arrays: np.ndarray) -> tuple[int, list[int], int, bytes]:
    """Arrays as one compressed value: (part, their lengths, bytes, value)."""
    load = b"".join(x.tobytes() for x in arrays)
    return int(part), [len(x) for x in arrays], len(load), pa.compress(load, "zstd", asbytes=True)


def _unpacked(sizes: list[int], raw: int, load: bytes, kinds: tuple) -> list[np.ndarray]:
    data, at, out = pa.decompress(load, raw, "zstd", asbytes=True), 0, []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def often_contexts(docs: DataFrame, total_bytes: int) -> np.ndarray:
    """Codes of the opening and of words that more than one in OFTEN words of a sample is: at most OFTEN."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total_bytes // PLAN_BYTES))) == 0).select("text")

    def count(batches):
        for _, raw in c.blocks(batches):
            code, n = np.unique(units(raw)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(code), pa.array(n)], names=["b", "n"])

    counts = c.save(some.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = counts.where(F.col("n") > max(1, total // c.OFTEN)).select("b").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(np.append(found, OPENING))


# --------------------------------------------------------------------------- the model
PAIRS = "part int, sizes array<int>, raw int, load binary"
COUNTS = "kind int, x long, b long, n long, n1 long, n2 long, n3 long, n4 long"


def _pairs(shards: int, often: np.ndarray):
    """The pairs of each slab of texts, for their shards: contexts, how many words follow each, the words, counts."""

    def run(batches):
        for _, raw in c.blocks(batches, limit=SLAB_BYTES):
            a, b, _ = units(raw)
            if not len(b):
                continue
            x = as_context(a)
            code, first, n = np.unique(pair_code(x, b), return_index=True, return_counts=True)
            a, b, x = a[first], b[first], x[first]
            deal = np.where(np.isin(a, often), c.mix(code), x) % np.uint64(shards)
            order = np.lexsort((a, deal))
            a, b, n, deal = a[order], b[order], n[order].astype(np.uint32), deal[order]
            cut = np.flatnonzero(np.diff(deal, prepend=np.uint64(1 << 63)))
            rows = []
            for s, e in zip(cut, [*cut[1:], len(a)], strict=True):
                head = np.flatnonzero(np.diff(a[s:e], prepend=~a[s : s + 1]))
                rows.append(_packed(deal[s], _five(a[s:e][head]), np.diff(np.append(head, e - s)).astype(np.uint32), _five(b[s:e]), n[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.binary()), strict=True)], names=["part", "sizes", "raw", "load"])

    return run


def _add_up(cut: int):
    """A shard's pairs: those seen cut times or more (kind 2), and parts of what words (1) and contexts (0) have."""

    def run(batches):
        got = []
        for batch in batches:
            for r in batch.to_pylist():
                a, size, b, n = _unpacked(r["sizes"], r["raw"], r["load"], (np.uint8, np.uint32, np.uint8, np.uint32))
                got.append((np.repeat(as_context(_wide(a)), size), _wide(b), n))
        if not got:
            return
        x, b, n = (np.concatenate(v) for v in zip(*got, strict=True))
        _, first, at = np.unique(pair_code(x, b), return_index=True, return_inverse=True)
        x, b, n = x[first], b[first], np.bincount(at, n).astype(np.int64)

        def batch(kind, size, **columns):
            names = COUNTS.replace(" long", "").replace(" int", "").split(", ")
            zero = np.zeros(size, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()), *(_long(columns.get(k, zero)) for k in names[1:])], names=names)

        keep = n >= cut
        yield batch(2, int(keep.sum()), x=x[keep], b=b[keep], n=n[keep])
        word, at = np.unique(b, return_inverse=True)
        yield batch(1, len(word), b=word, n=np.bincount(at, n), n1=np.bincount(at))
        context, at = np.unique(x, return_inverse=True)
        seen = {f"n{i}": np.bincount(at[(n == i) if i != 3 else (n >= 3)], minlength=len(context)) for i in (1, 2, 3)}
        # n3 counts pairs seen 3 times or more, n4 has those of 3 and of 4 times in two halves.
        exact = np.bincount(at[n == 3], minlength=len(context)) + (np.bincount(at[n == 4], minlength=len(context)) << 32)
        yield batch(0, len(context), x=context, n=np.bincount(at, n), n4=exact, **seen)

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2, D3+ of one order from its counts of counts; usual values where a count of counts is zero."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _sorted(rows: DataFrame) -> list[np.ndarray]:
    """Columns of a bounded table, in order of the first, a code."""
    got = rows.toArrow()
    columns = [got.column(i).to_numpy() for i in range(got.num_columns)]
    order = np.argsort(columns[0].view(np.uint64))
    return [columns[0].view(np.uint64)[order], *(x[order] for x in columns[1:])]


def _gain(tables, high: np.ndarray):
    """Pairs (x, b, n) to (gram, c, gain): what a pair adds to its context's back-off weight and its word's probability."""

    def run(batches):
        (context, t, back), (word, lp) = tables.value
        for batch in batches:
            x, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            n = batch.column(2).to_numpy()
            i, j = np.searchsorted(context, x), np.searchsorted(word, b)
            low = back[i] + lp[j]
            gain = np.log((n - high[np.minimum(n, 3) - 1]) / t[i] + np.exp(low)) - low
            yield pa.RecordBatch.from_arrays([_long(pair_code(x, b)), pa.array(n), pa.array(gain.astype(np.float32))], names=["gram", "c", "gain"])

    return run


def model(trusted: DataFrame, cut: int = CUT) -> tuple[DataFrame, float]:
    """(gram, c, gain) of the words, contexts and pairs of trusted texts, and the log probability of an unknown word."""
    spark = trusted.sparkSession
    total = c.text_bytes(trusted)
    shards = c.partitions(spark, total // 6, SHARD_ROWS)
    pairs = trusted.select("text").mapInArrow(_pairs(shards, often_contexts(trusted, total)), PAIRS)
    counts = c.save(pairs.repartitionById(shards, F.col("part")).mapInArrow(_add_up(cut), COUNTS))
    before = c.save(counts.where("kind = 0").groupBy("x").agg(*[F.sum(k).alias(k) for k in ("n", "n1", "n2", "n3", "n4")]))
    said = c.save(counts.where("kind = 1").groupBy("b").agg(F.sum("n").alias("c"), F.sum("n1").alias("n")))

    parts = (before, said)
    seen = before.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("n4").bitwiseAND(F.lit((1 << 32) - 1))).alias("n3"), F.sum(F.shiftright("n4", 32)).alias("n4")).first()
    high = discounts(*(float(x or 0) for x in seen))
    each = said.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)], F.sum("n").alias("n"), F.count("*").alias("words")).first()
    if not each["n"]:
        return said.select(F.col("b").alias("gram"), "c", F.lit(0.0).cast("float").alias("gain")), 0.0
    low = discounts(*(float(each[f"n{i}"]) for i in range(1, 5)))
    by = lambda n, d: F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    held = said.agg(F.sum(by(F.col("n"), low)).alias("held")).first()["held"]
    rest = held / (each["words"] + 1)
    unknown = math.log(rest / each["n"])

    words = said.select("b", "c", F.log((F.col("n") - by(F.col("n"), low) + rest) / each["n"]).alias("lp"))
    # What contexts hold back: the discounts of pairs that are kept, and pairs below the cut whole.
    back = sum((F.col(f"n{i}") * (float(i) if i < cut else high[i - 1]) for i in (1, 2, 3)), F.lit(0.0))
    before = before.select("x", F.col("n").alias("t"), F.log(back / F.col("n")).alias("back"))
    kept = counts.where("kind = 2").select("x", "b", "n")
    if each["words"] <= BROADCAST_WORDS:
        table = kept.mapInArrow(_gain(spark.sparkContext.broadcast((_sorted(before), _sorted(words.select("b", "lp")))), np.array(high)), "gram long, c long, gain float")
    else:
        both = kept.join(before, "x").join(words.select("b", "lp"), "b")
        p = (F.col("n") - by(F.col("n"), high)) / F.col("t") + F.exp(F.col("back") + F.col("lp"))
        table = both.select(_sql_pair(F.col("x"), F.col("b")).alias("gram"), F.col("n").alias("c"), (F.log(p) - F.col("back") - F.col("lp")).cast("float").alias("gain"))
    table = table.unionAll(words.select("b", "c", (F.col("lp") - unknown).cast("float"))).unionAll(before.select("x", "t", F.col("back").cast("float")))
    table = c.save(table)
    c.drop(counts, *parts)
    return table, unknown


# --------------------------------------------------------------------------- looking grams up
def _places(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (code >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (code & mask).astype(np.int64)


def _hot(table: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams most often said, fewer than HOT: those of a count that so few reach; (gram, c, gain) in order of gram."""
    by = Window.orderBy(F.desc("power"))
    # Counts in classes of a twentieth, so there are few classes whatever the table.
    power = F.floor(F.log(F.col("c").cast("double")) / math.log(1.05))
    above = table.groupBy(power.alias("power")).agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(by))
    least = above.where(F.col("above") <= (most or HOT)).agg(F.min("power").alias("p")).first()["p"]
    got = (table.limit(0) if least is None else table.where(power >= least)).select("gram", "c", "gain").toArrow()
    gram, count, gain = (got.column(i).to_numpy() for i in range(3))
    order = np.argsort(gram.view(np.uint64))
    return gram.view(np.uint64)[order], count[order], gain[order]


def bloom(table: DataFrame) -> np.ndarray:
    """A Bloom filter of the grams, 2**FILTER_BITS bits, put together piece by piece."""

    def own(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = bits.reshape(-1, PIECE)
        for i in np.flatnonzero(pieces.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(pieces[i].tobytes(), "zstd", asbytes=True)], pa.binary())], names=["piece", "bits"])

    def together(batches):
        now, bits = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["piece", "bits"])
        for batch in batches:
            for i, load in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(load, PIECE, "zstd", asbytes=True), np.uint8)
                if i != now:
                    if now is not None:
                        yield row()
                    now, bits = i, part.copy()
                bits |= part
        if now is not None:
            yield row()

    made = table.select("gram").mapInArrow(own, "piece int, bits binary").repartition(c.partitions(table.sparkSession, 0, 1), "piece").sortWithinPartitions("piece").mapInArrow(together, "piece int, bits binary")
    out = np.zeros((1 << (FILTER_BITS - 3)) // PIECE * PIECE, np.uint8).reshape(-1, PIECE)
    for r in made.toLocalIterator():
        out[r["piece"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("__key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("gain", T.DoubleType())])
ASKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("slab", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("c", T.LongType()), T.StructField("gain", T.FloatType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("raw", T.IntegerType()), T.StructField("load", T.BinaryType()), T.StructField("docs", T.ArrayType(DOC))])
SUMS = T.StructType([T.StructField("part", T.IntegerType()), *[ASKED[n] for n in ("slab", "sizes", "raw", "load", "docs")]])
_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("__key", pa.int64()), ("n_words", pa.int64()), ("gain", pa.float64())]))
_ASKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("slab", pa.int64()), ("gram", pa.int64()), ("c", pa.int64()), ("gain", pa.float32()), ("sizes", pa.list_(pa.int32())), ("raw", pa.int32()), ("load", pa.binary()), ("docs", _DOC)])
_SUMS = pa.schema([("part", pa.int32()), *[_ASKED.field(n) for n in ("slab", "sizes", "raw", "load", "docs")]])


def _counted(own: np.ndarray, doc: np.ndarray, n: np.ndarray, count: np.ndarray, gain: np.ndarray, docs: int) -> np.ndarray:
    """Sums by document of n times gain; a trusted document's own grams only if others have them too."""
    return np.bincount(doc, np.where(~own[doc] | (count > n), n * gain, 0.0), docs)


def _ask(shards: int, known):
    """A slab's grams for the model's shards (kind 1), and its documents with the gains of hot grams (kind 2)."""

    def run(batches):
        hot, count, gain, bits = known.value
        task = TaskContext.get()
        slab = (task.partitionId() if task else 0) << 32
        for part, raw in c.blocks(batches, limit=SLAB_BYTES):
            a, b, doc = units(raw)
            x = as_context(a)
            key = c.long_array(part.column(part.schema.get_field_index("__key")))
            own = key & 1 == 1
            words = np.bincount(doc, minlength=len(raw))
            gram, at = np.concatenate([b, x, pair_code(x, b)]), np.tile(doc.astype(np.int32), 3)
            del a, b, x, doc
            order = np.argsort(gram, kind="stable")
            gram, at = gram[order], at[order]
            del order
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            first = np.flatnonzero(new | np.append(True, at[1:] != at[:-1])[: len(gram)])
            n = np.diff(np.append(first, len(gram)))
            which = np.cumsum(new)[first] - 1  # the posting's gram
            at, gram = at[first], gram[new]
            sums = np.zeros(len(raw))
            open_ = np.zeros(len(gram), bool)
            if len(gram) and len(hot):
                place = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
                found = hot[place] == gram
                mine = found[which]
                p = place[which[mine]]
                sums = _counted(own, at[mine], n[mine], count[p], gain[p], len(raw))
                open_ = ~found
                for spot in _places(gram):
                    open_ &= bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1
            doc_id = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            lang = part.column(part.schema.get_field_index("lang")).to_pylist()
            docs = [{"doc_id": i, "lang": l, "__key": k, "n_words": w, "gain": g} for i, l, k, w, g in zip(doc_id, lang, key.tolist(), words.tolist(), sums.tolist(), strict=True)]
            rows = [{"part": int(c.mix(np.array([slab], np.uint64))[0] % np.uint64(shards)), "kind": 2, "slab": slab, "docs": docs}]
            deal = c.mix(gram) % np.uint64(shards)
            some = np.flatnonzero(open_[which])
            some = some[np.argsort(deal[which[some]], kind="stable")]
            w = which[some]
            head = np.flatnonzero(np.diff(w, prepend=-1))
            share = np.append(head, len(w))
            deals = deal[w[head]]
            cut = np.flatnonzero(np.diff(deals, prepend=np.uint64(1 << 63)))
            flags = np.packbits(own)
            for s, e in zip(cut, np.append(cut[1:], len(head)), strict=False):
                i = some[share[s] : share[e]]
                where, sizes, size, load = _packed(deals[s], _five(gram[w[head[s:e]]]), np.diff(share[s : e + 1]).astype(np.uint32), at[i].astype(np.uint32), n[i].astype(np.uint32), flags)
                rows.append({"part": where, "kind": 1, "slab": slab, "sizes": [*sizes, len(raw)], "raw": size, "load": load})
            slab += 1
            yield pa.RecordBatch.from_pylist(rows, _ASKED)

    return run


def _answer(tasks: int):
    """A shard: the model's grams come first, then what slabs ask; sums by document go back to the slab."""

    def run(batches):
        held, table = [], None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            of = int((kind == 0).sum())  # rows are ordered by kind
            if of:
                held.append([batch.column(i).slice(0, of).to_numpy() for i in (3, 4, 5)])
            if of == len(kind):
                continue
            if table is None:
                gram, count, gain = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
                gram = gram.view(np.uint64) & SHORT
                order = np.argsort(gram)
                table = gram[order], count[order], gain[order]
            rows = []
            for r in batch.slice(of).to_pylist():
                out = {"part": r["slab"] % tasks, "slab": r["slab"]}
                if r["kind"] == 2:
                    rows.append(out | {"docs": r["docs"]})
                    continue
                *sizes, docs = r["sizes"]
                gram, share, doc, n, flags = _unpacked(sizes, r["raw"], r["load"], (np.uint8, np.uint32, np.uint32, np.uint32, np.uint8))
                gram = _wide(gram)
                if not len(table[0]):
                    continue
                place = np.minimum(np.searchsorted(table[0], gram), len(table[0]) - 1)
                found = np.repeat(table[0][place] == gram, share)
                place = np.repeat(place, share)[found]
                sums = _counted(np.unpackbits(flags, count=docs).view(bool), doc[found], n[found], table[1][place], table[2][place], docs)
                some = np.flatnonzero(sums)
                if len(some):
                    _, sizes, size, load = _packed(0, sums[some].astype(np.float32), some.astype(np.uint32))
                    rows.append(out | {"sizes": sizes, "raw": size, "load": load})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SUMS)

    return run


def _together(batches):
    """The documents of each slab with all their gains."""
    docs, sums = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["docs"] is not None:
                docs[r["slab"]] = r["docs"]
                continue
            gain, at = _unpacked(r["sizes"], r["raw"], r["load"], (np.float32, np.uint32))
            have = sums.get(r["slab"], np.zeros(0))
            if len(have) <= at[-1]:
                have = np.append(have, np.zeros(int(at[-1]) + 1 - len(have)))
            have[at] += gain
            sums[r["slab"]] = have
    for slab in sorted(docs):
        more = sums.pop(slab, np.zeros(0)).tolist()
        own = docs.pop(slab)
        for d, g in zip(own, more, strict=False):
            d["gain"] += g
        yield pa.RecordBatch.from_pylist(own, pa.schema(list(_DOC.value_type)))


def gains(marked: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, lang, __key, n_words, gain) of each row under the model of the trusted ones, and the unknown word's log probability."""
    spark = marked.sparkSession
    table, unknown = model(marked.where("__trusted"))
    rows = table.count()
    gram, count, gain = _hot(table)
    known = spark.sparkContext.broadcast((gram, count, gain, bloom(table)))
    total = c.text_bytes(marked)
    shards, tasks = c.partitions(spark, rows, SHARD_ROWS), c.partitions(spark, total, SUM_BYTES)
    asked = marked.select("doc_id", "lang", "__key", "text").mapInArrow(_ask(shards, known), ASKED)

    def dealt(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            n = len(gram)
            empty = [pa.nulls(n, _ASKED.field(k).type) for k in ("sizes", "raw", "load", "docs")]
            yield pa.RecordBatch.from_arrays([pa.array((c.mix(gram) % np.uint64(shards)).astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), *batch.columns, *empty], schema=_ASKED)

    both = table.mapInArrow(dealt, ASKED).unionByName(asked).repartitionById(shards, F.col("part")).sortWithinPartitions("kind")
    sums = both.mapInArrow(_answer(tasks), SUMS).repartitionById(tasks, F.col("part")).mapInArrow(_together, DOC)
    return sums, unknown


# --------------------------------------------------------------------------- verdicts
def _limits(rows: DataFrame, value: str) -> tuple[DataFrame, object]:
    """Per language (l) of trusted rows: median and high quantile of value in bins of 0.001; and those of all languages."""
    bins = c.save(rows.where(F.col("__trusted") & F.col(value).isNotNull()).groupBy("l", F.floor(F.col(value) * 1000).alias("bin")).agg(F.count("*").alias("n")))
    both = bins.unionAll(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("l"), "bin", "n"))
    order = Window.partitionBy("l").orderBy("bin")
    both = both.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("l"))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bin"))) / 1000 + 0.001
    limits = c.save(both.groupBy("l").agg(at(0.5).alias("m"), at(QUANTILE).alias("h"), F.first("all").alias("all")))
    by = limits.where(F.col("l").isNotNull() & (F.col("all") >= LEAST)).select(F.col("l").alias("__l"), F.col("m").alias("__m"), F.col("h").alias("__h"))
    if by.count() <= BROADCAST_LANGUAGES:
        by = F.broadcast(by)
    return by, limits.where("l is null").first()


MADE = ["n_words", "nats", "perplexity", "score", "threshold", "kept"]


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with __trusted, and a key that equal rows share (its last bit says whether they are trusted)."""
    ids = c.save(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__label")).distinct())
    bounded = ids.count() <= BROADCAST_IDS
    docs = docs.drop(*MADE, "__trusted", "__key", "__label")
    marked = docs.join(F.broadcast(ids) if bounded else ids, F.col("doc_id").cast("long") == F.col("__label"), "left").withColumn("__trusted", F.col("__label").isNotNull()).drop("__label")
    key = F.xxhash64("doc_id", "lang", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("__trusted").cast("long"))
    return marked.withColumn("__key", key)


def judged(marked: DataFrame) -> DataFrame:
    """Without texts: doc_id, lang, key and what the model says of each row."""
    typed = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", "__trusted", "__key")
    sums, unknown = gains(typed)
    nats = -(F.col("n_words") * unknown + F.col("gain"))
    rows = c.save(sums.select("doc_id", "lang", "__key", (F.col("__key").bitwiseAND(F.lit(1)) == 1).alias("__trusted"), "n_words", nats.alias("nats"), F.coalesce("lang", F.lit("")).alias("l")))
    plain, all_ = _limits(rows.withColumn("__x", F.try_divide("nats", "n_words")), "__x")
    if all_ is None:
        return rows.select("doc_id", "lang", "__key", "n_words", "nats", F.exp(F.try_divide("nats", "n_words")).alias("perplexity"), *[F.lit(None).cast("double").alias(x) for x in ("score", "threshold")], F.lit(True).alias("kept"))
    drawn = F.when(F.col("n_words") > 0, (F.col("nats") + PRIOR * F.coalesce("__m", F.lit(all_["m"]))) / (F.col("n_words") + PRIOR))
    rows = c.save(rows.join(plain, F.col("l") == F.col("__l"), "left").withColumn("score", drawn).drop("__l", "__m", "__h"))
    by, all_ = _limits(rows, "score")
    high = F.coalesce("__h", F.lit(all_["h"]))
    rows = rows.join(by, F.col("l") == F.col("__l"), "left").withColumn("threshold", high)
    return rows.select("doc_id", "lang", "__key", "n_words", "nats", F.exp(F.try_divide("nats", "n_words")).alias("perplexity"), "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_words, nats (their sum), perplexity (per word), score (smoothed nats a word), threshold (its bound) and kept."""
    c.small_batches(docs.sparkSession)
    marked = _marked(docs, labels)
    found = c.save(judged(marked).select("__key", *MADE).dropDuplicates(["__key"]))
    return marked.drop("__trusted").join(found, "__key").drop("__key")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected; texts move only if rejected rows are very many."""
    c.small_batches(docs.sparkSession)
    marked = _marked(docs, labels)
    gone = c.save(judged(marked).where("not kept").select("__key").distinct())
    bounded = gone.count() <= BROADCAST_IDS
    return marked.join(F.broadcast(gone) if bounded else gone, "__key", "left_anti").drop("__key", "__trusted")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    c.small_batches(spark)
    return judged(_marked(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "lang", *MADE)
