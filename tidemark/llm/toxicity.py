"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed toxic; the unlabelled sample is any text, its labels unread.  A
linear classifier over which words, and which beginnings of longer words, a text has (as 64-bit
codes of lower-cased text) is trained with numpy on the risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]),      l(z) = log(1 + exp(-z)),

whose second part is what unlabelled text costs as negatives, less the positives among it; where
a step would make it negative, the step goes back up instead, so that it can't be fitted below
zero.  The logistic loss makes sigmoid(f) an estimate of the probability of label 1.

1.  Which words get a weight: for every word and beginning, the texts with it are counted among the
    positives and among all texts that may be learned from, over all of them; the FEATURES whose shares
    differ most for their spread are kept.
2.  The weights: fitted to a bounded sample, at most POSITIVES confirmed and UNLABELLED other texts (those
    whose doc_id has the smallest hash), each as the codes of the features it has: at most FEATURES of
    8 bytes a text, whatever its length.
3.  Every text is scored whole.

Defined cases: null and empty text score the bias alone; equal texts score alike and count once for
learning, as toxic if one of them is; rows without doc_id are scored, not held
out, never learned from; labels that contradict each other count as toxic; without any confirmed
toxic text every score is the prior (0.01 without labels); an empty table gives an empty table.  Other
columns pass through; columns named score, predicted or held_out are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 8192
#: Confirmed ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Text bytes whose words a task counts before it gives them out.
SLAB_BYTES = 16 << 20
#: A word must be in so many texts.
LEAST_TEXTS = 4
#: Beginnings of words, in bytes.
BEGINNINGS = (4, 5, 6, 7)
#: Standard deviations by which the shares of positive and unlabelled texts with a word must differ.
LEAST_SPREADS = 5.0
STEPS, RATE, DECAY = 250, 0.08, 3e-5
THRESHOLD = 0.3


def remainder(column: str = "doc_id"):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 4


def _kinds(raw: list[bytes]) -> tuple[c.Words, np.ndarray, np.ndarray]:
    """The distinct words and beginnings of each text of a block: (words, texts, codes)."""
    words = c.Words(raw, kind=c.ALNUM, lower=True, beginnings=BEGINNINGS)
    doc = words.doc_of()
    codes, at = np.concatenate([words.codes, *words.beginnings]), np.concatenate([doc] * (1 + len(BEGINNINGS)))
    at, codes = at[codes != 0], codes[codes != 0]
    order = np.lexsort((at, codes))
    at, codes = at[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])
    return words, at[new], codes[new]


def _texts_with(batches):
    """(code, p, u): in how many confirmed and in how many texts of a slab each word is."""
    got: list = []
    size = 0

    def flush():
        if got:
            codes, p, u = (np.concatenate(x) for x in zip(*got, strict=True))
            found, at = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(np.bincount(at, x, len(found)).astype(np.int64)) for x in (p, u))], names=["code", "p", "u"])
            got.clear()

    for part, raw in c.blocks(batches):
        mark = part.column(part.schema.get_field_index("__positive")).to_numpy(zero_copy_only=False).astype(bool)
        _, at, codes = _kinds(raw)
        if len(codes):
            start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            got.append((codes[start], np.add.reduceat(mark[at].astype(np.int64), start), np.diff(np.append(start, len(codes)))))
        size += sum(map(len, raw))
        if size >= SLAB_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def choose(rows: DataFrame) -> np.ndarray:
    """The words whose shares of confirmed and of all texts (rows: __positive, text) differ most for their spread."""
    n = rows.agg(F.count("*").alias("u"), F.coalesce(F.sum(F.col("__positive").cast("long")), F.lit(0)).alias("p")).first()
    counts = rows.select("__positive", "text").mapInArrow(_texts_with, "code long, p long, u long").groupBy("code").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    np_, nu = float(max(n["p"], 1)), float(max(n["u"], 1))
    share = (F.col("p") + F.col("u") + 0.5) / (np_ + nu + 1)
    spread = F.sqrt(share * (1 - share) * (1 / np_ + 1 / nu))
    z = F.abs(F.col("p") / np_ - F.col("u") / nu) / F.greatest(spread, F.lit(1e-9))
    best = counts.where(F.col("p") + F.col("u") >= LEAST_TEXTS).select("code", z.alias("z")).where(F.col("z") > LEAST_SPREADS).orderBy(F.desc("z"), "code").limit(FEATURES)
    return np.sort(best.toArrow().column(0).to_numpy().view(np.uint64))


def _learned(rows: DataFrame, features: np.ndarray, most: int) -> list[np.ndarray]:
    """The features of each text of rows, at most so many."""

    def run(batches):
        for _, raw in c.blocks(batches):
            _, at, codes = _kinds(raw)
            keep = features[np.minimum(np.searchsorted(features, codes), len(features) - 1)] == codes
            order = np.argsort(at[keep], kind="stable")
            at, codes = at[keep][order], codes[keep][order]
            bounds = np.searchsorted(at, np.arange(len(raw) + 1))
            yield pa.RecordBatch.from_pydict({"codes": pa.array([codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    got = rows.select("text").mapInArrow(run, "codes binary").orderBy(F.xxhash64("codes"), "codes").limit(most)
    return [np.frombuffer(x, np.uint64) for x in sorted(got.toArrow().column("codes").to_pylist())]


class Sparse:
    """Rows of present features, as flat indices and row starts."""

    def __init__(self, rows: list[np.ndarray], features: np.ndarray):
        flat = np.concatenate([np.empty(0, np.uint64), *rows])
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        at = np.minimum(np.searchsorted(features, flat), max(len(features) - 1, 0))
        keep = features[at] == flat if len(features) else np.zeros(len(flat), bool)
        self.index, self.row, self.n = at[keep], row[keep], len(rows)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], self.n)

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, values[self.row], width)


def train(positive: Sparse, unlabelled: Sparse, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam, all texts in each step)."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        fp, fu = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        up, uu = prior * sigmoid(fp) / positive.n, sigmoid(fu) / unlabelled.n
        if negative >= 0:
            gp, gu = -prior * sigmoid(-fp) / positive.n - up, uu
        else:
            gp, gu = up, -uu
        grad = np.append(positive.back(gp, width) + unlabelled.back(gu, width), gp.sum() + gu.sum())
        grad[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(word codes, weights, bias) learned from the rows that may be learned from."""
    open_ = labels.where((remainder() != 2) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = open_.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    prior = min(max(n["toxic"] / n["n"], 0.005), 0.5) if n["n"] else 0.01
    nothing = np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior)))
    if not n["toxic"]:
        return nothing
    ids = c.save(open_.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("__label")))
    bounded = ids.count() <= BROADCAST_IDS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(remainder() != 2)
    marks = docs.join(F.broadcast(ids) if bounded else ids, docs["doc_id"] == ids["__label"], "left").select("doc_id", F.xxhash64("text").alias("__text"), F.col("__label").isNotNull().alias("__positive"))
    # Of equal texts the one of the smallest doc_id is learned from; only ids and hashes of texts move.
    groups = c.save(marks.groupBy("__text").agg(F.min("doc_id").alias("doc_id"), F.max("__positive").alias("__positive"), F.count("*").alias("n")))
    toxic = c.save(groups.where("__positive").select(F.col("doc_id").alias("__id")).distinct())
    copies = c.save(groups.where("n > 1").select("__text", F.col("doc_id").alias("__first")))
    near = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    again = c.save(docs.select("doc_id", F.xxhash64("text").alias("__text")).join(near(copies), "__text").where(F.col("doc_id") != F.col("__first")).select("doc_id").distinct())
    rows = docs.join(near(again), "doc_id", "left_anti").join(near(toxic), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.col("__id").isNotNull().alias("__positive"))
    features = choose(rows)
    if not len(features):
        return nothing

    def drawn(some: DataFrame, most: int, seed: int) -> list[np.ndarray]:
        picked = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        # At most so many ids of 8 bytes.
        return _learned(some.join(F.broadcast(picked), "doc_id", "left_semi"), features, most)

    positive, unlabelled = drawn(rows.where("__positive"), POSITIVES, 5), drawn(rows, UNLABELLED, 6)
    if not positive or not unlabelled:
        return nothing
    weights, bias = train(Sparse(positive, features), Sparse(unlabelled, features), len(features), prior)
    return features, weights, bias


def _scorer(features: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches):
        for part, raw in c.blocks(batches):
            total = np.full(len(raw), bias)
            if len(features):
                words = c.Words(raw, kind=c.ALNUM, lower=True, beginnings=BEGINNINGS)
                pairs = []
                for codes in (words.codes, *words.beginnings):
                    at = np.minimum(np.searchsorted(features, codes), len(features) - 1)
                    hit = np.flatnonzero(features[at] == codes)
                    pairs.append((np.searchsorted(words.first, hit, side="right") - 1) * len(features) + at[hit])
                pair = np.unique(np.concatenate(pairs))
                total += np.bincount(pair // len(features), weights[pair % len(features)], len(raw))
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1), predicted (score >= threshold) and held_out (never learned from)."""
    docs = docs.drop("score", "predicted", "held_out")
    c.small_batches(docs.sparkSession)
    model = fit(docs, labels)
    scored = docs.mapInArrow(_scorer(*model), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": F.coalesce(remainder() == 2, F.lit(False))})


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
