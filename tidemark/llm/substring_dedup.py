"""Substring dedup: prefix-partitioned suffix trees over the words of all documents.

1.  Variable-length prefixes.  A suffix's prefix is its first word; where that word starts more
    suffixes than a part of a group should hold, its first two words, then three.  A hashed sample,
    counted by Spark, finds those words and pairs; it grows with the groups, only plans and never decides.
2.  A window of min_words words belongs to the group of the prefix, of all that stand inside it, whose
    code is smallest.  That depends on the window's words alone, so equal windows meet in one group; and
    as neighbouring windows mostly share that prefix, they travel together as one run of text.  Each word
    travels about 3 times, not min_words times, and whole words travel.
3.  Before the shuffle every slab of documents keeps, of runs of equal words, those of the smallest
    doc_id; the others are known to repeat it and are reported at once.  So a passage that a third of all
    documents share sends a run per slab, not one per document.
4.  A group's task takes its prefixes in LANES lanes, one after the other, so that its arrays are those of
    a lane; it orders a lane's suffixes word by word (words are compared by their bytes) and finds the
    suffix tree's deep internal nodes: leaves whose common prefix has min_words words or more.  The
    node's smallest document keeps its words; the other leaves' windows are reported as spans.
5.  Spans meet their documents in a join; together they are the maximal repeated spans, which are cut.

Defined cases: a null or empty text has no words; texts of fewer than min_words words have no
window; repeats inside one document stay; rows with equal doc_id count as one document, and each
is cleaned; rows without doc_id rank behind all others, by a hash of their text; an empty table
gives an empty table.  Columns of the input pass through unchanged; new columns are n_words,
n_removed, spans, kept_text, and an input column of one of these names is replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MIN_WORDS = 13
#: Words of the longest prefix.
PREFIX_WORDS = 3
#: Suffixes that one group should hold; the groups' tasks (more groups share tasks, one after the other).
GROUP_WORDS, MOST_TASKS = 700_000, 100_000
#: Parts of a group, by prefix, whose suffixes are put in order one after the other.
LANES = 8
#: Text bytes within which equal runs are joined before the shuffle.
SLAB_BYTES = 4 << 20
#: Sampled text bytes that find heavy prefixes: at least, and for each group.
PLAN_BYTES, PLAN_GROUP_BYTES = 8 << 20, 4096
#: A prefix is heavy if it starts more than one in HEAVY * groups suffixes, or more than one in MOST_HEAVY:
#: so there are fewer than MOST_HEAVY heavy words and as many heavy pairs, of 8 bytes each.
HEAVY, MOST_HEAVY = 16, 1 << 20
LAST = np.iinfo(np.int64).max

KEY, ROW = "__key", "__row"
SENT = T.StructType([T.StructField("group", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("raw", T.LongType()), T.StructField("load", T.BinaryType())])
REPORT = T.StructType([T.StructField(KEY, T.LongType()), T.StructField(ROW, T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ONE_LINE = bytes(0x20 if c.SPACES[x] else x for x in range(256))


def with_key(docs: DataFrame) -> DataFrame:
    """The order of documents: doc_id, then (without one) a hash of the text; and a number of the row's text."""
    spare = F.lit(int(LAST)) - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40))
    return docs.withColumns({KEY: F.coalesce(F.col("doc_id").cast("long"), spare), ROW: F.xxhash64("doc_id", "text")})


# --------------------------------------------------------------------------- prefixes
def prefix_code(words: np.ndarray, length: int) -> np.ndarray:
    """Codes of the prefixes of some words of all suffixes that have so many."""
    out = words[: len(words) - length + 1]
    for i in range(1, length):
        out = out * c.STEP + words[i : len(words) - length + 1 + i]
    return c.mix(out)


def plan_prefixes(docs: DataFrame, total_bytes: int, groups: int, longest: int) -> list[np.ndarray]:
    """For each length below the longest, the codes of prefixes that are too heavy for a group, in order."""
    share = max(1, total_bytes // (PLAN_BYTES + PLAN_GROUP_BYTES * groups))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select("text")

    def count(batches):
        for _, raw in c.blocks(batches, limit=SLAB_BYTES):
            words = c.Words(raw).codes
            for length in range(1, longest):
                if len(words) >= length:
                    code, n = np.unique(prefix_code(words, length), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), length)), pa.array(code.view(np.int64)), pa.array(n)], names=["length", "code", "n"])

    if longest < 2:
        return []
    counts = c.save(some.mapInArrow(count, "length long, code long, n long").groupBy("length", "code").agg(F.sum("n").alias("n")))
    words = counts.where("length = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    limit = max(2, words / groups / HEAVY, words / MOST_HEAVY)
    found = counts.where(F.col("n") > limit).select("length", "code").toArrow()
    length, code = (found.column(i).to_numpy() for i in (0, 1))
    return [np.sort(code[length == i].view(np.uint64)) for i in range(1, longest)]


def prefixes(words: np.ndarray, heavy: list[np.ndarray]) -> np.ndarray:
    """For every suffix the code of its shortest prefix that is not heavy (or of the longest)."""
    out = prefix_code(words, 1)
    open_ = np.arange(len(words))
    for length, known in enumerate(heavy, 1):
        if not len(known):
            break
        here = out[open_]
        found = np.minimum(np.searchsorted(known, here), len(known) - 1)
        open_ = open_[known[found] == here]
        open_ = open_[open_ + length < len(words)]
        out[open_] = prefix_code(words, length + 1)[open_]
    return out


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


# --------------------------------------------------------------------------- runs of windows
def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs that start at start and have size, one run after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _parts(size: np.ndarray):
    """Runs of about STRIDE words together: first run, run after the last."""
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + c.STRIDE, side="right")))
        yield a, b
        a = b


def runs(words: c.Words, k: int, heavy: list[np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document and prefix: first word, word after the last, group, lane of the group."""
    at = words.whole(k)
    if not len(at):
        return at, at, at, at
    mark = smallest(prefixes(words.codes, heavy), k - len(heavy))[at]
    doc = np.searchsorted(words.first, at, side="right")
    new = np.ones(len(at), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(at)) - 1
    lane, group = np.divmod(c.mix(mark[start]), np.uint64(groups))
    return at[start], at[last] + k, group.astype(np.int64), (lane % np.uint64(LANES)).astype(np.uint8)


def _unlike(words: c.Words, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs to send, and runs whose words a run of a smaller document in the same slab has too."""
    code = np.empty(len(start), np.uint64)
    for a, b in _parts(size):
        first, n = start[a:b], size[a:b]
        word = _spread(first, n)
        code[a:b] = np.add.reduceat(c.mix(words.codes[word] + (word - np.repeat(first, n)).astype(np.uint64) * c.STEP), np.cumsum(n) - n)
    order = np.lexsort((key, code, size))
    o, p = order[1:], order[:-1]
    head = np.ones(len(order), bool)
    head[1:] = (size[o] != size[p]) | (code[o] != code[p])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = np.flatnonzero(key > key[first])
    same = np.empty(len(later), bool)
    for a, b in _parts(size[later]):
        i, n = later[a:b], size[later[a:b]]
        same[a:b] = np.logical_and.reduceat(c.same_words(words, _spread(start[i], n), words, _spread(start[first[i]], n)), np.cumsum(n) - n)
    later = later[same]
    sent = np.ones(len(start), bool)
    sent[later] = False
    return np.flatnonzero(sent), later


def _row(group: int, kind: int, arrays: list[np.ndarray], text: bytes = b"") -> tuple:
    load = b"".join(x.tobytes() for x in arrays) + text
    return int(group), kind, len(arrays[0]), len(load), pa.compress(load, "zstd", asbytes=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=SENT.names)


def leaves(k: int, heavy: list[np.ndarray], groups: int):
    """Per slab: a row of runs for each group (kind 0), and a row of the repeats already known (kind 1)."""

    def run(batches):
        for part, raw in c.blocks(batches, limit=SLAB_BYTES):
            words = c.Words(raw)
            start, stop, group, lane = runs(words, k, heavy, groups)
            if not len(start):
                continue
            doc = np.searchsorted(words.first, start, side="right") - 1
            key, row = (c.long_array(part.column(part.schema.get_field_index(n)))[doc] for n in (KEY, ROW))
            begin = start - words.first[doc]
            sent, known = _unlike(words, start, stop - start, key)
            rows = []
            if len(known):
                rows.append(_row(int(key[known[0]]) % groups, 1, [key[known], row[known], begin[known], begin[known] + (stop - start)[known]]))
            sent = sent[np.argsort(group[sent], kind="stable")]
            low, high = words.starts[start[sent]], words.ends[stop[sent] - 1]
            line = words.data.translate(_ONE_LINE)
            cut = np.flatnonzero(np.diff(group[sent], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(sent)], strict=True):
                i = sent[a:b]
                text = b"\n".join([*(line[x:y] for x, y in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)), b""])
                rows.append(_row(group[i[0]], 0, [key[i], row[i], begin[i], lane[i]], text))
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


# --------------------------------------------------------------------------- subtrees
def deep_nodes(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below nodes of k words or more, in order, and the first of each node; ids number the words."""
    bits = max(1, int(ids.max()).bit_length())
    each = max(1, 63 // bits)
    rank = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    depth = 0
    while depth < k and len(open_):  # suffixes that are alone so far are leaves of shallower nodes
        step = min(each, k - depth)
        key = np.zeros(len(open_), np.int64)
        for j in range(depth, depth + step):
            key = key << bits | ids[at[open_] + j]
        order = np.lexsort((key, rank[open_])) if depth else np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        base = rank[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (base[1:] != base[:-1]) | (key[1:] != key[:-1])
        rank[open_] = np.cumsum(new)
        open_ = open_[~(new & np.append(new[1:], True))]
        depth += step
    return open_, np.flatnonzero(np.diff(rank[open_], prepend=-1))


def spans(key: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of words of rows, those that touch as one."""
    order = np.lexsort((start, row, key))
    key, row, start, stop = key[order], row[order], start[order], stop[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    # Within a row, a span goes on while a start is not beyond what came before it.
    owner = np.cumsum(new)
    reach = np.maximum.accumulate(stop + owner * (1 << 40)) - owner * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], row[at], start[at], reach[np.append(at[1:], len(key)) - 1] if len(at) else reach


def _reports(key, row, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in spans(key, row, start, stop)], names=REPORT.names)


def subtrees(k: int):
    """Rows of a group follow each other: order its suffixes, find deep nodes, report leaves that are not the node's first."""

    def tree(got: list):
        key, row, begin, lane = (np.concatenate([x[i] for x in got]) for i in range(4))
        texts = [y for x in got for y in x[4].split(b"\n")[:-1]]
        got.clear()
        order = np.argsort(lane, kind="stable")
        found = [lane_tree(key[own], row[own], begin[own], [texts[i] for i in own.tolist()]) for own in np.split(order, np.flatnonzero(np.diff(lane[order])) + 1)]
        found = [x for x in found if x]
        if found:
            yield _reports(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def lane_tree(key, row, begin, texts):
        words = c.Words(texts)
        at = words.whole(k)
        leaf, node = deep_nodes(c.word_ids(words), at, k)
        if not len(leaf):
            return None
        at = at[leaf]
        run = np.searchsorted(words.first, at, side="right") - 1
        own = key[run]
        owner = np.repeat(np.minimum.reduceat(own, node), np.diff(np.append(node, len(own))))
        later = np.flatnonzero(own > owner)
        start = (begin[run] + at - words.first[run])[later]
        return spans(own[later], row[run[later]], start, start + k) if len(later) else None

    def run(batches):
        now, got = None, []
        for batch in batches:
            for r in batch.to_pylist():
                load = pa.decompress(r["load"], r["raw"], "zstd", asbytes=True)
                n = r["n"]
                if r["kind"]:
                    yield _reports(*np.frombuffer(load, np.int64).reshape(4, n))
                    continue
                if r["group"] != now:
                    if got:
                        yield from tree(got)
                    now, got = r["group"], []
                got.append((*np.frombuffer(load, np.int64, 3 * n).reshape(3, n), np.frombuffer(load, np.uint8, n, 24 * n), load[25 * n :]))
        if got:
            yield from tree(got)

    return run


def repeats(docs: DataFrame, k: int = MIN_WORDS) -> DataFrame:
    """(__key, __row, start, stop): spans of words of docs (with_key) that stand in a document of smaller key too."""
    spark = docs.sparkSession
    total = c.text_bytes(docs)
    groups = c.partitions(spark, total // 6, GROUP_WORDS)
    heavy = plan_prefixes(docs, total, groups, min(PREFIX_WORDS, k))
    sent = docs.select(KEY, ROW, "text").mapInArrow(leaves(k, heavy, groups), SENT)
    tasks = min(groups, MOST_TASKS)
    sent = sent.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int"))
    if groups > tasks:
        sent = sent.sortWithinPartitions("group")
    return c.save(sent.mapInArrow(subtrees(k), REPORT))


# --------------------------------------------------------------------------- cutting
def cutter(names: list[str], full: bool):
    """Texts without the words of their spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for part, raw in c.blocks(batches):
            told = part.column(part.schema.get_field_index("__spans")).to_pylist()
            n_words, n_removed, cut, kept = [], [], [], []
            for x, found in zip(raw, told, strict=True):
                words = x.split()
                n_words.append(len(words))
                if found:
                    gone = np.zeros(len(words), bool)
                    for s in found:
                        gone[s["start"] : s["stop"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    cut.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    n_removed.append(int(gone.sum()))
                    words = compress(words, ~gone)
                else:
                    cut.append([])
                    n_removed.append(0)
                kept.append(b" ".join(words))
            columns = {n: part.column(part.schema.get_field_index(n)) for n in names}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(cut, span)}
            if full:
                columns["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
            else:
                columns["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            yield pa.RecordBatch.from_pydict(columns)

    return run


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, digest: bool = False) -> DataFrame:
    """Cut every window of min_words words that also starts in a document of smaller doc_id.

    Gives the columns of docs with n_words, n_removed, spans (word ranges cut: the maximal
    repeats of this document) and kept_text, the words left joined by one space; with digest, the
    SHA-256 of kept_text stands in its place, so that texts need not leave the task.
    """
    c.small_batches(docs.sparkSession)
    last = "kept_sha256" if digest else "kept_text"
    docs = with_key(docs.drop("n_words", "n_removed", "spans", last))
    told = repeats(docs, min_words).groupBy(KEY, ROW).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    names = [x for x in docs.columns if x not in (KEY, ROW)]
    if digest:
        names = ["doc_id"]
        docs = docs.select("doc_id", "text", KEY, ROW)
    out = T.StructType([*[docs.schema[n] for n in names], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPAN), T.StructField(last, T.StringType())])
    return docs.join(told.hint("shuffle_hash"), [KEY, ROW], "left").drop(KEY, ROW).mapInArrow(cutter(names, not digest), out)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
