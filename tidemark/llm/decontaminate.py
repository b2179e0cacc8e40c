"""Benchmark decontamination by suffix arrays over the training texts.

Each block of documents is a shard with its own suffix array over words.  The array holds the
suffixes whose first words (as many as the shortest item has, three at most) start some test
suffix; no other suffix can hold a window of an item.  It is ordered word by word, by 64-bit
word codes, to the depth of a window.  Every test suffix is binary-searched in every shard; the
interval it spans holds all places where codes say that a whole window of the item occurs, and the
words themselves decide.  Equal windows of the benchmark are searched once, so a document word begins at most one
hit for each length of window: what is found grows with the text, never with the product of the
repeats on both sides.  Windows that follow each other in both texts make up the longest verbatim
matches.  Texts are whole within a shard, so a document's verdict needs no shuffle.

Matches are told from left to right: at the first hit window not in a match told before, the longest run that holds it,
over all places in the benchmark, as far as both texts agree in either direction; the longest match of
a document is always among them.  An item shorter than a window is told at its first place.

A Spark job cuts the benchmark into slices of at most SLICE_WORDS words (an item of more words is a
slice alone), each a file in the shared folder.  Every slice is a pass over the documents, chained, with
what has been hit carried along each document; a pass reads its own slice inside the tasks, so the
driver holds the names of slices only.

Defined cases: null text, empty text or text without words: no words, nothing hit, not
contaminated.  Items with null or no words occur nowhere.  Items of fewer words than a window
are one window.  Rows with one item_id are separate texts of one item, which counts once.  Equal
windows in several items count for each.  item_id may be of any type; ids that are not whole
numbers are given as strings.  Other columns pass through; columns named like a new
one (n_words, n_hit, items, longest, matches, contaminated) are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW = 10
#: Words of the benchmark that a task holds at once: 8 bytes each and as many again for its indexes.
SLICE_WORDS = 2_000_000


def match_type(item: T.DataType) -> T.ArrayType:
    item = T.LongType() if isinstance(item, T.IntegralType) else T.StringType()
    return T.ArrayType(T.StructType([T.StructField("item_id", item), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("length", T.LongType())]))


class Query:
    """A slice of the benchmark: its words, the suffix starts that begin a window, and their needed depths."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.words = words = c.Words([t.encode() for t in texts], kind=c.ALNUM, lower=True)
        size = words.counts
        need = np.minimum(size, window)
        here = np.where(size > 0, size - need + 1, 0)
        item = np.repeat(np.arange(len(ids)), here)
        self.offset = np.arange(len(item)) - np.repeat(np.cumsum(here) - here, here)
        self.ids = np.array([*ids, None], object)[:-1][item]
        self.start, self.need, self.room = words.first[item] + self.offset, need[item], size[item] - self.offset
        if len(self.start):
            self.depth = int(min(3, self.need.min()))
            head = words.codes[self.start[:, None] + np.arange(self.depth)]
            self.heads = np.unique(_head(list(head.T)))
            kind = _kinds(c.word_ids(words), self.start, self.need)
            #: A suffix for each different window; the kinds of all suffixes; the suffixes of each kind, one after the other.
            _, self.one = np.unique(kind, return_index=True)
            self.of = np.argsort(kind, kind="stable")
            self.bounds = np.searchsorted(kind[self.of], np.arange(len(self.one) + 1))
            #: Kinds in the order of the texts, with something unlike any kind between two texts.
            self.at = np.arange(len(kind)) + item + 1
            self.rest = np.repeat(here, here) - self.offset
            self.line = np.full(self.at[-1] + 2, -2)
            self.line[self.at] = kind

    def items(self, kind: int) -> set:
        return set(self.ids[self.of[self.bounds[kind] : self.bounds[kind + 1]]].tolist())


def _kinds(ids: np.ndarray, start: np.ndarray, need: np.ndarray) -> np.ndarray:
    """A number for each window, equal exactly for windows of equal words."""
    out, base = np.zeros(len(start), np.int64), 0
    for n in np.unique(need).tolist():
        own = np.flatnonzero(need == n)
        kind = ids[start[own]]
        for i in range(1, n):
            _, kind = np.unique(kind * (len(ids) + 1) + ids[start[own] + i], return_inverse=True)
        _, kind = np.unique(kind, return_inverse=True)
        out[own] = base + kind
        base += int(kind.max()) + 1
    return out


def _head(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0].copy()
    for x in columns[1:]:
        out = out * c.STEP + x
    return c.mix(out)


def suffix_array(words: c.Words, query: Query) -> tuple[np.ndarray, np.ndarray]:
    """Ordered starts of the shard's suffixes that can matter, and the words each has left in its document."""
    d = query.depth
    n = len(words.codes) - d + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head = _head([words.codes[i : i + n] for i in range(d)])
    found = np.minimum(np.searchsorted(query.heads, head), len(query.heads) - 1)
    at = np.flatnonzero(query.heads[found] == head)
    left = words.first[1:][np.searchsorted(words.first, at, side="right") - 1] - at
    at, left = at[left >= d], left[left >= d]
    # Order word by word: only suffixes that are equal so far are looked at further.
    rank = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    depth = 0
    while len(open_) and depth < query.need.max():
        code = np.where(left[open_] > depth, words.codes[np.minimum(at[open_] + depth, len(words.codes) - 1)], np.uint64(0))
        order = np.lexsort((code, rank[open_]))
        o, code = open_[order], code[order]
        base = rank[o]
        new = np.ones(len(o), bool)
        new[1:] = (base[1:] != base[:-1]) | (code[1:] != code[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        group_start = np.ones(len(o), bool)
        group_start[1:] = base[1:] != base[:-1]
        rank[o] = base + np.arange(len(o)) - np.maximum.accumulate(np.where(group_start, np.arange(len(o)), 0)) - (np.arange(len(o)) - first)
        alone = new & np.append(new[1:], True)
        open_ = o[~alone & (left[o] > depth)]
        depth += 1
    order = np.argsort(rank, kind="stable")
    return at[order], left[order]


def _compare(words, at, left, query, start, room, upto) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix (at most upto words) of shard suffixes and test suffixes, and whether the shard's is the smaller."""
    common = np.zeros(len(at), np.int64)
    less = np.zeros(len(at), bool)
    open_ = np.arange(len(at))
    depth = 0
    while len(open_):
        mine = left[open_] > depth
        theirs = (room[open_] > depth) & (upto[open_] > depth)
        x = np.where(mine, words[np.minimum(at[open_] + depth, len(words) - 1)], np.uint64(0))
        y = np.where(theirs, query[np.minimum(start[open_] + depth, len(query) - 1)], np.uint64(0))
        same = mine & theirs & (x == y)
        less[open_[theirs & (~mine | (x < y)) & ~same]] = True
        common[open_[same]] += 1
        open_ = open_[same]
        depth += 1
    return common, less


def _bound(words, sa, left, query: Query, which, depth, above: bool) -> np.ndarray:
    """Binary search of test suffixes cut to depth words: the first place that is not less (or is beyond equal)."""
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa), np.int64)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        q = which[open_]
        common, less = _compare(words, sa[mid], left[mid], query.words.codes, query.start[q], query.room[q], depth[open_])
        right = less | (above & (common >= depth[open_]))
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(words: c.Words, query: Query) -> tuple[np.ndarray, np.ndarray]:
    """Every different test window in one shard: (kind, shard word) of its occurrences."""
    none = np.empty(0, np.int64)
    if not len(query.start):
        return none, none
    sa, left = suffix_array(words, query)
    if not len(sa):
        return none, none
    q = query.one
    lo = _bound(words.codes, sa, left, query, q, query.need[q], above=False)
    near = np.minimum(lo, len(sa) - 1)
    common, _ = _compare(words.codes, sa[near], left[near], query.words.codes, query.start[q], query.room[q], query.need[q])
    kind = np.flatnonzero((lo < len(sa)) & (common >= query.need[q]))
    if not len(kind):
        return none, none
    lo, q = lo[kind], q[kind]
    n = _bound(words.codes, sa, left, query, q, query.need[q], above=True) - lo
    place = sa[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    kind, q = np.repeat(kind, n), np.repeat(q, n)
    same = np.ones(len(q), bool)
    for i in range(int(query.need[q].max())):  # codes have found them, words decide
        some = np.flatnonzero(same & (query.need[q] > i))
        same[some] = c.same_words(words, place[some] + i, query.words, query.start[q[some]] + i)
    return kind[same], place[same]


def _reach(line: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each of `at`: how many kinds from there on agree with those of text."""
    far, open_, done, size = np.zeros(len(at), np.int64), np.arange(len(at)), 0, 8
    while len(open_) and done < len(text):
        own = text[done : done + size]
        same = line[np.minimum(at[open_, None] + np.arange(done, done + len(own)), len(line) - 1)] == own
        run = np.where(same.all(1), len(own), same.argmin(1))
        far[open_] += run
        open_ = open_[run == len(own)]
        done, size = done + len(own), min(2 * size, 512)
    return far


def _told(query: Query, kinds: np.ndarray, window: int) -> list[dict]:
    """The matches of one document, whose words begin windows of these kinds (-1: none), from left to right."""
    out, p = [], 0
    places = np.flatnonzero(kinds >= 0)
    begins, ends = places[np.append(True, np.diff(places) != 1)], places[np.append(np.diff(places) != 1, True)] + 1
    back, last = query.line[::-1], len(query.line) - 1
    while (n := int(np.searchsorted(places, p))) < len(places):
        p = int(places[n])
        every = query.of[query.bounds[kinds[p]] : query.bounds[kinds[p] + 1]]
        own = int(np.searchsorted(begins, p, side="right")) - 1
        after, before = kinds[p : ends[own]], kinds[begins[own] : p][::-1]
        # No run is longer than both texts have room for: those with most room first, until none can be longer.
        room = np.minimum(query.rest[every], len(after)) + np.minimum(query.offset[every], len(before))
        order = np.argsort(-room, kind="stable")
        best = (0, 0, 0)
        for start in range(0, len(every), 256):
            some = every[order[start : start + 256]]
            if room[order[start]] <= best[0]:
                break
            at = query.at[some]
            right, left = _reach(query.line, at, after), _reach(back, last - at + 1, before)
            k = int((right + left).argmax())
            best = max(best, (int(right[k] + left[k]), int(right[k]), -int(some[k])))
        length, right, q = best[0], best[1], -best[2]
        left = length - right
        out.append({"item_id": query.ids[q], "item_word": int(query.offset[q]) - left, "doc_word": p - left, "length": length + window - 1})
        p += right
    return out


def marker(file: str | None, window: int, match: pa.DataType):
    """Adds one slice's hits to each document: hit words as bits, items, and longest matches with their places."""

    def run(batches):
        query = load(file, window) if file else Query([], [], window)
        for part, raw in c.blocks(batches, limit=4 * c.BLOCK_BYTES):
            words = c.Words(raw, kind=c.ALNUM, lower=True)
            kind, place = search(words, query)
            n = len(words.codes)
            need = query.need[query.one[kind]] if len(kind) else np.empty(0, np.int64)
            hit = c.cover(n, place, need) if len(kind) else np.zeros(n, bool)
            full = need == window
            begins = np.full(n, -1)
            begins[place[full]] = kind[full]
            doc = np.searchsorted(words.first, place, side="right") - 1
            told: dict[int, list] = {d: _told(query, begins[words.first[d] : words.first[d + 1]], window) for d in np.unique(doc[full]).tolist()}
            items: dict[int, set] = {}
            # Each kind of window once a document: its items, and for short ones the first place.
            order = np.lexsort((place, kind, doc))
            once = order[np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(kind[order]) != 0)))] if len(kind) else order
            for i in once.tolist():
                d = int(doc[i])
                items.setdefault(d, set()).update(query.items(kind[i]))
                if not full[i]:
                    q = query.one[kind[i]]
                    told.setdefault(d, []).append({"item_id": query.ids[q], "item_word": 0, "doc_word": int(place[i] - words.first[d]), "length": int(need[i])})
            old = {x: part.column(part.schema.get_field_index(x)) for x in ("__hits", "__matches", "__items")}
            hits, matches, n_hit, found = [], [], [], []
            for d in range(len(raw)):
                own = hit[words.first[d] : words.first[d + 1]]
                had = old["__hits"][d].as_py()
                if had is not None:
                    own = own | np.unpackbits(np.frombuffer(had, np.uint8), count=len(own)).view(bool)
                n_hit.append(int(own.sum()))
                hits.append(np.packbits(own).tobytes() if n_hit[-1] else None)
                matches.append([*(old["__matches"][d].as_py() or []), *told.get(d, [])] or None)
                found.append(sorted({*(old["__items"][d].as_py() or []), *items.get(d, ())}, key=lambda x: (x is None, x)) or None)
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {"__words": pa.array(words.counts.astype(np.int64)), "__n_hit": pa.array(n_hit, pa.int64()), "__hits": pa.array(hits, pa.binary()), "__matches": pa.array(matches, match), "__items": pa.array(found, pa.list_(match.value_type.field("item_id").type))})

    return run


def slices(benchmark: DataFrame, most: int = SLICE_WORDS) -> list[str]:
    """Files with a slice of the benchmark each: the item ids and texts of at most so many words."""
    spark = benchmark.sparkSession
    item = benchmark.schema["item_id"].dataType
    ids = F.col("item_id").cast("long" if isinstance(item, T.IntegralType) else "string")
    items = benchmark.where("text is not null").select(ids.alias("item_id"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([T.StructField("ids", T.ArrayType(items.schema["item_id"].dataType)), T.StructField("texts", T.ArrayType(T.StringType()))])
    schema = pa.schema([("ids", pa.list_(pa.int64() if isinstance(item, T.IntegralType) else pa.string())), ("texts", pa.list_(pa.string()))])

    def cut(batches):
        got: list[tuple] = []
        size = 0
        row = lambda: pa.RecordBatch.from_pylist([{"ids": [x[0] for x in got], "texts": [x[1] for x in got]}], schema)
        for batch in batches:
            for r in batch.to_pylist():
                n = len(c.Words([r["text"].encode()], kind=c.ALNUM).codes)
                if got and size + n > most:
                    yield row()
                    got, size = [], 0
                got.append((r["item_id"], r["text"]))
                size += n
        if got:
            yield row()

    # Words have two bytes at least with what parts them, mostly many more.
    tasks = max(1, c.text_bytes(items) // (most * 4))
    path = c.scratch_dir(spark)
    items.repartition(tasks).mapInArrow(cut, kind).write.option("maxRecordsPerFile", 1).parquet(path)
    return sorted(spark.read.schema(kind).parquet(path).inputFiles())


@lru_cache(2)
def load(file: str, window: int) -> Query:
    """The slice in a file, read by a task."""
    import pyarrow.parquet as pq

    system, path = c.file_system(file)
    rows = pq.read_table(path, filesystem=system, partitioning=None).to_pylist()
    return Query([x for r in rows for x in r["ids"]], [x for r in rows for x in r["texts"]], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids, ascending), matches (longest, with places), longest and contaminated."""
    c.small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_hit", "items", "matches", "longest", "contaminated")
    match = match_type(benchmark.schema["item_id"].dataType)
    item = match.elementType["item_id"].dataType
    arrow = pa.list_(pa.struct([("item_id", pa.int64() if isinstance(item, T.LongType) else pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))
    state = docs.withColumns({"__words": F.lit(None).cast("long"), "__n_hit": F.lit(0).cast("long"), "__hits": F.lit(None).cast("binary"), "__matches": F.lit(None).cast(match), "__items": F.lit(None).cast(T.ArrayType(item))})
    for file in slices(benchmark, slice_words) or [None]:
        state = state.mapInArrow(marker(file, window, arrow), state.schema)
    return state.select(
        *docs.columns,
        F.col("__words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.array_sort(F.coalesce("__items", F.array().cast(T.ArrayType(item)))).alias("items"),
        F.coalesce("__matches", F.array().cast(match)).alias("matches"),
        F.coalesce(F.array_max(F.transform("__matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest"),
        F.col("__hits").isNotNull().alias("contaminated"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")
