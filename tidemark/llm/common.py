"""What the operators of this subpackage share: the shared scratch folder, blocks of texts, words and their codes.

Texts travel as Arrow batches into tasks.  A block of documents becomes one byte buffer in
which a line feed parts the texts; words, their 64-bit codes and the codes of word windows are
then computed with numpy for the whole block at once.  Codes only find what may be equal: where
a hit, a link or a removal is decided, the words themselves are compared (same_words, word_ids).
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, save, scratch_dir  # noqa: F401

#: Bytes of text that a task turns into arrays at once (one longer text is a block of its own).
BLOCK_BYTES = 1 << 20
#: Rows, and bytes, of a batch between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 256
#: Words that are hashed or compared at once, so that what stands between takes little memory, however many there are.
STRIDE = 1 << 16
#: A key is often if more than one in OFTEN rows has it; so there are fewer than OFTEN such keys.
OFTEN = 1000

STEP = np.uint64(0xD6E8FEB86659FD93)
SEED = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- files, partitions, joins
def file_system(uri: str):
    """The file system that a URI names, and the path there, for tasks."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession, bytes_: int, each: int) -> int:
    """A number of shuffle partitions that grows with the input."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(bytes_) // each)))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def often_keys(left: DataFrame, key: str) -> list:
    """Keys of more than one in OFTEN rows of left (and more than 100): fewer than OFTEN."""
    counts = save(left.groupBy(key).agg(F.count("*").alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    return [r[key] for r in counts.where(F.col("__n") > max(total // OFTEN, 100)).select(key).collect()]


def join_split(left: DataFrame, right: DataFrame, key: str, often: list | None = None) -> DataFrame:
    """left joined by key to right, which has one row a key; often keys of left don't meet in one task.

    The rows of right for often keys, fewer than OFTEN, are broadcast; all others are joined by
    a shuffle.  left is read several times, so it should be a saved table.
    """
    often = often_keys(left, key) if often is None else often
    if not often:
        return left.join(right, key)
    names = F.broadcast(left.sparkSession.createDataFrame([(x,) for x in often], left.select(key).schema))
    rare = left.join(names, key, "left_anti").join(right, key)
    return rare.unionByName(left.join(F.broadcast(right.join(names, key, "left_semi")), key))


# --------------------------------------------------------------------------- blocks of texts
def small_batches(spark: SparkSession) -> None:
    """Fewer rows and bytes a batch between Spark and Python than suit narrow rows: texts, and packed values, are long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    raw = column if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_binary())
    return [x or b"" for x in raw.to_pylist()]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Cut record batches into runs of rows with at most limit bytes of text: (rows, their texts)."""
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(column))
        if not len(raw):
            continue
        sizes = np.zeros(len(raw), np.int64) if pa.types.is_null(raw.type) else pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 1)
        start = 0
        while start < len(raw):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, texts(part.column(part.schema.get_field_index(column)))
            start = stop


# --------------------------------------------------------------------------- words
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = ~SPACES
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (splitmix64's last step)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a block: byte bounds, 64-bit codes, and the first word of each document.

    kind says of every byte value to which kind of word it belongs (0: to none); a word is a run of
    bytes of one kind.  With lower, A-Z are lower-cased in data.  A code mixes the word's 8-byte pieces one after the
    other with its length and a seed; long words take xxh3 of their bytes instead.
    """

    def __init__(self, raw: list[bytes], kind: np.ndarray = SPACED, lower: bool = False, beginnings: tuple[int, ...] = (), seed: int = 0):
        data = b"\n" + b"\n".join(raw) + b"\n"
        self.data = data.translate(LOWER) if lower else data
        buf = np.frombuffer(self.data, np.uint8)
        kinds = kind[buf]
        edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        self.starts, self.ends = edges[kinds[edges] != 0], edges[kinds[edges - 1] != 0]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw], out=offsets[1:])
        self.first = np.searchsorted(self.starts, offsets + 1)
        self.pieces = pieces(self.data)
        self.key = mix(SEED + np.array([seed], np.uint64))[0]
        self.codes = self._codes()
        #: For each length (at most 8) asked for: codes of the first bytes of words that are longer, 0 for others.
        self.beginnings = []
        for k in beginnings:
            codes = np.zeros(len(self.starts), np.uint64)
            long = np.flatnonzero(self.ends - self.starts > k)
            codes[long] = mix((self.pieces[self.starts[long]] & _MASKS[k]) ^ mix(self.key + np.array([k + 1000], np.uint64))[0])
            self.beginnings.append(codes)

    def _codes(self) -> np.ndarray:
        size = self.ends - self.starts
        code = np.empty(len(size), np.uint64)
        for s in range(0, len(code), STRIDE):
            at, left, own = self.starts[s : s + STRIDE], size[s : s + STRIDE], code[s : s + STRIDE]
            own[:] = mix(self.key ^ left.astype(np.uint64))
            open_ = np.arange(len(own))
            for _ in range(LONG_WORD // 8):
                if not len(at):
                    break
                own[open_] = mix(own[open_] * STEP ^ (self.pieces[at] & _MASKS[np.minimum(left, 8)]))
                more = np.flatnonzero(left > 8)
                open_, at, left = open_[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            code[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]], int(self.key))
        return code

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The document (its index in the block) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and code of every window of k consecutive words of one document."""
        at = self.whole(k)
        return (at, roll(self.codes, k)[at]) if len(at) else (at, np.empty(0, np.uint64))

    def whole(self, k: int) -> np.ndarray:
        """Start word of every window of k consecutive words of one document."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = np.ones(n, bool)
        cut = (self.first[1:-1, None] - np.arange(1, k)).ravel() if k > 1 else np.empty(0, np.int64)
        ok[cut[(cut >= 0) & (cut < n)]] = False
        return np.flatnonzero(ok)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def pieces(data: bytes) -> np.ndarray:
    """The eight bytes from each place of data on, as a number (zeros stand beyond its end)."""
    return np.ndarray(len(data), "<u8", data + b"\0" * 8, 0, (1,))


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b have the same bytes, for arrays of words."""
    i, j = np.asarray(i), np.asarray(j)
    same = np.empty(len(i), bool)
    for s in range(0, len(i), STRIDE):
        same[s : s + STRIDE] = _same_words(a, i[s : s + STRIDE], b, j[s : s + STRIDE])
    return same


def _same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    x, y, size = a.starts[i], b.starts[j], a.ends[i] - a.starts[i]
    same = size == b.ends[j] - b.starts[j]
    open_ = np.flatnonzero(same)
    for k in range(0, LONG_WORD, 8):
        if not len(open_):
            break
        mask = _MASKS[np.minimum(size[open_] - k, 8)]
        differ = (a.pieces[x[open_] + k] & mask) != (b.pieces[y[open_] + k] & mask)
        same[open_[differ]] = False
        open_ = open_[~differ]
        open_ = open_[size[open_] > k + 8]
    for o in open_.tolist():
        same[o] = a.word(i[o]) == b.word(j[o])
    return same


def word_ids(w: Words) -> np.ndarray:
    """A number for each word, equal exactly for words of equal bytes."""
    _, first, ids = np.unique(w.codes, return_index=True, return_inverse=True)
    if not same_words(w, np.arange(len(ids)), w, first[ids]).all():  # one code of several words
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w.word(i), len(names)) for i in range(len(w.codes))], np.int64)
    return ids


def roll(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of all runs of k values, an array shorter by k - 1."""
    n = len(codes) - k + 1
    out = codes[:n].copy()
    for i in range(1, k):
        out *= STEP
        out += codes[i : i + n]
    return mix(out)


def cover(n: int, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the given words."""
    opened = np.bincount(at, minlength=n + 1)
    return np.cumsum((opened - np.bincount(np.minimum(at + k, n), minlength=n + 1))[:n]) > 0


def long_array(x) -> np.ndarray:
    """An Arrow column of longs as numpy; null becomes the smallest long."""
    return x.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
