"""Packing by minimum bin slack: windows of tokens filled by bitset subset sums over remaining lengths.

Every document becomes token ids and an end id.  Pieces of a whole window are cut off first; the
rest of each document is shorter than a window.  A task packs the rests of PACK_PIECES pieces
at a time: it counts the pieces of each length, takes the longest that is left, and asks which
multiset of the others fills the window closest to its capacity.  Reachable sums are the set
bits of one integer per step (a length that occurs k times is offered as 1, 2, 4, ... copies),
and walking back through the steps gives how many of each length to take.  The pattern is
used as often as the counts allow before the next one is sought.  Windows that the rests of
a batch can't fill to the last token stay open: their rests wait for the next batch.  At a task's
end (or when more than half a batch waits) open windows' rests are laid end to end and cut at the
windows' edges, and what is left over, less than a window, is cut into sequences of powers of two,
which need no padding.  So nothing is padded, whatever the number of tasks; each adds nine short
sequences at most.

Tasks pack on their own, so nothing is shuffled or gathered; sequence ids carry the task's
number.  A task that is run again packs the same rows the same way.

Defined cases: null or empty text is the end id alone; equal rows are packed as often as they
occur; rows without doc_id are packed like others; very long texts are cut into whole windows;
an empty table gives an empty table.  Only doc_id and text are read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as c

WINDOW = 1024
END = 0
#: Rests packed at once by a task; at 1,024 tokens each this is 64 MB of ids.
PACK_PIECES = 16_384
PIECE = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def encoder(path: str):
    """A function from text to token ids: the byte-level BPE of a tokenizers file, run by tiktoken.

    The file's vocabulary lists a merge's result with an id in order of rank, so its ids are the
    ranks; the ids are those that tokenizers gives (held against it in the tests), several
    times as fast.  Added tokens that stand in a text are one id each, as there.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, added = file["model"]["vocab"], file.get("added_tokens", [])
    if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in what stands around them")
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte[x] for x in token): i for token, i in vocabulary.items() if all(x in byte for x in token) and not token.startswith("<|")}
    special = {x["content"]: x["id"] for x in added}
    encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return partial(encoding.encode, allowed_special=set(special), disallowed_special=())


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths whose sum is closest to capacity from below, as (length, copies)."""
    reach, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> capacity:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + copies
            at -= length * copies
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of lengths, the longest first, with how many windows use each; every piece is used once."""
    counts, out = dict(counts), []
    while counts:
        top = max(counts)
        counts[top] -= 1
        pattern = dict(fill({k: v for k, v in counts.items() if v}, window - top))
        counts[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        out.append((sorted(pattern.items(), reverse=True), times))
    return out


def packer(path: str, window: int, end: int, digest: bool):
    def run(batches):
        encode = encoder(path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        rests: list[tuple] = []
        ready: list[tuple] = []

        def piece(doc, start, ids, total, number, offset):
            raw = ids.tobytes()
            return (doc, start, len(ids), zlib.crc32(raw) if digest else raw, total, number, offset)

        def put(pieces: list[tuple]):
            nonlocal sequence
            offset = 0
            for x in pieces:
                ready.append(piece(*x, sequence, offset))
                offset += len(x[2])
            sequence += 1

        def pack(last: bool = False):
            by: dict[int, list] = {}
            for x in rests:
                by.setdefault(len(x[2]), []).append(x)
            rests.clear()
            for pattern, times in plan({k: len(v) for k, v in by.items()}, window):
                full = sum(k * n for k, n in pattern) == window
                for _ in range(times):
                    pieces = [by[length].pop() for length, copies in pattern for _ in range(copies)]
                    put(pieces) if full else rests.extend(pieces)
            if last or len(rests) > PACK_PIECES // 2:
                cut(last)

        def cut(last: bool):
            """Rests end to end: whole windows, and at the end powers of two."""
            todo, left = rests[::-1], sum(len(x[2]) for x in rests)
            rests.clear()
            while left >= window or (last and left):
                room = window if left >= window else 1 << (left.bit_length() - 1)
                left -= room
                pieces = []
                while room:
                    doc, start, ids, total = todo.pop()
                    pieces.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        todo.append((doc, start + room, ids[room:], total))
                    room -= len(pieces[-1][2])
                put(pieces)
            rests.extend(todo)

        def batch():
            names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.binary()] + [pa.int64()] * 3
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=names)
            ready.clear()
            return out

        for part, raw in c.blocks(batches, limit=4 * c.BLOCK_BYTES):
            for doc, text in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), raw, strict=True):
                ids = np.array([*encode(text.decode("utf-8", "replace")), end], np.dtype("<u4"))
                total = len(ids)
                whole = total - total % window
                for start in range(0, whole, window):
                    ready.append(piece(doc, start, ids[start : start + window], total, sequence, 0))
                    sequence += 1
                if whole < total:
                    rests.append((doc, whole, ids[whole:].copy(), total))
                    if len(rests) >= PACK_PIECES:
                        pack()
            if len(ready) > 2000:
                yield batch()
        pack(last=True)
        if ready:
            yield batch()

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end: int = END, digest: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids as little-endian unsigned 32-bit.

    With digest, ids_crc32 stands in the place of ids.
    """
    c.small_batches(docs.sparkSession)
    kind = PIECE
    if digest:
        kind = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in PIECE.fields])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(packer(vocabulary or default_vocabulary(), window, end, digest), kind)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
