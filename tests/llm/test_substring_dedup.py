import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import substring_dedup as operator
from tidemark.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, n_words string, lang string"


def brute(rows, k=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (5, f"intro {passage} end"),
        (2, f"other start\n{passage}\tand \x0b more"),
        (9, passage),
        (11, passage + " " + passage),
        (12, "the " * 60),
        (13, "the " * 30 + "x"),
        (20, None),
        (21, ""),
        (22, "   \n"),
        (23, "w1 w2 w3"),
        (24, "é ß " * 20),
        (25, "z é ß " * 3 + "é ß " * 20),
        (26, " ".join(f"w{i}" for i in range(5, 18))),
        (27, " ".join(f"w{i}" for i in range(5, 17))),
        (30, "a b " * 14),
    ]
    df = spark.createDataFrame([(i, t, "mine", "en") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in substring_dedup(df, digest=True).collect()}
    want = brute(rows)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    full = substring_dedup(df)
    assert full.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "spans", "kept_text"]
    for r in full.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == want[r.doc_id][2]
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and r.lang == "en"


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    p = " ".join(f"w{i}" for i in range(13))
    rows = spark.createDataFrame([(1, p), (1, p), (None, p), (2, p)], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in substring_dedup(rows).collect())
    assert got == [(-1, 13), (1, 0), (1, 0), (2, 13)]


def test_sample_table(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    df = spark.read.parquet(d)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, digest=True).collect()}
    assert got == want


def _peak(step, batches):
    tracemalloc.start()
    out = list(step(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_memory_of_a_task():
    """A slab's runs and a group's suffixes take little more memory than the words that stand in them."""
    rng = np.random.default_rng(5)
    names = np.array([f"w{i:x}" for i in range(20_000)])
    texts = [" ".join(names[rng.integers(0, len(names), 3_000)]) for _ in range(200)]
    texts[7] = texts[3]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=[operator.KEY, operator.ROW, "text"])
    size, none = sum(map(len, texts)), [np.empty(0, np.uint64)] * 2
    sent, peak = _peak(operator.leaves(13, none, 1), [batch])
    assert peak < 40 * size, peak / size
    found, peak = _peak(operator.subtrees(13), sent)
    assert peak < 40 * size, peak / size
    assert [x.to_pylist() for x in found] == [[{operator.KEY: 7, operator.ROW: 7, "start": 0, "stop": 3_000}]]
