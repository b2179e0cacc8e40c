"""Decontamination without Spark: repeated words on both sides, and matches against a plain version."""

import random
import resource
import time

import pyarrow as pa
import pytest

from tidemark.llm import decontaminate

MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())]))


@pytest.fixture
def marked(monkeypatch):
    def run(items, texts, window=10):
        monkeypatch.setattr(decontaminate, "load", lambda file, w: decontaminate.Query(list(range(len(items))), items, w))
        n = len(texts)
        none = lambda kind: pa.array([None] * n, kind)
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "__words": none(pa.int64()), "__n_hit": pa.array([0] * n, pa.int64()), "__hits": none(pa.binary()), "__matches": none(MATCH), "__items": none(pa.list_(pa.int64()))})
        return [r for x in decontaminate.marker("file", window, MATCH)([batch]) for r in x.to_pylist()]

    return run


def test_repeated_words_on_both_sides(marked):
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    (r,) = marked(["w " * 2000], ["w " * 200_000])
    assert time.time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 * 1024
    assert r["__n_hit"] == 200_000 and r["__items"] == [0] and max(m["length"] for m in r["__matches"]) == 2000 and len(r["__matches"]) < 200
    _, r = marked(["w " * 2000, "a w"], ["", ("w " * 11 + "j ") * 5000])
    assert r["__n_hit"] == 55_000 and [m["length"] for m in r["__matches"]] == [11] * 5000


def plain(items, text, window):
    """Hit words, items, and the longest match."""
    t, hit, found, best = text.split(), set(), set(), 0
    for k, item in enumerate(i.split() for i in items):
        n = min(window, len(item))
        for a in range(len(item) - n + 1 if item else 0):
            for p in range(len(t) - n + 1):
                if t[p : p + n] == item[a : a + n]:
                    hit |= set(range(p, p + n))
                    found.add(k)
                    length = n
                    while len(item) >= window and a + length < len(item) and p + length < len(t) and item[a + length] == t[p + length]:
                        length += 1
                    best = max(best, length)
    return len(hit), sorted(found), best


@pytest.mark.parametrize("seed", range(40))
def test_matches_against_a_plain_version(marked, seed):
    rng = random.Random(seed)
    window, letters = rng.choice([1, 2, 3, 4]), rng.choice(["ab", "abc"])
    items = [" ".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(4)]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(6)]
    for text, r in zip(texts, marked(items, texts, window), strict=True):
        told = r["__matches"] or []
        assert (r["__n_hit"], r["__items"] or [], max((m["length"] for m in told), default=0)) == plain(items, text, window)
        for m in told:
            at, p, n = m["item_word"], m["doc_word"], m["length"]
            assert items[m["item_id"]].split()[at : at + n] == text.split()[p : p + n]
