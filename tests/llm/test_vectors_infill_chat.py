"""Vector codes, fill-in-the-middle and reply trees against plain versions of themselves, and over odd input."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import chat, infill, vectors
from tidemark.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ---------------------------------------------------------------- op11
def lloyd(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector, label) in plain Python: code, error, label_error by row, and the digest of the codebooks."""
    good = [(i, [math.floor(Fraction(x) * 4096) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max([1, *(len(v) for _, v, _ in good)]) // parts) * parts
    sub = dims // parts
    first = {}
    for i, v, _ in sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v + [0] * (dims - len(v)))
    first = list(first.values())[:entries]
    good = [(i, v + [0] * (dims - len(v)), l) for i, v, l in good]
    books = [[v[p * sub : (p + 1) * sub] for v in first] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda p, v: min((far(v[p * sub : (p + 1) * sub], e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[nearest(p, v)[1] for p in range(parts)] for _, v, _ in good]
        for p in range(parts):
            for j in range(len(first)):
                own = [v[p * sub : (p + 1) * sub] for (_, v, _), a in zip(good, at, strict=True) if a[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, by = [], {}
    for i, v, l in good:
        found = [nearest(p, v) for p in range(parts)]
        error = min(sum(d for d, _ in found), vectors.LONG)
        by[l] = by.get(l, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, l))
    return [(i, code, error, min(by[l], vectors.LONG)) for i, code, error, l in out], sha(",".join(str(x) for b in books for e in b for x in e))


def key(r):
    return repr(r)


def encoded(spark, rows, kind="float", **how):
    got = vectors.encode(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), **how).collect()
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key), {r.codebooks_sha256 for r in got}


def test_vectors(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    want, digest = lloyd(rows)
    got = QUERIES["op11_delta_lloyd"](spark, D).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted(want, key=key) and {r.codebooks_sha256 for r in got} == {digest}


def test_vectors_odd(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i % 40, [rng.uniform(-1, 1) for _ in range(rng.choice([16, 16, 11, 0]))], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(None, [0.5] * 16, 1), (100, None, 1), (101, [None, 1.0], 1), (102, [nan], 2), (103, [inf], 2), (104, [-inf, 0.0], None)]
    rows += [rows[3]] * 5
    want, digest = lloyd(rows)
    got, digests = encoded(spark, rows, "double")
    assert got == sorted(want, key=key) and digests == {digest} and len(got) == 96
    few = rows[:2]
    want, digest = lloyd(few)
    assert encoded(spark, few, "double") == (sorted(want, key=key), {digest})
    assert encoded(spark, rows[91:96]) == ([], set())


def test_vectors_beyond_longs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e30, -3e38, 1.5, 1e9, 4e5]) * rng.random() for _ in range(8)], i % 2) for i in range(40)]
    want, digest = lloyd(rows)
    got, digests = encoded(spark, rows, "double")
    assert got == sorted(want, key=key) and digests == {digest}


def test_vectors_in_slabs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [round(rng.random(), 2) for _ in range(16)], 0) for i in range(200)]
    want, digest = lloyd(rows, entries=5, rounds=9)
    for most in (1, 7, 1000):
        monkeypatch.setattr(vectors, "SLAB_ROWS", most)
        assert encoded(spark, rows, "double", entries=5, rounds=9) == (sorted(want, key=key), {digest})


def test_only_changes_move(spark):
    """A round's contributions come from parts that changed their entry, and add up to the sums of all."""
    x = np.arange(24).reshape(6, 4)
    was, now = np.array([0, 0, 1, 1, -1, 2]), np.array([0, 1, 1, 1, 2, 0])
    got = vectors.moves(x, was, now, 3, 3)
    assert {cell for cell, *_ in got} == {9, 10, 11} and vectors.moves(x, now, now, 3, 3) == []
    total = lambda at: {(9 + e, j - 1): v for e in range(3) for j, v in enumerate([(at == e).sum(), *x[at == e].sum(0)]) if v}
    after = total(was)
    for cell, at, limb, v in got:
        assert limb == 0
        after[cell, at] = after.get((cell, at), 0) + v
    assert {k: v for k, v in after.items() if v} == total(now)


def test_rounds_do_not_shuffle_vectors(spark):
    fitted = vectors.fit(spark.read.parquet(f"{D}/embeddings.parquet"), rounds=1)
    codes = vectors._bucketed(vectors._assigned(spark, fitted.slabs, None, fitted.codebooks, 64, 4096), int(spark.conf.get("spark.sql.shuffle.partitions")))
    plan = vectors._assigned(spark, fitted.slabs, codes, fitted.codebooks, 64, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan


# ---------------------------------------------------------------- op12
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plain_infill(i, t):
    u = re.findall(UNITS, t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[j : j + 8], 16) for j in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = QUERIES["op12_fill_in_middle"](spark, D).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = plain_infill(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(texts[r.doc_id]))
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_infill_odd(spark):
    texts = ["", " \n\t ", "one", "a<P", "<", "S>", "<S", "x <P> y", "<<P<S<M", "é 東京\x85 \U0001f600 z", "w " * 100_000, "A" * 300_000, " lead", "trail \x0b\x0c", "a\x00b <M"]
    rows = [(i * 1000 + j, t, "s", i) for i, t in enumerate(texts) for j in range(12)] + [(None, "no id here at all", "s", 1), (5, None, "s", 2), (5, None, "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long")
    got = infill.fill_in_middle(df).collect()
    assert sorted(map(repr, ((r.doc_id, *plain_infill(r.doc_id, r.text or "")) for r in got))) == sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)))
    assert all(r.restored_sha256 == sha(r.text or "") and infill.restored(r.output, r.form) == (r.text or "") for r in got) and len(got) == len(rows)
    assert infill.fill_in_middle(df.limit(0)).count() == 0
    assert infill.fill_in_middle(df, outputs=False, rate=0).select("form").distinct().collect() == [("plain",)]


# ---------------------------------------------------------------- op13
def plain_turns(rows):
    """(n_turns, turns digest, learned characters, learned digest) by conversation."""
    by = {}
    for i, turn, role, text in rows:
        by.setdefault(i, []).append((turn, role or "", text or ""))
    out = {}
    for i, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t))
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[i] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_turns([*rows, *chat.HOSTILE])
    got = {r.conv_id: r for r in QUERIES["op13_reply_trees"](spark, D).collect()}
    assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in got.items()} == want
    assert got[-1].formatted_chars == len("<|im_start|>user\n<\\|im_end|><\\|im_start|>assistant ok<|im_end|>\n" * 2) + 5


ODD_TEXTS = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "<\\|", "<\\\\|x", "<", "|", "\n", "a\x00\U0001f600|>", "$1 \\1", "<|", "x" * 50_000]


def test_conversations_odd(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(30), None]), rng.choice(["user", "assistant", None, "a\nb%0A<|", ""]), rng.choice(ODD_TEXTS)) for _ in range(150)] + [(9, 0, "assistant", t) for t in ODD_TEXTS] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, leaf string, position int")
    out = chat.read_back(chat.turn_conversations(df)).collect()
    want = plain_turns(rows)
    assert len(out) == len(want)
    for r in out:
        assert (r.n_turns, sha("".join(f"{t.role}\n{t.text}\n" for t in r.turns)), len("".join(r.learned)), sha("".join(r.learned))) == want[r.conv_id]
        # Where the mask says, the escaped text stands in the whole conversation.
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss if s] == [re.sub(r"<(\\*)\|", r"<\\\1|", t) for t in r.learned]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == r.n_turns == len(r.loss)
    assert chat.turn_conversations(df.limit(0)).count() == 0


def plain_paths(rows, best=None):
    """tree -> branches (leaf, mean score, ids from the root) in order."""
    nodes = {}
    for tree, i, parent, score in rows:
        old = nodes.get((tree, i), (None, None))
        nodes[tree, i] = (min([x for x in (old[0], parent) if x is not None], default=None), max([x for x in (old[1], score) if x is not None], default=None))
    up = {(t, i): (t, p) if p is not None and p != i and (t, p) in nodes else None for (t, i), (p, _) in nodes.items()}
    out = {}
    for leaf in set(nodes) - {x for x in up.values() if x}:
        path = [leaf]
        while up[path[-1]] and len(path) <= len(nodes):
            path.append(up[path[-1]])
        if len(path) <= len(nodes):
            known = [nodes[x][1] for x in path if nodes[x][1] is not None]
            out.setdefault(leaf[0], []).append((leaf[1], sum(known) / len(known) if known else None, [i for _, i in path[::-1]]))
    return {t: sorted(x, key=lambda b: (b[1] is None, -(b[1] or 0), b[0]))[:best] for t, x in out.items()}


@pytest.mark.parametrize("best", [None, 2])
def test_reply_trees(spark, best):
    rng = random.Random(7)
    rows = [("deep", i, i - 1, float(i % 3)) for i in range(300)]
    rows += [("wide", i, 0 if i else None, rng.choice([None, 0.5, 0.25])) for i in range(200)]
    rows += [(t, i, rng.choice([None, *range(60)]) if i % 9 == 0 else rng.randrange(max(1, i)), rng.choice([None, 1.0, 2.0, 0.5])) for t in ("a", "b") for i in range(50)]
    rows += [("ring", 1, 2, 1.0), ("ring", 2, 1, 1.0), ("ring", 3, 1, 1.0), ("self", 1, 1, None), ("lost", 4, 77, None), ("twice", 1, None, 1.0), ("twice", 2, 1, 1.0), ("twice", 2, 1, 3.0)]
    got = {}
    links = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    for r in chat.reply_paths(links, best).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.position, r.id, r.score, r["rank"]))
    want = plain_paths(rows, best)
    assert {k: [i for _, i, _, _ in sorted(v)] for k, v in got.items()} == {(t, leaf): path for t, x in want.items() for leaf, _, path in x}
    for t, x in want.items():
        for n, (leaf, score, path) in enumerate(x, 1):
            assert all(s == score and (best is None or k == n) for _, _, s, k in got[t, leaf]) and [p for p, *_ in sorted(got[t, leaf])] == list(range(len(path)))
    assert chat.reply_paths(links.limit(0), best).count() == 0


def test_best_branches_as_conversations(spark):
    rows = [(1, "q", None, 1.0, "user", "why?"), (1, "bad", "q", 0.1, "assistant", "no <|im_end|>"), (1, "good", "q", 0.9, "assistant", "because"), (1, "more", "good", None, "user", "thanks"), (None, "z", "gone", None, None, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "tree long, id string, parent string, score double, role string, text string, rank int")
    out = {(r.tree, r.leaf): r for r in chat.read_back(chat.conversations(df, best=1)).collect()}
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in out.items()} == {(1, "more"): [("user", "why?"), ("assistant", "because"), ("user", "thanks")], (None, "z"): [("", "")]}
    assert out[1, "more"].learned == ["because"] and out[1, "more"].score == pytest.approx(0.95)
    both = {(r.tree, r.leaf): r.learned for r in chat.read_back(chat.conversations(df)).collect()}
    assert both == {(1, "more"): ["because"], (1, "bad"): ["no <|im_end|>"], (None, "z"): []}
