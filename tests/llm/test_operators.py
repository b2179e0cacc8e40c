"""Each operator against a plain version of itself, and over nulls, ties, repeats, clashing names and empty tables."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import common, decontaminate, graph, kneser_ney, licenses, media, minhash, packing, sharding, substring_dedup, toxicity, warc
from tidemark.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
ODD = [(None, "x y z " * 10), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "é " * 4000), (6, "A" * 50_000), (7, "Zürich 東京 42\x0b\x85"), (8, "\x00\x01"), (9, "same text here for all of you"), (10, "same text here for all of you")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in (t or ""))


# ---------------------------------------------------------------- words
def test_words():
    for raw in (["a bb  ccc\x0bd", "", "x", "  ", "é\x85ü z"], [""], ["w" * 5000 + " v"], []):
        for kind, pattern, low in ((common.SPACED, r"[^\x20\x09-\x0D]+", False), (common.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
            w = common.Words([t.encode() for t in raw], kind=kind, lower=low)
            want = [re.findall(pattern, lower(t) if low else t) for t in raw]
            got = [[w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(raw))]
            assert [[lower(x) if low else x for x in g] for g in got] == want
            names = {}
            for d, g in enumerate(want):
                for j, x in enumerate(g):
                    assert names.setdefault(x, w.codes[w.first[d] + j]) == w.codes[w.first[d] + j]
            assert len(set(names.values())) == len(names)
            at, code = w.windows(2)
            assert [tuple(w.word(i) for i in (a, a + 1)) for a in at] == [(x.encode(), y.encode()) for g in [re.findall(pattern, t) if not low else [w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d, t in enumerate(raw)] for x, y in zip(g, g[1:], strict=False)]


def test_codes_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    text = b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(300_000))
    w = common.Words([b"pad " * 7, text])
    alone = common.Words([b"q"] + [w.word(i) for i in range(len(w.codes) - 50, len(w.codes))])
    assert list(alone.codes[1:]) == list(w.codes[-50:])


THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


class Colliding(common.Words):
    """Words whose codes are all alike where their lengths are."""

    def _codes(self):
        return common.mix((self.ends - self.starts).astype(np.uint64))


@pytest.fixture(params=["codes", "colliding codes"])
def codes(request, monkeypatch):
    if request.param != "codes":
        monkeypatch.setattr(common, "Words", Colliding)


def test_words_decide(codes):
    """Words of one code are told apart where a hit, a link or a removal is decided."""
    w = common.Words([f"{THUE} {MORSE} {THUE} one two".encode()])
    assert (common.word_ids(w)[[0, 0, 3]] != common.word_ids(w)[[1, 4, 4]]).all() and common.word_ids(w)[0] == common.word_ids(w)[2]
    nine = " ".join(f"w{i}" for i in range(9))
    query = decontaminate.Query([1], [f"{nine} {THUE}"], 10)
    for last, want in ((THUE, 1), (MORSE, 0)):
        q, place = decontaminate.search(common.Words([f"x {nine} {last}".encode()], kind=common.ALNUM, lower=True), query)
        assert len(q) == want
    own = minhash.Shingles([f"a b c d {THUE}".encode(), f"a b c d {MORSE}".encode(), f"a b c d {THUE.upper()}".encode()])
    assert own.common(0, own, 1) == 0 and own.common(0, own, 2) == 1
    both = minhash.Shingles([f"a b c d {THUE} a b c d {MORSE}".encode()])
    assert both.count[0] == 6


def test_words_decide_in_tables(spark):
    nine, twelve = (" ".join(f"w{i}" for i in range(n)) for n in (9, 12))
    df = spark.createDataFrame([(1, f"{twelve} {THUE}"), (2, f"{twelve} {MORSE}"), (3, f"{twelve} {THUE}"), (4, f"a b c d {THUE}"), (5, f"a b c d {MORSE}")], SCHEMA)
    cut = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df, digest=True).collect()}
    assert cut == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert found[4] == 4 and found[5] == 5 and found[3] == 1
    hit = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(df, spark.createDataFrame([("q-1", f"w3 w4 w5 w6 w7 w8 w9 w10 w11 {THUE}")], "item_id string, text string")).collect()}
    assert hit == {1: 10, 2: 0, 3: 10, 4: 0, 5: 0}


# ---------------------------------------------------------------- op1
def test_sharding(spark, docs, odd):
    for df in (docs.select("doc_id", "text"), odd, docs.limit(1).select("doc_id", "text")):
        rows = sharding.shard(df.withColumn("shard", df.doc_id)).collect()
        assert len(rows) == df.count()
        by = collections.defaultdict(list)
        for r in rows:
            raw = (r.text or "").encode()
            assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 8
            by[r.shard].append(r)
        for s in by.values():
            assert sorted(r.slot for r in s) == list(range(len(s)))
        total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        for s in by.values():
            assert sum(r["size"] for r in s) <= total / 8 + most + total * sharding.EDGE
    assert sharding.shard(odd.limit(0)).count() == 0


def test_sharding_against_a_plain_version(spark, docs):
    """Records in the order of their keys, cut where a shard's bytes are full or a group ends near there."""
    rows = QUERIES["op1_sampled_splitters"](spark, D).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h")).collect()}
    order = sorted(texts, key=lambda i: (hashes[i], i))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == order
    size = {i: len((texts[i] or "").encode()) + 1 for i in texts}
    total, at, starts = sum(size.values()), 0, []
    for n, i in enumerate(order):
        starts.append((at, n == 0 or hashes[order[n - 1]] != hashes[i]))
        at += size[i]
    shard = {r.doc_id: r.shard for r in rows}
    for s in range(1, 8):
        want, edge = total * s // 8, total * sharding.EDGE / 8
        first = next(n for n, i in enumerate(order) if shard[i] >= s)
        whole = [x for x, new in starts if new and abs(x - want) <= edge]
        assert starts[first][0] == min(whole or [x for x, _ in starts], key=lambda x: (abs(x - want), x))


def test_hot_group_is_split(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same hot text' else concat('text number ', id) end as text")
    sizes = collections.Counter()
    for r in sharding.shard(df).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


# ---------------------------------------------------------------- op3
def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    assert auc > 0.75 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    features = np.arange(1, 41, dtype=np.uint64)
    pos = [np.unique(np.append(rng.integers(11, 41, 8), rng.integers(1, 4, 2))).astype(np.uint64) for _ in range(60)]
    neg = [np.unique(rng.integers(11, 41, 8)).astype(np.uint64) for _ in range(540)]
    more = [np.unique(np.append(rng.integers(11, 41, 8), rng.integers(1, 4, 2))).astype(np.uint64) for _ in range(60)]
    w, b = toxicity.train(toxicity.Sparse(pos, features), toxicity.Sparse(neg + more, features), 40, 0.1)
    score = lambda rows: 1 / (1 + np.exp(-(toxicity.Sparse(rows, features).dot(w) + b)))
    assert score(more).mean() > 0.6 and score(neg).mean() < 0.1


def toxicity_plain(docs, labels):
    """The same classifier with dictionaries: which words get a weight, and every text's score."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lower(t).encode())
    kinds = lambda t: {(0, w) for w in words(t)} | {(k, w[:k]) for w in words(t) for k in toxicity.BEGINNINGS if len(w) > k}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    toxic = {}
    for i, x in labels:
        if not held(i) and x is not None:
            toxic[i] = max(x, toxic.get(i, 0))
    prior = min(max(sum(toxic.values()) / len(toxic), 0.005), 0.5)
    sets, first = {i: kinds(t) for i, t in docs}, {}
    for i, t in sorted(docs):
        if not held(i):
            first.setdefault(t, i)
    alike = {i: {j for j, x in docs if x == t} for i, t in docs}
    open_ = sorted(first.values())
    bad = [i for i in open_ if any(toxic.get(j) for j in alike[i])]
    u, p = collections.Counter(w for i in open_ for w in sets[i]), collections.Counter(w for i in bad for w in sets[i])
    best = []
    for w in u:
        share = (u[w] + p[w] + 0.5) / (len(open_) + len(bad) + 1)
        spread = math.sqrt(share * (1 - share) * (1 / len(bad) + 1 / len(open_)))
        z = abs(p[w] / len(bad) - u[w] / len(open_)) / max(spread, 1e-9)
        if u[w] + p[w] >= toxicity.LEAST_TEXTS and z > toxicity.LEAST_SPREADS:
            best.append((-z, w))
    names = {w: n for n, (_, w) in enumerate(sorted(best)[: toxicity.FEATURES])}
    row = lambda i: tuple(sorted(names[w] for w in sets[i] if w in names))
    sparse = lambda ids: toxicity.Sparse([np.array(x, np.uint64) for x in sorted(row(i) for i in ids)], np.arange(len(names), dtype=np.uint64))
    weights, bias = toxicity.train(sparse(bad), sparse(open_), len(names), prior)
    return {i: 1 / (1 + math.exp(-(bias + sum(weights[j] for j in row(i))))) for i in sets}


def test_toxicity_against_a_plain_version(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op3_nnpu_toxicity"](spark, D).collect()}
    want = toxicity_plain([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    assert got == pytest.approx(want, abs=0.02)


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, None), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd.withColumn("score", odd.doc_id), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    want = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 11)}
    assert all(r.held_out == want.get(r.doc_id, False) for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0


# ---------------------------------------------------------------- op4
def contaminated(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = find(t)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for i, t in docs:
        w, hit, found = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_words", [2_000_000, 15])
def test_decontamination(spark, slice_words):
    long = " ".join(f"k{i}" for i in range(30))
    items = [(1, long), (2, "Short Item here"), (3, None), (4, "!!"), (5, "one"), (6, " ".join(f"k{i}" for i in range(5, 17))), (6, "alpha beta " * 8), (7, "a a a a a a a a a a a a")]
    docs = [*ODD, (20, f"x {long} y"), (21, "K3, " + long[:60]), (22, "short-item HERE short item here"), (23, "beta alpha " * 30), (24, "a " * 25), (25, long[5:] + " " + long), (26, "a " * 9 + "b")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id as items", "1 as n_hit")
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), slice_words=slice_words)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=str) == contaminated(docs, items)
    best = {r.doc_id: (r.longest, [(m.item_id, m.item_word, m.doc_word, m.length) for m in r.matches]) for r in got.where("doc_id = 20").collect()}
    assert best[20][0] == 30 and (1, 0, 1, 30) in best[20][1]


def test_decontamination_tables(spark, docs):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    got = decontaminate.decontaminate(docs.select("doc_id", "text"), bench)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=str)
    assert rows == contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    none = decontaminate.decontaminate(docs.select("doc_id", "text"), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


# ---------------------------------------------------------------- op5
def word_units(text):
    """Runs of letters and digits, runs of marks, and single characters of scripts written without blanks."""
    return re.findall(r"[\u3000-\u9fff\u0e00-\u0eff\u1000-\u10ff\u1780-\u17ff\U00020000-\U0003ffff]|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u3000-\u9fff\u0e00-\u0eff\u1000-\u10ff\u1780-\u17ff\U00020000-\U0003ffff]+|[\x00-\x08\x0e-\x1f\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")


def kneser_ney_plain(trusted, cut=2):
    """Interpolated modified Kneser-Ney over pairs of words, written out; a function of a text and whether it is trusted.

    A trusted text's own grams that no other has are unknown.
    """
    pairs = lambda t: list(zip(["", *word_units(t)], word_units(t), strict=False))
    two = collections.Counter(g for t in trusted for g in pairs(t))
    one, said, before, after = collections.Counter(b for _, b in two), collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for (a, b), n in two.items():
        said[b] += n
        before[a] += n
        after[a].append(n)

    def discounts(table):
        n = collections.Counter(table.values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]

    d1, d2 = discounts(one), discounts(two)
    rest = sum(d1[min(n, 3) - 1] for n in one.values()) / (len(one) + 1)
    total = sum(one.values())
    back = {a: sum(n if n < cut else d2[min(n, 3) - 1] for n in ns) / before[a] for a, ns in after.items()}

    def nats(text, own=False):
        mine = pairs(text)
        mine2, mine1, mine0 = (collections.Counter(x) if own else collections.Counter() for x in (mine, [b for _, b in mine], [a for a, _ in mine]))
        out = 0.0
        for a, b in mine:
            full = lambda w: (one[w] - d1[min(one[w], 3) - 1] + rest) / total
            low = full(b) if said[b] > mine1[b] else rest / total
            held = back[a] if before[a] > mine0[a] else 1.0
            if two[a, b] > mine2[a, b] and two[a, b] >= cut:
                # the pair's gain is that over what the whole model says of its words
                gain = ((two[a, b] - d2[min(two[a, b], 3) - 1]) / before[a] + back[a] * full(b)) / (back[a] * full(b))
                out -= math.log(held * low * gain)
            else:
                out -= math.log(held * low)
        return out

    return nats


def test_kneser_ney(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = kneser_ney.score(docs.select("doc_id", "lang", "text"), labels).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    plain = kneser_ney_plain([r.text for r in rows if r.doc_id in good])
    for r in rows:
        assert r.n_words == len(word_units(r.text))
        assert r.nats == pytest.approx(plain(r.text, r.doc_id in good), rel=1e-5, abs=1e-5)
    kept = {r.doc_id for r in rows if r.kept}
    assert len(good & kept) >= 0.98 * len(good & {r.doc_id for r in rows})
    of = collections.defaultdict(list)
    for r in rows:
        if r.doc_id in good and r.n_words:
            of[r.lang].append(r)
    middle = lambda x: math.floor(sorted(x)[math.ceil(len(x) * 0.5) - 1] * 1000) / 1000 + 0.001
    some = max(of.values(), key=len)
    assert len(some) >= kneser_ney.LEAST
    m = middle([r.nats / r.n_words for r in some])
    drawn = sorted((r.nats + kneser_ney.PRIOR * m) / (r.n_words + kneser_ney.PRIOR) for r in some)
    bound = math.floor(drawn[math.ceil(len(drawn) * kneser_ney.QUANTILE) - 1] * 1000) / 1000 + 0.001
    assert all(r.threshold == pytest.approx(bound) for r in rows if r.lang == some[0].lang)


def test_kneser_ney_without_hot_grams_or_filter(spark, docs, monkeypatch):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    few = docs.select("doc_id", "lang", "text")
    want = {r["__key"]: (r.n_words, r.gain) for r in kneser_ney.gains(kneser_ney._marked(few, labels))[0].collect()}
    monkeypatch.setattr(kneser_ney, "HOT", 7)
    monkeypatch.setattr(kneser_ney, "bloom", lambda table: np.full(1 << (kneser_ney.FILTER_BITS - 3), 255, np.uint8))
    got = {r["__key"]: (r.n_words, r.gain) for r in kneser_ney.gains(kneser_ney._marked(few, labels))[0].collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-5, abs=1e-4) for k in want)


def test_kneser_ney_odd(spark, odd):
    df = odd.selectExpr("*", "case when doc_id < 5 then 'en' end as lang", "7 as kept")
    for labels in ([(9, 1), (9, 1), (4, 0), (None, 1)], []):
        rows = kneser_ney.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(rows) == len(ODD) and all(r.kept for r in rows if not r.n_words)
    assert kneser_ney.score(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_words_in_wrong_order_are_surprising(spark):
    rng = np.random.default_rng(3)
    chain = {f"{x}word{i}": [f"{x}word{j}" for j in rng.integers(0, 60, 2)] for x in ("", "ж", "Q") for i in range(60)}

    def text(x):
        out = [f"{x}word{rng.integers(60)}"]
        while len(out) < 50:
            out.append(chain[out[-1]][rng.integers(2)])
        return out

    good = [text(("", "ж", "Q")[i % 3]) for i in range(150)]
    wrong = [list(rng.permutation(x)) for x in (text("") for _ in range(20))]
    rows = [(i, "en", " ".join(x)) for i, x in enumerate(good + wrong)] + [(0, "en", " ".join(good[0])), (500, "en", "東京都 word1")]
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    got = kneser_ney.score(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()
    assert len(got) == len(rows)
    plain = kneser_ney_plain([r.text for r in got if r.doc_id < 120])
    for r in got:
        assert r.nats == pytest.approx(plain(r.text, r.doc_id < 120), rel=1e-5)
    assert next(r.n_words for r in got if r.doc_id == 500) == 4
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(120, 150))) >= 28 and not kept & set(range(150, 170))


# ---------------------------------------------------------------- op6
def linked(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 900, 220)]
    rows = [(i, t) for i, t in ODD if i not in (None, 4)] + [(4, "one")]
    for k in range(60):  # a drifting family: neighbours are similar, ends are not
        base = [w if rng.random() > 0.012 else f"n{rng.integers(1e6)}" for w in base]
        rows.append((100 + k, " ".join(base)))
    rows += [(300, "Same  TEXT here\tfor all of you"), (301, "one"), (302, "two")]
    df = spark.createDataFrame(rows + [(None, "one")], SCHEMA)
    got = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == linked(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_table(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == linked([(r.doc_id, r.text) for r in docs.collect()])


def test_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        words = [b"w%d" % x for x in rng.integers(0, 1 << 30, 300)]
        other = [w if rng.random() > 0.03 else b"o%d" % rng.integers(1 << 30) for w in words]
        own = minhash.Shingles([b" ".join(words), b" ".join(other)])
        code, bounds = own.code, own.bounds
        a, b = (set(code[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
        sig = minhash._signatures(code, bounds).view(np.uint64)
        est, _ = minhash._likely(sig[:1], sig[1:], np.array([float(len(a))]), np.array([float(len(b))]))
        errors.append(est[0] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1), (20, 4), *[(100 + i, 101 + i) for i in range(40)], *[(7, 200 + i) for i in range(30)]]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)} | {7: 7} | {200 + i: 7 for i in range(30)}
    assert got == want


# ---------------------------------------------------------------- op7
def test_warc(spark, tmp_path):
    big = "<p>" + "ü" * 900 + "</p>"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (None, "http://f", big), (7, "http://g", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", df_id(rows))
    index = warc.write(df, f"file://{tmp_path}/w")
    back = {r.page_id: r for r in warc.read(index).collect()}
    assert len(back) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = back[i]
        assert (r.bytes, r.digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.kind, r.refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
        assert bytes(r.body) == (b"" if i in (1, 2) else raw)
    part = warc.read(index.where("page_id in (4, 7)")).collect()
    assert sorted(r.page_id for r in part) == [4, 7]
    name = index.first()["archive"].removeprefix("file://")
    assert gzip.open(name).read(8) == b"WARC/1.1"
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def df_id(rows):
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (9000, 10)], gap=200, read=1000) == [(0, 105), (9000, 9010)]
    assert warc.coalesced([(0, 600), (600, 600)], gap=10, read=1000) == [(0, 600), (600, 1200)]
    assert warc.coalesced([]) == []


# ---------------------------------------------------------------- op8
def test_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    end = "<|endoftext|>"
    for text in (f"{end}at the start", f"in the {end} middle", f"in the{end}middle", f"at the end{end}", f"{end}{end} twice \n{end}", end, f"<|endoftext{end}|>", "<|endoftext|", "<|fim|> none", ""):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(900, "it's  a\n\n test—“quoted” 12345 　 x" * 3), (901, "🙂 naïve\r\n\tA1b2"), (902, " ")], SCHEMA)
    df = docs.select("doc_id", "text").unionAll(odd).unionAll(extra).where("doc_id is not null and doc_id not in (4, 5)").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in df.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(1)
    for r in packing.pack(df).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) for r in own)
    used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        used += at
    assert used > 0.97 * 1024 * len(sequences)
    assert packing.pack(odd.limit(0)).count() == 0 and packing.pack(odd).count() >= len(ODD)


def padding(rows):
    """Share of tokens that are padding: sequences go to 1024, but for those of a power of two."""
    size = collections.Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    full = {s: n if n & (n - 1) == 0 else 1024 for s, n in size.items()}
    return 1 - sum(size.values()) / sum(full.values())


@pytest.mark.parametrize("parts", [1, 200])
def test_padding_does_not_depend_on_the_number_of_tasks(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(parts)
    rows = packing.pack(docs, digest=True).collect()
    assert padding(rows) == 0
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in QUERIES["op8_minimum_bin_slack"](spark, D).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_fill():
    rng = np.random.default_rng(7)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 5)}
        capacity = int(rng.integers(1, 90))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
        found = packing.fill(counts, capacity)
        assert sum(k * n for k, n in found) == max(sums) and all(0 < n <= counts[k] for k, n in found)
    plan = packing.plan({700: 3, 324: 2, 100: 5, 1024: 1}, 1024)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern) <= 1024
        for k, n in pattern:
            used[k] += n * times
    assert used == {700: 3, 324: 2, 100: 5, 1024: 1}


# ---------------------------------------------------------------- op9
def scanned(text):
    grams = lambda t: (lambda w: set(zip(w, w[1:], strict=False)))(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))
    found = collections.Counter()
    lines = (text or "").split("\n")
    paragraphs, run = [], []
    for x in [*lines, ""]:
        if re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", lower(x)):
            run.append(x)
        elif run:
            paragraphs.append("\n".join(run))
            run = []
    passages = {}
    for level in (lines, paragraphs, [text or ""]):
        at = 0
        for x in level:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
            if w:
                passages[at, at + len(w)] = x
                at += len(w)
    for x in passages.values():
        a, best = grams(x), set()
        for name, texts in licenses.TEMPLATES.items():
            if a and any(2 * len(a & grams(t)) >= 0.8 * (len(a) + len(grams(t))) - 1e-9 for t in texts):
                best.add(name)
        found.update(best)
    return dict(found)


def test_licenses(spark, docs, odd):
    mit = licenses.TEMPLATES["MIT"][3]
    rows = [*ODD, (30, f"Intro line\n\n{mit[:200]}\n{mit[200:]}\n\nReleased under the MIT License."), (31, mit.upper()), (32, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (33, "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as matches").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "2 as matches"))
    for r in licenses.scan(df).collect():
        assert dict(collections.Counter(m.license for m in r.matches)) == scanned(r.text), r.text[:200]
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_inside_lines(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    mit, bsd2 = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["BSD-2-Clause"][-1]
    rows = [
        (1, f"{filler} Licensed under the Apache License, Version 2.0. {filler}"),
        (2, f"{filler} {mit} {filler} {mit}"),
        (3, f"{filler} {bsd2[:400]} other words here {bsd2[400:]} {filler}"),
        (4, f"Copyright 2020 Nobody {mit}"),
        (5, filler + " the license of the software and the following conditions " + filler),
        (6, f"{filler} This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {filler}"),
        (7, None),
        (8, ""),
    ]
    got = {r.doc_id: [(m.license, m.first_word, m.n_words, m.level) for m in r.matches] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), inside=True).collect()}
    assert ("Apache-2.0", 300, 8, "passage") in got[1] and {x[0] for x in got[1]} == {"Apache-2.0"}
    n = len(re.findall(r"[a-z0-9]+", mit.lower()))
    assert [x[1:3] for x in sorted(got[2]) if x[0] == "MIT" and x[2] == n] == [(300, n), (600 + n, n)]
    assert "BSD-2-Clause" in {x[0] for x in got[3]} and "MIT" in {x[0] for x in got[4]}
    assert got[5] == got[7] == got[8] == [] and "LGPL-3.0" in {x[0] for x in got[6]}
    own = {"Own": ["alpha beta gamma delta epsilon zeta eta theta"]}
    one = licenses.scan(spark.createDataFrame([(1, f"{filler} alpha beta gamma delta epsilon zeta eta theta {filler}")], SCHEMA), own, inside=True).first().matches
    assert [(m.license, m.first_word, m.n_words, m.dice) for m in one] == [("Own", 300, 8, 1.0)]


# ---------------------------------------------------------------- the queries and the pipeline
def test_queries_run(spark):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)
    for n in ("op2_lossless_webp", "op9_license_scan", "op7_warc_index_first"):
        assert QUERIES[n](spark, D).count() > 0


def test_registered_queries_against_plain_versions(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    names = lambda items: hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    want = {i: (words, hit, len(items), names(items), bad) for i, words, hit, items, bad in contaminated(rows, bench)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_suffix_array_decontamination"](spark, D).collect()} == want
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_bbit_minhash"](spark, D).collect()} == linked(rows)
    words, first = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in QUERIES["op10_substring_dedup"](spark, D).collect():
        own = words[r.doc_id]
        gone = {p for k in range(len(own) - 12) if first[tuple(own[k : k + 13])] < r.doc_id for p in range(k, k + 13)}
        kept = " ".join(w for p, w in enumerate(own) if p not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert QUERIES["op5_kneser_ney_quality"](spark, D).count() == len(rows)


def test_repeated_ids_with_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = spark.createDataFrame([(1, long), (1, long + " x"), (1, "other"), (2, long), (3, "z")], SCHEMA)
    found = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert found == [(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True)]
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(rows, labels).count() == 5
    judged = kneser_ney.score(rows.selectExpr("*", "'en' as lang"), labels).collect()
    assert len(judged) == 5 and {r.n_words for r in judged} == {60_000, 60_001, 1}


def test_media_equal_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], SCHEMA)
    a, b = media.read(media.store(df), pixels=False).drop("doc_id").collect()
    assert a == b


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    sets, seen = {}, docs
    for name, stage in p.STAGES:
        seen = common.save(stage(spark, seen, D))
        sets[name] = seen
        if name != "packed":
            assert seen.columns == p.COLUMNS and dict(seen.dtypes) == dict(docs.dtypes)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    clean = {r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1}
    kept = [(r.doc_id, r.text) for r in sets["quality"].collect()]
    assert clean <= {i for i, _ in kept}
    near = [(r.doc_id, r.text) for r in sets["near_duplicates"].collect()]
    assert sorted(near) == sorted((i, t) for i, t in kept if linked(kept)[i][2])
    cut = {r.doc_id: r.text for r in sets["substrings"].collect()}
    first = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in near}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, t in near:
        gone = set()
        for k in range(len(words[i]) - 12):
            if first[tuple(words[i][k : k + 13])] < i:
                gone.update(range(k, k + 13))
        assert cut[i] == (" ".join(w for k, w in enumerate(words[i]) if k not in gone) if gone else t)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clear = {i for i, *_, bad in contaminated(list(cut.items()), bench) if not bad}
    assert {r.doc_id for r in sets["benchmark"].collect()} == clear
    assert {r.doc_id for r in sets["packed"].collect()} == clear
    assert {r.doc_id for r in p.run(spark, D).collect()} == clear
