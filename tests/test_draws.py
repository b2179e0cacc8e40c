"""Matching in rounds, spaced draws and redaction by dictionary, each against a plain version that goes one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, redaction, sampling


def one_by_one(anchors, candidates, tiers):
    """anchors, candidates: (group, id, key, *tier values) -> (group, anchor, control, tier)."""
    out, taken = [], set()
    for a in sorted(anchors, key=lambda r: (r[0], r[2], r[1])):
        best = None
        for c in candidates:
            if c[0] == a[0] and c[1] not in taken:
                same = next(k for k in range(tiers + 1) if all(x == y and x is not None for x, y in zip(a[3 : 3 + tiers - k], c[3 : 3 + tiers - k], strict=True)))
                best = min(best or (99,), (same, c[2], c[1]))
        if best:
            taken.add(best[2])
            out.append((a[0], a[1], best[2], best[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_that_of_the_sequence(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (rng.randrange(3), i, f"{rng.randrange(10**6):06}", rng.choice(["a", "b", "c"]), rng.choice([1, 2, None]))
    anchors, candidates = [row(i) for i in range(60)], [row(1000 + i) for i in range(70)]
    schema = "g int, id long, sample_key string, t string, u int"
    got = matching.match_controls(spark.createDataFrame(anchors, schema), spark.createDataFrame(candidates, schema), ["g"], ["t", "u"])
    assert sorted(map(tuple, got.collect())) == one_by_one(anchors, candidates, 2)


def test_matching_one_cell_and_nothing_left(spark):
    schema = "g int, id long, sample_key string, t string"
    anchors = [(1, i, f"{i:04}", "x") for i in range(40)] + [(2, 500, "a", "x")]
    candidates = [(1, 1000 + i, f"{i * 37 % 30:04}", "x" if i % 3 else "y") for i in range(30)]
    got = matching.match_controls(spark.createDataFrame(anchors, schema), spark.createDataFrame(candidates, schema), ["g"], ["t"])
    assert sorted(map(tuple, got.collect())) == one_by_one(anchors, candidates, 1)
    none = spark.createDataFrame([], schema)
    assert matching.match_controls(none, none, ["g"], ["t"]).count() == matching.match_controls(spark.createDataFrame(anchors, schema), none, ["g"], ["t"]).count() == 0


def test_matching_a_group_of_a_million(spark):
    candidates = spark.range(1_000_000).select(F.lit(1).alias("g"), "id", F.lpad(F.col("id").cast("string"), 8, "0").alias("sample_key"), (F.col("id") % 3).cast("string").alias("t"))
    anchors = spark.range(50).select(F.lit(1).alias("g"), (-F.col("id") - 1).alias("id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("sample_key"), (F.col("id") % 4).cast("string").alias("t"))
    got = matching.match_controls(anchors, candidates, ["g"], ["t"]).collect()
    near = [(1, -i - 1, f"{i:04}", str(i % 4)) for i in range(50)]
    far = [(1, i, f"{i:08}", str(i % 3)) for i in range(300)]
    assert sorted(map(tuple, got)) == one_by_one(near, far, 1)


def test_spaced_draws(spark):
    rng = random.Random(3)
    rows = [(c, rng.randrange(400), f"{rng.randrange(10**6)}", n) for c in range(5) for n in range(150)] + [(9, None, "a", 1), (9, 5, "b", 2), (9, 5, "b", 3)]
    got = sampling.spaced(spark.createDataFrame(rows, "code int, at int, key string, n int"), "code", "at", "key", 20).collect()
    want = {}
    for code, at, key, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1] is None, r[1] or 0)):
        if at is not None and all(abs(at - y) >= 20 for y, _ in want.setdefault(code, [])):
            want[code].append((at, key))
    assert sorted((r.code, r["at"], r.key) for r in got) == sorted((c, *x) for c, xs in want.items() for x in xs)


def plain_redaction(text, names, code):
    words = sorted({v for n in names for v in redaction.variants(n)}, key=len, reverse=True)
    out, at = "", 0
    while text is not None and at < len(text):
        word = next((w for w in words if text.startswith(w, at)), None)
        out, at = (out + redaction.NAME, at + len(word)) if word else (out + text[at], at + 1)
    return None if text is None else redaction.code_pattern(code).sub(redaction.CODE, out) if code else out


def test_variants():
    assert redaction.variants("株式会社ＸＹ テック") == [  # the longest first, those of one length in order
        "株式会社XY テック", "株式会社ＸＹ テック", "株式会社XYテック", "株式会社ＸＹテック", "XY テック", "ＸＹ テック"]
    assert redaction.variants("A") == redaction.variants(None) == redaction.variants("") == []


def test_redaction_by_dictionary(spark):
    names = [("株式会社ＸＹテック",), ("日本グループ",), ("ab",), ("abc",), ("bcd",), ("bc d",), (None,), ("Z",), ("[NAME",)]
    texts = [(1, "XYテック（1301）は13015百万円、１３０１。1301", "1301"), (2, "abcd ab bcd abcabc", None), (3, None, "1"), (4, "", "1"), (5, "x1301 1301x 1302", "1301"), (6, "(A1B2) a1b2 Ａ１Ｂ２", "A1B2"), (7, "bcdbcd" * 2000, "")]
    df = spark.createDataFrame(texts, "id int, t string, own string")
    for most in (1000, 3):
        got = {r.id: r.t for r in redaction.redact(df, "t", spark.createDataFrame(names, "n string"), "n", "own", most).collect()}
        assert got == {i: plain_redaction(t, [n for n, in names], c) for i, t, c in texts}
    assert got[1] == "[NAME]（[CODE]）は13015百万円、[CODE]。[CODE]" and got[5] == "x1301 1301x 1302" and got[2] == "[NAME]d [NAME] [NAME] [NAME][NAME]"
    none = redaction.redact(df, "t", spark.createDataFrame([], "n string"), "n")
    assert {r.id: r.t for r in none.collect()} == {i: t for i, t, _ in texts} and redaction.redact(df.limit(0), "t", spark.createDataFrame(names, "n string"), "n").count() == 0


def test_redaction_by_many_names(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcあい") for _ in range(rng.randrange(2, 7)))
    names, texts = [(word(),) for _ in range(400)], [(i, "".join(rng.choice("abcあい ") for _ in range(300))) for i in range(30)]
    for most in (10_000, 50):
        got = {r.id: r.t for r in redaction.redact(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(names, "n string"), "n", most=most).collect()}
        assert got == {i: plain_redaction(t, [n for n, in names], None) for i, t in texts}


def test_redaction_holds_few_spans(tmp_path):
    """A task holds the spans of SLICE texts, packed, however large the batch that comes: texts may be nothing but names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"v": ["ab", "abc"]}), tmp_path / "w.parquet")
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["abcab" * 50] * 1000), "__spans": pa.array([b""] * 1000, pa.binary())})
    out = list(redaction._find(str(tmp_path), "t")([batch]))
    assert max(b.num_rows for b in out) <= redaction.SLICE and sum(b.num_rows for b in out) == 1000
    assert sum(b.column(1).nbytes for b in out) < 1000 * (100 * 8 + 16)


def test_reduced_moves_few_rows(spark):
    """Each task gives on at most the largest size of a cohort's rows: the rank is bounded before the shuffle."""
    rows = spark.range(2000).selectExpr("string(id) as s", "if(id % 2 = 0, 'A', 'B') as c")
    out = sampling.reduced(rows, "c", "s", {"A": 3, "B": 2}, "seed")
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted((r.c, r.draw) for r in out.collect()) == [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 2)]
    assert sampling.reduced(rows, "c", "s", {}, "seed").count() == 0
