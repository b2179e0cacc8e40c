"""The commit log: one of two writers wins, a damaged file is told, what has no record is not read."""

import threading

import pytest

from tidemark.sources import commits


def put(spark, log, name, n):
    commits.jsonl(spark.range(n).selectExpr("id % 3 as part", "id as key", "if(id % 2 = 0, null, 'é\"x') as v"), f"{log}/{name}", "part", "key")


def test_two_writers(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert commits.head(spark, log) == 0
    for name in ("a", "b", "c", "d"):
        put(spark, log, name, 10)
    assert commits.commit(spark, log, "a", "t1", on=0) == 1
    with pytest.raises(commits.Conflict):
        commits.commit(spark, log, "b", "t1", on=0)
    got = []
    writers = [threading.Thread(target=lambda x=x: got.append(commits.commit(spark, log, x, "t2"))) for x in ("c", "d")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(got) == [2, 3] and commits.head(spark, log) == 3
    rows = {r.version: r for r in commits.history(spark, log).collect()}
    assert {v: r.parent for v, r in rows.items()} == {1: 0, 2: 1, 3: 2} and {r.artifacts for r in rows.values()} == {"a", "c", "d"} and all(r.files == 3 for r in rows.values())


def test_verified(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    put(spark, log, "a", 9)
    commits.commit(spark, log, "a", "t1")
    files, problems = commits.verified(spark, log, 1)
    lines = sorted(x for r in files.collect() for x in bytes(r.content).decode().splitlines())
    assert lines[:2] == ['{"key":0,"v":null}', '{"key":1,"v":"é\\"x"}'] and len(lines) == 9 and problems.isEmpty()
    one, two, three = sorted(p for p in (tmp_path / "log" / "a").rglob("part-*"))
    one.write_bytes(one.read_bytes().replace(b"0", b"7"))
    two.write_bytes(b"short")
    three.unlink()
    for p in (tmp_path / "log" / "a").rglob(".*crc"):
        p.unlink()
    files, problems = commits.verified(spark, log, 1)
    assert files.isEmpty() and sorted(r.reason for r in problems.collect()) == ["MISSING", "OTHER_CONTENT", "OTHER_SIZE"]
    with pytest.raises(ValueError):
        commits.verified(spark, log, 2)
    spark.range(0).selectExpr("cast(id as string) as value").write.text(f"{log}/none")
    with pytest.raises(ValueError):
        commits.commit(spark, log, "none", "t")


def test_files_are_dealt_out_and_a_loser_describes_none(spark, tmp_path):
    """several tasks write the files, and who comes too late has read none of them and may offer them again."""
    log = f"file://{tmp_path}/log"
    commits.jsonl(spark.range(40).selectExpr("id % 20 as part", "id as key"), f"{log}/a", "part", "key")
    files = list((tmp_path / "log" / "a").rglob("part-*.txt"))
    assert len(files) == 20 and len({f.name.split("-")[1] for f in files}) > 1
    put(spark, log, "b", 10)
    commits.commit(spark, log, "a", "t1", on=0)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, log, "b", "t1", on=0)
    assert not (tmp_path / "log" / "manifests" / "b").exists()
    assert commits.commit(spark, log, "b", "t2") == 2
