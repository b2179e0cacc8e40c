"""Artifact sets with a commit log: numbered records made by compare-and-set, and readers that check every byte they use.

Artifacts are written first, under a name of their own; nothing reads them yet.  A commit is one
record file with the next number, put in place by a rename that fails if that number is taken: of two
writers one wins, the other learns it and tries the next number, or gives up if it must build on the head
it has seen.  The record names a table of the set's files with size and SHA-256, which tasks compute and
readers check again through binaryFile.  What a writer that lost or died has left is named by no record.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "commit-1"
FILES = "name string, bytes long, sha256 string"


class Conflict(RuntimeError):
    """Another writer has made the commit that this one was to build on."""


def jsonl(rows: DataFrame, folder: str, part: str, order: str) -> None:
    """rows as JSON lines, a file for each value of part, in order; keys as the columns stand, nulls included.

    Tasks put their files in place themselves, not the driver one after the other: nothing reads them before a commit, and a
    task that is tried again writes the same names.  The shuffle has its number of partitions by name, since what takes time
    is the files, not their bytes: adaptive plans would give all to one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.to_json(F.struct(*[c for c in rows.columns if c != part]), {"ignoreNullFields": "false"}).alias("value")
    spread = rows.select(part, F.col(order).alias("__order"), line).repartition(n, F.col(part)).sortWithinPartitions(part, "__order")
    spread.select(part, "value").write.partitionBy(part).mode("errorifexists").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)


def described(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the data files below a folder, names from there on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.element_at(F.split("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/"), -1)
    files = files.select(base.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.element_at(F.split("name", "/"), -1).rlike("^[._]"))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def head(spark: SparkSession, log: str) -> int:
    """The number of the last commit, 0 before the first."""
    _, folder, fs = _hadoop(spark, f"{log}/commits")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under another name and rename it into place; False if that place is taken."""
    jvm, target, fs = _hadoop(spark, path)
    source = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(source, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(target), none)
        return True
    except Exception as e:
        fs.delete(source, False)
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
            return False
        raise


def commit(spark: SparkSession, log: str, artifacts: str, at: str, on: int | None = None, tries: int = 100) -> int:
    """Make the artifacts below {log}/{artifacts} the next commit; its number.

    on: the head that this commit builds on; if another writer has gone ahead, Conflict.  Without it the next free number is taken.
    Where that is seen before the files are read, they are not described, and may be offered again as they are.
    """
    if on is not None and head(spark, log) > on:
        raise Conflict(f"commit {on + 1} of {log} is another writer's")
    described(spark, f"{log}/{artifacts}").coalesce(1).write.mode("errorifexists").parquet(f"{log}/manifests/{artifacts}")
    # A sum over the files, so that it needs no order and no place where all names meet.
    each = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", "name", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = manifest(spark, log, artifacts).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.sum(each).cast("string").alias("d")).first()
    if not total["n"]:
        raise ValueError(f"no artifacts below {artifacts}")
    for _ in range(tries):
        parent = head(spark, log) if on is None else on
        record = {"schema": SCHEMA, "version": parent + 1, "parent": parent, "artifacts": artifacts, "files": total["n"], "bytes": total["b"], "digest": total["d"], "committed_at": at}
        if _put_if_absent(spark, f"{log}/commits/{parent + 1:020d}.json", json.dumps(record, sort_keys=True)):
            return parent + 1
        if on is not None:
            raise Conflict(f"commit {on + 1} of {log} is another writer's")
    raise Conflict(f"{tries} numbers of {log} were taken by others")


def manifest(spark: SparkSession, log: str, artifacts: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{log}/manifests/{artifacts}")


def history(spark: SparkSession, log: str) -> DataFrame:
    """The commits, as their records say."""
    rows = spark.read.schema("schema string, version long, parent long, artifacts string, files long, bytes long, digest string, committed_at string").json(f"{log}/commits")
    return rows.where(F.col("schema") == SCHEMA).drop("schema")


def verified(spark: SparkSession, log: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(files: name, bytes, sha256, content; problems: name, reason) of a commit: only files that are what the record says."""
    record = history(spark, log).where(F.col("version") == version).first()
    if record is None:
        raise ValueError(f"{log} has no commit {version}")
    folder = f"{log}/{record['artifacts']}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.element_at(F.split("path", "/" + record["artifacts"] + "/"), -1)
    there = files.select(base.alias("name"), F.col("length").alias("found_bytes"), F.sha2("content", 256).alias("found"), "content")
    both = manifest(spark, log, record["artifacts"]).join(there, "name", "left")
    same = F.col("found").eqNullSafe(F.col("sha256")) & F.col("found_bytes").eqNullSafe(F.col("bytes"))
    reason = F.when(F.col("found").isNull(), "MISSING").when(F.col("found_bytes") != F.col("bytes"), "OTHER_SIZE").otherwise("OTHER_CONTENT")
    return both.where(same).select("name", "bytes", "sha256", "content"), both.where(~same).select("name", reason.alias("reason"))
