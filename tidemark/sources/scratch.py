"""Written tables in the shared folder: the only way lineage is cut here."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset: a temporary folder in local mode, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.scratch", "")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("tidemark.scratch", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's own switch: shuffle files of an execution go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once into the shared folder and read it back: a cut of the lineage that survives lost executors.

    The write's shuffles are its own and nothing reads them once the table stands, so they leave the disk with it.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*saved: DataFrame) -> None:
    """Remove tables that save wrote and nothing will read again: what was made of them must be saved itself."""
    for df in saved:
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def file_system(uri: str):
    """The pyarrow file system that a URI names, and the path there: for tasks that read single files."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)
