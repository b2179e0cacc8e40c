"""A session set up as the operators expect it: UTC, ANSI arithmetic, adaptive plans with skew handling."""

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
