"""Groups that links join: every key with the smallest key that it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import save


def joined_groups(links: DataFrame) -> DataFrame:
    """(key, root) for every key of links (a, b): root is the smallest key reached, however many links lie between.

    Each round every key takes the smallest root among its neighbours', and then its root's root, so the rounds grow with
    the logarithm of a chain's length.  Rounds are written tables; per key one aggregate, combined before the shuffle.
    Null ends, loops and repeated links change nothing.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = save(links.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = links.join(roots.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        stepped = save(roots.join(near, "key").select("key", "root", F.least("root", "near").alias("next")))
        up = stepped.select(F.col("key").alias("next"), F.col("next").alias("up"))
        jumped = save(stepped.join(up, "next", "left").select("key", "root", F.least("next", F.coalesce("up", "next")).alias("next")))
        if jumped.where(F.col("root") != F.col("next")).isEmpty():
            return jumped.select("key", "root")
        roots = jumped.select("key", F.col("next").alias("root"))
