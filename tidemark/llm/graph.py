"""Connected components of links between ids, by alternating star contractions.

Large stars hang every neighbour above a node from the smallest neighbour; small stars do so for
those below.  Both are an aggregate per node (combined before the shuffle) joined back to the
links; nodes with very many links (fewer than common.OFTEN) take a broadcast join, so their links
stay where they are.  The rounds needed grow with the logarithm of the number of nodes.  Each step
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _ordered(links: DataFrame) -> DataFrame:
    """Links as (u > v), without loops."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _tidy(links: DataFrame) -> DataFrame:
    return _ordered(links).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return c.join_split(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return c.join_split(links, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every id that has a link: (id, component), the smallest id that links reach.

    Null ids link nothing, loops and repeated links change nothing, no links give no rows.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    links = c.save(_tidy(links))
    while True:
        links = c.save(_tidy(_large_star(links)))
        links = c.save(_tidy(_small_star(links)))
        # Done when all are stars: no centre hangs below another node, and no node below two centres.
        ends = links.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("centre")).unionAll(links.select(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("centre")))
        if ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("centre").alias("centre")).where("below + centre > 1").isEmpty():
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
