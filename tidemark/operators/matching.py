"""Control matching: each anchor takes the best candidate that no earlier anchor took."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save


def match_controls(anchors: DataFrame, candidates: DataFrame, group: list[str], tiers: list[str]) -> DataFrame:
    """(group, anchor, control, tier): tier 0 agrees in all of `tiers`, tier k in all but the last k.

    What anchors would get one after the other, in rounds of joins: each anchor without a control asks for
    the next candidate of its tier's cell, each candidate keeps the earliest anchor that ever asked, and those
    sent away ask on.  Since all candidates prefer earlier anchors, the end is that of the sequence.  Anchors that
    stand in one cell ask for candidates one behind the other, as a later one can't get what an earlier one
    asks for: so rounds are few, and no pairs are made.  Of a cell only as many candidates are kept as its group has
    anchors.  A null in a tier agrees with no other value; anchors without any candidate left have no row.
    """
    wanted = anchors.groupBy(*group).agg(F.count("*").alias("n_anchors"))
    turn = Window.partitionBy(*group).orderBy("sample_key", "id")
    cell = lambda n: F.struct(*[F.col(t) for t in tiers[:n]]) if n else F.struct(F.lit(0).alias("all"))
    known = lambda n: reduce(lambda a, t: a & F.col(t).isNotNull(), tiers[:n], F.lit(True))
    # A cell of every tier in one column: JSON tells values and their places apart.
    cells = [F.when(known(len(tiers) - k), F.concat(F.lit(f"{k}|"), F.to_json(cell(len(tiers) - k)))) for k in range(len(tiers) + 1)]
    lists = candidates.select(*group, "id", "sample_key", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy(*group, "cell").orderBy("sample_key", "id")))
    lists = save(lists.join(wanted, group).where("place <= n_anchors").select(*group, "cell", "place", F.col("id").alias("control")))

    state = anchors.select(*group, F.col("id").alias("anchor"), F.row_number().over(turn).alias("turn"), F.array(*cells).alias("cells"), F.lit(0).alias("tier"), F.lit(1).alias("place"), F.lit(None).cast(candidates.schema["id"].dataType).alias("control"))
    state = save(state)
    asks = (F.col("tier") <= len(tiers)) & F.col("control").isNull()
    while not state.where(asks).isEmpty():
        asking = state.where(asks).drop("control").withColumn("cell", F.get("cells", F.col("tier")))
        # One behind the other, none before the place it has come to: own + the largest of (place - own) so far.
        line = Window.partitionBy(*group, "cell").orderBy("turn")
        asking = asking.withColumn("own", F.row_number().over(line))
        asking = asking.withColumn("place", F.col("own") + F.max(F.col("place") - F.col("own")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        asked = asking.join(lists, [*group, "cell", "place"], "left").select(*state.columns)
        both = asked.unionByName(state.where(~asks))
        first = F.row_number().over(Window.partitionBy(*group, "control").orderBy("turn")) == 1
        kept = F.col("control").isNotNull() & first
        # At a cell's end the next tier begins; after the last one there is none.
        ended = F.col("control").isNull()
        state = save(
            both.withColumns({"kept": kept, "ended": ended}).select(
                *group, "anchor", "turn", "cells", F.when(F.col("ended") & (F.col("tier") <= len(tiers)), F.col("tier") + 1).otherwise(F.col("tier")).alias("tier"),
                F.when(F.col("ended"), 1).when(F.col("kept"), F.col("place")).otherwise(F.col("place") + 1).alias("place"), F.when(F.col("kept"), F.col("control")).alias("control"),
            )
        )
    held = state.where("control IS NOT NULL")
    return held.select(*group, "anchor", "control", F.col("tier").cast("long").alias("tier"))
