"""Events and identities: keys, roles by arrival, near-miss pairs, demotion of shared identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save

UNIT = "\u001f"


def event_key(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def deterministic_uuid(namespace: str, key: Column) -> Column:
    d = F.md5(F.concat(F.lit(f"{namespace}|"), key))
    return F.concat_ws("-", *[F.substring(d, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def source_roles(rows: DataFrame) -> DataFrame:
    """Per event: the first arrival is DISCOVERY, a publisher's first later one VERIFICATION, a repeat CORROBORATION."""
    event = Window.partitionBy("event_key").orderBy("available_at", "document_id")
    source = Window.partitionBy("event_key", "source_key").orderBy("available_at", "document_id")
    role = F.when(F.row_number().over(event) == 1, "DISCOVERY").when(F.row_number().over(source) == 1, "VERIFICATION").otherwise("CORROBORATION")
    return rows.withColumn("role", role)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def _classes(rows: DataFrame, key: str, group: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    sets = rows.select(key, *group, F.array_sort(tokens(F.col(text))).alias("t")).where(F.size("t") > 0)
    return sets, sets.groupBy(*group, "t").agg(F.min(key).alias("id"))


def near_members(rows: DataFrame, key: str, group: list[str], text: str) -> DataFrame:
    """(key, id): the class of equal token sets that each row of near_pairs' input belongs to, by its representative."""
    sets, classes = _classes(rows, key, group, text)
    same = [sets[g].eqNullSafe(classes[g]) for g in group]
    match = sets["t"] == classes["t"]
    for s in same:
        match &= s
    return sets.join(classes, match).select(sets[key], classes["id"])


#: Longs of a set's bits: a token sets one of 64 * WORDS.
WORDS = 4


def _bits(t: str) -> list[Column]:
    """Longs in which each token of an array has set one bit: sets differ in at least as many tokens as their longs do in bits."""
    place = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * WORDS)).cast("int"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x % 64)
    word = lambda w: F.filter(place, lambda x: F.floor(x / 64) == w)
    return [F.aggregate(word(w), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))).alias(f"b{w}") for w in range(WORDS)]


def near_pairs(rows: DataFrame, key: str, group: list[str], text: str, least: float = 0.6) -> DataFrame:
    """Pairs of one group whose token sets have Jaccard similarity of at least `least`.

    Equal sets are one class with a representative; classes meet only on a token among their first
    n - ceil(least * n) + 1 in order of rarity: sets as similar as asked must share one of those.
    Sets travel only for the pairs of met_classes, not for all that meet.
    Gives (left, right, similarity) between representatives, smaller key left; near_members says whom they stand for.
    """
    classes = save(_classes(rows, key, group, text)[1])
    met = met_classes(classes, group, least)
    a, b = (classes.select(F.col("id").alias(n), F.col("t").alias(f"t_{n}")) for n in ("left", "right"))
    both = F.size(F.array_intersect("t_left", "t_right"))
    similarity = both / (F.size("t_left") + F.size("t_right") - both)
    return met.join(a, "left").join(b, "right").select("left", "right", similarity.alias("similarity")).where(F.col("similarity") >= least)


def met_classes(classes: DataFrame, group: list[str], least: float) -> DataFrame:
    """(left, right): every pair of classes (group, id, t) as similar as asked, and some that are nearly so.

    What two classes can share at most is told where they meet, by the places of the token and by the bits of the sets.
    """
    each = classes.select(*group, "id", F.size("t").alias("size"), F.explode("t").alias("token"))
    often = each.groupBy(*group, "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "token"))
    first = each.join(often, [*group, "token"]).withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    first = first.join(classes.select("id", *_bits("t")), "id")
    left, right = (first.select(*group, "token", *[F.col(x).alias(f"{x}_{n}") for x in ("id", "size", "place", *(f"b{w}" for w in range(WORDS)))]) for n in ("left", "right"))
    na, nb = F.col("size_left"), F.col("size_right")
    # Tokens shared by sets as similar as asked; a rounding error must not lose a pair.
    asked = (na + nb) * (least / (1 + least)) - 1e-6
    # Of the shared tokens the first in order has none before it: there, only those after it can be shared too.
    after = F.least(na - F.col("place_left"), nb - F.col("place_right")) + 1
    apart = sum(F.bit_count(F.col(f"b{w}_left").bitwiseXOR(F.col(f"b{w}_right"))) for w in range(WORDS))
    may = (F.col("id_left") < F.col("id_right")) & (after >= asked) & ((na + nb - apart) / 2 >= asked)
    return left.join(right, [*group, "token"]).where(may).select(F.col("id_left").alias("left"), F.col("id_right").alias("right")).distinct()


def demote_shared(rows: DataFrame, key: str) -> DataFrame:
    """An identity key that several carriers claim identifies none of them: all are demoted."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("confidence", F.when(F.col(key).isNull(), "PROVISIONAL").when(n > 1, "DEMOTED").otherwise("ANCHORED"))
