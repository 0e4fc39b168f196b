"""Contiguous shards of near-equal bytes: minimax partition over atomic groups.

Equal texts are one group and stay together. Groups are ordered by the MD5 of
their text, and the ordered sizes are cut into at most ``shards`` runs so that
the largest run is as small as it can be: binary search over the capacity, each
capacity checked greedily, cuts where the greedy fill of the least feasible one
makes them.

The driver never holds all groups. It starts from the byte sums of 4,096 ranges
of the order. Taking a range as divisible anywhere, and a single group as not,
gives a capacity that is never above the least one, and places for its cuts.
Only ranges in which such a cut lies, and the ones beside them, are split
further, by 256, and the capacity is taken anew, until no cut lies inside a
range: the cuts are then those of the search over all groups. That is at most
three ranges a cut, some ten thousand numbers a round, whatever the corpus and
however large a group.

Cases: a null text has size 1 and CRC 0, and is a group of its own (it sorts
first); repeated rows and ids each get a slot; fewer groups than shards leave
shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import byte_length, stored

SHARDS = 16
FIRST_DIGITS, MORE_DIGITS = 3, 2


def greedy(ends: list[int], single: list[bool], capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """(place in bytes, unit it lies in) of each cut if only single groups are indivisible, or None if the shards don't hold all."""
    cuts, place = [], 0
    for _ in range(shards):
        place += capacity
        if place >= ends[-1]:
            return cuts
        at = bisect_right(ends, place)
        if single[at]:
            place = ends[at - 1] if at else 0
        cuts.append((place, at))
    return None


def least_capacity(ends: list[int], single: list[bool], shards: int, low: int) -> int:
    """The least capacity from ``low`` on with which the units fill at most ``shards`` shards."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, single, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _units(groups: DataFrame, prefix: Column) -> list[tuple[str, int, bool, str]]:
    """(first key, bytes, is a single group, prefix) of each range of keys with an equal prefix."""
    found = (
        groups.groupBy(prefix.alias("prefix"))
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("size").alias("size"))
        .collect()
    )
    return [(row["first"], row["size"], row["first"] == row["last"], row["prefix"]) for row in found]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """The first key of each shard after the first; ``groups`` has key (hex text) and size."""
    units = sorted(_units(groups, F.substring("key", 1, FIRST_DIGITS)))
    if not units:
        return []
    total = sum(unit[1] for unit in units)
    while True:
        ends = list(accumulate(unit[1] for unit in units))
        single = [unit[2] for unit in units]
        low = max(-(-total // shards), max((unit[1] for unit in units if unit[2]), default=1))
        cuts = greedy(ends, single, least_capacity(ends, single, shards, low), shards)
        inside = [at for place, at in cuts if place > (ends[at - 1] if at else 0)]
        if not inside:
            return [units[at][0] for _, at in cuts]
        near = {i for at in inside for i in (at - 1, at, at + 1) if 0 <= i < len(units) and not single[i]}
        part, prefix = F.lit(False), F.lit(None).cast("string")
        for length in {len(units[i][3]) for i in near}:
            within = F.substring("key", 1, length).isin([units[i][3] for i in near if len(units[i][3]) == length])
            part = part | within
            prefix = F.when(within, F.substring("key", 1, length + MORE_DIGITS)).otherwise(prefix)
        units = sorted([u for i, u in enumerate(units) if i not in near] + _units(groups.where(part), prefix))


def shard_of(key, cuts: list[str]):
    """Number of cuts that are not after the key."""
    shard = F.lit(0)
    for i, cut in enumerate(cuts):
        shard = F.when(F.col(key) >= F.lit(cut), F.lit(i + 1)).otherwise(shard)
    return shard.cast("int")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (byte_length("text") + 1).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("key"),
            F.spark_partition_id().alias("block"),
        ),
        "sizes",
    )
    placed = rows.withColumn("shard", shard_of("key", minimax_cuts(rows, shards)))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "block").orderBy("key", "doc_id")
    return (
        placed.withColumn("row", F.row_number().over(within))
        .join(bases, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("row") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
