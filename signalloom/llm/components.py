"""Connected components of a table of links, by alternating stars.

Each round every node hands its larger neighbours to its least one, then its smaller neighbours;
trees flatten to stars in a number of rounds that grows with the logarithm of the longest chain.
Rounds are stored, so a lost executor costs one round, and links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.shared import Scratch


def _print(links: DataFrame) -> tuple:
    """Count and order-free digest, to see whether a round changed anything."""
    mark = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(mark, 20)), F.bit_xor(mark)).first())


def connected(links: DataFrame, scratch: Scratch, label: str = "links") -> DataFrame:
    """``node`` and the least node ``component`` it reaches, for the ends ``a``, ``b`` of links.

    Links with a null end are left out; loops and repeats do no harm; no links give no rows.
    """
    known = links.where("a is not null and b is not null and a <> b")
    step = scratch.store(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-0")
    seen, k = _print(step), 0
    while seen[0]:
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(root, "b")
        small = met.select(F.col("m").alias("a"), "b").unionByName(met.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        k += 1
        step = scratch.store(small.distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        was, seen = seen, _print(step)
        if was == seen:
            break
    ends = step.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(step.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
