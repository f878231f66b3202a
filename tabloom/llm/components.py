"""Connected components of a table of links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

MAX_ROUNDS = 60


def _lowest(links: DataFrame) -> DataFrame:
    """Each end `a` with its smallest neighbour; the minimum is combined before the shuffle, so a hub is no hot task."""
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(_lowest(both), "a").filter("b > a")
    return near.select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    near = links.join(_lowest(links), "a")
    moved = near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(near.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, root) for every id that occurs in a link to another id; root is the smallest id of its component.

    Alternating large-star and small-star rounds: each round replaces links by links to smaller ids until only stars are
    left, in a number of rounds that grows with the logarithm of the longest path. Nulls and links of an id to itself are
    left out; repeated links count once; no links give an empty table.
    """
    a, b = F.col(left), F.col(right)
    ends = links.filter(a.isNotNull() & b.isNotNull() & (a != b))
    now = cut_lineage(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("root"))
            ).distinct()
        state = seen
        now = cut_lineage(_small_star(_large_star(now)))
    raise RuntimeError("components did not settle")
