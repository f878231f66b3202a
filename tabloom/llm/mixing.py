"""Mixing sources to target weights, with DataFrame expressions only.

A token budget goes down a tree of levels. Among siblings it is shared by weight; a child whose leaves hold less than its share is
filled and the shortage goes to its siblings, and only what no sibling can take leaves the parent. Each leaf then draws
its tokens from seeded epochs: whole passes over the leaf, and a prefix of the next pass in the order of that epoch's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

#: Leaves whose figures are sent to every task (some 200 bytes each); with more, documents and leaves meet by a shuffle, whose hot keys Spark splits.
SENT_LEAVES = 50_000
NONE = "(none)"


def word_count(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def share_out(leaves: DataFrame, levels: list[str], weights: list[Column], budget: Column) -> DataFrame:
    """`leaves` (levels, own, room) with `target`: the tokens each leaf gets of `budget`, whole numbers.

    `weights` gives each level's weight of a node, from the level columns down to it; a null, negative or zero weight gets nothing.
    Windows run over nodes of the tree, never over documents.
    """
    # the room of leaves that get nothing is nobody's room: it counts neither in the budget nor for a node above
    held = leaves.withColumn("_all", F.lit(0))
    for weight in weights:
        held = held.filter(F.coalesce(weight.cast("double"), F.lit(0.0)) > 0)
    parents = held.agg(F.least(budget, F.sum("room")).cast("double").alias("given")).withColumn("_all", F.lit(0))
    above: list[str] = ["_all"]
    for level, weight in zip(levels, weights, strict=True):
        nodes = held.groupBy(*above, level).agg(F.sum("room").cast("double").alias("room"))
        nodes = nodes.join(parents, above).withColumn("weight", weight.cast("double"))
        # siblings in the order in which a rising level fills them; those that are full at the final level are a prefix
        line = Window.partitionBy(*above).orderBy(F.col("room") / F.col("weight"), level)
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        onwards = line.rowsBetween(0, Window.unboundedFollowing)
        rate = (F.col("given") - F.coalesce(F.sum("room").over(earlier), F.lit(0.0))) / F.sum("weight").over(onwards)
        nodes = nodes.withColumn("full", F.col("room") <= rate * F.col("weight") * (1 + 1e-12))
        family = Window.partitionBy(*above)
        left = F.col("given") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(family)
        open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(family)
        got = F.when(F.col("full"), F.col("room")).otherwise(F.greatest(left, F.lit(0.0)) * F.col("weight") / open_weight)
        above = [*above, level]
        parents = nodes.withColumn("given", got).select(*above, "given")
    shares = parents.select(*levels, F.floor(F.col("given") + 1e-6).alias("target"))
    return leaves.join(shares, levels, "left").withColumn("target", F.least(F.coalesce("target", F.lit(0)), F.col("room")))


def _draw(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch, from 0 to 2**60 - 1."""
    name = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: list[Callable[[dict[str, Column]], Column]], tokens: Column, share: float, epochs: int = 1, seed: int = 1,
    doc_id: str = "doc_id",
) -> DataFrame:
    """Rows of `docs` that are drawn, once for each epoch that draws them, with `epoch` (from 0) added after their own columns.

    `levels` names the tree's levels from the top, each from columns of docs; nulls are a node of their own. `weights` has a function per level, from the
    level columns by name to a node's weight. The budget is
    `share` of all tokens; a leaf gives each document at most `epochs` times. A leaf's last epoch is a prefix: documents by the
    hash of seed, epoch and id while their tokens fit; rows of one id go in or stay out together. A leaf without tokens
    gives nothing. A column `epoch` of docs is replaced. An empty table gives an empty table.
    """
    names = [f"_mix_{k}" for k in range(len(levels))]
    labels = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, levels.values(), strict=True)]
    nodes = {level: F.col(name) for level, name in zip(levels, names, strict=True)}
    # a leaf's order has as many slices as the root of its documents; only the slice that holds the cut is sorted
    narrow = cut_lineage(docs.select(F.col(doc_id).alias("_mix_id"), *labels, F.coalesce(tokens, F.lit(0)).cast("long").alias("_mix_tokens")))
    leaves = narrow.groupBy(*names).agg(F.sum("_mix_tokens").alias("own"), F.count("*").alias("docs")).filter("own > 0")
    leaves = leaves.withColumn("room", F.col("own") * epochs)
    total = narrow.agg(F.sum("_mix_tokens")).first()[0] or 0
    shared = share_out(leaves, names, [w(nodes) for w in weights], F.floor(F.lit(total) * F.lit(share)))
    targets = cut_lineage(shared.select(
        *names, F.floor(F.col("target") / F.col("own")).alias("_mix_full"), (F.col("target") % F.col("own")).alias("_mix_rest"),
        F.ceil(F.sqrt("docs")).alias("_mix_slices"),
    ))
    # a hot leaf stays where its documents lie: only leaves move, while they are few
    sent = F.broadcast if targets.count() <= SENT_LEAVES else _itself
    drawn = narrow.join(sent(targets.filter("_mix_rest > 0")), names).withColumn("_mix_at", _draw(seed, F.col("_mix_full"), F.col("_mix_id")))
    drawn = drawn.withColumn("_mix_slice", _slice_of())
    sums = drawn.groupBy(*names, "_mix_slice").agg(F.sum("_mix_tokens").alias("sum"), F.first("_mix_rest").alias("rest"))
    line = Window.partitionBy(*names).orderBy("_mix_slice")
    split = sums.withColumn("before", F.sum("sum").over(line) - F.col("sum")).filter("before <= rest and before + sum > rest")
    split = split.select(*names, "_mix_slice", "before", "rest")
    inside = drawn.join(sent(split), [*names, "_mix_slice"]).groupBy(*names, "_mix_slice", "_mix_at").agg(
        F.sum("_mix_tokens").alias("sum"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    order = Window.partitionBy(*names).orderBy("_mix_at")
    fits = inside.withColumn("until", F.sum("sum").over(order) + F.col("before")).filter("until <= rest")
    last = fits.groupBy(*names).agg(F.max("_mix_at").alias("_mix_last"))
    cuts = cut_lineage(targets.join(split.select(*names, F.col("_mix_slice").alias("_mix_split")), names, "left").join(last, names, "left"))
    placed = docs.drop("epoch").select("*", *labels).join(sent(cuts), names)
    at = _draw(seed, F.col("_mix_full"), F.col(doc_id))
    in_prefix = (F.col("_mix_rest") > 0) & (
        (_slice_of(at) < F.col("_mix_split")) | ((_slice_of(at) == F.col("_mix_split")) & (at <= F.coalesce("_mix_last", F.lit(-1))))
    )
    count = F.col("_mix_full") + F.when(F.coalesce(in_prefix, F.lit(False)), 1).otherwise(0)
    taken = placed.withColumn("_mix_count", count).filter("_mix_count > 0")
    return taken.withColumn("epoch", F.explode(F.expr("sequence(0L, _mix_count - 1)"))).drop(
        *names, "_mix_full", "_mix_rest", "_mix_slices", "_mix_split", "_mix_last", "_mix_count"
    )


def _itself(df: DataFrame) -> DataFrame:
    return df


def _slice_of(at: Column | None = None) -> Column:
    return F.floor((F.col("_mix_at") if at is None else at) / F.lit(float(1 << 60)) * F.col("_mix_slices"))
