"""Shapes that keep one hot key from landing in one task.

Per-key statistics are always an aggregate (combined map-side) joined back, never a window over the key: AQE can
split the probe side of that join, while a window must hold a whole key in one task. Running totals and numbers
are built on two levels, a chunk inside the key and the chunks of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Aggregate per key and join the result back to every row."""
    per_key = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in stats.items()])
    return df.join(per_key, keys, "left")


#: Bytes, as text, of the short side that `beside` sends to every executor.
BESIDE_BYTES = 64 << 20


def beside(rows: DataFrame, lists: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` (wide, such as whole texts) with the one list of their key, or left, semi or anti joined with it.

    The lists' size is measured: up to BESIDE_BYTES they are sent to the rows, which then aren't shuffled; beyond that both
    sides are dealt by key, and Spark splits hot keys.
    """
    size = lists.agg(F.sum(F.octet_length(F.to_json(F.struct(*lists.columns))))).first()[0] or 0
    return rows.join(F.broadcast(lists) if size <= BESIDE_BYTES else lists, key, how)


def running(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column | str],
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Inclusive running sum, min or max per key in `order`: values maps a name to ('sum' | 'min' | 'max', column).

    `chunk` must grow with `order` (an hour, or position // n). Each (key, chunk) is folded first, the chunk results are
    accumulated per key, and only rows of one chunk share a task, so a hot key is spread over its chunks.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    tagged = df.withColumn("_chunk", chunk)
    folded = tagged.groupBy(*keys, "_chunk").agg(*[fold[how](v).alias(f"_s_{n}") for n, (how, v) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = folded.select(
        *keys, "_chunk", *[fold[how](f"_s_{n}").over(before).alias(f"_o_{n}") for n, (how, _) in values.items()]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[fold[how](v).over(inside).alias(f"_l_{n}") for n, (how, v) in values.items()])

    def join_up(n: str, how: str) -> Column:
        prior, own = F.col(f"_o_{n}"), F.col(f"_l_{n}")
        if how == "sum":
            return F.coalesce(prior, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.least(prior, own) if how == "min" else F.greatest(prior, own)

    joined = local.join(offsets, [*keys, "_chunk"])
    return joined.select(*df.columns, *[join_up(n, how).alias(n) for n, (how, _) in values.items()])


def running_total(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column | str], totals: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per key."""
    return running(df, keys, chunk, order, {n: ("sum", v) for n, v in totals.items()})


def number_rows(df: DataFrame, keys: list[str], chunk: Column, order: list[Column | str], name: str) -> DataFrame:
    """1-based position per key in `order`."""
    return running_total(df, keys, chunk, order, {name: F.lit(1)})


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark limits each group before the shuffle, so at most k rows per task and key move."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)
