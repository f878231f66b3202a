"""Order-dependent folds over rows of a key, as scans over runs of a fixed number of rows.

Rows are dealt by range of key and order, so a hot key lies in many tasks; a task cuts its stretch of a key into runs of RUN
rows. What a run does to a state is an element of its own, and elements are combined on three levels: the runs of a
key in a task, the tasks of a key, and the way back down, which gives every run the state it starts from. So no task ever
holds more of a key than a few bytes per run of one task, or per task, whatever the key's share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

#: Rows of a run.
RUN = 512
_FIRST = Window.unboundedPreceding


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right` where the keys are equal; null is a key like any other."""
    told = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(told, on, how).drop(*[f"_key_{k}" for k in keys])


def dealt(df: DataFrame, keys: list[str], order: list[str], size: int = RUN) -> DataFrame:
    """`df` with _task and _run: (keys, _task, _run) names a run, and runs of a key follow each other in this order."""
    by = [F.col(c) for c in [*keys, *order]]
    place = F.monotonically_increasing_id()
    return df.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.shiftright(place, 33).alias("_task"), F.floor(place.bitwiseAND((1 << 33) - 1) / size).alias("_run")
    )


def counter(
    df: DataFrame, keys: list[str], order: list[str], step: Column, name: str, start: DataFrame | None = None, floor: bool = False, size: int = RUN
) -> DataFrame:
    """`df` with `name`: the running sum of `step` per key in `order`, from 0 or from `start` (keys, state).

    With `floor` the sum is held at 0 after each row that would take it below. The element of a run is the pair (sum, lowest
    prefix): from a state s it leads to sum + max(s, -lowest). A null step counts as 0.
    """
    moved = dealt(df.withColumn("_step", F.coalesce(step, F.lit(0))), keys, order, size)
    inside = Window.partitionBy(*keys, "_task", "_run").orderBy(*order).rowsBetween(_FIRST, 0)
    local = moved.withColumn("_sum", F.sum("_step").over(inside)).withColumn("_low", F.min("_sum").over(inside))
    local = cut_lineage(local)
    runs = local.groupBy(*keys, "_task", "_run").agg(F.sum("_step").alias("_s"), F.min("_low").alias("_l"))

    def before(rows: DataFrame, part: list[str], at: str) -> DataFrame:
        """Element of what lies before each row of a part."""
        earlier = Window.partitionBy(*part).orderBy(at).rowsBetween(_FIRST, -1)
        summed = rows.withColumn("_sb", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        return summed.withColumn("_lb", F.min(F.col("_sb") + F.col("_l")).over(earlier))

    def led(state: Column) -> Column:
        held = F.greatest(state, -F.col("_lb")) if floor else state
        return F.col("_sb") + held

    inner = before(runs, [*keys, "_task"], "_run")
    tasks = inner.groupBy(*keys, "_task").agg(F.sum("_s").alias("_s"), F.min(F.col("_sb") + F.col("_l")).alias("_l"))
    outer = before(tasks, keys, "_task")
    if start is not None:
        begun = start.select(*keys, F.col("state").alias("_begun"))
        outer = matched(outer, begun, keys, "left")
    else:
        outer = outer.withColumn("_begun", F.lit(0))
    opened = outer.select(*keys, "_task", led(F.coalesce("_begun", F.lit(0))).alias("_open"))
    placed = matched(inner, opened, [*keys, "_task"]).select(*keys, "_task", "_run", led(F.col("_open")).alias("_open"))
    joined = matched(local, placed, [*keys, "_task", "_run"])
    held = F.greatest("_open", -F.col("_low")) if floor else F.col("_open")
    return joined.select(*df.columns, (F.col("_sum") + held).alias(name))


def gathered(df: DataFrame, keys: list[str], order: list[str], values: list[str], size: int = RUN) -> DataFrame:
    """One row per run: keys, _task, _run and `rows`, the run's order and value columns as an array of structs in order."""
    moved = dealt(df, keys, order, size)
    return moved.groupBy(*keys, "_task", "_run").agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("rows"))


def starts(
    elements: DataFrame, keys: list[str], compose: Callable[[list[bytes]], bytes], move: Callable[[bytes, int], int], begin: DataFrame | None = None
) -> DataFrame:
    """(keys, _task, _run, state): the state that each run starts from.

    `elements`: keys, _task, _run, element (what the run does, as bytes). `compose` puts elements one after the other, `move`
    leads a state through one. `begin` gives the first state of keys (keys, state), 0 where there is none.
    """
    spark = elements.sparkSession
    kinds = {f.name: f.dataType for f in elements.schema.fields}
    parts = cut_lineage(elements.groupBy(*keys, "_task").agg(F.array_sort(F.collect_list(F.struct("_run", "element"))).alias("parts")))
    told = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [compose([p["element"] for p in row]) for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "element"])

    def walk(at: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, place, state = [], [], []
                for k, (row, now) in enumerate(zip(batch.column("parts").to_pylist(), batch.column("state").to_pylist(), strict=True)):
                    for part in row:
                        owner.append(k)
                        place.append(part[at])
                        state.append(now)
                        now = move(part["element"], now)
                kept = batch.select([n for n in batch.schema.names if n not in ("parts", "state")]).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(place, pa.int64()), pa.array(state, pa.int64())], names=[*kept.schema.names, at, "state"]
                )

        return run

    tasks = parts.mapInArrow(whole, f"{told}, _task bigint, element binary")
    chains = tasks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_task", "element"))).alias("parts"))
    if begin is None:
        begin = spark.createDataFrame([], f"{told}, state bigint")
    first = begin.select(*keys, F.col("state").cast("bigint").alias("state"))
    chains = matched(chains, first, keys, "left").fillna(0, ["state"])
    opened = chains.mapInArrow(walk("_task"), f"{told}, _task bigint, state bigint")
    both = matched(parts, opened, [*keys, "_task"])
    return both.mapInArrow(walk("_run"), f"{told}, _task bigint, _run bigint, state bigint")
