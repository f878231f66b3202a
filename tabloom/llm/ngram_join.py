"""Jaccard join of word-shingle sets with a count-vector R-tree.

Every set is a point: its shingles are hashed into groups and the counts of the groups are the coordinates. The sum of
coordinate minima of two points bounds the overlap of their sets, also for the boxes of an R-tree, so most pairs are left
out without a look at the sets; what survives is verified.

Which points meet in one tree is decided without loss: sets that link share one of their first n - ceil(0.75 n) + 1 shingles
in any fixed order of all shingles. The order taken puts long shingles first and frequent ones last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import groups, record_batch
from tabloom.llm.components import connected_components
from tabloom.llm.shingles import mix, set_id, shingle_sets
from tabloom.session import cut_lineage

#: A point has a group for every so many shingles, a power of two of groups and LEAST_GROUPS at least. Unrelated sets share some
#: seven tenths of their counts by chance then, whatever their size; linked ones share six sevenths.
PER_GROUP = 4
LEAST_GROUPS = 64
#: A coordinate of 255 stands for any count from there on.
FULL = 255
#: Points of one tree; a larger block or class is cut into cells and every pair of cells gets a tree.
CELL = 4096
#: Shingles of the sets of a cell of a class, about (8 bytes each); a class with more is cut into more cells.
CELL_SHINGLES = 4_000_000
#: A shingle in so many documents goes to the end of the order. Only speed depends on it.
FREQUENT = 64
#: At most so many frequent shingles are told apart; they travel as a bit map of BITS bits, whatever the input.
MAX_FREQUENT = 500_000
BITS = 1 << 23


def enough(a, b):
    """Smallest overlap of sets of a and b shingles with 100 * overlap >= 75 * union, times 175."""
    return 75 * (a + b)


def prefix_length(n: int) -> int:
    """Shingles of a set of n of which a linked set must share one."""
    return n - -(-3 * n // 4) + 1


def groups_of(n: int) -> int:
    return max(LEAST_GROUPS, 1 << max(0, -(-n // PER_GROUP) - 1).bit_length())


def point_of(ids: np.ndarray) -> np.ndarray:
    """Counts of the shingle groups."""
    width = groups_of(len(ids))
    counts = np.bincount((ids & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.minimum(counts, FULL).astype(np.uint8)


class Classes:
    """Disjoint classes of 0..n-1; `of` holds the class of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = [[i] for i in range(n)]
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        self.links.append((i, j))


class RTree:
    """Packed R-tree over count vectors: leaves of 32 points, nodes of 16 children, boxes kept as upper corners and sizes."""

    LEAF, FAN = 32, 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        rows = len(sizes)
        by_size = np.argsort(sizes, kind="stable")
        spread = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        strip = self.LEAF * max(1, int(np.sqrt(rows / self.LEAF)))
        self.order = np.concatenate(
            [s[np.argsort(points[s, spread], kind="stable")] for s in (by_size[k : k + strip] for k in range(0, rows, strip))]
        )
        self.points, self.sizes = points[self.order], sizes[self.order]
        step = np.arange(0, rows, self.LEAF)
        self.levels = [(np.maximum.reduceat(self.points, step), np.minimum.reduceat(self.sizes, step), np.maximum.reduceat(self.sizes, step))]
        while len(self.levels[-1][1]) > self.FAN:
            top, low, high = self.levels[-1]
            step = np.arange(0, len(low), self.FAN)
            self.levels.append((np.maximum.reduceat(top, step), np.minimum.reduceat(low, step), np.maximum.reduceat(high, step)))

    @staticmethod
    def _may(top, low, high, own_top, own_low, own_high) -> np.ndarray:
        overlap = np.minimum(top, own_top).sum(axis=-1)
        return (175 * overlap >= enough(low, own_low)) & (4 * high >= 3 * own_low) & (4 * own_high >= 3 * low)

    def near_leaves(self, leaf: int) -> np.ndarray:
        """Leaves from `leaf` on whose boxes may hold a linked point."""
        own = tuple(x[leaf] for x in self.levels[0])
        found = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            found = found[self._may(top[found], low[found], high[found], *own)]
            if depth:
                found = (found[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                found = found[found < len(self.levels[depth - 1][1])]
        return found[found >= leaf]

    def join(self, classes: Classes, names: np.ndarray, wanted: np.ndarray, verify: Callable[[int, int], bool] | None) -> None:
        """Join the classes of points that pass the bound and `verify`. Pairs of one class already, or not `wanted`, are left out."""
        rows = len(self.sizes)
        own = names[self.order]
        need = wanted[self.order]
        for leaf in range(len(self.levels[0][1])):
            a = np.arange(leaf * self.LEAF, min(rows, (leaf + 1) * self.LEAF))
            for other in self.near_leaves(leaf):
                b = np.arange(other * self.LEAF, min(rows, (other + 1) * self.LEAF))
                apart = classes.of[own[a]][:, None] != classes.of[own[b]][None, :]
                if other == leaf:
                    apart &= a[:, None] < b[None, :]
                apart &= need[a][:, None] | need[b][None, :]
                i, j = np.nonzero(apart)
                if not len(i):
                    continue
                n, m = self.sizes[a[i]], self.sizes[b[j]]
                fits = (4 * n >= 3 * m) & (4 * m >= 3 * n)
                i, j, n, m = i[fits], j[fits], n[fits], m[fits]
                overlap = np.minimum(self.points[a[i]], self.points[b[j]]).sum(axis=1)
                passed = 175 * overlap >= enough(n, m)
                for x, y in zip(own[a[i[passed]]].tolist(), own[b[j[passed]]].tolist(), strict=True):
                    if classes.of[x] != classes.of[y] and (verify is None or verify(x, y)):
                        classes.join(x, y)


def tree_links(points: list[np.ndarray], sizes: np.ndarray, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that span the classes of all points that pass the bound (and `verify`): at most one fewer than points."""
    classes = Classes(len(sizes))
    widths = np.array([len(p) for p in points])
    for width in np.unique(widths):
        # linked sets have sizes within three quarters of each other, so at most twice the groups
        names = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(names) < 2:
            continue
        folded = np.zeros((len(names), width), dtype=np.int32)
        for row, k in enumerate(names):
            whole = points[k].astype(np.int32)
            whole[whole == FULL] = 1 << 20
            folded[row] = whole.reshape(-1, width).sum(axis=0)
        RTree(folded, sizes[names]).join(classes, names, widths[names] == width, verify)
    return classes.links


def _points(batches):
    for batch in batches:
        ids, rows = batch.column(0), []
        for ids_of in shingle_sets(batch.column(1).to_pylist()):
            some = len(ids_of) > 0
            rows.append((len(ids_of), set_id(ids_of) if some else None, point_of(ids_of).tobytes() if some else None))
        n, node, point = zip(*rows, strict=True) if rows else ((), (), ())
        yield record_batch("doc_id n_shingles node point", ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(point, pa.binary()))


def _repeated(batches):
    """Shingles that more than one different set of this task holds, with how many."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def counted():
        ids, times = np.unique(np.concatenate(held), return_counts=True)
        return record_batch("shingle times", ids[times > 1].astype(np.int64), times[times > 1].astype(np.int64))

    for batch in batches:
        for ids in shingle_sets(batch.column(0).to_pylist()):
            if len(ids) and (name := set_id(ids)) not in seen:
                seen.add(name)
                held.append(ids)
                size += len(ids)
                if size > 6_000_000:
                    yield counted()
                    held, size = [], 0
    if held:
        yield counted()


def _prefixes(flags: np.ndarray):
    """The shingles of each set that a linked set must share one of, with the set's size."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for ids in shingle_sets(batch.column(0).to_pylist()):
                if not len(ids) or (name := set_id(ids)) in seen:
                    continue
                seen.add(name)
                frequent = bit_at(flags, ids)
                first = np.concatenate([ids[~frequent], ids[frequent]])[: prefix_length(len(ids))]
                keys.append(first.astype(np.int64))
                nodes.append(np.full(len(first), name, dtype=np.int64))
            if keys:
                yield record_batch("key node", np.concatenate(keys), np.concatenate(nodes))

    return run


def bit_at(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = mix(ids) & np.uint64(BITS - 1)
    return (flags[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_map(ids: np.ndarray) -> np.ndarray:
    flags = np.zeros(BITS, dtype=np.uint8)
    flags[(mix(ids.astype(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def _runs(batches) -> Iterator[np.ndarray]:
    """Distinct sets of each key that has two or more, from batches sorted by key and set."""
    keys, nodes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        nodes = np.concatenate([nodes, batch.column(1).to_numpy()])
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh = new | np.concatenate([[True], nodes[1:] != nodes[:-1]])
        keys, nodes, new = keys[fresh], nodes[fresh], new[fresh]
        begin = np.flatnonzero(new)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a > 1:
                yield nodes[a:b]
        keys, nodes = keys[begin[-1] :], nodes[begin[-1] :]
    if len(nodes) > 1:
        yield nodes


def _blocks(batches):
    """Blocks of sets that share a prefix shingle; blocks of the same sets come once from a task."""
    seen: set[int] = set()
    blocks, nodes, size = [], [], 0
    for run in _runs(batches):
        cells = [run[k : k + CELL] for k in range(0, len(run), CELL)]
        for own in cells if len(cells) == 1 else (np.concatenate(pair) for pair in combinations(cells, 2)):
            name = xxhash.xxh3_64_intdigest(own.tobytes()) >> 1
            if name in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(name)
            blocks.append(np.full(len(own), name, dtype=np.int64))
            nodes.append(own)
            size += len(own)
            if size > 100_000:
                yield record_batch("block node", np.concatenate(blocks), np.concatenate(nodes))
                blocks, nodes, size = [], [], 0
    if nodes:
        yield record_batch("block node", np.concatenate(blocks), np.concatenate(nodes))


def _tree_blocks(batches):
    """Links by the bound alone that span the classes of each block: (a, b)."""
    for table in groups(batches, 1):
        nodes = table.column(1).to_numpy()
        points = [np.frombuffer(p, dtype=np.uint8) for p in table.column(3).to_pylist()]
        links = tree_links(points, table.column(2).to_numpy())
        if links:
            i, j = np.array(links).T
            yield record_batch("a b", nodes[i], nodes[j])


def _wanted_sets(flags: np.ndarray):
    """Sets whose bit is set, once from a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, sets, size = [], [], 0
            for ids in shingle_sets(batch.column(0).to_pylist()):
                if not len(ids) or (name := set_id(ids)) in seen:
                    continue
                seen.add(name)
                if bit_at(flags, np.array([name], dtype=np.uint64))[0]:
                    nodes.append(name)
                    sets.append(ids.tobytes())
                    size += len(ids)
                    if size > 1_000_000:
                        yield record_batch("node shingles", pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()))
                        nodes, sets, size = [], [], 0
            if nodes:
                yield record_batch("node shingles", pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()))

    return run


def _verified(batches):
    """Links of sets that share three quarters of their union, enough to span the classes of each group: (a, b)."""
    for table in groups(batches, 3):
        nodes = table.column(3).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        nodes = nodes[first]
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column(4).take(pa.array(first)).to_pylist()]
        sizes = np.array([len(s) for s in sets])

        def same(i: int, j: int, sets=sets) -> bool:
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return 175 * shared >= enough(len(sets[i]), len(sets[j]))

        links = tree_links([point_of(s) for s in sets], sizes, same)
        if links:
            i, j = np.array(links).T
            yield record_batch("a b", nodes[i], nodes[j])


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Bit map of shingles seen in FREQUENT or more documents, counted in tasks and summed; shingles a task sees once don't count."""
    counted = docs.select(text).mapInArrow(_repeated, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counted.filter(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "shingle").limit(MAX_FREQUENT)
    return bit_map(np.array([r[0] for r in top.select("shingle").toLocalIterator()], dtype=np.int64))


def jaccard_links(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(a, b): links between shingle sets that span every class of linked sets."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text))

    def prefixes(batches):
        return _prefixes(frequent.value)(batches)

    keys = docs.select(text).mapInArrow(prefixes, "key long, node long")
    blocks = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_blocks, "block long, node long").distinct()
    points = nodes.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("point").alias("point"))
    placed = blocks.join(points, "node").select("block", "node", "n", "point")
    near = cut_lineage(
        placed.repartition("block").sortWithinPartitions("block", "node").mapInArrow(_tree_blocks, "a long, b long").distinct()
    )
    classes = cut_lineage(connected_components(near, "a", "b"))
    asked = spark.sparkContext.broadcast(_bits_of(classes))

    def wanted(batches):
        return _wanted_sets(asked.value)(batches)

    sets = docs.select(text).mapInArrow(wanted, "node long, shingles binary")
    weighed = classes.join(points.select(F.col("node").alias("id"), "n"), "id").groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("held"))
    cells = F.least(F.col("sets"), F.greatest(F.ceil(F.col("sets") / CELL), F.ceil(F.col("held") / CELL_SHINGLES))).cast("long")
    sized = classes.join(weighed.select("root", cells.alias("cells")), "root")
    cell = F.pmod(F.xxhash64("id"), F.col("cells"))
    # a class of one cell gets one tree; more cells meet in pairs
    placed = sized.withColumn("cell", cell).select(
        "root", F.col("id").alias("node"), "cell", F.explode(F.expr("sequence(0L, cells - 1)")).alias("other"), "cells"
    ).filter("cells = 1 or cell <> other")
    tasks = placed.select("root", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "node")
    rows = tasks.join(sets, "node").select("root", "x", "y", "node", "shingles")
    return rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node").mapInArrow(_verified, "a long, b long")


def _bits_of(classes: DataFrame) -> np.ndarray:
    """Bit map of the ids; tasks and driver handle bits, BITS at most, never ids."""

    def bits(batches):
        flags = np.zeros(BITS, dtype=bool)
        for batch in batches:
            flags[(mix(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        for part in np.flatnonzero(flags.reshape(256, -1).any(axis=1)):
            yield record_batch("part bits", pa.array([int(part)], pa.int32()), pa.array([np.packbits(flags.reshape(256, -1)[part], bitorder="little").tobytes()], pa.binary()))

    def either(batches):
        for table in groups(batches, 1):
            parts = [np.frombuffer(b, dtype=np.uint8) for b in table.column(1).to_pylist()]
            yield record_batch("part bits", pa.array([table.column(0)[0].as_py()], pa.int32()), pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary()))

    found = classes.select("id").mapInArrow(bits, "part int, bits binary").repartition("part").sortWithinPartitions("part")
    flags = np.zeros(BITS // 8, dtype=np.uint8).reshape(256, -1)
    for part, own in found.mapInArrow(either, "part int, bits binary").collect():
        flags[part] = np.frombuffer(own, dtype=np.uint8)
    return flags.ravel()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`: the exact classes of documents with similarity 0.75 or more.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. A null id links with
    nothing and gets a null component. Repeated rows give repeated rows; rows of one id are one document and share its
    smallest component. Other columns are left alone. An empty table gives an empty table.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes = cut_lineage(plain.mapInArrow(_points, "doc_id long, n_shingles long, node long, point binary"))
    known = plain.filter("doc_id is not null")
    links = jaccard_links(known, nodes.filter("doc_id is not null"), "text")
    classes = connected_components(links, "a", "b")
    own = nodes.filter("doc_id is not null and node is not null").select("node", "doc_id")
    named = own.join(classes.withColumnRenamed("id", "node"), "node", "left").select(
        "doc_id", "node", F.coalesce("root", "node").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("low"))
    found = named.join(lowest, "root").select("node", F.col("low").alias("component_id")).groupBy("node").agg(
        F.min("component_id").alias("component_id")
    )
    return nodes.join(found, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
