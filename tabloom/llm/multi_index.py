"""Near-duplicate vectors by an inverted multi-index.

The two halves of each unit vector have a codebook each, fitted on a bounded sample; a cell is a pair of nearest centroids.
A vector is filed in its own cell and looks into other cells in order of their cost, the squared distance to the borders
of both half cells, up to a cost that holds the target share of all links. The cost is set from links of sampled vectors
to all rows. What is found is verified by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import groups, record_batch
from tabloom.llm.components import connected_components
from tabloom.session import cut_lineage

#: Rows that the codebooks are fitted on, at most; every row is filed and looked for.
SAMPLE = 16_384
#: Sampled rows whose links to all rows set the cost to stop at.
PROBES = 512
#: Share of the links of sampled rows that lie within the cost, before the margin.
RECALL = 0.999
MARGIN = 1.5
#: Centroids of a half, at most.
MAX_CENTROIDS = 1024
#: Vectors of a block; a fuller cell is cut into blocks that meet in pairs.
BLOCK = 2048
BINS = 2000


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def fit_codebook(half: np.ndarray, centroids: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from a seeded start on a bounded sample."""
    distinct = np.unique(half, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:centroids]].copy()
    for _ in range(rounds):
        nearest = ((book**2).sum(axis=1)[None] - 2 * half @ book.T).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, nearest, half)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return np.unique(book, axis=0)


class Index:
    """The codebooks of both halves."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.books = [fit_codebook(part, centroids) for part in self._halves(sample)]
        self.apart = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(axis=-1), 1e-30)) for b in self.books]
        self.width = len(self.books[1])

    def _halves(self, units: np.ndarray) -> list[np.ndarray]:
        return [units[:, : self.cut], units[:, self.cut :] if units.shape[1] > 1 else units[:, :0]]

    def costs(self, units: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each vector, and per half the squared distance to the border of each half cell."""
        nearest, borders = [], []
        for part, book, apart in zip(self._halves(units), self.books, self.apart, strict=True):
            squared = (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None] - 2 * part @ book.T
            own = squared.argmin(axis=1)
            rows = np.arange(len(units))
            border = (squared - squared[rows, own][:, None]) / (2 * apart[own])
            border[rows, own] = 0
            nearest.append(own)
            borders.append(np.maximum(border, 0) ** 2)
        return nearest[0] * self.width + nearest[1], borders

    def visits(self, borders: list[np.ndarray], stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the cost `stop`, the nearest first for each row."""
        rows, cells, costs = [], [], []
        first_row, first = np.nonzero(borders[0] <= stop)
        for chosen in np.array_split(np.arange(len(first_row)), max(1, len(first_row) // 4096)):
            cost = borders[0][first_row[chosen], first[chosen]][:, None] + borders[1][first_row[chosen]]
            k, second = np.nonzero(cost <= stop)
            rows.append(first_row[chosen][k])
            cells.append(first[chosen][k] * self.width + second)
            costs.append(cost[k, second])
        row, cell, cost = np.concatenate(rows), np.concatenate(cells), np.concatenate(costs)
        order = np.lexsort((cost, row))
        return row[order], cell[order]

    def covers(self, borders: list[np.ndarray], rows: np.ndarray, cells: np.ndarray, stop: float) -> np.ndarray:
        return borders[0][rows, cells // self.width] + borders[1][rows, cells % self.width] <= stop


def _stop_cost(vectors: DataFrame, index: Index, probes: np.ndarray, dim: int, least: float) -> float:
    """Cost within which RECALL of all links from the probes lie, times MARGIN.

    Links are those to all rows, and, so that rare links don't leave it unset, to made-up vectors just at the cosine `least`.
    """
    limit = 2 * (1 - least)
    shared = vectors.sparkSession.sparkContext.broadcast((index, probes))

    def count(batches):
        held, asked = shared.value
        _, borders = held.costs(asked)
        bins = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                units = as_matrix(batch.column(0), dim)
                cells, _ = held.costs(units)
                row, other = np.nonzero(asked @ units.T >= least)
                cost = borders[0][row, cells[other] // held.width] + borders[1][row, cells[other] % held.width]
                bins += np.bincount(np.minimum((cost / limit * BINS).astype(np.int64), BINS - 1), minlength=BINS)
        some = np.flatnonzero(bins)
        yield record_batch("bin times", some, bins[some])

    rows = vectors.select("vector").mapInArrow(count, "bin long, times long").groupBy("bin").agg(F.sum("times")).collect()
    bins = np.zeros(BINS)
    for place, times in rows:
        bins[place] = times
    real = np.searchsorted(np.cumsum(bins), RECALL * bins.sum()) / BINS * limit
    noise = np.random.default_rng(11).standard_normal((8, *probes.shape))
    noise -= (noise * probes).sum(axis=-1, keepdims=True) * probes
    noise /= np.maximum(np.linalg.norm(noise, axis=-1, keepdims=True), 1e-12)
    _, borders = index.costs(probes)
    made = []
    for side in noise:
        cells, _ = index.costs(least * probes + np.sqrt(1 - least**2) * side)
        made.append(borders[0][np.arange(len(probes)), cells // index.width] + borders[1][np.arange(len(probes)), cells % index.width])
    return min(limit, MARGIN * max(real + limit / BINS, float(np.quantile(made, RECALL))))


def _pairs_in(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links left[k] - right[k] (places in ids), enough to span their classes."""
    root = np.arange(len(ids))
    kept = []
    while len(left):
        # each class takes the smallest root it touches; a link that lowers a root is kept
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept.append(np.stack([left[first], right[first]]))
        root_of = np.arange(len(ids))
        root_of[high[first]] = low[first]
        while True:
            deeper = root_of[root_of]
            if (deeper == root_of).all():
                break
            root_of = deeper
        root = root_of[root]
    both = np.concatenate(kept, axis=1) if kept else np.zeros((2, 0), dtype=np.int64)
    return ids[both[0]], ids[both[1]]


def _same_length(vectors: DataFrame, dim: int, rows: int, least: float) -> DataFrame:
    """(a, b, times): a null `b` gives `times` links to `a`, else a link that joins a class."""
    spark = vectors.sparkSession
    picked = vectors.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).select("vector")
    sample = as_matrix(pa.array([bytes(r[0]) for r in picked.toLocalIterator()], pa.binary()), dim)
    centroids = int(min(MAX_CENTROIDS, len(sample), 2 ** np.ceil(np.log2(max(2.0, np.sqrt(rows / 64))))))
    index = Index(sample, centroids)
    stop = _stop_cost(vectors, index, sample[:PROBES], dim, least)
    shared = spark.sparkContext.broadcast(index)

    def cells_of(batches):
        for batch in batches:
            if batch.num_rows:
                yield record_batch("cell", shared.value.costs(as_matrix(batch.column(0), dim))[0])

    # at most MAX_CENTROIDS squared cells; only those of more than one block are told
    full = vectors.select("vector").mapInArrow(cells_of, "cell long").groupBy("cell").count().filter(F.col("count") > BLOCK)
    blocks = spark.sparkContext.broadcast({r[0]: -(-r[1] // BLOCK) for r in full.collect()})

    def place(batches):
        held, parts = shared.value, blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, units = batch.column(0).to_numpy(), as_matrix(batch.column(1), dim)
            own, borders = held.costs(units)
            row, cell = held.visits(borders, stop)
            several = np.array([parts.get(c, 1) for c in cell.tolist()])
            resident = own[row] == cell
            out = []
            for k in np.unique(several):
                r, c, at_home = row[several == k], cell[several == k], resident[several == k]
                block = (ids[r] * 0x9E3779B1 >> 7) % k
                for other in range(k):
                    x = np.where(at_home, np.minimum(block, other), other)
                    y = np.where(at_home, np.maximum(block, other), other)
                    out.append((c, x, y, r, at_home, own[r], block))
            c, x, y, r, at_home, home, block = (np.concatenate(p) for p in zip(*out, strict=True))
            for k in range(0, len(c), 20_000):
                s = slice(k, k + 20_000)
                yield record_batch(
                    "cell x y block home id weight vector", c[s], x[s], y[s], np.where(at_home[s], block[s], -1), home[s],
                    ids[r[s]], batch.column(2).take(pa.array(r[s])), batch.column(1).take(pa.array(r[s])),
                )

    def verify(batches):
        held = shared.value
        for rows_of in groups(batches, 3):
            cell, x, y = (rows_of.column(k)[0].as_py() for k in range(3))
            block, home, ids, weight = (rows_of.column(k).to_numpy() for k in range(3, 7))
            units = as_matrix(rows_of.column(7), dim)
            _, borders = held.costs(units)
            residents = np.flatnonzero(block == y)
            others = np.flatnonzero(block == x) if x != y else np.arange(len(ids))
            times, left, right = np.zeros(len(ids), dtype=np.int64), [], []
            for k in range(0, len(others), 1024):
                i, j = np.nonzero(units[others[k : k + 1024]] @ units[residents].T >= least)
                i, j = others[k : k + 1024][i], residents[j]
                inside = block[i] >= 0
                once = np.where(inside, (i < j) if x == y else True, True)
                # two vectors that look into each other's cell meet twice: the smaller cell counts
                twice = ~inside & held.covers(borders, j, home[i], stop) & (home[i] < cell)
                i, j = i[once & ~twice], j[once & ~twice]
                np.add.at(times, i, weight[j])
                np.add.at(times, j, weight[i])
                left.append(i)
                right.append(j)
            some = np.flatnonzero(times)
            if len(some):
                yield record_batch("a b times", ids[some], pa.nulls(len(some), pa.int64()), times[some])
                a, b = _pairs_in(ids, np.concatenate(left), np.concatenate(right))
                yield record_batch("a b times", a, b, pa.nulls(len(a), pa.int64()))

    layout = "cell long, x long, y long, block long, home long, id long, weight long, vector binary"
    placed = vectors.select("id", "vector", "weight").mapInArrow(place, layout)
    return placed.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(verify, "a long, b long, times long")


def _valid(batches) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; null for vectors that link with nothing."""
    for batch in batches:
        packed, dims = [], []
        for vector in batch.column(1).to_pylist():
            raw = None if vector is None or None in vector else np.array(vector, dtype=np.float64)
            usable = raw is not None and len(raw) and np.isfinite(raw).all() and raw.any()
            if usable:
                # what would leave the range of floats, alone or squared, is scaled by a power of two first: no cosine changes
                power = int(np.frexp(np.abs(raw).max())[1])
                raw = (np.ldexp(raw, -power) if abs(power) > 60 else raw).astype(np.float32)
            packed.append((raw + np.float32(0)).tobytes() if usable else None)
            dims.append(len(raw) if usable else None)
        yield record_batch("id vector dim", batch.column(0), pa.array(packed, pa.binary()), pa.array(dims, pa.int32()))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links with a cosine of `least` or more that the index finds.

    Vectors that are null, empty, zero, or hold nulls or non-finite components, link with nothing, and so do vectors of
    different lengths and rows without id. Equal vectors are one entry of the index with a weight, so copies cost nothing;
    rows that repeat an id count as further vectors of that id. Components count with 24 bits beside the largest one of their vector,
    all that a float has. Other columns don't matter. An empty table gives an
    empty table.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    packed = cut_lineage(rows.mapInArrow(_valid, "id long, vector binary, dim int"))
    entries = cut_lineage(
        packed.filter("id is not null and vector is not null").groupBy("vector", "dim").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    )
    found = None
    for dim, count in sorted(tuple(r) for r in entries.groupBy("dim").count().collect()):
        part = _same_length(entries.filter(F.col("dim") == dim), dim, count, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = entries.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("weight").alias("times")).limit(0)
    found = cut_lineage(found)
    times = found.filter("b is null").groupBy(F.col("a").alias("entry")).agg(F.sum("times").alias("times"))
    roots = connected_components(found.filter("b is not null"), "a", "b").withColumnRenamed("id", "entry")
    known = (
        entries.withColumnRenamed("id", "entry").join(times, "entry", "left").join(roots, "entry", "left")
        .select("vector", (F.coalesce("times", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "entry").alias("component_id"))
    )
    usable = packed.filter("id is not null and vector is not null").join(known, "vector").select("id", "n_links", "component_id")
    rest = packed.filter("id is null or vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable.unionByName(rest).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
