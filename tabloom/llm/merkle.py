"""Manifest of a dataset as a content-addressed tree of digests, and proofs read from it.

Every row is a leaf; the leaves of a source, by id, are the leaves of its tree, and the sources' roots, by source, those of
the tree above. A store maps the digest of an inner node to its children. A proof goes down from the root: the digits of
the leaf's rank select a child on every level, the others are collected, and the path is turned round at the end.

Trees are built and descended in segments of SEGMENT_LEVELS levels: one task holds a segment (at most 3,280 digests), and the
path above a segment is looked up once for the segment, not once for each of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.batches import groups, record_batch
from tabloom.session import cut_lineage

ARITY = 3
#: Levels of a tree that one task builds or descends at once.
SEGMENT_LEVELS = 7
SEGMENT = ARITY**SEGMENT_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """A value as digest input: `-` for null, else its UTF-8 byte count, a colon and the value."""
    told = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, one after the other."""
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree; a lone leaf is its own root."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with rank (from 0 in `order`) and size, both within the rows of equal `keys`; nulls come first.

    Rows are dealt by range of keys and order, so a hot key is spread over tasks; only counts of (task, key) are accumulated.
    """
    by = [F.col(c) for c in [*keys, *order]]
    place = F.monotonically_increasing_id()
    dealt = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.shiftright(place, 33).alias("_task"), place.bitwiseAND((1 << 33) - 1).alias("_place")
    ))
    held = dealt.groupBy("_task", *keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.select(
        F.col("_task").alias("_part"), *[F.col(k).alias(f"_key_{k}") for k in keys], "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("size"),
    )
    same = F.col("_task") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return dealt.join(parts, same).select(
        *rows.columns, (F.col("_place") - F.col("_first") + F.col("_before")).alias("rank"), "size"
    )


def _levels(leaves: list[str], levels: int) -> Iterator[list[str]]:
    """The levels above the leaves, lowest first."""
    for _ in range(levels):
        leaves = [digest(leaves[k : k + ARITY]) for k in range(0, len(leaves), ARITY)]
        yield leaves


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner nodes of each segment (tree, segment) with their children; the segment's root, with its size, has level -1."""
    for rows in groups(batches, 2):
        tree, segment, size = (rows.column(k)[0].as_py() for k in (0, 1, 4))
        below = rows.column(3).to_pylist()
        found: list[tuple[int, str, list[str]]] = []
        for level, nodes in enumerate(_levels(below, min(SEGMENT_LEVELS, height(size)))):
            found += [(level, node, below[k * ARITY : (k + 1) * ARITY]) for k, node in enumerate(nodes)]
            below = nodes
        found.append((-1, below[0], []))
        level, node, children = zip(*found, strict=True)
        count = len(found)
        yield record_batch(
            "tree segment level digest children size", pa.array([tree] * count, pa.int64()), pa.array([segment] * count, pa.int64()),
            pa.array(level, pa.int32()), list(node), pa.array(children, pa.list_(pa.string())),
            pa.array([-(-size // SEGMENT)] * count, pa.int64()),
        )


def build(leaves: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Roots (tree, root) and, from the lowest, each tier's leaves and store.

    `leaves`: tree, rank, size (leaves of the tree), digest. A tier's leaves are the roots of the segments of the tier below.
    """
    tiers = []
    while True:
        longest = leaves.agg(F.max("size")).first()[0] or 0
        if longest <= 1:
            return leaves.select("tree", F.col("digest").alias("root")), tiers
        rows = leaves.select("tree", F.expr(f"rank div {SEGMENT}").alias("segment"), "rank", "digest", "size")
        store = cut_lineage(rows.repartition("tree", "segment").sortWithinPartitions("tree", "segment", "rank").mapInArrow(
            _segments, "tree long, segment long, level int, digest string, children array<string>, size long"
        ))
        tiers.append((leaves, store))
        leaves = store.filter("level = -1").select("tree", F.col("segment").alias("rank"), "size", "digest")


_REQUEST = "tree long, segment long, kind int, rank long, digest string, other string, id long, size long, names array<string>, shape array<int>"


def _descend(fold: bool):
    """Paths of the leaves of each segment: siblings from the leaf up, and for each level 4 * own place + number of siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 2):
            tree, segment = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
            store: dict[str, list[str]] = {}
            top, above, above_shape = "", [], []
            out: list[tuple] = []
            columns = [rows.column(k).to_pylist() for k in range(2, 10)]
            for kind, rank, own, other, ident, size, names, shape in zip(*columns, strict=True):
                if kind == 0:
                    top, above, above_shape = own, names, shape
                    continue
                if kind == 1:
                    store[own] = names
                    continue
                levels = min(SEGMENT_LEVELS, height(size))
                node, parts = top, []
                for level in range(levels - 1, -1, -1):
                    children = store[node]
                    digit = rank // ARITY**level % ARITY
                    node = children[digit]
                    parts.append((digit, children[:digit] + children[digit + 1 :]))
                if node != own:
                    raise RuntimeError("the store does not lead to the leaf")
                parts.reverse()
                path = [name for _, others in parts for name in others] + above
                shapes = [4 * digit + len(others) for digit, others in parts] + above_shape
                if fold:
                    out.append((ident, own, digest(path), folded(other, path, shapes)))
                else:
                    out.append((rank, own, path, shapes))
            if not out:
                continue
            found = list(zip(*out, strict=True))
            if fold:
                yield record_batch("tree doc_id leaf proof_sha256 folded_root", pa.array([tree] * len(out), pa.int64()), pa.array(found[0], pa.int64()), *map(list, found[1:]))
            else:
                yield record_batch(
                    "tree segment digest names shape", pa.array([tree] * len(out), pa.int64()), pa.array(found[0], pa.int64()), list(found[1]),
                    pa.array(found[2], pa.list_(pa.string())), pa.array(found[3], pa.list_(pa.int32())),
                )

    return run


def folded(leaf: str, path: list[str], shape: list[int]) -> str:
    """The root that a leaf and a path give."""
    at = 0
    for told in shape:
        digit, others = divmod(told, 4)
        run = path[at : at + others]
        leaf = digest([*run[:digit], leaf, *run[digit:]])
        at += others
    return leaf


def descend(heads: DataFrame, tiers: list[tuple[DataFrame, DataFrame]], fold: bool = False) -> DataFrame:
    """Paths of all leaves, from the highest tier down.

    `heads`: tree, segment (0), digest of the tree's root, names and shape of the path above it. The result has the same columns,
    one row per leaf with its rank as segment; with `fold`, tree, doc_id, leaf, proof_sha256 and folded_root (from the leaves' column
    `other`).
    """
    nothing = F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("shape")
    for tier in range(len(tiers) - 1, -1, -1):
        leaves, store = tiers[tier]
        last = fold and tier == 0
        none = F.lit(None)
        told = [
            heads.select("tree", "segment", F.lit(0).alias("kind"), none.cast("long").alias("rank"), "digest", none.cast("string").alias("other"), none.cast("long").alias("id"), none.cast("long").alias("size"), "names", "shape"),
            store.filter("level >= 0").select("tree", "segment", F.lit(1).alias("kind"), none.cast("long").alias("rank"), "digest", none.cast("string").alias("other"), none.cast("long").alias("id"), none.cast("long").alias("size"), F.col("children").alias("names"), nothing[1]),
            leaves.select(
                "tree", F.expr(f"rank div {SEGMENT}").alias("segment"), F.lit(2).alias("kind"), "rank", "digest",
                (F.col("other") if last else none.cast("string")).alias("other"), (F.col("id") if last else none.cast("long")).alias("id"), "size", *nothing,
            ),
        ]
        rows = told[0].unionByName(told[1]).unionByName(told[2])
        dealt = rows.repartition("tree", "segment").sortWithinPartitions("tree", "segment", "kind")
        if last:
            return dealt.mapInArrow(_descend(True), "tree long, doc_id long, leaf string, proof_sha256 string, folded_root string")
        heads = dealt.mapInArrow(_descend(False), "tree long, segment long, digest string, names array<string>, shape array<int>")
    return heads


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of `docs` (FIELDS; other columns don't matter).

    `altered` replaces fields of the rows as they are found later; the folded root is made from those and the proof of the
    original. Rows without id or source come first in their tree and among the trees; rows of one id lie by leaf digest; rows
    that are repeated whole are leaves each. An empty table gives an empty table.
    """
    now = {c: F.col(c) for c in FIELDS} | (altered or {})
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
        leaf_digest(*[F.col(c) for c in FIELDS]).alias("digest"), leaf_digest(*now.values()).alias("other"),
    ))
    leaves = ranked(rows, ["source"], ["id", "digest"])
    trees = ranked(rows.select("source").distinct(), [], ["source"]).select(F.col("source").alias("name"), F.col("rank").alias("tree"), F.col("size").alias("trees"))
    trees = cut_lineage(trees)
    # the few names travel to the rows where they are small; beyond that the join is split where a source is hot
    leaves = cut_lineage(leaves.join(trees, F.col("source").eqNullSafe(F.col("name"))).select("tree", "rank", "size", "digest", "other", "id"))
    roots, tiers = build(leaves)
    subroots = roots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("size"), F.col("root").alias("digest"))
    top, upper = build(subroots)
    first = top.first()
    root = F.lit(first.root if first else None).cast("string")
    empty = F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("shape")
    zero = F.lit(0).cast("long")
    if upper:
        heads = descend(top.select("tree", zero.alias("segment"), F.col("root").alias("digest"), *empty), upper)
        heads = heads.select(F.col("segment").alias("tree"), zero.alias("segment"), "digest", "names", "shape")
    else:
        heads = subroots.select(F.col("rank").alias("tree"), zero.alias("segment"), "digest", *empty)
    heads = cut_lineage(heads)
    if tiers:
        found = descend(heads, tiers, fold=True)
    else:
        found = _lone(leaves, heads)
    return found.join(roots.withColumnRenamed("root", "subroot"), "tree").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def _lone(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """As `descend` where no tree has more than one leaf."""

    @F.udf("struct<proof:string,folded:string>")
    def prove(leaf, path, shape):
        return digest(path), folded(leaf, path, shape)

    both = leaves.join(heads.select("tree", "names", "shape"), "tree").select("*", prove("other", "names", "shape").alias("told"))
    return both.select("tree", F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("told.proof").alias("proof_sha256"), F.col("told.folded").alias("folded_root"))


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """The text as an accident leaves it: line ends are lost where the checksum of the decimal id is even."""
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
