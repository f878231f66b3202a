"""Best-fit packing of documents into token sequences, in levels.

Each task cuts its documents into pieces and packs them by best fit, longest first. Bins that nothing else can fill are
done; underfull bins become items of their own and are packed again by best fit, in ever fewer groups, until one group is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import groups, record_batch
from tabloom.llm.tokens import token_cache
from tabloom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Items that are packed together, at most.
ITEMS = 50_000
#: A bin with less room than this share is done.
NEARLY = 0.005


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds: longest first, into the bin with the least room that takes it."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used: list[int] = []
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, own = capacity, len(used)
            used.append(0)
        bins[k], offsets[k] = own, used[own]
        used[own] += need
        if room - need:
            if not by_room.setdefault(room - need, []):
                insort(rooms, room - need)
            by_room[room - need].append(own)
    return bins, offsets, np.array(used, dtype=np.int64)


def _pieces(doc_ids: list, token_ids, capacity: int):
    """(doc_id, piece, start, length, crc32) of every piece; only a document above the capacity is cut."""
    for doc_id, ids in zip(doc_ids, token_ids, strict=True):
        whole = np.append(ids, np.uint32(END_ID)).astype("<u4")
        for piece, start in enumerate(range(0, len(whole), capacity)):
            own = whole[start : start + capacity]
            yield doc_id, piece, start, len(own), zlib.crc32(own.tobytes())


def _place(tokenizer: str, capacity: int):
    def run(batches):
        cache = token_cache(tokenizer)
        task = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        made = 0

        def packed():
            doc_id, piece, start, length, crc = zip(*held, strict=True)
            length = np.array(length, dtype=np.int64)
            bins, offsets, used = best_fit(length, capacity)
            return record_batch(
                "doc_id piece start length ids_crc32 bin offset used", pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), length, pa.array(crc, pa.int64()), task + made + bins, offsets, used[bins],
            ), len(used)

        for batch in batches:
            ids = cache.encode(batch.column(1).to_pylist())
            for row in _pieces(batch.column(0).to_pylist(), ids, capacity):
                held.append(row)
                if len(held) == ITEMS:
                    out, count = packed()
                    yield out
                    held, made = [], made + count
        if held:
            yield packed()[0]

    return run


def _merge(capacity: int):
    def run(batches):
        for table in groups(batches, 1):
            items, used = table.column(1).to_numpy(), table.column(2).to_numpy()
            bins, offsets, total = best_fit(used, capacity)
            # a bin takes the name of its first item, so names stay different everywhere
            first = np.zeros(len(total), dtype=np.int64)
            first[bins[::-1]] = items[::-1]
            yield record_batch("item bin shift used", items, first[bins], offsets, total[bins])

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Tokens are the ids of the whole text and one end id, so null and empty texts have one token. Pieces lie gapless from 0 in
    their sequence. Null ids are kept; repeated rows are packed each; other columns don't matter; an empty table gives an
    empty table.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"
    placed = cut_lineage(rows.mapInArrow(_place(tokenizer, capacity), layout))
    room = max(1, int(capacity * NEARLY))
    names = placed.select(F.col("bin").alias("item"), "bin", F.lit(0).cast("long").alias("shift"), "used").filter(f"offset = 0 and used <= {capacity - room}")
    moves = None
    while True:
        state = names.agg(F.count_distinct("bin"), F.min("used")).first()
        open_bins = names.filter(F.col("used") + F.lit(state[1] or 0) <= capacity)
        count = open_bins.select("bin").distinct().count() if state[0] else 0
        if count < 2:
            break
        parts = -(-count // ITEMS)
        items = open_bins.select("bin", "used").distinct().select((F.pmod(F.xxhash64("bin"), F.lit(parts))).alias("part"), "bin", "used")
        merged = items.repartition("part").sortWithinPartitions("part", "bin").mapInArrow(
            _merge(capacity), "item long, bin long, shift long, used long"
        )
        step = cut_lineage(merged)
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("shift").alias("more"), F.col("used").alias("now"))
            moves = cut_lineage(moves.join(later, "bin", "left").select(
                "item", F.coalesce("next", "bin").alias("bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                F.coalesce("now", "used").alias("used"),
            ))
        left = step.select("bin").distinct().count()
        if parts == 1 or left > 0.98 * count:
            break
        names = step.filter(f"used <= {capacity - room}")
    if moves is None:
        moves = names.limit(0)
    moved = moves.select(F.col("item").alias("bin"), F.col("bin").alias("sequence"), "shift")
    return placed.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
