"""Token sequences in training order, as shards of fixed-stride records.

Every sequence has a number, its task and its place in the task. A keyed Feistel network with cycle-walking permutes the
numbers; equal ranges of permuted numbers are the shards, and a sequence's slot is its rank in permuted order, which the
shards' first slots make global. A reader finds slot s in the shard with the last first slot up to s, at a fixed byte offset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.batches import groups, record_batch
from tabloom.llm.shingles import mix
from tabloom.llm.tokens import token_cache
from tabloom.session import cut_lineage

LENGTH = 2048
END_ID = 1
#: Sequences of one task, at most 2 to this power.
ROOM = 24
ROUNDS = 6
#: Bytes in front of the ids of a record: its number of tokens.
HEAD = 4


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Keyed permutation of 0..size-1: a balanced Feistel network on the next even number of bits; results outside walk on."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    now = once(numbers.astype(np.uint64))
    while (outside := now >= np.uint64(size)).any():
        now[outside] = once(now[outside])
    return now.astype(np.int64)


def _sequences(tokenizer: str, length: int, size: int, shards: int, key: int):
    """Sequences of the joined documents of a task, with permuted numbers and the ids of the documents that begin or go on in each."""

    def run(batches):
        cache = token_cache(tokenizer)
        task = TaskContext.get().partitionId() << ROOM
        made, held, spans, size_held = 0, [], [], 0

        def cut(last: bool):
            nonlocal made, held, spans, size_held
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint16)
            count = -(-len(ids) // length) if last else len(ids) // length
            ends = np.cumsum([n for _, n in spans])
            records, docs, tokens = [], [], []
            for k in range(count):
                own = ids[k * length : (k + 1) * length]
                first, stop = np.searchsorted(ends, k * length, side="right"), np.searchsorted(ends, k * length + len(own), side="left")
                docs.append([spans[i][0] for i in range(first, stop + 1)])
                tokens.append(len(own))
                records.append(own.tobytes())
            numbers = task + made + np.arange(count)
            made += count
            used = min(count * length, len(ids))
            keep = int(np.searchsorted(ends, used, side="right"))
            if keep < len(spans):
                spans = [(spans[keep][0], int(ends[keep] - used)), *spans[keep + 1 :]]
            else:
                spans = []
            held, size_held = ([ids[used:]], len(ids) - used) if used < len(ids) else ([], 0)
            if not count:
                return None
            place = feistel(numbers, size, key)
            shard = np.array([int(p) * shards // size for p in place.tolist()], dtype=np.int64)
            return record_batch(
                "shard place number n_tokens doc_ids ids", shard, place, numbers, pa.array(tokens, pa.int64()),
                pa.array(docs, pa.list_(pa.int64())), pa.array(records, pa.binary()),
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1).to_pylist()), strict=True):
                own = np.append(ids, END_ID).astype(np.uint16)
                held.append(own)
                spans.append((doc_id, len(own)))
                size_held += len(own)
                if size_held > 500_000 and (out := cut(False)) is not None:
                    yield out
        if size_held and (out := cut(True)) is not None:
            yield out

    return run


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(folder: str, length: int):
    """Write each shard under a name of this attempt, then rename it: a repeated task puts the same file in its place."""

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for table in groups(batches, 1):
            shard = table.column(0)[0].as_py()
            name = f"{base}/shard-{shard:06d}.bin"
            crcs = []
            with store.open_output_stream(f"{name}.{attempt}") as out:
                for n, ids in zip(table.column("n_tokens").to_pylist(), table.column("ids").to_pylist(), strict=True):
                    out.write(np.array([n], dtype="<u4").tobytes() + ids.ljust(2 * length, b"\0"))
                    crcs.append(zlib.crc32(ids))
            store.move(f"{name}.{attempt}", name)
            yield record_batch(
                "shard record number n_tokens doc_ids ids_crc32", table.column(0).combine_chunks(), np.arange(table.num_rows),
                table.column("number").combine_chunks(), table.column("n_tokens").combine_chunks(),
                table.column("doc_ids").combine_chunks(), pa.array(crcs, pa.int64()),
            )

    return run


def write_training_order(
    docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    key: int = 20_240_601, shards: int | None = None,
) -> DataFrame:
    """Write the shards to `folder`; (slot, shard, record, byte_offset, number, n_tokens, doc_ids, ids_crc32) for every sequence.

    Documents of a task are joined, each closed by one end id, and cut into sequences of `length` 16-bit ids; the last of a
    task may be shorter and is filled with zeros, so no token is lost. A record is its token count (4 bytes) and the ids,
    little endian. Null and empty texts are one end id, null ids stay null in doc_ids, repeated rows are written each,
    other columns don't matter. An empty table writes no shard and gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tasks = max(1, rows.rdd.getNumPartitions())
    size = tasks << ROOM
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = "shard long, place long, number long, n_tokens long, doc_ids array<long>, ids binary"
    cut = rows.mapInArrow(_sequences(tokenizer, length, size, shards, key), layout)
    # shards are equal ranges of permuted numbers, so each task gets one of them and nothing is sampled
    laid = cut.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "place")
    written = cut_lineage(
        laid.mapInArrow(_write(folder, length), "shard long, record long, number long, n_tokens long, doc_ids array<long>, ids_crc32 long")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = written.groupBy("shard").count().select("shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    return written.join(first, "shard").select(
        (F.col("first_slot") + F.col("record")).alias("slot"), "shard", "record",
        (F.col("record") * (HEAD + 2 * length)).alias("byte_offset"), "number", "n_tokens", "doc_ids", "ids_crc32",
    )


def read_slots(folder: str, shard: int, record: int, count: int, length: int = LENGTH) -> list[np.ndarray]:
    """Ids of `count` records of a shard from `record` on, by one sequential read: the way to go on after a stop."""
    store, base = _open(folder)
    stride = HEAD + 2 * length
    with store.open_input_file(f"{base}/shard-{shard:06d}.bin") as file:
        file.seek(record * stride)
        data = file.read(count * stride)
    rows = [data[k : k + stride] for k in range(0, len(data), stride)]
    return [np.frombuffer(r, dtype="<u2", offset=HEAD)[: int(np.frombuffer(r[:HEAD], dtype="<u4")[0])] for r in rows]
