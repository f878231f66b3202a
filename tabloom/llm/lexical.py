"""Ranked search over an index of blocked posting lists.

The index is cut into segments of documents. Inside a segment the posting list of each term is clustered by the similarity of
its documents into blocks, and a block keeps the largest impact of each coordinate over its documents. A sum of the asked
weights times those maxima bounds the score of every document of the block, so a block is skipped only if no document
of it can be among the best.

A document is looked for in the list of the rarest term that it shares with an item. So the summary of a block needs only
coordinates that come after its own term in the order of rarity, and only those that some item asks for beside that term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import record_batch
from tabloom.operators.skew import top_per_key
from tabloom.session import cut_lineage

#: Documents, postings, and documents times asked terms of a segment, at most (a longer document is a segment of its own).
SEGMENT_DOCS = 4096
SEGMENT_POSTINGS = 250_000
SEGMENT_CELLS = 1 << 25
#: Documents of a block, at most.
BLOCK = 64
#: Blocks that are looked into before the threshold is raised again.
STEP = 8
#: Items that are answered in one pass over the index. More items take more passes.
ITEMS = 2000
#: Segments that give the first threshold. It is a bound from below, so any number gives the same result.
FIRST_SEGMENTS = 4
SCALE = 1_000_000_000
_PIECE = 1 << 20

_TERM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size: runs of digits, letters and bytes outside ASCII, with only A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + _PIECE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def count_terms(text: str | None) -> tuple[int, Counter]:
    """Number of terms with repeats, and how often each occurs."""
    total, found = 0, Counter()
    for part in terms_of(text):
        total += len(part)
        found.update(part)
    return total, found


@dataclass
class Asked:
    """Items as arrays: their terms, by number in the order of rarity, and for each term the coordinates its summaries keep."""

    ids: list
    terms: list[np.ndarray]
    weights: np.ndarray
    beside: list[np.ndarray]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term) of the items, each pair once. Rows of one id are one item."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for item, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set()
                for part in terms_of(told):
                    own.update(part)
                ids += [item] * len(own)
                terms += own
            yield record_batch("item_id term", pa.array(ids, pa.int64()), pa.array(terms, pa.binary()))

    return items.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(run, "item_id long, term binary").distinct()


def forward_rows(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row that has a term: its number of terms, and which of the vocabulary it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches):
        known = shared.value
        for batch in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for doc, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, found = count_terms(told)
                if total:
                    own = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                    ids.append(doc)
                    sizes.append(total)
                    terms.append(np.array([k for k, _ in own], dtype=np.int32))
                    tfs.append(np.array([c for _, c in own], dtype=np.int64))
            yield record_batch("doc_id n terms tfs", pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())))

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a score, before its weight, in whole numbers."""
    length = 100 - 90 + (90 * n * documents) // total
    return (SCALE * tf) // (1000 * tf + 8 * length)


def clusters(points: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Order of the rows in which runs of `size` are similar: by nearest of evenly picked pivots (by cosine), then by likeness to it."""
    if len(points) <= size:
        return np.arange(len(points))
    told = points / np.maximum(np.sqrt((points * points).sum(axis=1, keepdims=True)), 1e-30)
    pivots = told[np.linspace(0, len(points) - 1, -(-len(points) // size)).astype(np.int64)]
    near = told @ pivots.T
    best = near.argmax(axis=1)
    return np.lexsort((-near[np.arange(len(points)), best], best))


_INDEX = "doc_ids array<long>, ends array<int>, terms array<int>, impacts array<int>, lists array<int>, list_ends array<int>, members array<int>, maxima array<long>"


def _segment(rows: list[tuple], asked: Asked) -> pa.RecordBatch:
    """One segment: documents with their impacts, and for each term the members of its list in block order and the blocks' maxima."""
    terms = np.concatenate([r[1] for r in rows]).astype(np.int64)
    values = np.concatenate([r[2] for r in rows])
    lengths = np.array([len(r[1]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    order = np.lexsort((owner, terms))
    by_term, first = np.unique(terms[order], return_index=True)
    bounds = np.append(first, len(order))
    # each coordinate's impacts over the whole segment, one column at a time; a list reads the rows and columns it needs
    place = np.full(len(asked.weights), -1, dtype=np.int64)
    place[by_term] = np.arange(len(by_term))
    dense = np.zeros((len(by_term), len(rows)), dtype=np.int32)
    dense[place[terms], owner] = values
    members, maxima = [], []
    for k, term in enumerate(by_term):
        docs = owner[order[bounds[k] : bounds[k + 1]]]
        beside = asked.beside[term]
        points = np.zeros((len(docs), len(beside)), dtype=np.int32)
        held = place[beside]
        known = held >= 0
        points[:, known] = dense[held[known]][:, docs].T
        ranked = clusters(points.astype(np.float64) * asked.weights[beside])
        members.append(docs[ranked])
        maxima.append(np.maximum.reduceat(points[ranked], np.arange(0, len(docs), BLOCK), axis=0).astype(np.int64).ravel())

    def one(values, kind):
        return pa.array([np.asarray(values)], pa.list_(kind))

    return record_batch(
        "doc_ids ends terms impacts lists list_ends members maxima", pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
        one(np.cumsum(lengths).astype(np.int32), pa.int32()), one(terms.astype(np.int32), pa.int32()), one(values.astype(np.int32), pa.int32()),
        one(by_term.astype(np.int32), pa.int32()), one(bounds[1:].astype(np.int32), pa.int32()),
        one(np.concatenate(members).astype(np.int32), pa.int32()), one(np.concatenate(maxima), pa.int64()),
    )


def build_index(forward: DataFrame, asked: Asked, documents: int, total: int) -> DataFrame:
    """One row per segment, see _INDEX. Documents without an asked term are in no list."""
    shared = forward.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        known = shared.value
        most = max(1, min(SEGMENT_DOCS, SEGMENT_CELLS // len(known.weights)))
        held: list[tuple] = []
        postings = 0
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
            for k, (doc, n) in enumerate(zip(*columns, strict=True)):
                terms = batch.column(2)[k].values.to_numpy()
                own = impact(batch.column(3)[k].values.to_numpy(), np.int64(n), documents, total)
                if held and (len(held) == most or postings + len(terms) > SEGMENT_POSTINGS):
                    yield _segment(held, known)
                    held, postings = [], 0
                held.append((doc, terms, own))
                postings += len(terms)
        if held:
            yield _segment(held, known)

    return forward.filter(F.size("terms") > 0).mapInArrow(run, _INDEX)


def _best(segment: dict, asked: Asked, least: np.ndarray, k: int) -> Iterator[tuple]:
    """(item, doc, score) of the documents of a segment that can be among the k best of an item, whose k-th score is at least `least`."""
    ends, terms, impacts = (segment[c].astype(np.int64) for c in ("ends", "terms", "impacts"))
    starts = np.concatenate([[0], ends[:-1]])
    lists = {int(t): j for j, t in enumerate(segment["lists"])}
    list_ends = segment["list_ends"].astype(np.int64)
    list_starts = np.concatenate([[0], list_ends[:-1]])
    blocks = -(-(list_ends - list_starts) // BLOCK)
    widths = np.array([len(asked.beside[t]) for t in segment["lists"]], dtype=np.int64)
    maxima_ends = np.cumsum(blocks * widths)
    ids = segment["doc_ids"]
    weight = np.zeros(len(asked.weights), dtype=np.int64)
    for item, own in enumerate(asked.terms):
        held = [t for t in own.tolist() if t in lists]
        if not held:
            continue
        weight[own] = asked.weights[own]
        bounds, where = [], []
        for t in held:
            j = lists[t]
            beside = asked.beside[t]
            table = segment["maxima"][maxima_ends[j] - blocks[j] * widths[j] : maxima_ends[j]].reshape(blocks[j], widths[j])
            bounds.append(table @ weight[beside])
            where.append(np.stack([np.full(blocks[j], j), np.arange(blocks[j])], axis=1))
        bound, at = np.concatenate(bounds), np.concatenate(where)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(ends), dtype=bool)
        found_docs, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        threshold = max(1, int(least[item]))
        for begin in range(0, len(order), STEP):
            step = order[begin : begin + STEP]
            step = step[bound[step] >= threshold]
            if not len(step):
                break
            spans = [
                segment["members"][list_starts[j] + b * BLOCK : min(list_starts[j] + (b + 1) * BLOCK, list_ends[j])] for j, b in at[step].tolist()
            ]
            docs = np.unique(np.concatenate(spans))
            docs = docs[~seen[docs]].astype(np.int64)
            if not len(docs):
                continue
            seen[docs] = True
            sizes = ends[docs] - starts[docs]
            base = np.cumsum(sizes) - sizes
            flat = np.arange(sizes.sum()) - np.repeat(base - starts[docs], sizes)
            scores = np.add.reduceat(weight[terms[flat]] * impacts[flat], base)
            keep = scores >= threshold
            found_docs, found = np.concatenate([found_docs, docs[keep]]), np.concatenate([found, scores[keep]])
            if len(found) >= k:
                # equal scores stay, the order by id decides among them later
                kth = np.partition(found, len(found) - k)[len(found) - k]
                threshold = max(threshold, int(kth))
                keep = found >= threshold
                found_docs, found = found_docs[keep], found[keep]
        weight[own] = 0
        if len(found) > k:
            best = sorted(range(len(found)), key=lambda r: (-found[r], ids[found_docs[r]] is None, ids[found_docs[r]] or 0))[:k]
            found_docs, found = found_docs[best], found[best]
        for doc, score in zip(found_docs.tolist(), found.tolist(), strict=True):
            yield item, ids[doc], score


def _search(index: DataFrame, asked: Asked, least: np.ndarray, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((asked, least))

    def run(batches):
        known, bound = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                segment = {
                    name: batch.column(c)[r].as_py() if name == "doc_ids" else batch.column(c)[r].values.to_numpy()
                    for c, name in enumerate(batch.schema.names)
                }
                out = list(_best(segment, known, bound, k))
                if out:
                    item, doc, score = zip(*out, strict=True)
                    yield record_batch("item doc_id score", pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64()))

    found = index.mapInArrow(run, "item int, doc_id long, score long")
    return top_per_key(found, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k rows of `docs` with the highest score above 0 for each item, equal scores by id.

    Null and empty texts have no terms: such documents are found by no item, such items find nothing and give no row. Documents
    without an id come last among equal scores; repeated rows are documents each. Rows of one item id are one item; those
    without id are one item too. Empty tables give an empty table; other columns don't matter.

    The driver holds the asked terms of at most ITEMS items at a time, with one number for each.
    """
    spark = docs.sparkSession
    pairs = cut_lineage(item_terms(items, item_id, text))
    ids = [r[0] for r in pairs.select("item_id").distinct().orderBy("item_id").collect()]
    answers = None
    for begin in range(0, len(ids), ITEMS):
        part = ids[begin : begin + ITEMS]
        number = {item: j for j, item in enumerate(part)}
        # nulls come first in the order
        told = [i for i in part if i is not None]
        inside = F.col("item_id").between(told[0], told[-1]) if told else F.lit(False)
        if None in number:
            inside = inside | F.col("item_id").isNull()
        found = _answer(docs, pairs.filter(inside).collect(), part, number, k, doc_id, text)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return answers


def _answer(docs: DataFrame, told: list, ids: list, number: dict, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({bytes(r.term) for r in told})
    forward = cut_lineage(forward_rows(docs, vocabulary, doc_id, text))
    size = forward.agg(F.count("*"), F.sum("n")).first()
    documents, total = size[0], size[1] or 1
    held = {r.term: r.df for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    df = np.array([held.get(j, 0) for j in range(len(vocabulary))], dtype=np.int64)
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    # rarest first
    place = np.empty(len(vocabulary), dtype=np.int64)
    place[np.argsort(df, kind="stable")] = np.arange(len(vocabulary))
    by_word = {t: j for j, t in enumerate(vocabulary)}
    own: list[list[int]] = [[] for _ in ids]
    for row in told:
        own[number[row.item_id]].append(by_word[bytes(row.term)])
    beside: list[set] = [set() for _ in vocabulary]
    for terms in own:
        terms.sort(key=lambda t: place[t])
        for j, t in enumerate(terms):
            beside[t].update(terms[j:])
    asked = Asked(ids, [np.array(t, dtype=np.int64) for t in own], weights, [np.array(sorted(b), dtype=np.int64) for b in beside])
    index = cut_lineage(build_index(forward, asked, documents, total))
    least = np.zeros(len(ids), dtype=np.int64)
    first = _search(index.limit(FIRST_SEGMENTS), asked, least, k)
    for row in first.filter(F.col("rank") == k).collect():
        least[row.item] = row.score
    names: Column = F.element_at(F.lit(ids).cast("array<long>"), F.col("item") + 1)
    return _search(index, asked, least, k).select(names.alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
