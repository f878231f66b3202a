"""Quality by ordinal regression: one weight per hashed feature, and ordered thresholds between the grades.

P(grade <= k) is the logistic of threshold k minus the text's score. The expected grade and the probability of a grade from
a given one on follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import record_batch
from tabloom.llm.shingles import hash_spans, mix, slices

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
BUCKETS = 1 << 20
#: A feature gets a weight if it occurs in so many sampled texts, and for some grade their share at or above it is off the share of
#: all by so many standard errors and by such a part of the standard deviation.
LEAST_TEXTS = 6
LEAST_ERRORS = 3.5
LEAST_SHARE = 0.6
EPOCHS = 120
RATE = 0.5
#: A text is kept if the probability of the highest grade is at least this.
KEEP = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and other bytes of words, 2 ASCII punctuation
_KIND = np.ones(256, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _c in range(33, 127):
    if not chr(_c).isalnum() and chr(_c) != "'":
        _KIND[_c] = 2
_SHAPES = 16
#: Bytes at the beginning of a word that count as its stem.
_STEM = 5


def _shares(flags: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of flagged bytes of each text, as one of _SHAPES steps on a square-root scale."""
    total = np.add.reduceat(np.append(flags, False).astype(np.int64), starts)
    return np.minimum(np.sqrt(total / np.maximum(sizes, 1)) * _SHAPES, _SHAPES - 1).astype(np.uint64)


def features(texts: list[str | None]):
    """Distinct buckets of each text: its words, their stems and runs of punctuation, and steps of what it is made of."""
    for run in slices(texts):
        sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
        raw = np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        kind = _KIND[raw]
        before = np.concatenate([np.zeros(1, dtype=np.int8), kind[:-1]])
        begin, end = np.flatnonzero((kind != before) & (kind > 0)), np.flatnonzero((kind != before) & (before > 0))
        lowered = _LOWER[raw]
        words = hash_spans(lowered, begin, end)
        stems = hash_spans(lowered, begin, np.minimum(end, begin + _STEM)) ^ np.uint64(1)
        bounds = np.concatenate([[0], np.searchsorted(begin, np.cumsum(sizes + 1))])
        shapes = [
            _shares((raw >= 65) & (raw <= 90), starts, sizes), _shares(kind == 2, starts, sizes), _shares(kind == 0, starts, sizes),
            _shares((raw >= 48) & (raw <= 57), starts, sizes), _shares(raw == 10, starts, sizes),
        ]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own, stem = np.unique(words[a:b]), np.unique(stems[a:b])
            repeat = np.uint64((_SHAPES - 1) * len(own) // max(1, b - a))
            steps = np.array([s[k] for s in shapes] + [repeat], dtype=np.uint64) + np.arange(6, dtype=np.uint64) * np.uint64(64)
            yield np.unique(np.concatenate([own, stem, mix(steps + np.uint64(1))]) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class OrdinalModel:
    """Weights of buckets, and thresholds in ascending order, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features(texts)], dtype=np.float64)

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every text and threshold."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = EPOCHS, decay: float = 1e-5, seed: int = 3) -> OrdinalModel:
    """Mini-batch AdaGrad on the likelihood of the grades; thresholds are a first one and positive steps, so they stay ordered."""
    weights = np.zeros(BUCKETS, dtype=np.float64)
    shares = np.cumsum(np.bincount(grades, minlength=levels)[:-1] + 1) / (len(grades) + levels)
    base = np.log(shares / (1 - shares))
    first, steps = base[0], np.log(np.maximum(np.diff(base), 1e-3))
    if len(rows):
        every = np.concatenate(rows)
        texts = np.bincount(every, minlength=BUCKETS)
        told = np.zeros(BUCKETS, dtype=bool)
        lengths = [len(r) for r in rows]
        for level in range(1, levels):
            above = (grades >= level).astype(np.float64)
            off = np.abs(np.bincount(every, np.repeat(above - above.mean(), lengths), minlength=BUCKETS))
            told |= (off >= LEAST_ERRORS * above.std() * np.sqrt(texts)) & (off >= LEAST_SHARE * above.std() * texts)
        told &= texts >= LEAST_TEXTS
        rows = [r[told[r]] for r in rows]
    power, power_t = np.full(BUCKETS, 1e-6), np.full(levels - 1, 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
            lengths = np.array([len(rows[k]) for k in part])
            flat = np.concatenate([rows[k] for k in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            score = np.bincount(owner, weights[flat], minlength=len(part))
            edges = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
            below = 1 / (1 + np.exp(-np.clip(edges[None] - score[:, None], -50, 50)))
            cdf = np.concatenate([np.zeros((len(part), 1)), below, np.ones((len(part), 1))], axis=1)
            y = grades[part]
            k = np.arange(len(part))
            chance = np.maximum(cdf[k, y + 1] - cdf[k, y], 1e-9)
            slope = cdf * (1 - cdf)
            # derivative of -log(chance): by the score, and by each threshold
            by_score = (slope[k, y + 1] - slope[k, y]) / chance
            by_edge = np.zeros((len(part), levels - 1))
            inner = y < levels - 1
            by_edge[k[inner], y[inner]] -= (slope[k, y + 1] / chance)[inner]
            inner = y > 0
            by_edge[k[inner], y[inner] - 1] += (slope[k, y] / chance)[inner]
            touched, place = np.unique(flat, return_inverse=True)
            grad = np.bincount(place, by_score[owner], minlength=len(touched)) / len(part) + decay * weights[touched]
            power[touched] += grad**2
            weights[touched] -= RATE * grad / np.sqrt(power[touched])
            g = by_edge.mean(axis=0)
            tail = np.cumsum(g[::-1])[::-1]
            g = np.concatenate([[tail[0]], tail[1:] * np.exp(steps)])
            power_t += g**2
            move = RATE * g / np.sqrt(power_t)
            first, steps = first - move[0], np.maximum(steps - move[1:], -7)
    return OrdinalModel(weights.astype(np.float32), first + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def fit_on(docs: DataFrame, ratings: DataFrame, levels: int, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most `sample` rated documents, picked by a hash of their id. `ratings`: (doc_id, grade from 0 to levels - 1).

    Null ids and grades, and grades out of range, are left out; several grades of a document count as its lowest. Without any
    rating the weights are zero.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("_id"), F.col("grade").cast("int").alias("_grade"))
    rated = rated.filter(F.col("_id").isNotNull() & F.col("_grade").between(0, levels - 1))
    picked = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # `sample` rows of two numbers: small whatever the input
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")

    def buckets(batches):
        for batch in batches:
            found = [f.tobytes() for f in features(batch.column(2).to_pylist())]
            yield record_batch("id grade buckets", batch.column(0), batch.column(1), pa.array(found, pa.binary()))

    found = texts.select("_id", "_grade", "_text").mapInArrow(buckets, "id long, grade int, buckets binary")
    # copies would count as evidence again and again: texts of the same features count once, with their lowest grade
    one = found.groupBy("buckets").agg(F.min("grade").alias("grade"), F.min("id").alias("id")).select("id", "grade", "buckets").orderBy("id").collect()
    return fit([np.frombuffer(r[2], dtype=np.int32) for r in one], np.array([r[1] for r in one], dtype=np.int64), levels)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: float = KEEP) -> DataFrame:
    """`docs` with expected_grade, top_probability and keep added after its own columns, which stay as they are.

    Null and empty texts are scored as texts without words. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected_grade double, top_probability double>")
    def rate(texts: pa.Array) -> pa.Array:
        below = shared.value.at_most(shared.value.scores(texts.to_pylist()))
        return pa.StructArray.from_arrays(
            [pa.array((1 - below).sum(axis=1)), pa.array(1 - below[:, -1])], names=["expected_grade", "top_probability"]
        )

    rated = docs.withColumn("_rated", rate(F.col(text)))
    top: Column = F.col("_rated.top_probability")
    return rated.withColumns({
        "expected_grade": F.col("_rated.expected_grade"), "top_probability": top, "keep": top >= keep,
    }).drop("_rated")


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 low quality, 1 toxic, 2 neither."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return labels.filter("quality is not null or toxic is not null").select(
        "doc_id", F.when(low, 0).when(toxic, 1).otherwise(2).alias("grade")
    )
