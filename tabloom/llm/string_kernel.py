"""Toxicity by a support vector machine on a string kernel.

Words are compared by their common subsequences of three characters, gaps allowed: a subsequence counts the less the more
characters lie inside it, so `idxiot` stays close to `idiot`; characters other than letters and digits are no part of a word, so
`id-iot` and `i d i o t` are `idiot`. The kernel of two words is normalised and raised to a power; that of two sentences is the
sum over their different words. It is mapped to numbers by Nystroem's method: the kernel with a
few landmark words, whitened by the landmarks' own kernel matrix.

Labels are of documents, insults of sentences. So the sentences of clean documents are trained on as clean, and of each
toxic one the sentences that the machine finds toxic, chosen anew in every round. One sentence of each document is trained on a
few times more with a character inserted in each word. A document scores as its worst sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import record_batch
from tabloom.session import cut_lineage

#: Documents of each label that the model is fitted on, at most; sentences of each of them, at most.
SAMPLE = 2000
SENTENCES = 10
#: Landmark words, at most: words that tell labels apart, and the commonest ones.
TELLING = 120
COMMON = 40
#: Characters that a subsequence may span, its weight by each character inside it, and the power of the word kernel.
SPAN = 6
DECAY = 0.8
POWER = 3
#: Words of a sentence, at most; a longer one is several. Characters of a word, at most; a longer one is several.
SENTENCE_WORDS = 12
WORD_CHARS = 40
ROUNDS = 6
#: Log odds of a word above which its sentences count as toxic in the first round.
TELLING_WEIGHT = 1.5
PENALTY = 1e-4
#: Altered copies of a sentence of each document.
ALTERED = 3
#: Words whose scores a task keeps.
KEPT_WORDS = 1_000_000
#: Characters of text that are worked on at once.
SLICE_CHARS = 1_000_000

_END = re.compile(r"[.!?]\s+|[\n\r]+")
_EDGES = ".,;:!?()[]|\"'-*"
_NO_WORD = re.compile(r"[\W_]+")


def sentences(text: str | None) -> Iterator[list[str]]:
    """Different words of each sentence of a text, lower-cased, of letters and digits only (a word without any stays as it is).

    Three or more single characters in a row are one word.
    """
    for part in _END.split((text or "").lower()):
        tokens = [t if t.isalnum() else _bare(t) for t in part.split()]
        if not tokens:
            continue
        sizes = list(map(len, tokens))
        if max(sizes) > WORD_CHARS or sizes.count(1) > 2:
            tokens = _joined(tokens)
        held = list(dict.fromkeys(tokens))
        for a in range(0, len(held), SENTENCE_WORDS):
            yield held[a : a + SENTENCE_WORDS]


def _bare(token: str) -> str:
    inner = token.strip(_EDGES)
    return inner if inner.isalnum() else _NO_WORD.sub("", inner) or token


def _joined(tokens: list[str]) -> Iterator[str]:
    """Words of a sentence with runs of single characters or overlong words."""
    for short, run in groupby(tokens, key=lambda t: len(t) == 1):
        held = list(run)
        if short:
            yield from ["".join(held)] if len(held) > 2 else held
            continue
        for word in held:
            if len(word) > WORD_CHARS:
                yield from (word[a : a + WORD_CHARS] for a in range(0, len(word), WORD_CHARS // 2))
            else:
                yield word


def inserted(word: str, salt: int) -> str:
    """The word with one letter inserted, both chosen by a checksum of the word."""
    told = zlib.crc32(word.encode("utf-8", "surrogatepass"), salt)
    at = 1 + told % max(1, len(word) - 1)
    return word[:at] + chr(97 + (told >> 8) % 26) + word[at:]


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, middle and last places of the subsequences of a marked word of this length, and the characters inside them."""
    found = [
        (first, first + middle, first + last, last - 2)
        for first in range(length) for last in range(2, min(SPAN, length - first)) for middle in range(1, last)
    ]
    return tuple(np.array(c, dtype=np.int64) for c in zip(*found, strict=True))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of the three-character subsequences of each word between its edge marks, each once, word after word."""
    whose, codes, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    decay = DECAY ** np.arange(SPAN)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        marked = "".join("\x02" + words[k] + "\x03" for k in own.tolist()).encode("utf-32-le", "surrogatepass")
        data = np.frombuffer(marked, dtype="<u4").astype(np.int64).reshape(len(own), size + 2) & 0xFFFFF
        if size < 1:
            continue
        first, middle, last, inside = _places(size + 2)
        # 20 bits a character, then the number of characters inside, so equal subsequences lie together
        packed = np.sort((data[:, first] << 43) | (data[:, middle] << 23) | (data[:, last] << 3) | inside, axis=1)
        weight, code = decay[packed & 7], packed >> 3
        same = code[:, 1:] == code[:, :-1]
        again = np.flatnonzero(same.any(axis=1))
        if len(again):
            # occurrences of one subsequence are added up at its last place
            held, part = weight[again], same[again]
            for k in range(part.shape[1]):
                held[:, k + 1] += held[:, k] * part[:, k]
                held[:, k] *= ~part[:, k]
            weight[again] = held
        whose.append(np.repeat(own, code.shape[1]))
        codes.append(code.ravel())
        weights.append(weight.ravel())
    return np.concatenate(whose), np.concatenate(codes), np.concatenate(weights)


def _sieve(codes: np.ndarray) -> np.ndarray:
    """Slot of each code in a table that tells quickly that a code is no landmark's."""
    return ((codes * np.int64(0x9E3779B97F4A7C1)) >> 40) & 0x3FFFF


class Landmarks:
    """Landmark words with their subsequences: for each subsequence the landmarks that have it, with weights of unit length."""

    def __init__(self, words: list[str]):
        self.words = words
        whose, codes, weights = subsequences(words)
        lengths = np.sqrt(np.bincount(whose, weights**2, minlength=len(words)))
        self.codes, place = np.unique(codes, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.marks, self.weights = whose[order], (weights / lengths[whose])[order]
        self.counts = np.bincount(place, minlength=len(self.codes))
        self.starts = np.cumsum(self.counts) - self.counts
        self.sieve = np.zeros(0x40000, dtype=bool)
        self.sieve[_sieve(self.codes)] = True

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark, from 0 to 1."""
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        for begin in range(0, len(words), 2000):
            part = words[begin : begin + 2000]
            whose, codes, weights = subsequences(part)
            lengths = np.sqrt(np.bincount(whose, weights**2, minlength=len(part)))
            hit = np.flatnonzero(self.sieve[_sieve(codes)])
            at = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
            known = self.codes[at] == codes[hit]
            hit, at = hit[known], at[known]
            counts = self.counts[at]
            flat = np.arange(counts.sum()) + np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts)
            value = np.repeat(weights[hit] / lengths[whose[hit]], counts) * self.weights[flat]
            cell = np.repeat(whose[hit] * len(self.words), counts) + self.marks[flat]
            out[begin : begin + len(part)] = np.bincount(cell, value, minlength=len(part) * len(self.words)).reshape(len(part), -1)
        return np.minimum(out, 1) ** POWER

    def sums(self, own: list[list[str]]) -> np.ndarray:
        """For each sentence the kernels of its words with each landmark, added up."""
        words = sorted({w for s in own for w in s})
        place = {w: k for k, w in enumerate(words)}
        kernels, out = self.kernel(words), np.zeros((len(own), len(self.words)), dtype=np.float32)
        for k, s in enumerate(own):
            if s:
                out[k] = kernels[[place[w] for w in s]].sum(axis=0)
        return out


@dataclass
class KernelModel:
    """Landmarks with their weights in a word's score, the intercept of a sentence, and the calibration of a document."""

    landmarks: Landmarks
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def worst(self, texts: list[str | None], kept: dict[str, float]) -> np.ndarray:
        """The highest sentence score of each text; a text without words has the intercept. `kept` holds scores of words."""
        out = np.full(len(texts), self.intercept)
        held: list[tuple[int, list[list[str]]]] = []
        size = 0
        for k, text in enumerate(texts):
            held.append((k, list(sentences(text))))
            size += len(text or "")
            if size > SLICE_CHARS or k == len(texts) - 1:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                fresh = list({w for _, own in held for s in own for w in s} - kept.keys())
                kept.update(zip(fresh, (self.landmarks.kernel(fresh) @ self.weights).tolist(), strict=True))
                for at, own in held:
                    if own:
                        out[at] = self.intercept + max(sum(map(kept.__getitem__, s)) for s in own)
                held, size = [], 0
        return out

    def chance(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


def pick_landmarks(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Landmarks from (word, toxic documents, clean documents): the most telling ones, none close to an earlier one, and common ones."""

    def telling(row):
        word, bad, good = row
        expected = (bad + good) * toxic / max(1, toxic + clean)
        return (bad - expected) / np.sqrt(expected + 1)

    by_weight = [r[0] for r in sorted(counts, key=lambda r: (-telling(r), r[0])) if telling(r) > 2][: 10 * TELLING]
    by_count = [r[0] for r in sorted(counts, key=lambda r: (-r[2], r[0]))][: 10 * COMMON]
    every = [*by_weight, *by_count]
    chosen: list[int] = []
    if every:
        near = Landmarks(every).kernel(every)
        for begin, end, most in ((0, len(by_weight), TELLING), (len(by_weight), len(every), TELLING + COMMON)):
            for k in range(begin, end):
                if len(chosen) < most and not (near[k, chosen] >= 0.7**POWER).any():
                    chosen.append(k)
    return [every[k] for k in chosen]


def _whiten(landmarks: Landmarks) -> np.ndarray:
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.words).astype(np.float64))
    return vectors * (1 / np.sqrt(np.maximum(values, 1e-4)))


def train(points: np.ndarray, sign: np.ndarray, cost: np.ndarray, weights: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights (the last one the intercept) of a linear machine with squared hinge loss, by Newton steps over its support vectors, from given ones on."""
    wide = np.column_stack([points, np.ones(len(points), dtype=points.dtype)])
    ridge = np.eye(wide.shape[1]) * penalty * cost.sum()
    ridge[-1, -1] *= 1e-3
    for _ in range(20):
        inside = sign * (wide @ weights.astype(wide.dtype)) < 1
        own = wide[inside]
        held = own * cost[inside, None].astype(wide.dtype)
        new = np.linalg.solve(ridge + (held.T @ own).astype(np.float64), (held.T @ sign[inside].astype(wide.dtype)).astype(np.float64))
        if np.allclose(new, weights, rtol=1e-4, atol=1e-5):
            break
        weights = new
    return weights


def calibrate(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the chance by a score: logistic regression with a little pull towards even odds."""
    slope, shift = 1.0, 0.0
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * worst + shift, -40, 40)))
        off, curve = p - goal, p * (1 - p) + 1e-9
        grad = np.array([(off * worst).sum() + 1e-3 * slope, off.sum() + 1e-3 * shift])
        hess = np.array([[(curve * worst**2).sum(), (curve * worst).sum()], [(curve * worst).sum(), curve.sum()]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


def fit(landmarks: Landmarks, docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> KernelModel:
    """`docs`: (label, whether altered, sentences by landmark kernel sums, telling weight of each sentence for the first round).

    The chance is calibrated on those that aren't altered.
    """
    whiten = _whiten(landmarks).astype(np.float32)
    toxic = np.array([label == 1 for label, _, _, _ in docs], dtype=bool)
    points = [rows @ whiten for _, _, rows, _ in docs]
    clean = [p for p, bad in zip(points, toxic, strict=True) if not bad]
    # sentences with telling words come first, then those that the machine finds toxic; the worst one always
    chosen = [np.flatnonzero((first > TELLING_WEIGHT) | (first == first.max())) for _, _, _, first in docs]
    weights = np.zeros(len(landmarks.words) + 1)
    if toxic.any() and clean:
        below = np.concatenate(clean)
        for _ in range(ROUNDS):
            above = np.concatenate([p[c] for p, c, bad in zip(points, chosen, toxic, strict=True) if bad])
            share = np.concatenate([np.full(len(c), 1 / len(c)) for c, bad in zip(chosen, toxic, strict=True) if bad])
            cost = np.concatenate([share * 500 / share.sum(), np.full(len(below), 500 / len(below))])
            weights = train(np.concatenate([above, below]), np.repeat([1.0, -1.0], [len(above), len(below)]), cost, weights)
            scores = [p @ weights[:-1] + weights[-1] for p in points]
            again = [np.flatnonzero((s > 0) | (s == s.max())) for s in scores]
            if all(np.array_equal(x, y) for x, y, bad in zip(again, chosen, toxic, strict=True) if bad):
                break
            chosen = again
    worst = np.array([(p @ weights[:-1]).max() + weights[-1] for p in points]) if docs else np.zeros(0)
    plain = np.array([not again for _, again, _, _ in docs], dtype=bool)
    slope, shift = calibrate(worst[plain], toxic[plain])
    return KernelModel(landmarks, (whiten @ weights[:-1]).astype(np.float32), float(weights[-1]), slope, shift)


def crc_of(doc_id):
    """Unsigned CRC-32 of the decimal id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> KernelModel:
    """Fit on at most `sample` documents of each label (1 toxic, 0 clean), picked by a hash of their id, with whole texts.

    Null ids and other labels are left out; a document with both labels counts as toxic, equal texts count once. Without both
    labels every text gets the same score.
    """
    told = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    told = told.groupBy("_id").agg(F.max("_label").alias("_label"))
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    picked = told.filter("_label = 1").orderBy(*by_hash).limit(sample).unionByName(told.filter("_label = 0").orderBy(*by_hash).limit(sample))
    # 2 * `sample` rows of two numbers: small whatever the input
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("_text").agg(F.max("_label").alias("_label"), F.min("_id").alias("_id"))
    rows = cut_lineage(rows.repartition("_id"))

    def words(batches):
        for batch in batches:
            found, labelled = [], []
            for whole, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {w for s in sentences(whole) for w in s}
                found += held
                labelled += [own] * len(held)
            yield record_batch("word label", pa.array(found, pa.string()), pa.array(labelled, pa.int32()))

    bad, good = F.sum("label"), F.sum(1 - F.col("label"))
    counts = rows.select("_text", "_label").mapInArrow(words, "word string, label int").groupBy("word").agg(bad.alias("bad"), good.alias("good"))
    size = rows.agg(F.coalesce(F.sum("_label"), F.lit(0)).alias("toxic"), F.count("*").alias("every")).first()
    toxic, clean = size.toxic, size.every - size.toxic
    counts = counts.filter("bad + good > 2").cache()
    part = toxic / max(1, size.every)
    above = (F.col("bad") - (F.col("bad") + F.col("good")) * part) / F.sqrt((F.col("bad") + F.col("good")) * part + 1)
    telling = [tuple(r) for r in counts.orderBy(above.desc(), "word").limit(10 * TELLING).collect()]
    common = [tuple(r) for r in counts.orderBy(F.col("good").desc(), "word").limit(10 * COMMON).collect()]
    counts.unpersist()
    landmarks = Landmarks(pick_landmarks(sorted({*telling, *common}), toxic, clean) or ["-"])
    weight = {w: np.log((b + 0.5) / (toxic + 1)) - np.log((g + 0.5) / (clean + 1)) for w, b, g in telling}
    shared = docs.sparkSession.sparkContext.broadcast((landmarks, weight))

    def chosen(whole: str, first: dict[str, float]) -> list[list[str]]:
        own = list(sentences(whole)) or [[]]
        if len(own) <= SENTENCES:
            return own
        # those with the most telling words, then spread evenly over the text
        order = sorted(range(len(own)), key=lambda k: -max((first.get(w, 0.0) for w in own[k]), default=0.0))
        return [own[k] for k in sorted({*order[: SENTENCES // 2], *np.linspace(0, len(own) - 1, SENTENCES - SENTENCES // 2).astype(int).tolist()})]

    def features(batches):
        marks, first = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                plain = [chosen(whole, first) for whole in part.column(2).to_pylist()]
                least = [np.array([max((first.get(w, 0.0) for w in s), default=0.0) for s in own], dtype="<f4") for own in plain]
                worst = [own[int(np.argmax(told))] for own, told in zip(plain, least, strict=True)]
                altered = [[inserted(w, salt) for w in s] for s in worst for salt in range(1, ALTERED + 1)]
                sums = marks.sums([s for own in plain for s in own] + altered).astype("<f4")
                ends = np.cumsum([len(own) for own in plain])
                rows = [sums[a:b].tobytes() for a, b in zip(np.append(0, ends), ends)]
                yield record_batch(
                    "id label again points least", pa.concat_arrays([part.column(0)] * 2), pa.concat_arrays([part.column(1)] * 2), [0] * len(plain) + [1] * len(plain),
                    pa.array(rows + [row.tobytes() for row in sums[ends[-1] :].reshape(len(plain), -1)], pa.binary()),
                    pa.array([t.tobytes() for t in least] + [np.zeros(ALTERED, dtype="<f4").tobytes()] * len(plain), pa.binary()),
                )

    found = rows.select("_id", "_label", "_text").mapInArrow(features, "id long, label int, again long, points binary, least binary").collect()
    found.sort(key=lambda r: (r.again, r.id))
    model = fit(landmarks, [
        (r.label, r.again, np.frombuffer(r.points, dtype="<f4").reshape(-1, len(landmarks.words)), np.frombuffer(r.least, dtype="<f4")) for r in found
    ])
    rated = told.agg(F.sum("_label").alias("toxic"), F.count("*").alias("every")).first()
    if toxic and clean:
        # the sample holds more toxic documents than the rated rows do
        model.shift += float(np.log(rated.toxic / (rated.every - rated.toxic)) - np.log(toxic / clean))
    return model


def score(docs: DataFrame, model: KernelModel, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name` added, from 0 to 1: how likely the text is toxic. Null and empty texts score as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, float] = {}
        for texts in parts:
            yield pd.Series(shared.value.chance(shared.value.worst(list(texts), kept)))

    return docs.withColumn(name, rate(F.col(text)))
