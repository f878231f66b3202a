"""The string kernel against its definition, and toxicity on rows that the model was not fitted on."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import string_kernel as sk
from tabloom.llm.queries import QUERIES


def plain_features(word):
    told, out = "\x02" + word + "\x03", {}
    for places in itertools.combinations(range(len(told)), 3):
        span = places[2] - places[0] + 1
        if span <= sk.SPAN:
            name = "".join(told[p] for p in places)
            out[name] = out.get(name, 0) + sk.DECAY ** (span - 3)
    return out


def plain_kernel(a, b):
    a, b = plain_features(a), plain_features(b)
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    return (dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))) ** sk.POWER


WORDS = ["idiot", "idxiot", "a", "ab", "aaaaaaa", "日本語", "naïve", "x" * 40, "mormon", "moron"]


def test_kernel_is_the_sum_over_common_subsequences():
    marks = sk.Landmarks(["idiot", "moron", "aaa", "日本"])
    got = marks.kernel(WORDS)
    for k, word in enumerate(WORDS):
        for j, mark in enumerate(marks.words):
            assert got[k, j] == pytest.approx(plain_kernel(word, mark), abs=1e-5)
    assert marks.kernel([]).shape == (0, 4)


def test_sentences():
    assert list(sk.sentences("You I-d.i o t! An ID-iot\nhere")) == [["you", "idi", "o", "t"], ["an", "idiot"], ["here"]]
    assert list(sk.sentences("a b c d ef. \n\n")) == [["abcd", "ef"]]
    assert list(sk.sentences(None)) == list(sk.sentences(" \n ")) == []
    assert list(sk.sentences("the the The")) == [["the"]]
    long = list(sk.sentences(" ".join(f"w{k}" for k in range(100)) + " " + "y" * 100))
    assert max(map(len, long)) <= sk.SENTENCE_WORDS and all(len(w) <= sk.WORD_CHARS for s in long for w in s)


def test_machine_finds_the_least_loss():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 4))
    sign = np.where(points[:, 0] + 0.3 * rng.normal(size=300) > 0.2, 1.0, -1.0)
    cost = np.ones(300)
    weights = sk.train(points, sign, cost, np.zeros(5))

    def loss(w):
        off = np.maximum(0, 1 - sign * (points @ w[:-1] + w[-1]))
        return (off**2).sum() + sk.PENALTY * cost.sum() * ((w[:-1] ** 2).sum() + 1e-3 * w[-1] ** 2)

    for k in range(5):
        for step in (-1e-2, 1e-2):
            moved = weights.copy()
            moved[k] += step
            assert loss(moved) > loss(weights)


INSULTS = ["grobvex", "zilpang", "mookter"]


def made_docs(count, seed):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("aeioubdlnrst"), int(rng.integers(2, 8)))) for _ in range(400)]
    rows = []
    for k in range(count):
        words = rng.choice(plain, int(rng.integers(5, 120))).tolist()
        bad = k % 4 == 0
        if bad:
            words[int(rng.integers(0, len(words)))] = INSULTS[k // 4 % 3]
        rows.append((k, " ".join(words) + ".", int(bad)))
    return rows


def test_toxic_words_with_gaps_and_insertions(spark):
    rows = made_docs(600, 1)
    odd = [(1000, None, 0), (1001, "", 1), (1002, "same text here", 0), (1003, "same text here", 0), (1004, "bad id", None), (1004, "bad id", 0)]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t, _ in rows + odd[:-1]], "doc_id long, text string, _label string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows[:450] + odd] + [(None, 1, 1), (3, 7, 0)], "doc_id long, toxic int, quality int")
    model = sk.fit_on(docs, labels)
    got = {r.doc_id: r.score for r in sk.score(docs, model).collect()}
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for s in got.values())
    held = rows[450:]
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in held)
    assert got[1000] < 0.5 and got[1000] == got[1001]
    more = spark.createDataFrame(
        [(0, f"{held[1][1]} what a grob-vex"), (1, f"{held[2][1]} z i l p a n g"), (2, "some mooxkter there"), (3, "nothing tart here " * 3000 + "zilpang"), (4, "nothing tart here " * 3000)],
        "doc_id long, text string",
    )
    found = [r.score for r in sk.score(more, model).orderBy("doc_id").collect()]
    assert found[0] >= 0.5 and found[1] >= 0.5 and found[3] >= 0.5 > found[4]
    # a letter inside a telling word leaves most of its weight
    assert found[2] > 3 * found[4]
    again = sk.fit_on(docs, labels)
    assert np.array_equal(again.weights, model.weights) and again.shift == model.shift


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for told in (labels, labels.limit(0)):
        scores = [r.score for r in sk.score(docs, sk.fit_on(docs, told)).collect()]
        assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    assert sk.score(docs.limit(0), sk.fit_on(docs, labels)).count() == 0


def test_held_out_rows_of_the_tables(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    found = QUERIES["op12_toxicity"](spark, folder)
    told = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").distinct()
    rows = found.filter("held_out").join(told, "doc_id").select("predicted", "toxic").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert len(rows) > 50 and right > 0.93
    assert found.filter(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
