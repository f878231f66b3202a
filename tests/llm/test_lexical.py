"""Ranked search against scores worked out document by document."""

import math
import re

import numpy as np
import pytest

from tabloom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    told = [(doc_id, terms(text)) for doc_id, text in docs]
    told = [(d, t) for d, t in told if t]
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    total, count = sum(len(t) for _, t in told), len(told)
    df = {}
    for _, t in told:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, own in asked.items():
        found = []
        for doc_id, t in told:
            m, score = 100 - 90 + 90 * len(t) * count // total, 0
            for w in own & set(t):
                tf = t.count(w)
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else doc_id, -score))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def found_by(spark, docs, items, k=10):
    left = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, rank int, term string")
    right = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in lexical.search(left, right, k).collect()), key=lambda r: (r[0] is not None, r))


def test_search_of_odd_rows(spark):
    docs = [
        (1, "Apple pear"), (2, "apple, PEAR; apple"), (3, None), (4, ""), (5, " \n\t!"), (6, "É é É pear"), (7, "apple " * 40_000 + "rare"),
        (None, "apple pear"), (8, "Apple pear"), (8, "Apple pear"), (9, "naïve日本 a1 b2"), (10, "rare-pear_apple"),
    ]
    items = [(1, "pear apple"), (2, None), (3, ""), (4, "unknown"), (5, "É naïve日本"), (5, "rare"), (None, "a1"), (7, "APPLE apple")]
    assert found_by(spark, docs, items) == plain_search(docs, items, 10)
    assert found_by(spark, docs, items, 2) == plain_search(docs, items, 2)
    assert found_by(spark, [], items) == [] and found_by(spark, docs, []) == [] and found_by(spark, docs[2:5], items) == []


def test_search_of_many_documents(spark):
    rng = np.random.default_rng(4)
    chance = 1 / np.arange(1, 401)
    draw = lambda n: " ".join(f"w{w}" for w in rng.choice(400, n, p=chance / chance.sum()))
    docs = [(k, draw(int(rng.integers(1, 60)))) for k in range(5500)] + [(90_000 + k, "w1 w2 w3 w300 w301") for k in range(900)]
    items = [(k, draw(12)) for k in range(15)] + [(50, "w1 w2 w3 w300 w301")]
    assert found_by(spark, docs, items) == plain_search(docs, items, 10)


def test_items_in_several_passes(spark, monkeypatch):
    docs = [(k, f"a{k % 7} b{k % 5} c{k % 3}") for k in range(60)]
    items = [(None, "a1")] + [(k, f"a{k % 7} c{k % 3}") for k in range(9)]
    monkeypatch.setattr(lexical, "ITEMS", 4)
    assert found_by(spark, docs, items) == plain_search(docs, items, 10)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_skip(seed):
    """Every block's bound is at least the score of each of its documents, and the search leaves blocks out."""
    rng = np.random.default_rng(seed)
    count = 3000
    rows = []
    for k in range(count):
        own = np.unique(np.concatenate([rng.integers(0, 40, 8) + 40 * int(rng.integers(0, 5)), rng.integers(0, 200, 4)])).astype(np.int32)
        rows.append((k, own, rng.integers(1, 100_000, len(own))))
    held = np.bincount(np.concatenate([r[1] for r in rows]), minlength=200)
    place = np.argsort(np.argsort(held, kind="stable"), kind="stable")
    weights = np.floor(1000 * np.log((2.0 * count + 2) / (2.0 * held + 1))).astype(np.int64)
    item = sorted(rng.choice(200, 9, replace=False).tolist(), key=lambda t: place[t])
    beside = [np.zeros(0, dtype=np.int64)] * 200
    for j, t in enumerate(item):
        beside[t] = np.array(sorted(item[j:]), dtype=np.int64)
    asked = lexical.Asked([1], [np.array(item)], weights, beside)
    batch = lexical._segment(rows, asked)
    segment = {n: batch.column(c)[0].as_py() if n == "doc_ids" else batch.column(c)[0].values.to_numpy() for c, n in enumerate(batch.schema.names)}
    want = []
    for doc, own, values in rows:
        score = sum(int(weights[t]) * int(v) for t, v in zip(own.tolist(), values.tolist()) if t in item)
        if score:
            want.append((-score, doc))
    got = list(lexical._best(segment, asked, np.zeros(1, dtype=np.int64), 10))
    assert [(-s, d) for _, d, s in sorted(got, key=lambda r: (-r[2], r[1]))] == sorted(want)[:10]
    low = list(lexical._best(segment, asked, np.array([-sorted(want)[9][0]]), 10))
    assert sorted(low) == sorted(got)
    # clustering: runs of 64 of a list are closer to each other than runs of the list as it lies
    points = np.concatenate([rng.normal(size=(1, 12)) * 9 + rng.normal(size=(200, 12)) for _ in range(6)])[rng.permutation(1200)]
    spread = lambda p: sum(p[a : a + 64].std(axis=0).sum() for a in range(0, 1200, 64))
    assert spread(points[lexical.clusters(points)]) < 0.8 * spread(points)
