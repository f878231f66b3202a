"""Cases that lost something once: chains of long texts, leaves that weigh nothing, very large numbers."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import mixing, multi_index, ngram_join


def test_unrelated_sets_of_any_size_fail_the_bound():
    rng = np.random.default_rng(1)
    for size in (100, 255, 511, 513, 2000, 3500, 4095, 15_000, 20_000):
        sets = [np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for _ in range(12)]
        assert not ngram_join.tree_links([ngram_join.point_of(s) for s in sets], np.array([len(s) for s in sets]))


def test_linked_sets_of_neighbouring_widths_pass_the_bound():
    rng = np.random.default_rng(2)
    for size in (255, 256, 257, 1023, 4100, 16_385):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.sort(rng.choice(a, int(len(a) * 0.76), replace=False))
        assert ngram_join.tree_links([ngram_join.point_of(a), ngram_join.point_of(b)], np.array([len(a), len(b)]))


def test_a_chain_of_long_texts_is_no_class(spark):
    """Each text shares a phrase with the next; no two are similar, but for one pair."""
    texts = []
    for k in range(24):
        own = [f"t{k}w{j}x{j * 7919 % 1013}" for j in range(6000)]
        texts.append(" ".join(own[:3000] + [f"phrase{k}of{j}" for j in range(12)] + own[3000:] + [f"phrase{k - 1}of{j}" for j in range(12)]))
    texts.append(texts[3] + " and a tail")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {**{k: k for k in range(24)}, 24: 3}


def test_classes_are_cut_by_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", 2000)
    base = [f"w{j}" for j in range(400)]
    texts = [" ".join(base[:k] + [f"n{k}"] + base[k + 1 :]) for k in range(0, 400, 10)] + [" ".join(f"o{j}" for j in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {**{k: 0 for k in range(40)}, 40: 40}


def plain_share(tree, budget):
    """Water filling, one family after the other: `tree` maps a name to (weight, subtree or room)."""

    def room(node):
        weight, below = node
        if not weight or weight < 0:
            return 0
        return sum(map(room, below.values())) if isinstance(below, dict) else below

    def walk(children, given, path, out):
        given = min(given, sum(map(room, children.values())))
        shares, open_ = {}, {n: c for n, c in children.items() if room(c) > 0}
        while open_:
            rate = given / sum(c[0] for c in open_.values())
            full = {n: c for n, c in open_.items() if room(c) <= rate * c[0] * (1 + 1e-12)}
            if not full:
                shares |= {n: rate * c[0] for n, c in open_.items()}
                break
            shares |= {n: room(c) for n, c in full.items()}
            given -= sum(room(c) for c in full.values())
            open_ = {n: c for n, c in open_.items() if n not in full}
        for n, (_, below) in children.items():
            if isinstance(below, dict):
                walk(below, shares.get(n, 0), (*path, n), out)
            else:
                out[(*path, n)] = int(shares.get(n, 0) + 1e-6)

    out = {}
    walk(tree, budget, (), out)
    return out


def shared(spark, tree, budget):
    rows = [(d, s, leaf[1], w, leaf[0]) for d, (w, below) in tree.items() for s, leaf in below.items()]
    leaves = spark.createDataFrame(rows, "d string, s string, room long, wd double, ws double").withColumn("own", F.col("room"))
    names = {d: w for d, (w, _) in tree.items()}
    leaf = {(d, s): v[0] for d, (_, below) in tree.items() for s, v in below.items()}

    def pick(told, key):
        out = F.lit(None).cast("double")
        for name, weight in told.items():
            if weight is not None:
                out = F.when(key(name), F.lit(float(weight))).otherwise(out)
        return out

    found = mixing.share_out(
        leaves, ["d", "s"],
        [pick(names, lambda n: F.col("d") == n), pick(leaf, lambda n: (F.col("d") == n[0]) & (F.col("s") == n[1]))], F.lit(budget),
    )
    return {(r.d, r.s): r.target for r in found.collect()}


def test_leaves_that_weigh_nothing_hold_no_budget(spark):
    tree = {"a": (1.0, {"x": (0.0, 100), "y": (1.0, 10)}), "b": (1.0, {"z": (1.0, 200)})}
    assert shared(spark, tree, 100) == {("a", "x"): 0, ("a", "y"): 10, ("b", "z"): 90}
    odd = {"a": (None, {"x": (1.0, 50)}), "b": (-2.0, {"y": (1.0, 50)}), "c": (3.0, {"z": (None, 70), "w": (2.0, 30)}), "d": (1.0, {"v": (1.0, 5)})}
    assert shared(spark, odd, 100) == {("a", "x"): 0, ("b", "y"): 0, ("c", "z"): 0, ("c", "w"): 30, ("d", "v"): 5}


def test_shares_follow_the_walk(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        tree = {
            f"d{k}": (float(rng.integers(0, 4)), {f"s{j}": (float(rng.integers(0, 4)), int(rng.integers(1, 500))) for j in range(int(rng.integers(1, 6)))})
            for k in range(5)
        }
        budget = int(rng.integers(1, 3000))
        assert shared(spark, tree, budget) == plain_share(tree, budget)


def test_vectors_of_large_and_small_numbers(spark):
    rows = [(1, [1e60, 0.0]), (2, [1e60, 1e59]), (3, [1e-300, 0.0]), (4, [0.0, 1e-300]), (5, [float("inf"), 1.0]), (6, [3e38, 3e37])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(vectors).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (0, 5), 6: (3, 1)}
