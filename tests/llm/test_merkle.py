"""The dataset manifest against a plain tree, built and proved leaf by leaf."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tabloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, digest string, tree int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h([field(row[0]), field(row[3]), field(row[2]), field(row[4]), field(text)])


def tree_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield at % 3, run[: at % 3] + run[at % 3 + 1 :]
        at //= 3


def plain_manifest(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        held = sorted(by_source[source], key=lambda r: (first(r[0]), leaf_of(r, r[1])))
        trees.append((held, tree_levels([leaf_of(r, r[1]) for r in held])))
    top = tree_levels([levels[-1][0] for _, levels in trees])
    out = []
    for t, (held, levels) in enumerate(trees):
        for at, row in enumerate(held):
            steps = [*siblings(levels, at), *siblings(top, t)]
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of(row, text)
            for digit, others in steps:
                node = h([*others[:digit], node, *others[digit:]])
            proof = h([x for _, others in steps for x in others])
            out.append((row[0], levels[0][at], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=lambda r: (first(r[0]), r[1]))


def manifest_of(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, {"text": merkle.without_line_ends(F.col("doc_id"), F.col("text"))}).collect()
    return sorted((tuple(r) for r in found), key=lambda r: ((r[0] is not None, r[0] or 0), r[1]))


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 7, "clash", 1)


def test_manifest_of_odd_rows(spark):
    rows = [
        row(1, "one\ntwo"), row(2, "one\ntwo"), row(3, ""), row(4, None), row(5, "é\n日本", "b", None), row(6, "x\n" * 50_000, "b"),
        row(7, "alone\n", None), row(8, "alone\n", "ß"), row(None, "no id\n"), row(None, "no id either\n"), row(9, "tie 1"), row(9, "tie 2"),
        row(10, "twice\n", "c"), row(10, "twice\n", "c"), row(-3, "a:b-c", ""),
    ]
    assert manifest_of(spark, rows) == plain_manifest(rows)
    assert manifest_of(spark, rows[:1]) == plain_manifest(rows[:1])
    every_alone = [row(k, "t\n", f"s{k}") for k in range(5)]
    assert manifest_of(spark, every_alone) == plain_manifest(every_alone)
    assert manifest_of(spark, []) == []


def test_manifest_over_several_segments_and_a_hot_source(spark):
    rows = [row(k * 7 % 9001, f"text\n{k % 11}", "hot" if k % 3 else f"s{k % 5}") for k in range(9001)]
    assert merkle.SEGMENT < sum(r[3] == "hot" for r in rows)
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_many_sources(spark):
    rows = [row(k, "a\nb", f"source {k % 2500:05d}") for k in range(3000)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_height():
    assert [merkle.height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
