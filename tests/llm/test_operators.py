"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import (
    bloom_cascade, chat_format, components, license_scan, mixing, multi_index, ngram_join, order_minhash, packing, quality_model,
    training_order,
)
from tabloom.llm.queries import domain_of, mixed, tokenizer_path
from tabloom.llm.tokens import TokenCache

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, id string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", f"src{k % 5}", len(t or ""), k, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


BASE = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    BASE, BASE.upper(), BASE + " end", BASE.replace("word7 ", "other "), None, "", " \n\t ", "two words", "Two  WORDS", "a b c d e",
    LONG, LONG + " tail", "x " * 500, "x " * 40, "né ü ß — 日本 " * 9, "a<|endoftext|>b don't, it's ('s!)",
]


def shingles(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    if len(words) < 5:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_join_is_exact(spark):
    docs = documents(spark, [*TEXTS, "no id"], [*range(len(TEXTS)), None])
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    got = ngram_join.jaccard_components(docs).collect()
    sets = {k: shingles(t) for k, t in enumerate(TEXTS)}
    linked = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = classes(sets, linked)
    assert len(got) == len(TEXTS) + 2
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), want[row.doc_id])
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for _ in range(300):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            own[at] = f"n{rng.integers(0, 9)}"
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = classes(range(300), linked)
    old, ngram_join.CELL = ngram_join.CELL, 64
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, texts)).collect()}
    finally:
        ngram_join.CELL = old
    assert got == want


def test_tree_bound_never_loses_a_pair():
    rng = np.random.default_rng(2)
    for size in (3, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 1 << 60, max(1, size // 20)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 175 * shared >= ngram_join.enough(len(a), len(b)):
            assert ngram_join.tree_links([ngram_join.point_of(a), ngram_join.point_of(b)], np.array([len(a), len(b)]))


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200), (None, 3), (5, 5)], "x long, y long")
    got = {r.id: r.root for r in components.connected_components(links, "x", "y").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100}
    assert components.connected_components(links.limit(0), "x", "y").count() == 0


def test_fingerprints_follow_texts_and_edits(spark):
    docs = documents(spark, TEXTS, [5 * k for k in range(len(TEXTS))])
    got = {r.doc_id: r for r in order_minhash.fingerprint_edits(docs).collect()}
    texts = [t or "" for t in TEXTS]
    for k, text in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)], len(text) // 2
        row = got[5 * k]
        edited = text[: len(text) - half] + after[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert got[20].fingerprint == got[25].fingerprint == "" and got[20].near_next == 1
    assert got[50].near_next > 0.9 and got[5].near_next < 1
    assert order_minhash.fingerprint_edits(docs.limit(0)).count() == 0
    repeated = docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert order_minhash.fingerprint_edits(repeated).count() == 2 * len(TEXTS)


def test_order_minhash_by_hand(spark):
    words = [f"v{k}" for k in range(200)]
    swapped = words[100:] + words[:100]
    docs = documents(spark, [" ".join(words), " ".join(swapped), " ".join(words[:100] * 2)])
    prints = docs.select(order_minhash.fingerprint(F.col("text")).alias("p"))
    a, b, c = (r.p for r in prints.collect())
    same_tuples = len(set(a) & set(b)) / len({x >> 32 for x in a} | {x >> 32 for x in b})
    assert same_tuples < 0.85, "k-mers are nearly the same, but half of the tuples changed their order"
    assert len(a) <= 64 and len({x >> 32 for x in c}) == len(c)


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "user", "\\0 <turn a>b</turn>\n<next> \\"), (1, 1, "user", ""), (1, 2, "assistant", "x<y>\\1"), (1, 3, "assistant", None),
        (1, 4, None, "z"), (2, None, "assistant", "late"), (2, 0, "us>er", "first"), (None, 0, "user", "q"), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ] + [(9, k, "user" if k % 7 else "assistant", f"t{k}\n") for k in range(900)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(0))
    chats = chat_format.format_chats(turns)
    got = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.learnt_text(F.col("segments")).alias("l"))
    for row in got.collect():
        own = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == row.conv_id)
        )
        assert [(t.role, t.text) for t in row.t] == [(r, x) for _, _, r, x in own]
        assert row.l == "".join(x for _, _, r, x in own if r == "assistant")
    first = chats.filter("conv_id = 3").first()
    assert first.formatted == "<turn user>same<next>same</turn>\n"
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_mix_meets_weights_and_passes_shortage_to_siblings(spark):
    sizes = {("a", "x"): 10, ("a", "y"): 300, ("b", "z"): 400}
    rows = [(k, d, s) for (d, s), n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, d, s) for i, (_, d, s) in enumerate(rows)], "doc_id long, d string, s string").withColumn("text", F.lit("one two"))
    out = mixing.mix(
        docs, {"d": F.col("d"), "s": F.col("s")}, [lambda n: F.lit(1.0), lambda n: F.lit(1.0)], mixing.word_count(F.col("text")), 0.5, 1
    )
    got = {(r.d, r.s): r["count"] for r in out.groupBy("d", "s").count().collect()}
    # 710 words: 355 each domain; x is full at 20 words, its sibling takes the rest
    assert got == {("a", "x"): 10, ("a", "y"): 167, ("b", "z"): 177}
    more = mixing.mix(docs, {"s": F.col("s")}, [lambda n: F.lit(1.0)], mixing.word_count(F.col("text")), 0.9, 40)
    times = {r.s: (r.n, r.m) for r in more.groupBy("s").agg(F.count("*").alias("n"), F.max("epoch").alias("m")).collect()}
    assert times["x"] == (213, 21) and times["y"][0] == 213
    assert more.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0


def test_mix_edges(spark):
    docs = documents(spark, TEXTS).unionByName(documents(spark, TEXTS).withColumn("source", F.lit(None).cast("string")))
    out = mixed(docs, 1.0, 1)
    assert out.columns == [*docs.columns, "epoch"]
    leaf = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w"))
    assert out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).filter("w > 0").count() == leaf.filter("w > 0").count()
    assert mixed(docs.limit(0), 0.5, 2).count() == 0
    assert docs.select(domain_of(F.col("source")).alias("d")).filter("d is null").count() in (0, len(TEXTS))


def test_licences(spark):
    mit = list(license_scan.SENTENCES)[2:5]
    texts = [
        "Intro.\nReleased under the MIT License.\nMore", ". ".join(mit) + ".", "Licensed under the Apache License, Version 2.0. Then text.",
        "This licence is odd.", None, "", "nothing here", LONG + "\nLicensed under CC BY-NC 4.0.", "Released under the MIT License.\n" * 3,
    ]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    assert [got[k].licences for k in range(9)] == [["MIT"], ["MIT"], ["Apache-2.0"], [], [], [], [], ["CC-BY-NC-4.0"], ["MIT"]]
    assert got[3].sentences == ["unknown"] and got[3].unmatched == 1 and got[1].unmatched == 0 and got[0].places == [1]
    assert license_scan.scan(documents(spark, texts).limit(0)).count() == 0


# The notices as licence files and headers carry them, with the sentences that a rule takes: (notice, licence, identifiers).
NOTICES = [
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""", "MIT", ["mit-grant", "mit-notice-kept", "mit-as-is"]),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
   from this software without specific prior written permission.""", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.""", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""", "Apache-2.0", ["apache-notice", "apache-use", "apache-copy", "unknown", "apache-as-is"]),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0", ["apache-notice"]),
    ("Released under the MIT License.", "MIT", ["mit-notice"]),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "GPL-3.0-or-later", ["gpl-3-later"]),
    ("""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", "GPL-2.0-or-later", ["gpl-2-later"]),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", ["gpl-3-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only", ["gpl-2-notice"]),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0", ["cc-by-notice"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0", ["mpl-2-notice"]),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", ["unlicense"]),
]


@pytest.mark.parametrize("width, start, end", [(72, "", "\n"), (76, " * ", "\r\n"), (30, "# ", "\n"), (100_000, "", "\n")])
def test_license_rules_match_their_wrapped_notices(spark, width, start, end):
    def laid(notice):
        lines = [line for part in notice.split("\n\n") for line in [*textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False), ""]]
        return end.join(start + line for line in ["Some program.", *lines, "The end."])

    assert [licence for _, licence in license_scan.RULES] == [licence for _, licence, _ in NOTICES]
    got = license_scan.scan(documents(spark, [laid(notice) for notice, _, _ in NOTICES])).collect()
    for r in got:
        _, licence, ids = NOTICES[r.doc_id]
        assert (r.licences, r.sentences, r.unmatched) == ([licence], ids, 0)


def test_license_sentences_keep_their_places(spark):
    texts = [
        "Intro. This program is free software: you can\nredistribute\nit and/or modify. Odd licence.\nReleased under the\nMIT License.",
        "You may obtain a copy of the License at https://x.org/LICENSE Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
        "See https://x.org/license for the licence.\nhttps://x.org/license\nNot released under the MIT License.", "put in the public\ndomain",
        "Released under the MIT License.\nhttps://x.org/license", "Released under the MIT License.\nOdd licence.\nAll rights\nreserved",
    ]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, texts)).collect()}
    told = [(list(zip(got[k].sentences, got[k].places, strict=True)), got[k].licences, got[k].unmatched) for k in range(len(texts))]
    assert told == [
        ([("unknown", 1), ("unknown", 3), ("unknown", 5), ("mit-notice", 6)], ["MIT"], 3),
        ([("apache-copy", 0), ("unknown", 0), ("apache-as-is", 0)], [], 2),
        ([("unknown", 0), ("unknown", 1), ("unknown", 2)], [], 3),
        ([("unknown", 0)], [], 1),
        ([("mit-notice", 0), ("unknown", 1)], ["MIT"], 1),
        ([("mit-notice", 0), ("unknown", 1), ("reserved", 2)], ["MIT"], 2),
    ]


def test_packing_round_trip(spark):
    docs = documents(spark, [*TEXTS, "again", "again"], [*range(len(TEXTS)), 50, 50])
    got = packing.pack(docs, tokenizer_path()).toPandas()
    encoder = TokenCache(tokenizer_path()).tokenizer
    for k, text in enumerate(TEXTS):
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = got[got.doc_id == k].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096))
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in own.start]
    assert (got.doc_id == 50).sum() == 2
    laid = got.sort_values(["sequence_id", "offset"])
    assert (laid.groupby("sequence_id").length.cumsum() - laid.length == laid.offset).all()
    assert laid.groupby("sequence_id").length.sum().max() <= 4096
    assert laid.sequence_id.nunique() <= math.ceil(laid.length.sum() / 4096) + 2
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_best_fit_is_near_the_bound():
    lengths = np.random.default_rng(3).integers(1, 2000, 5000)
    bins, offsets, used = packing.best_fit(lengths, 4096)
    assert used.max() <= 4096 and used.sum() == lengths.sum() and len(used) <= math.ceil(lengths.sum() / 4096) + 1
    assert (offsets + lengths <= used[bins]).all()


def test_training_order_round_trip(spark, tmp_path):
    docs = documents(spark, TEXTS * 3).repartition(4)
    folder = str(tmp_path / "shards")
    got = training_order.write_training_order(docs, tokenizer_path(), folder, length=64, shards=5).toPandas().sort_values("slot")
    assert got.slot.tolist() == list(range(len(got))) and got.number.is_unique
    read = {r.number: training_order.read_slots(folder, r.shard, r.record, 1, 64)[0] for r in got.itertuples()}
    encoder = TokenCache(tokenizer_path()).tokenizer
    assert sum(map(len, read.values())) == sum(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS * 3)
    assert all(zlib.crc32(read[r.number].astype("<u2").tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert set().union(*got.doc_ids) == set(range(3 * len(TEXTS)))
    assert len(training_order.read_slots(folder, int(got.shard.iloc[0]), 0, 2, 64)) == 2
    assert training_order.write_training_order(docs.limit(0), tokenizer_path(), folder, shards=2).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 65_537])
def test_feistel_is_a_permutation(size):
    assert sorted(training_order.feistel(np.arange(size), size, 99).tolist()) == list(range(size))


def test_quality_held_out(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(400)]
    marks = [["junk!!", "BUY"], ["rude", "vile"], []]
    rows = []
    for k in range(1500):
        grade = int(rng.choice(3, p=[0.2, 0.2, 0.6]))
        rows.append((k, " ".join(rng.permutation([*rng.choice(words, 80), *marks[grade] * 2]).tolist()), grade))
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(None, None, 1), (7000, "", 2)], "doc_id long, text string, keep int")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 1000] + [(None, 1), (3, None), (4, 9)], "doc_id long, grade int")
    model = quality_model.fit_on(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    assert len(got) == 1502
    held = [(got[i], g) for i, _, g in rows if i >= 1000]
    assert np.mean([r.keep == (g == 2) for r, g in held]) > 0.95
    assert np.mean([abs(r.expected_grade - g) < 0.75 for r, g in held]) > 0.9
    empty = quality_model.fit_on(docs.limit(0), ratings.limit(0), 3)
    assert quality_model.score(docs.limit(0), empty).count() == 0


def test_url_rules_and_cascade(spark):
    urls = [
        None, "no scheme", "http://A.example.NET/en/x?y", "https://net/", "http://foo.net", "http://x.org/fr/1#t", "x://h0.com?a=/de/", "http://example.com/de/a",
        "http://notexample.com/de/", "http://",
    ] + [f"http://h{k}.com/p" for k in range(500)]
    pages = spark.createDataFrame([(k, u, "own") for k, u in enumerate(urls)], "page_id long, url string, host string")
    hosts = spark.createDataFrame([(f"h{k}.com",) for k in range(0, 500, 3)] + [(None,), ("",), ("absent.com",)], "host string")
    from tabloom.llm.queries import RULES

    got = {r.page_id: r for r in bloom_cascade.judge_urls(pages, hosts, RULES).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(10)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"),
        ("foo.net", "", None, "allow"), ("x.org", "/fr/1", "org/fr/", "allow"), ("h0.com", "", None, "block"),
        ("example.com", "/de/a", "example.com/de/", "block"), ("notexample.com", "/de/", None, "allow"), ("", "", None, "allow"),
    ]
    assert all((got[10 + k].verdict == "block") == (k % 3 == 0) for k in range(500))
    old, bloom_cascade.MOST_BYTES = bloom_cascade.MOST_BYTES, 0
    try:
        joined = {r.page_id: r.verdict for r in bloom_cascade.judge_urls(pages, hosts, RULES).collect()}
    finally:
        bloom_cascade.MOST_BYTES = old
    assert joined == {k: r.verdict for k, r in got.items()}
    assert bloom_cascade.judge_urls(pages.limit(0), hosts.limit(0), RULES).count() == 0


def test_multi_index_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    rows = [v for v in base]
    for v in base[:60]:
        rows += [v + 0.1 * rng.standard_normal(16) for _ in range(5)]
    rows += [base[0]] * 40
    vectors = [[float(np.float32(x)) for x in v] for v in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15, [1.0, 0.0]]
    data = [(k, v, 1) for k, v in enumerate([*vectors, *odd])]
    frame = spark.createDataFrame([*data, (None, vectors[0], 1)], "vec_id long, embedding array<float>, id int")
    old, multi_index.BLOCK = multi_index.BLOCK, 32
    try:
        got = {r.vec_id: r for r in multi_index.near_vectors(frame).collect()}
    finally:
        multi_index.BLOCK = old
    units = np.array(vectors)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    want = near.sum(axis=1) - 1
    found = np.array([got[k].n_links for k in range(len(vectors))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[len(vectors) + k].n_links == 0 and got[len(vectors) + k].kept for k in range(len(odd)))
    roots = classes(range(len(vectors)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert np.mean([got[k].component_id == roots[k] for k in roots]) > 0.9
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, before = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).toPandas(), docs.schema)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
        before = kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
