"""Duplicate attachments against a walk in order of arrival."""

import random

from tabloom.operators import inbound as I

NEW = "arrival_id bigint, user_id bigint, message_id string, sender string, filename string, file_size bigint"


def walked(rows):
    kept, mails, files = [], set(), set()
    for at in sorted({r[0] for r in rows}):
        batch = [r for r in rows if r[0] == at]
        fresh = [r for r in batch if r[1:3] not in mails and (r[1], *r[3:]) not in files]
        kept += fresh
        mails |= {r[1:3] for r in fresh}
        files |= {(r[1], *r[3:]) for r in fresh}
    return sorted(kept)


def test_a_dropped_copy_does_not_drop_others(spark):
    rows = [(1, 1, "m1", "s", "A", 5), (2, 1, "m2", "s", "A", 5), (3, 1, "m2", "s", "B", 5)]
    old = spark.createDataFrame([], NEW + ", job_id string")
    got = I.skip_duplicate_attachments(spark.createDataFrame(rows, NEW), old).collect()
    assert sorted(tuple(r) for r in got) == [rows[0], rows[2]]
    assert I.skip_duplicate_attachments(spark.createDataFrame([], NEW), old).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, "A", 5), (2, None, None, None, "A", 5)], NEW)
    assert I.skip_duplicate_attachments(nulls, old).count() == 2


def test_chains_against_a_walk(spark):
    rnd, rows = random.Random(5), []
    for at in range(60):
        user, mail = rnd.randrange(2), f"m{rnd.randrange(20)}"
        rows += [(at, user, mail, "s", f"f{rnd.randrange(12)}", 1) for _ in range(rnd.randrange(1, 4))]
    old = spark.createDataFrame([], NEW + ", job_id string")
    got = I.skip_duplicate_attachments(spark.createDataFrame(rows, NEW), old).collect()
    assert sorted(tuple(r) for r in got) == walked(rows)


def test_entities_resolve_once(spark):
    import html

    from tabloom.sources.readers import html_to_text, unescape_html

    texts = [
        "a &amp;lt;b", "caf&eacute;", "&copy 2024 &copyx &notit; &ampfoo;", "&#9;&#65;&#x41 &#150; &#0; &#x110000; &#99999999999; &#1;x &#xD800;",
        "&", "&&amp;&", "&nosuch; &NotEqualTilde; &fjlig;", "", "&#; &#x; &#xg;", "&LT&GT;&Aacute", "&#0000065;", "&#xfffe;|",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.u for r in rows.select("k", unescape_html(rows.t).alias("u")).collect()}
    assert got == {k: html.unescape(t) for k, t in enumerate(texts)}
    flat = spark.createDataFrame([("<p>x&#9;&#9;y</p>&lt;p&gt;", ), (None,)], "t string").select(html_to_text("t")).collect()
    assert [r[0] for r in flat] == ["x y\n<p>", None]
