"""State of streams: tables of the newest row, and timers."""

import os

import pandas as pd
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.plans.streaming_queries import Feed, fold_to_end, run_to_end
from tabloom.streaming import jobs, keyed
from tabloom.streaming.state import KeyedTable


def size_of(folder):
    return sum(os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_what_a_batch_reads_does_not_grow_with_batches(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/marks", "k string, mark string", ["k"], buckets=2)
    want, read = {}, []
    for batch in range(52):
        rows = {f"k{(batch * 3 + j) % 40}": f"m{batch}" for j in range(8)}
        want |= rows
        table.write(spark.createDataFrame(list(rows.items()), "k string, mark string").coalesce(1), batch)
        if batch % 13 == 5:
            # a repeated batch sees what it saw first, and replaces itself
            assert {r.k for r in table.read(batch).filter("mark = 'm%d'" % batch).collect()} == set()
            table.write(spark.createDataFrame(list(rows.items()), "k string, mark string").coalesce(1), batch)
        read.append(sum(size_of(f"{tmp_path}/marks/{kind}/batch={b}") for kind, b in table._folders(batch + 1)))
    assert {r.k: r.mark for r in table.read().collect()} == want
    assert max(read[40:]) <= 1.2 * max(read[12:30])
    asked = spark.createDataFrame([("k1",)], "k string")
    some = {r.k: r.mark for r in table.read(of=asked).collect()}
    assert some["k1"] == want["k1"] and len(some) < len(want)


def test_folder_cycles_keep_the_newest_mark(spark, tmp_path):
    listings = [
        spark.createDataFrame([(f"f{k}", "x", c, f"h{c if k == 1 else 0}") for k in range(4)], "file_id string, filename string, cycle long, content_mark string")
        for c in range(4)
    ]

    def process(files):
        # f2 fails in the first two cycles
        return files.select("file_id", "content_mark", (~((F.col("file_id") == "f2") & (F.col("cycle") < 2))).alias("done"))

    out = fold_to_end(Feed(listings, "listing"), lambda rows, *places: jobs.ingest_folder(rows, process, *places))
    got = sorted((r.batch_id, r.file_id, r.done) for r in out.collect())
    assert got == [
        (0, "f0", True), (0, "f1", True), (0, "f2", False), (0, "f3", True), (1, "f1", True), (1, "f2", False), (2, "f1", True), (2, "f2", True), (3, "f1", True),
    ]


ITEMS = "kind string, item_id long, event string, ts timestamp, expires_at timestamp, job_id string"


def items(spark, rows):
    return spark.createDataFrame(rows, "kind string, item_id long, event string, ts string, expires_at string, job_id string").select(
        "kind", "item_id", "event", F.to_timestamp("ts").alias("ts"), F.to_timestamp("expires_at").alias("expires_at"), "job_id"
    )


def test_items_leave_on_their_timer(spark):
    parts = [
        items(spark, [
            ("document", 1, "stored", "2024-01-01 00:00:00", "2024-01-08 00:00:00", None),
            ("document", 2, "stored", "2024-01-01 00:00:00", "2024-01-08 00:00:00", None),
            ("document", 3, "stored", "2024-01-01 00:00:00", "2024-01-08 00:00:00", "taken"),
            ("document", 4, "stored", "2024-01-01 00:00:00", "2024-01-20 00:00:00", None),
            ("session", 1, "stored", "2024-01-01 00:00:00", "2024-01-01 01:00:00", None),
            ("document", 2, "assigned", "2024-01-03 00:00:00", None, "job"),
        ]),
        # exactly at the end of its time a document is still there
        items(spark, [("tick", 0, "tick", "2024-01-08 00:00:00", "2024-01-08 00:00:00", None)]),
        items(spark, [("tick", 0, "tick", "2024-01-08 00:00:01", "2024-01-08 00:00:01", None)]),
        items(spark, [("tick", 0, "tick", "2024-02-01 00:00:00", "2024-02-01 00:00:00", None), ("document", 4, "assigned", "2024-01-19 00:00:00", None, "job")]),
    ]
    gone = run_to_end(Feed(parts, "items"), keyed.expire_stream).filter("kind <> 'tick'")
    got = sorted((r.kind, r.item_id, str(r.clock)) for r in gone.collect())
    assert got == [("document", 1, "2024-01-08 00:00:01"), ("session", 1, "2024-01-03 00:00:00")]


def test_counters_start_anew_on_their_timer(spark):
    shape = "user_id long, ts string, pages_used long, overage_pages long, usage_reset_at string, current_period_end string"
    rows = [
        [(1, "2024-01-01", 50, 3, "2024-01-10", "2024-02-10"), (2, "2024-01-01", 7, 0, "2024-01-10", None), (3, "2024-01-01", 9, 0, None, None)],
        [(-1, "2024-01-10", 0, 0, None, None)],
        [(2, "2024-01-11", 4, 0, "2024-02-09", None), (-1, "2024-01-12", 0, 0, None, None)],
        [(-1, "2024-02-09", 0, 0, None, None)],
    ]
    parts = [
        spark.createDataFrame(part, shape).withColumns({c: F.to_timestamp(c) for c in ("ts", "usage_reset_at", "current_period_end")}) for part in rows
    ]
    told = run_to_end(Feed(parts, "users"), keyed.reset_period_stream, "update").filter("user_id > 0").collect()
    got = sorted((r.user_id, r._batch, r.pages_used, str(r.usage_reset_at)[:10]) for r in told)
    assert [g[0:1] + g[2:] for g in got] == [
        (1, 50, "2024-01-10"), (1, 0, "2024-02-10"), (2, 7, "2024-01-10"), (2, 0, "2024-02-09"), (2, 4, "2024-02-09"), (2, 0, "2024-03-10"), (3, 9, "None"),
    ]


def test_late_resolution_of_a_plan(spark):
    shape = "customer string, sub_id string, event_type string, ts timestamp, event_id long, tier string, status string, cancel boolean, period_end timestamp"
    day = lambda k: F.timestamp_seconds(F.lit(1_704_067_200 + 86_400 * k))

    def event(k, kind, sub="s1", tier=None, status=None, end=None, customer="c"):
        return spark.range(1).select(
            F.lit(customer).alias("customer"), F.lit(sub).alias("sub_id"), F.lit(kind).alias("event_type"), day(k).alias("ts"), F.lit(k).cast("long").alias("event_id"),
            F.lit(tier).cast("string").alias("tier"), F.lit(status).cast("string").alias("status"), F.lit(None).cast("boolean").alias("cancel"),
            (day(end) if end else F.lit(None).cast("timestamp")).alias("period_end"),
        )

    parts = [
        event(1, "created", tier=None, end=40).unionByName(event(2, "created", customer="stranger", tier="pro")),
        event(3, "updated", sub="other", tier="business").unionByName(event(4, "failed")),
        event(5, "updated", tier="pro", status="trialing"), event(6, "paid", end=70), event(7, "deleted"), event(8, "updated", tier="business"),
    ]
    users = spark.createDataFrame([("c",)], "customer string")
    told = run_to_end(Feed(parts, "subs"), lambda rows: keyed.subscription_stream(rows, users), "update").orderBy("_batch").collect()
    assert [(r.tier, r.status, r.sub_id, str(r.period_end)[:10]) for r in told] == [
        (None, "active", "s1", "2024-02-10"), (None, "past_due", "s1", "2024-02-10"), ("pro", "trialing", "s1", "2024-02-10"),
        ("pro", "active", "s1", "2024-03-11"), ("free", "active", None, "None"), ("free", "active", None, "None"),
    ]


def test_period_end_of_odd_payloads(spark):
    told = [
        ('{"items":{"data":[{"current_period_end":86400}]},"current_period_end":5}', 86400), ('{"items":{"data":[]},"current_period_end":5}', 5),
        ('{"items":{"data":[{"current_period_end":0}]},"current_period_end":"172800"}', 172800), ('{"items":null}', None), ("{broken", None), (None, None), ("[]", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(told)], "k long, payload string")
    got = [r.s for r in df.select("k", F.unix_seconds(X.period_end("payload")).alias("s")).orderBy("k").collect()]
    assert got == [s for _, s in told]


class Handle:
    """A state store in memory that counts how often it is asked."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, kept):
        self.calls += 1
        self.kept = kept

    def clear(self):
        self.calls += 1
        self.kept = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.clock


def test_state_of_many_keys_is_read_and_written_at_once():
    handle, fold = Handle(), keyed.ExpireItems()
    fold.init(handle)
    item = [str(k) for k in range(5000)]
    stored = pd.DataFrame({"kind": "document", "item_id": item, "event": "stored", "at": 1000, "expires": range(5000), "job_id": None})
    assert list(fold.handleInputRows((3,), iter([stored[:2500], stored[2500:]]), handle)) == []
    assert handle.calls <= 4 and handle.timers == [1]
    handle.clock, handle.calls, handle.timers = 4000, 0, []
    gone = pd.concat(fold.handleExpiredTimer((3,), handle, None))
    assert list(gone["item_id"]) == item[:4000] and set(gone["clock"]) == {4000}
    assert handle.calls <= 4 and handle.timers == [4001]
