"""Order-dependent folds against plain loops."""

import random
from datetime import datetime, timedelta

from tabloom.operators import skew, usage
from pyspark.sql import functions as F


def events(n, users, hours):
    rnd = random.Random(11)
    return [(i, rnd.randrange(users), datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(60 * hours)), rnd.randrange(1, 40)) for i in range(n)]


def test_free_plan_admission(spark):
    data = events(400, 3, 30)
    df = spark.createDataFrame([(i, u, 0, t, p, "free") for i, u, t, p in data], "event_id bigint, user_id bigint, period bigint, ts timestamp, pages bigint, tier string")
    got = {r["event_id"]: (r["admitted"], r["used_after"]) for r in usage.admit_usage(df).collect()}
    used, want = {}, {}
    for i, u, t, p in sorted(data, key=lambda e: (e[2], e[0])):
        fits = used.get(u, 0) + p <= 100
        used[u] = used.get(u, 0) + (p if fits else 0)
        want[i] = (fits, used[u])
    assert got == want


def test_refunds_stop_at_zero(spark):
    data = [(i, u, t, p - 22) for i, u, t, p in events(300, 2, 40)]
    df = spark.createDataFrame([(i, u, 0, t, p) for i, u, t, p in data], "event_id bigint, user_id bigint, period bigint, ts timestamp, pages bigint")
    got = {r["event_id"]: r["used_after"] for r in usage.refund_usage(df).collect()}
    used, want = {}, {}
    for i, u, t, p in sorted(data, key=lambda e: (e[2], e[0])):
        used[u] = max(0, used.get(u, 0) + p)
        want[i] = used[u]
    assert got == want


def test_balance_with_renewal(spark):
    data = events(300, 4, 30)
    df = spark.createDataFrame([(i, u, t, p / 4) for i, u, t, p in data], "event_id bigint, user_id bigint, ts timestamp, cost double")
    rules = {u: (float(10 * u), u % 2 == 1, 5.0 + u, 20.0) for u in range(4)}
    users = spark.createDataFrame([(u, *r) for u, r in rules.items()], "user_id bigint, balance double, auto_renew boolean, threshold double, refill double")
    got = {r["event_id"]: (round(r["balance_after"], 6), r["renewal"]) for r in usage.balance_events(df, users).collect()}
    now, want = {u: r[0] for u, r in rules.items()}, {}
    for i, u, t, p in sorted(data, key=lambda e: (e[2], e[0])):
        _, renew, limit, refill = rules[u]
        now[u] = max(0.0, now[u] - p / 4)
        again = refill if renew and now[u] < limit else 0.0
        now[u] += again
        want[i] = (round(now[u], 6), again)
    assert got == want


def test_two_level_running_folds_on_one_hot_key(spark):
    n = 2000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id"), ((F.col("id") * 7919) % 101 - 50).alias("v"))
    out = skew.running(df, ["k"], F.floor(F.col("id") / 64), ["id"], {"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))})
    total, low, high = 0, 10**9, -10**9
    for r in out.orderBy("id").collect():
        v = (r["id"] * 7919) % 101 - 50
        total, low, high = total + v, min(low, v), max(high, v)
        assert (r["total"], r["low"], r["high"]) == (total, low, high)
