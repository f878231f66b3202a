"""Folds over one hot user and hour, and their parts, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import folds, scan, usage

ROWS = 200_000


def walk_balance(costs, balance, renews, limit, refill):
    out = []
    for c in costs:
        balance = max(0, balance - c)
        again = renews and balance < limit
        balance += refill if again else 0
        out.append((balance, refill if again else 0))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_maps_of_runs(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, rng.integers(1, 6))
    run = np.repeat(np.arange(len(sizes)), sizes)
    cost = rng.integers(0, 30, len(run)) * (rng.random(len(run)) < 0.9)
    limit, refill = np.full(len(sizes), int(rng.integers(1, 20))), np.full(len(sizes), int(rng.integers(0, 40)))
    top = limit + refill
    elements = folds.to_bytes(folds.chained(folds.charge_maps(cost, limit[run], refill[run]), sizes, top), top)
    whole = folds.compose_pieces(elements)
    for start in range(int(top[0])):
        now = start
        for r, element in enumerate(elements):
            want = walk_balance(cost[run == r].tolist(), now, True, int(limit[0]), int(refill[0]))[-1][0]
            now = folds.move_by_pieces(element, now)
            assert now == want
        assert folds.move_by_pieces(whole, start) == now


def test_pieces_stay_few():
    rng = np.random.default_rng(3)
    count, runs = 100_000, 200
    limit, refill = np.full(count, 2000), np.full(count, 5000)
    top = np.full(runs, 7000)
    maps = folds.chained(folds.charge_maps(rng.integers(0, 2000, count), limit, refill), np.full(runs, count // runs), top)
    assert len(maps.lo) < 20 * runs
    assert len(folds.compose_pieces(folds.to_bytes(maps, top))) < 8 * 3 * 50


@pytest.mark.parametrize("seed", range(5))
def test_tables_of_runs(seed):
    rng = np.random.default_rng(seed)
    pages = rng.integers(0, 60, (4, 30))
    tables = [row.astype("<i4").tobytes() for row in folds.admission_table(pages, 100)]
    for start in (0, 1, 50, 99, 100):
        now = start
        for k, row in enumerate(pages):
            fits, after = folds.admitted(row[None], np.array([now]), 100)
            used = now
            for p, f, a in zip(row, fits[0], after[0]):
                assert f == (used + p <= 100)
                used += p if f else 0
                assert a == used
            now = folds.move_by_table(tables[k], now)
            assert now == used
        assert folds.move_by_table(folds.compose_tables(tables), start) == now


def hot(spark, value):
    """One user's rows in one hour, and a few rows of others, one of them null."""
    rows = spark.range(ROWS).select(
        F.col("id").alias("event_id"), F.lit(7).cast("bigint").alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 3000).alias("ts"),
        value(F.col("id")).alias("v"),
    )
    few = spark.range(ROWS, ROWS + 40).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5 + 100).alias("user_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 7).alias("ts"), value(F.col("id")).alias("v"),
    )
    return rows.unionByName(few).repartition(16)


def by_user(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        found.setdefault(r["user_id"], []).append(r)
    return found


def test_admission_of_a_hot_user(spark):
    df = hot(spark, lambda i: (i * 7919) % 101).withColumns({"period": F.lit(0).cast("bigint"), "tier": F.lit("free"), "pages": F.col("v")})
    used = spark.createDataFrame([(7, 0, 13)], "user_id bigint, period bigint, state bigint")
    got = {r["event_id"]: (r["admitted"], r["used_after"]) for r in usage.admit_usage(df, used=used).collect()}
    assert len(got) == ROWS + 40
    for user, rows in by_user(df.collect()).items():
        now = 13 if user == 7 else 0
        for r in rows:
            fits = now + r["pages"] <= 100
            now += r["pages"] if fits else 0
            assert got[r["event_id"]] == (fits, now)


def test_refunds_of_a_hot_user(spark):
    df = hot(spark, lambda i: (i * 7919) % 101 - 52).withColumns({"period": F.lit(0).cast("bigint"), "pages": F.col("v")})
    got = {r["event_id"]: r["used_after"] for r in usage.refund_usage(df).collect()}
    paid = {r["event_id"]: r["used_after"] for r in usage.running_usage(df).collect()}
    for rows in by_user(df.collect()).values():
        now = total = 0
        for r in rows:
            now, total = max(0, now + r["pages"]), total + r["pages"]
            assert (got[r["event_id"]], paid[r["event_id"]]) == (now, total)


@pytest.mark.parametrize("renews", [True, False])
def test_balance_of_a_hot_user(spark, renews):
    df = hot(spark, lambda i: (i * 7919) % 1009 / 100.0).withColumnRenamed("v", "cost")
    users = spark.createDataFrame(
        [(7, 900.0, renews, 20.0, 50.0), (101, 3.0, True, 5.5, 1.0), (102, 0.0, True, 0.0, 9.0), (103, 10.0, None, 4.0, 9.0), (104, 20.0, True, 2.0, 3.0)],
        "user_id bigint, balance double, auto_renew boolean, threshold double, refill double",
    )
    rules = {u.user_id: u for u in users.collect()}
    got = {r["event_id"]: (round(r["balance_after"], 6), r["renewal"]) for r in usage.balance_events(df, users).collect()}
    held = {u: rows for u, rows in by_user(df.collect()).items() if u in rules}
    assert len(got) == sum(map(len, held.values()))
    for user, rows in held.items():
        rule = rules[user]
        costs = [round(r["cost"] * 1_000_000) for r in rows]
        want = walk_balance(costs, rule.balance * 1e6, bool(rule.auto_renew), rule.threshold * 1e6, rule.refill * 1e6)
        for r, (after, renewal) in zip(rows, want):
            assert got[r["event_id"]] == (round(after / 1e6, 6), renewal / 1e6)


def test_work_of_a_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_spread(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_spread(spark):
    rows = scan.dealt(spark.range(0, 50_000, 1, 8).select(F.lit(1).alias("k"), "id"), ["k"], ["id"], 1000)
    held = [r["count"] for r in rows.groupBy("_task", "_run").count().collect()]
    assert max(held) <= 1000 and sum(held) == 50_000 and rows.select("_task").distinct().count() > 1


def test_empty_folds(spark):
    none = hot(spark, lambda i: i).filter("false").withColumns({"period": F.lit(0).cast("bigint"), "tier": F.lit("free"), "pages": F.col("v"), "cost": F.lit(1.0)})
    users = spark.createDataFrame([(1, 1.0, True, 1.0, 1.0)], "user_id bigint, balance double, auto_renew boolean, threshold double, refill double")
    assert usage.admit_usage(none).count() == usage.refund_usage(none).count() == usage.balance_events(none, users).count() == 0
