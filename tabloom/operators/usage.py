"""Usage metering, pricing and subscription state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import folds
from tabloom.operators.scan import counter, gathered, matched, starts
from tabloom.operators.skew import running, running_total
from tabloom.session import cut_lineage

# Plans with monthly price in cents, pages per month and overage in cents per page.
TIERS = (
    ("free", 0, 100, None),
    ("starter", 6900, 800, 5.0),
    ("pro", 19900, 3000, 3.0),
    ("business", 69900, 10000, 1.5),
)
TIER_NAMES = tuple(t[0] for t in TIERS)
MARKUP = 1.2
REMOVED_TOKEN_PRICE = 0.05 / 1_000_000
OCR_PAGE_PRICE = 0.001
PERIOD_DAYS = 30
#: Parts of a unit of money that balances are counted in.
UNITS = 1_000_000
FORM_FILL_PAGES = 5
PROPOSAL_PAGES = 25


def _lookup(position: int, kind: str) -> Column:
    pairs = [x for t in TIERS for x in (F.lit(t[0]), F.lit(t[position]).cast(kind))]
    return F.create_map(*pairs)


def tier_of(c: Column | str) -> Column:
    """Known plan name; anything else counts as free."""
    name = X.col(c)
    return F.when(name.isin(*TIER_NAMES), name).otherwise("free")


def tier_pages(c: Column | str) -> Column:
    return F.try_element_at(_lookup(2, "bigint"), tier_of(c))


def price_calls(calls: DataFrame, prices: DataFrame, default_rate: tuple[float, float, float]) -> DataFrame:
    """Cost per call: the longest price key inside the model name, else the default; cached tokens at their own rate.

    prices: (model_key, input_price, cached_price, output_price). Parts of the distinct model names meet the keys in an
    equi-join, so calls and prices are never crossed.
    """
    models = calls.select("model").distinct()
    n = F.length("model")
    parts = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("model", i, k)))
    )
    pieces = models.filter(n > 0).select("model", F.explode(F.array_distinct(parts)).alias("model_key"))
    rates = F.struct("input_price", "cached_price", "output_price")
    hits = pieces.join(prices, "model_key").groupBy("model").agg(
        F.max_by(rates, F.struct(F.length("model_key"), F.col("model_key"))).alias("rate")
    )
    known = calls.join(hits, "model", "left")
    names = ("input_price", "cached_price", "output_price")
    rate = {n: F.coalesce(F.col("rate")[n], F.lit(v)) for n, v in zip(names, default_rate)}
    uncached = F.greatest(F.lit(0), F.col("prompt_tokens") - F.col("cached_tokens"))
    cost = uncached * rate["input_price"] + F.col("cached_tokens") * rate["cached_price"] + F.col("completion_tokens") * rate["output_price"]
    return known.select(*calls.columns, cost.alias("call_cost"))


def usage_cost(priced: DataFrame) -> DataFrame:
    """Tokens and billed cost per job: calls, text recognition and removed tokens, with mark-up."""
    sums = priced.groupBy("job_id").agg(
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"), F.sum("call_cost").alias("_calls"),
        F.sum("ocr_pages").alias("ocr_pages"), F.sum(F.greatest(F.lit(0), "removed_tokens")).alias("removed_tokens"),
    )
    raw = F.col("_calls") + F.col("ocr_pages") * OCR_PAGE_PRICE + F.col("removed_tokens") * REMOVED_TOKEN_PRICE
    return sums.withColumn("cost_usd", F.bround(raw * MARKUP, 6)).drop("_calls")


def resolve_tier(subs: DataFrame, price_map: DataFrame) -> DataFrame:
    """Plan per subscription: known price id, else its tier note, else the monthly amount; null when unresolved.

    subs: sub_id, items array<struct<price_id, unit_amount, interval>>, meta_tier, current_tier.
    """
    items = subs.select("sub_id", F.posexplode("items").alias("place", "item"))
    mapped = items.select("sub_id", "place", F.col("item.price_id").alias("price_id")).join(price_map, "price_id")
    by_price = mapped.groupBy("sub_id").agg(F.min_by("tier", "place").alias("price_tier"))
    by_amount = F.create_map(*[x for t in TIERS if t[1] for x in (F.lit(t[1]), F.lit(t[0]))])
    amounts = F.transform(
        "items", lambda i: F.when(i["interval"] == "month", F.try_element_at(by_amount, i["unit_amount"].cast("int")))
    )
    amount_tier = F.get(F.filter(amounts, lambda t: t.isNotNull()), F.lit(0))
    meta = F.when(F.col("meta_tier").isin(*TIER_NAMES), F.col("meta_tier"))
    joined = subs.join(by_price, "sub_id", "left")
    return joined.select(
        "sub_id", "current_tier", F.coalesce("price_tier", meta, amount_tier).alias("resolved_tier"),
        F.coalesce("price_tier", meta).alias("local_tier"),
        F.coalesce(F.coalesce("price_tier", meta, amount_tier), "current_tier").alias("tier"),
    )


def audit_tiers(users: DataFrame, resolved: DataFrame) -> DataFrame:
    """Users whose stored plan differs from the one their subscription states; unresolved ones are skipped."""
    joined = users.join(resolved.select("sub_id", "local_tier").filter("local_tier is not null"), "sub_id")
    return joined.filter(~F.col("subscription_tier").eqNullSafe(F.col("local_tier"))).select(
        "user_id", "sub_id", F.col("subscription_tier").alias("stored_tier"), F.col("local_tier").alias("correct_tier")
    )


def usage_summary(users: DataFrame) -> DataFrame:
    """Share used, limit flags, warning and next plan per user (user_id, subscription_tier, pages_used)."""
    tier, used, cap = tier_of("subscription_tier"), F.col("pages_used"), tier_pages("subscription_tier")
    share = used / cap * 100
    at_limit = used >= cap
    near = (share >= 80) & ~at_limit
    following = F.create_map(*[F.lit(x) for p in zip(TIER_NAMES, TIER_NAMES[1:]) for x in p])
    warning = (
        F.when(at_limit & (tier == "free"), "limit_reached_free").when(at_limit, "limit_reached_paid").when(near, "near_limit")
    )
    return users.select(
        "user_id", tier.alias("tier"), "pages_used", cap.alias("pages_limit"),
        F.least(share, F.lit(100.0)).alias("usage_percent"), at_limit.alias("at_limit"), near.alias("near_limit"),
        warning.alias("warning"), F.try_element_at(following, tier).alias("next_tier"),
    )


def hour_of(ts: str = "ts") -> Column:
    return F.date_trunc("hour", ts)


def running_usage(events: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Cumulative pages per user and period, in event order, from 0 or from `used` (user_id, period, state)."""
    return counter(events, ["user_id", "period"], ["ts", "event_id"], F.col("pages"), "used_after", used)


def overage_added(mode: str, used_after: Column, pages: Column, cap: Column) -> Column:
    """Overage of one request: whole excess each time, only the new excess, or the full request."""
    if mode == "cumulative_excess":
        return F.greatest(F.lit(0), used_after - cap)
    if mode == "new_excess":
        return F.greatest(F.lit(0), used_after - F.greatest(used_after - pages, cap))
    if mode == "full_request":
        return F.when(used_after > cap, pages).otherwise(0)
    raise ValueError(f"unknown overage mode {mode}")


def admit_usage(events: DataFrame, mode: str = "new_excess", used: DataFrame | None = None) -> DataFrame:
    """Admit or refuse page requests (user_id, period, ts, event_id, pages, tier), in order.

    Paid plans are always admitted: a running sum. The free plan refuses a request that would pass its cap, and a
    refused request does not count. Its state is a number of pages up to the cap, so a run of requests is a table from
    every possible start to its end; tables are put one after the other as `scan.starts` does, then every run is replayed from its
    start. `used` gives the pages used before (user_id, period, state). Null and negative pages of the free plan count as 0.
    """
    paid = events.filter(tier_of("tier") != "free")
    free = events.filter(tier_of("tier") == "free")
    counted = running_usage(paid, used)
    extra = overage_added(mode, F.col("used_after"), F.col("pages"), tier_pages("tier"))
    settled = counted.select(*events.columns, F.lit(True).alias("admitted"), "used_after", extra.cast("bigint").alias("overage_pages"))

    cap = TIERS[0][2]
    keys = ["user_id", "period"]
    runs = cut_lineage(gathered(free.withColumn("pages", F.col("pages").cast("bigint")), keys, ["ts", "event_id"], ["pages"]))
    names = [*keys, "_task", "_run"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, _ = folds.padded(batch.column("rows"), "pages")
            out = [row.astype("<i4").tobytes() for row in folds.admission_table(pages, cap)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.binary())], names=[*names, "element"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            pages, inside = folds.padded(rows, "pages")
            fits, after = folds.admitted(pages, batch.column("state").to_numpy(), cap)
            owner = np.repeat(np.arange(len(rows)), inside.sum(axis=1))
            told = [batch.column(k).take(pa.array(owner)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*told, rows.flatten().field("event_id"), pa.array(fits[inside]), pa.array(after[inside])], names=[*keys, "event_id", "admitted", "used_after"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    told = ", ".join(f"{k} {kinds[k]}" for k in keys)
    elements = runs.mapInArrow(tables, f"{told}, _task bigint, _run bigint, element binary")
    opened = starts(elements, keys, folds.compose_tables, folds.move_by_table, used)
    begun = matched(runs, opened, names)
    event = free.schema["event_id"].dataType.simpleString()
    decided = begun.mapInArrow(replay, f"{told}, event_id {event}, admitted boolean, used_after bigint")
    judged = matched(free, decided, [*keys, "event_id"]).select(
        *events.columns, "admitted", "used_after", F.lit(0).cast("bigint").alias("overage_pages")
    )
    return settled.unionByName(judged)


def refund_usage(events: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Counter after charges and refunds (negative `pages`), never below zero, from 0 or from `used` (user_id, period, state)."""
    return counter(events, ["user_id", "period"], ["ts", "event_id"], F.col("pages"), "used_after", used, floor=True)


def reset_period(users: DataFrame, now: Column) -> DataFrame:
    """Counters back to zero once the reset time has come; next reset at the period end if ahead, else in 30 days."""
    due = F.col("usage_reset_at").isNotNull() & (now >= F.col("usage_reset_at"))
    ahead = F.col("current_period_end") > now
    following = F.when(ahead, F.col("current_period_end")).otherwise(now + F.make_dt_interval(F.lit(PERIOD_DAYS)))
    changed = {
        "pages_used": F.when(due, 0).otherwise(F.col("pages_used")),
        "overage_pages": F.when(due, 0).otherwise(F.col("overage_pages")),
        "usage_reset_at": F.when(due, following).otherwise(F.col("usage_reset_at")),
    }
    return users.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in users.columns])


def subscription_state(events: DataFrame, users: DataFrame) -> DataFrame:
    """State per known customer after all events (customer, sub_id, event_type, ts, event_id, tier, status, cancel, period_end).

    An event counts while its subscription is the customer's current one: opened by the latest `created`, not yet
    `deleted`. Each attribute is then its last setting. An unresolved tier never overwrites.
    """
    known = events.join(users.select("customer"), "customer", "left_semi")
    at = F.struct("ts", "event_id")
    opening = F.when(F.col("event_type") == "created", F.struct("ts", "event_id", "sub_id"))
    placed = running(known, ["customer"], hour_of(), ["ts", "event_id"], {"_open": ("max", opening)})
    mine = placed.filter(F.col("sub_id") == F.col("_open.sub_id"))
    closing = mine.groupBy("customer", "_open").agg(F.min(F.when(F.col("event_type") == "deleted", at)).alias("_close"))
    live = mine.join(closing, ["customer", "_open"]).filter(F.col("_close").isNull() | (at <= F.col("_close")))

    kind = F.col("event_type")
    described, ended, paid = kind.isin("created", "updated"), kind == "deleted", kind == "paid"

    def last(value: Column, when: Column) -> Column:
        # a struct around the value lets null be a setting
        return F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, at))["v"]

    tier = F.when(ended, F.lit("free")).otherwise(F.col("tier"))
    status = F.when(described, F.coalesce("status", F.lit("active"))).when(ended | paid, F.lit("active")).otherwise(F.lit("past_due"))
    state = live.groupBy("customer").agg(
        last(tier, ended | (described & F.col("tier").isNotNull())).alias("tier"),
        last(status, F.lit(True)).alias("status"),
        last(F.coalesce(F.col("cancel") & described, F.lit(False)), described | ended).alias("cancel_at_period_end"),
        last(F.when(~ended, F.col("period_end")), ended | (F.col("period_end").isNotNull() & (described | paid))).alias("period_end"),
        last(F.when(~ended, F.col("sub_id")), (kind == "created") | ended).alias("sub_id"),
        F.max(F.when((kind == "created") | ended | paid, F.col("ts"))).alias("counters_reset_at"),
    )
    joined = users.select("customer", F.col("tier").alias("_tier")).join(state, "customer", "left")
    return joined.select(
        "customer", F.coalesce("tier", "_tier").alias("tier"), "status", "cancel_at_period_end", "period_end", "sub_id",
        "counters_reset_at",
    )


def balance_events(charges: DataFrame, users: DataFrame) -> DataFrame:
    """Balance after every charge, and the renewals it triggers.

    charges: (event_id, user_id, ts, cost); users: (user_id, balance, auto_renew, threshold, refill). `auto_renew` must
    already include that a payment method is saved. Amounts are counted in millionths, as costs are rounded; null and negative costs
    count as 0. Charges of unknown users are left out.

    Up to a user's first renewal the balance is what the running sum of the costs leaves. From then on it lies below
    threshold plus refill, and a run of charges is a map of balances in a few pieces; the maps are put one after the other as
    `scan.starts` does, then every run is replayed from its start.
    """
    keys, order = ["user_id"], ["ts", "event_id"]

    def units(amount: str) -> Column:
        return F.round(F.coalesce(F.col(amount), F.lit(0)) * UNITS).cast("bigint")

    rules = users.select(
        "user_id", units("balance").alias("_balance"), (F.coalesce("auto_renew", F.lit(False)) & (units("threshold") > 0)).alias("_renews"),
        units("threshold").alias("_limit"), units("refill").alias("_refill"),
    )
    rows = charges.join(rules, "user_id").withColumn("_cost", F.greatest(F.lit(0), units("cost")))
    spent = cut_lineage(counter(rows, keys, order, F.col("_cost"), "_spent"))
    left = F.col("_balance") - F.col("_spent")
    over = F.col("_renews") & (left < F.col("_limit"))
    first = spent.filter(over).groupBy("user_id").agg(F.min(F.struct(*order, F.greatest(F.lit(0), left) + F.col("_refill"))).alias("_f"))
    first = first.select("user_id", F.struct("_f.ts", "_f.event_id").alias("_at"), F.col("_f.col3").alias("state"))
    plain = spent.filter(~over).select(*charges.columns, F.greatest(F.lit(0), left).alias("_after"), F.lit(False).alias("_again"), "_refill")
    low = spent.filter(over).join(first, "user_id").withColumn("_is_first", F.struct(*order) == F.col("_at"))
    opening = low.filter("_is_first").select(*charges.columns, F.col("state").alias("_after"), F.lit(True).alias("_again"), "_refill")
    runs = cut_lineage(gathered(low.filter("not _is_first"), keys, order, ["_cost", "_limit", "_refill"]))
    names = [*keys, "_task", "_run"]

    def rule(rows: pa.ListArray, field: str) -> np.ndarray:
        told, _ = folds.padded(rows, field)
        return told[:, 0] if len(told) else np.zeros(0, dtype=np.int64)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("rows")
            limit, refill = rule(held, "_limit"), rule(held, "_refill")
            sizes = held.value_lengths().to_numpy().astype(np.int64)
            run = np.repeat(np.arange(len(held)), sizes)
            cost = held.flatten().field("_cost").to_numpy()
            found = folds.chained(folds.charge_maps(cost, limit[run], refill[run]), sizes, limit + refill)
            out = folds.to_bytes(found, limit + refill)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.binary())], names=[*names, "element"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("rows")
            cost, inside = folds.padded(held, "_cost")
            after, again = folds.charged(cost, batch.column("state").to_numpy(), rule(held, "_limit"), rule(held, "_refill"))
            owner = np.repeat(np.arange(len(held)), inside.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id").take(pa.array(owner)), held.flatten().field("event_id"), pa.array(after[inside]), pa.array(again[inside])],
                names=["user_id", "event_id", "_after", "_again"],
            )

    user, event = (charges.schema[c].dataType.simpleString() for c in ("user_id", "event_id"))
    elements = runs.mapInArrow(maps, f"user_id {user}, _task bigint, _run bigint, element binary")
    opened = starts(elements, keys, folds.compose_pieces, folds.move_by_pieces, first)
    begun = runs.join(opened, names).select(*names, "rows", "state")
    replayed = begun.mapInArrow(replay, f"user_id {user}, event_id {event}, _after bigint, _again boolean")
    later = low.filter("not _is_first").drop("state").join(replayed, ["user_id", "event_id"]).select(*charges.columns, "_after", "_again", "_refill")
    return plain.unionByName(opening).unionByName(later).select(
        *charges.columns, (F.col("_after") / UNITS).alias("balance_after"), F.when(F.col("_again"), F.col("_refill") / UNITS).otherwise(0.0).alias("renewal")
    )


def job_progress(docs: DataFrame) -> DataFrame:
    """Progress per job from its documents (job_id, done) and its phase (extracting, generating, billing, complete)."""
    counted = docs.groupBy("job_id").agg(
        F.count("*").alias("total_docs"), F.sum(F.col("done").cast("bigint")).alias("completed_docs"), F.max("phase").alias("phase")
    )
    phases = F.create_map(*[F.lit(x) for p in (("2_generating", 75), ("3_billing", 90), ("4_complete", 100)) for x in p])
    share = F.lit(5) + F.floor(F.col("completed_docs") * 65 / F.col("total_docs"))
    return counted.withColumn("progress", F.coalesce(F.try_element_at(phases, F.col("phase")), share).cast("int"))


def request_latency_report(requests: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per endpoint: requests, errors, exact rank percentiles, maximum, rate and load (endpoint, latency_ms, status, ts).

    Equal latencies are counted first; running counts over the distinct values give the ranks, so no row is ranked.
    """
    stats = requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"),
        F.sum((F.col("status") >= 400).cast("bigint")).alias("errors"),
        F.max("latency_ms").alias("max_ms"),
        F.avg("latency_ms").alias("avg_ms"),
        (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("_span"),
    )
    counted = requests.groupBy("endpoint", "latency_ms").agg(F.count("*").alias("_n"))
    ranked = running_total(counted, ["endpoint"], F.floor("latency_ms"), ["latency_ms"], {"place": F.col("_n")})
    joined = ranked.join(stats.select("endpoint", "requests"), "endpoint")

    def wanted(p: int) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col("requests") * p / 100))

    picks = joined.groupBy("endpoint").agg(
        *[F.min_by("latency_ms", F.when(F.col("place") >= wanted(p), F.col("place"))).alias(f"p{p}_ms") for p in percents]
    )
    rate = F.when(F.col("_span") > 0, F.col("requests") / (F.col("_span") / 1_000_000)).otherwise(0.0)
    return stats.join(picks, "endpoint").select(
        "endpoint", "requests", "errors", *[f"p{p}_ms" for p in percents], "max_ms", "avg_ms",
        rate.alias("rps"), (rate * F.col("avg_ms") / 1000).alias("capacity"),
    )
