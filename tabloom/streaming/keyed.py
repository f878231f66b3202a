"""Streams with state per key and timers: subscriptions, counters that start anew, documents that expire."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tabloom.operators.inbound import KEEP_DAYS
from tabloom.operators.usage import PERIOD_DAYS

DAY_MS = 86_400_000

#: Groups that the keys of a stream are dealt to. A group's state is read, written and timed at once instead of key by key; a
#: checkpoint belongs to one number of groups.
GROUPS = 256


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state lives in the embedded state store, which keeps it on disk and not in the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _group(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group")


def _whole(value) -> int | None:
    """A number that came as a number or as text; pandas has NaN for null."""
    return None if pd.isna(value) else int(value)


def _given(value):
    return None if pd.isna(value) else value


def _events(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for frame in rows:
        yield from zip(*(frame[c].tolist() for c in columns))


class GroupFold(StatefulProcessor):
    """State of a group's keys as one text, with one timer at the earliest time of any key.

    Subclasses keep `self.held` (key to values), and say when a key is due in `due`.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.store = handle.getValueState("held", "keys string, timer bigint")

    def due(self, values: list) -> int | None:
        """Time in milliseconds from which a key's timer may go off."""
        return None

    def _load(self) -> None:
        text, self.timer = self.store.get() if self.store.exists() else ("[]", None)
        self.held = {tuple(key): values for key, values in json.loads(text)}

    def _save(self, fired: bool = False) -> None:
        """Write the state and set the timer; one that has gone off is gone."""
        following = min((t for t in map(self.due, self.held.values()) if t is not None), default=None)
        if self.timer is not None and self.timer != following and not fired:
            self.handle.deleteTimer(self.timer)
        if following is not None and (fired or following != self.timer):
            self.handle.registerTimer(following)
        if self.held:
            self.store.update((json.dumps(list(self.held.items())), following))
        elif self.store.exists():
            self.store.clear()


SUBSCRIPTION = "customer string, tier string, status string, cancel_at_period_end boolean, period_end bigint, sub_id string, counters_reset_at bigint"


class SubscriptionFold(GroupFold):
    """The open subscription of a customer, and the last setting of each attribute.

    An attribute that was set to null is in the state as null; one that was never set isn't in it. Times are microseconds.
    """

    COLUMNS = ["customer", "at", "event_id", "sub_id", "event_type", "tier", "status", "cancel", "end"]

    @staticmethod
    def _apply(state: dict, event: tuple) -> None:
        _, now, _, sub_id, kind, tier, status, cancel, end = event
        if kind == "created":
            state["open"] = state["sub_id"] = sub_id
        elif "open" not in state or state["open"] != sub_id:
            return
        if kind in ("created", "updated"):
            if tier:
                state["tier"] = tier
            state["status"] = status or "active"
            state["cancel"] = bool(cancel)
        elif kind == "deleted":
            state.update(tier="free", cancel=False, sub_id=None, period_end=None)
            del state["open"]
        if kind in ("deleted", "paid"):
            state["status"] = "active"
        if kind == "failed":
            state["status"] = "past_due"
        if kind in ("created", "updated", "paid") and end is not None:
            state["period_end"] = end
        if kind in ("created", "deleted", "paid"):
            state["reset"] = now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        # the events of one customer in one trigger, in order
        told: dict[str, list[tuple]] = {}
        for customer, at, event_id, sub_id, kind, tier, status, cancel, end in _events(rows, self.COLUMNS):
            told.setdefault(customer, []).append((
                customer, _whole(at), _whole(event_id), _given(sub_id), kind, _given(tier), _given(status), _given(cancel), _whole(end)
            ))
        out = []
        for customer, events in told.items():
            state = self.held.setdefault((customer,), {})
            for event in sorted(events, key=lambda e: tuple((v is not None, v or 0) for v in e[1:3])):
                self._apply(state, event)
            out.append((customer, *(state.get(name) or None for name in ("tier", "status")), state.get("cancel"), state.get("period_end"),
                        state.get("sub_id") or None, state.get("reset")))
        self._save()
        yield pd.DataFrame(out, columns=["customer", "tier", "status", "cancel_at_period_end", "period_end", "sub_id", "counters_reset_at"], dtype=object)


def subscription_stream(events: DataFrame, users: DataFrame) -> DataFrame:
    """State per customer after each trigger that has events of theirs, as `usage.subscription_state` folds them.

    events: customer, sub_id, event_type, ts, event_id, tier, status, cancel, period_end; users: customer. Triggers must come in
    order; inside a trigger any order will do. Use output mode update: the last row of a customer stands, a null tier means the
    stored one.
    """
    use_keyed_state(events.sparkSession)
    known = events.join(users.select("customer").distinct(), "customer", "left_semi").select(
        _group("customer"), "customer", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("event_id"), "sub_id", "event_type",
        "tier", "status", "cancel", F.unix_micros(F.col("period_end").cast("timestamp")).alias("end"),
    )
    told = known.groupBy("_group").transformWithStateInPandas(SubscriptionFold(), SUBSCRIPTION, "Update", "None")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("period_end", "counters_reset_at")})


COUNTERS = "user_id string, pages_used bigint, overage_pages bigint, usage_reset_at bigint, current_period_end bigint"


class ResetCounters(GroupFold):
    """Counters of users: used, overage, reset time, end of the period; at the reset time they go to zero and the time anew."""

    COLUMNS = ["user_id", "at", "used", "overage", "reset", "period"]

    def due(self, values: list) -> int | None:
        return values[2]

    @staticmethod
    def _rows(told: dict) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(
            [(*key, *values) for key, values in told.items()],
            columns=["user_id", "pages_used", "overage_pages", "usage_reset_at", "current_period_end"], dtype=object,
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        last: dict[tuple, tuple] = {}
        for user, at, *counters in _events(rows, self.COLUMNS):
            if (user,) not in last or at > last[(user,)][0]:
                last[(user,)] = (at, counters)
        told = {user: [_whole(c) for c in counters] for user, (_, counters) in last.items()}
        self.held.update(told)
        self._save()
        yield from self._rows(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now, told = timerValues.getCurrentWatermarkInMs(), {}
        for user, (_, _, reset, period) in self.held.items():
            if reset is not None and reset <= now:
                told[user] = [0, 0, period if period is not None and period > now else now + PERIOD_DAYS * DAY_MS, period]
        self.held.update(told)
        self._save(fired=True)
        yield from self._rows(told)


def reset_period_stream(users: DataFrame) -> DataFrame:
    """Counters of users (user_id, ts, pages_used, overage_pages, usage_reset_at, current_period_end) as they come, and again
    whenever the clock, the latest `ts` of the stream, has reached their reset time: then they are zero.
    """
    use_keyed_state(users.sparkSession)
    # numbers travel as text: pandas would make floats of those with nulls among them
    clocked = users.withWatermark("ts", "0 seconds").select(
        _group("user_id"), F.col("user_id").cast("string").alias("user_id"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("pages_used").cast("string").alias("used"), F.col("overage_pages").cast("string").alias("overage"),
        F.unix_millis(F.col("usage_reset_at").cast("timestamp")).alias("reset"), F.unix_millis(F.col("current_period_end").cast("timestamp")).alias("period"),
    )
    told = clocked.groupBy("_group").transformWithStateInPandas(ResetCounters(), COUNTERS, "Update", "EventTime")
    return told.withColumns({"user_id": F.col("user_id").cast("bigint"), **{c: F.timestamp_millis(c) for c in ("usage_reset_at", "current_period_end")}})


GONE = "kind string, item_id string, expires_at bigint, clock bigint"


class ExpireItems(GroupFold):
    """When items expire and whether a job has taken them; the timer lets them go."""

    COLUMNS = ["kind", "item_id", "event", "at", "expires", "job_id"]

    def due(self, values: list) -> int | None:
        return None if values[0] is None else values[0] + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for kind, item, event, at, expires, job in sorted(_events(rows, self.COLUMNS), key=lambda e: (e[3], e[2] == "assigned")):
            if event == "stored":
                self.held[(kind, item)] = [_whole(expires), _given(job)]
            elif event == "assigned" and (kind, item) in self.held:
                self.held[(kind, item)] = [int(at) // 1000 + KEEP_DAYS * DAY_MS, _given(job)]
        self._save()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now = timerValues.getCurrentWatermarkInMs()
        over = [item for item, values in self.held.items() if self.due(values) is not None and self.due(values) <= now]
        gone = [(item, *self.held.pop(item)) for item in over]
        self._save(fired=True)
        deleted = [(*item, expires, now) for item, expires, job in gone if job is None]
        if deleted:
            yield pd.DataFrame(deleted, columns=["kind", "item_id", "expires_at", "clock"])


def expire_stream(items: DataFrame) -> DataFrame:
    """What is deleted, as the clock (the latest `ts` of the stream) goes on: documents and upload sessions whose time is over.

    items: kind ('document' or 'session'), item_id, event ('stored' or 'assigned'), ts, expires_at, job_id. An assigned document
    lives seven days from its assignment and isn't deleted; its state goes then. Times count in whole milliseconds.
    """
    use_keyed_state(items.sparkSession)
    # other events move the clock only; a filter here would be pushed below the watermark and hide them from it
    clocked = items.withWatermark("ts", "0 seconds").select(
        _group("kind", "item_id"), "kind", F.col("item_id").cast("string").alias("item_id"), "event", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.unix_millis(F.col("expires_at").cast("timestamp")).alias("expires"), "job_id",
    )
    told = clocked.groupBy("_group").transformWithStateInPandas(ExpireItems(), GONE, "Append", "EventTime")
    return told.select("kind", F.col("item_id").cast("bigint").alias("item_id"), *[F.timestamp_millis(c).alias(c) for c in ("expires_at", "clock")])
