"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators import inbound as I
from tabloom.operators import usage as G
from tabloom.streaming.state import KeyedTable


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace this batch's own folder, so a repeated batch leaves no double rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


PROCESSED = "file_id string, content_mark string"


def processed_files(spark: SparkSession, path: str) -> KeyedTable:
    """Recorded mark per file."""
    return KeyedTable(spark, path, PROCESSED, ["file_id"])


def ingest_folder(
    listings: DataFrame, process: Callable[[DataFrame], DataFrame], output: str, processed: str, checkpoint: str
) -> StreamingQuery:
    """Process new and changed files of listing snapshots (file_id, filename, content_mark, cycle).

    `process` turns listed files into rows with file_id and a boolean `done`; only files that are done get their mark
    recorded, so failed ones come again with the next listing. Output and marks are written per batch and a repeated
    batch overwrites itself.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("file_id").agg(F.max_by(F.struct(*batch.columns), "cycle").alias("f")).select("f.*")
        marks = processed_files(spark, processed)
        tagged = I.new_or_changed_files(newest, marks.read(batch_id, newest).withColumnRenamed("content_mark", "stored_mark"))
        todo = tagged.filter("state != 'processed'")
        _write_batch(process(todo), output, batch_id)
        # marks go last: they say that the output of their batch is complete
        done = spark.read.parquet(f"{output}/batch_id={batch_id}").filter("done").select("file_id").distinct()
        marks.write(todo.join(done, "file_id", "left_semi").select("file_id", "content_mark"), batch_id)

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


IDENTITY = ["user_id", "message_id", "sender", "filename", "file_size"]
STORED = "user_id bigint, message_id string, sender string, filename string, file_size bigint, job_id string"


def stored_identities(spark: SparkSession, path: str) -> KeyedTable:
    """What stored files are recognised by: the duplicate check reads this, by buckets of users, and no stored row."""
    return KeyedTable(spark, path, STORED, IDENTITY)


def ingest_messages(arrivals: DataFrame, keys: DataFrame, users: DataFrame, store: str, identities: str, checkpoint: str) -> StreamingQuery:
    """Route arriving files of messages, drop what their users already have, store the rest for seven days.

    arrivals: arrival_id, message_id, ts, sender, recipient columns, filename, file_size. Routing joins the stream with
    the key and user tables; the all-time duplicate check is an anti-join with the identities of the batch's users.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = stored_identities(spark, identities)
        mails = batch.select("arrival_id", "message_id", "ts", "sender", *I.RECIPIENTS).dropDuplicates(["arrival_id"])
        routed = I.route_mail(mails, keys, users).filter("user_id is not null").select("arrival_id", "user_id")
        files = batch.join(routed, "arrival_id").withColumn("sender", F.lower(F.trim("sender")))
        fresh = I.skip_duplicate_attachments(files, known.read(batch_id, routed))
        rows = fresh.select(
            "arrival_id", "user_id", "message_id", "sender", "filename", "file_size",
            (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(I.KEEP_DAYS))).alias("expires_at"),
            F.lit(None).cast("string").alias("job_id"),
        )
        _write_batch(rows, store, batch_id)
        # identities go last: they say that the output of their batch is complete
        stored = spark.read.parquet(f"{store}/batch_id={batch_id}")
        known.write(stored.select(*IDENTITY, "job_id").dropDuplicates(IDENTITY), batch_id)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent_stream(events: DataFrame, late: str | None = None) -> DataFrame:
    """First arrival per event id. Without `late` the ids are kept for ever; with it only within the watermark on `ts`."""
    if late is None:
        return events.dropDuplicates(["event_key"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_key"])


def _folded(
    rows: DataFrame, state: KeyedTable, output: str, checkpoint: str, fold: Callable[[DataFrame, DataFrame], DataFrame], after: str
) -> StreamingQuery:
    """Each trigger's rows go through a batch fold that starts from the states the triggers before left.

    `fold` takes the rows and the states (keys, state) and adds column `after`; the state of a key is its last value in (ts, event_id).
    Folds spread a hot key over tasks, so a trigger isn't bounded by its largest key.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        done = fold(batch, state.read(batch_id, batch))
        _write_batch(done, output, batch_id)
        told = batch.sparkSession.read.parquet(f"{output}/batch_id={batch_id}")
        last = told.groupBy(*state.keys).agg(F.max_by(after, F.struct("ts", "event_id")).alias("state"))
        state.write(last, batch_id)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counters(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "user_id bigint, period bigint, state bigint", ["user_id", "period"])


def admit_usage_stream(requests: DataFrame, output: str, state: str, checkpoint: str, mode: str = "new_excess") -> StreamingQuery:
    """Capped admission per user and period over a stream (columns as `usage.admit_usage`); triggers come in order of time."""

    def fold(rows: DataFrame, used: DataFrame) -> DataFrame:
        return G.admit_usage(rows, mode, used)

    return _folded(requests, _counters(requests.sparkSession, state), output, checkpoint, fold, "used_after")


def refund_usage_stream(events: DataFrame, output: str, state: str, checkpoint: str) -> StreamingQuery:
    """Counters with refunds over a stream (columns as `usage.refund_usage`); triggers come in order of time."""
    return _folded(events, _counters(events.sparkSession, state), output, checkpoint, G.refund_usage, "used_after")


def balance_stream(charges: DataFrame, users: DataFrame, output: str, state: str, checkpoint: str) -> StreamingQuery:
    """Balances and renewals over a stream (columns as `usage.balance_events`); triggers come in order of time."""
    table = KeyedTable(charges.sparkSession, state, "user_id bigint, state double", ["user_id"])

    def fold(rows: DataFrame, balances: DataFrame) -> DataFrame:
        now = users.join(balances, "user_id", "left").withColumn("balance", F.coalesce("state", "balance")).drop("state")
        return G.balance_events(rows, now)

    return _folded(charges, table, output, checkpoint, fold, "balance_after")


def job_progress_stream(docs: DataFrame) -> DataFrame:
    """Finished documents per job as they arrive; use output mode update or complete."""
    return docs.groupBy("job_id").agg(
        F.count("*").alias("total_docs"), F.sum(F.col("done").cast("bigint")).alias("completed_docs"),
        F.max("phase").alias("phase"),
    )


def latest_subscription_stream(events: DataFrame) -> DataFrame:
    """Last status-bearing event per customer as a running aggregate; use output mode update or complete."""
    return events.groupBy("customer").agg(
        F.max_by(F.struct("event_type", "tier", "status"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("events")
    ).select("customer", "last.*", "events")
