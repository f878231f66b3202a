"""Streaming forms, run to the end of the given tables and compared with their batch meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.bindings import spark_text, table, with_clause
from tabloom.plans.catalog import ORACLES, query
from tabloom.plans.inbound_queries import ARRIVALS, NOW, PROGRESS, S_ARRIVAL_WALK, S_NOW, s_admit
from tabloom.session import cut_lineage, scratch_path
from tabloom.functions import expr as X
from tabloom.streaming import jobs, keyed


class Feed:
    """Parts of a table that arrive one after the other: each is written whole, then the stream runs until it has read it."""

    def __init__(self, parts: list[DataFrame], name: str):
        self.spark = parts[0].sparkSession
        self.parts, self.path = parts, scratch_path(self.spark, name)

    def run(self, start: Callable[[DataFrame], StreamingQuery]) -> None:
        """`start` starts the same query, with the same checkpoint, on the stream."""
        for part in self.parts:
            part.write.mode("append").parquet(self.path)
            start(self.spark.readStream.schema(part.schema).parquet(self.path)).awaitTermination()


def sliced(df: DataFrame, name: str, order: str, slices: int = 3) -> Feed:
    """A table in `order`, in parts of about the same size."""
    kind = df.schema[order].dataType.typeName()
    place = (F.col(order).cast("timestamp") if kind.startswith("timestamp") else F.col(order)).cast("double")
    bounds = df.select(place.alias("v")).approxQuantile("v", [k / slices for k in range(1, slices)], 0.01) or [0.0] * (slices - 1)
    edges = [float("-inf"), *bounds, float("inf")]
    return Feed([df.filter((place > low) & (place <= high)) for low, high in zip(edges[:-1], edges[1:])], name)


def run_to_end(feed: Feed, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run a streaming query over all parts and return what it wrote."""
    spark = feed.spark
    out, marks = scratch_path(spark, "out"), scratch_path(spark, "marks")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    feed.run(
        lambda rows: build(rows).writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start()
    )
    return spark.read.parquet(out).drop("b")


def fold_to_end(feed: Feed, start: Callable[[DataFrame, str, str, str], StreamingQuery]) -> DataFrame:
    """Run a query that writes its own output and state over all parts, and return the output."""
    spark = feed.spark
    out, state, marks = (scratch_path(spark, n) for n in ("out", "state", "marks"))
    feed.run(lambda rows: start(rows, out, state, marks))
    return spark.read.parquet(out)


@query(
    "idempotent_stream",
    f"WITH a AS ({ARRIVALS.replace('{events}', 'events')}) SELECT DISTINCT event_key FROM a",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = spark.sql(ARRIVALS, events=table(spark, sf, "events"))
    return run_to_end(sliced(arrivals, "arrivals", "arrival_id"), jobs.idempotent_stream).select("event_key")


@query("admit_usage_stream", f"SELECT event_id, admitted, used_after FROM ({s_admit('new_excess')})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    feed = sliced(table(spark, sf, "requests"), "requests", "ts")
    return fold_to_end(feed, jobs.admit_usage_stream).select("event_id", "admitted", "used_after")


@query("refund_usage_stream", ORACLES["refund_usage"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fold_to_end(sliced(table(spark, sf, "refunds"), "refunds", "ts"), jobs.refund_usage_stream).select("event_id", "used_after")


@query("balance_stream", ORACLES["balance_events"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "users").select("user_id", "balance", "auto_renew", F.col("threshold").cast("double"), F.col("refill").cast("double"))
    out = fold_to_end(sliced(table(spark, sf, "charges"), "charges", "ts"), lambda rows, *places: jobs.balance_stream(rows, users, *places))
    return out.select("event_id", "user_id", F.round("balance_after", 4).alias("balance_after"), "renewal")


@query(
    "job_progress_stream",
    f"""WITH d AS ({PROGRESS.replace('{orders}', 'orders')}) SELECT job_id, count(*) AS total_docs, CAST(count(*) FILTER (WHERE done) AS BIGINT) AS completed_docs, max(phase) AS phase FROM d GROUP BY job_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.sql(PROGRESS, orders=table(spark, sf, "orders"))
    updates = run_to_end(sliced(docs, "docs", "job_id"), jobs.job_progress_stream, "update")
    # the last update of a job stands
    return updates.groupBy("job_id").agg(F.max_by(F.struct("total_docs", "completed_docs", "phase"), "_batch").alias("u")).select("job_id", "u.*")


@query(
    "latest_subscription_stream",
    f"""{with_clause('sub_events')} SELECT customer, event_type, tier, status, count(*) OVER (PARTITION BY customer) AS events FROM sub_events
    QUALIFY row_number() OVER (PARTITION BY customer ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    updates = run_to_end(sliced(table(spark, sf, "sub_events"), "subs", "event_id"), jobs.latest_subscription_stream, "update")
    last = updates.groupBy("customer").agg(F.max_by(F.struct("event_type", "tier", "status", "events"), "_batch").alias("u"))
    return last.select("customer", "u.*")


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Subscription events with their JSON: the period end on the item, on top level, as text, or behind a zero on the item."""
    epoch = F.coalesce(F.unix_timestamp("period_end").cast("string"), F.lit("null"))
    shapes = (
        ('{"items":{"data":[]},"current_period_end":', '}'),
        ('{"items":{"data":[{"current_period_end":', '},{"current_period_end":1}]}}'),
        ('{"items":{"data":[{"current_period_end":0}]},"current_period_end":"', '"}'),
        ('{"items":{"data":[{"id":"x","current_period_end":', '}]}}'),
    )
    told = F.concat(F.lit(shapes[3][0]), epoch, F.lit(shapes[3][1]))
    for k, (before, after) in enumerate(shapes[:3]):
        told = F.when(F.col("event_id") % 4 == k, F.concat(F.lit(before), epoch, F.lit(after))).otherwise(told)
    return table(spark, sf, "sub_events").withColumn("payload", told).drop("period_end")


@query("period_end", f"{with_clause('sub_events')} SELECT event_id, strftime(period_end, '%Y-%m-%d %H:%M') AS period_end FROM sub_events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _payloads(spark, sf).select("event_id", F.date_format(X.period_end("payload"), "yyyy-MM-dd HH:mm").alias("period_end"))


@query("subscription_stream", ORACLES["subscription_state"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "users").select("customer", "subscription_tier")
    events = _payloads(spark, sf).withColumn("period_end", X.period_end("payload")).drop("payload")
    updates = run_to_end(sliced(events, "subscriptions", "ts"), lambda rows: keyed.subscription_stream(rows, users), "update")
    last = updates.groupBy("customer").agg(F.max_by(F.struct(*[c for c in updates.columns if c not in ("customer", "_batch")]), "_batch").alias("s"))
    return users.join(last, "customer", "left").select(
        "customer", F.coalesce("s.tier", "subscription_tier").alias("tier"), "s.status", F.col("s.cancel_at_period_end").cast("string").alias("cancel_at_period_end"),
        F.date_format("s.period_end", "yyyy-MM-dd").alias("period_end"), "s.sub_id", F.date_format("s.counters_reset_at", "yyyy-MM-dd HH:mm:ss").alias("counters_reset_at"),
    )


@query("reset_period_stream", ORACLES["reset_period"])
def _(spark: SparkSession, sf: str) -> DataFrame:
    shape = ["user_id", "ts", "pages_used", "overage_pages", "usage_reset_at", "current_period_end"]
    users = table(spark, sf, "users").withColumn("ts", F.to_timestamp(F.lit("2023-12-01"))).select(*shape)
    tick = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("user_id"), F.to_timestamp(F.lit(NOW)).alias("ts"), F.lit(0).cast("bigint").alias("pages_used"), F.lit(0).cast("bigint").alias("overage_pages"),
        F.lit(None).cast("timestamp").alias("usage_reset_at"), F.lit(None).cast("timestamp").alias("current_period_end"),
    )
    updates = run_to_end(Feed([users, tick], "users"), keyed.reset_period_stream, "update").filter("user_id >= 0")
    last = updates.groupBy("user_id").agg(F.max_by(F.struct("pages_used", "overage_pages", "usage_reset_at"), "_batch").alias("u")).select("user_id", "u.*")
    return last.withColumn("usage_reset_at", F.date_format("usage_reset_at", "yyyy-MM-dd HH:mm"))


CLOCKS = ("2024-01-09 06:00:00", NOW, "2024-02-20 00:00:00")
S_CLOCKS = "(VALUES " + ", ".join(f"(TIMESTAMP '{c}')" for c in CLOCKS) + ") c(clock)"


@query(
    "expire_documents_stream",
    f"""{with_clause('stored_files')}, items AS (
      SELECT 'document' AS kind, doc_id AS item_id, created_at AS ts, expires_at, job_id, doc_id % 5 = 0 AND job_id IS NULL AS later FROM stored_files
      UNION ALL SELECT 'session', event_id, ts, ts + INTERVAL 1 HOUR, NULL, false FROM events WHERE event_id % 6 = 1)
    SELECT kind, item_id, strftime(clock, '%Y-%m-%d') AS clock FROM items, {S_CLOCKS}
    WHERE ts <= clock AND NOT (expires_at < clock AND job_id IS NULL AND NOT (later AND ts + INTERVAL 3 DAY <= clock))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Items that are there at each clock time: those that came by then, without what the stream deleted by then."""
    nothing = F.lit(None).cast("string")
    files = table(spark, sf, "stored_files").select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), F.lit("stored").alias("event"), F.col("created_at").alias("ts"), "expires_at", "job_id")
    sessions = table(spark, sf, "events").filter("event_id % 6 = 1").select(
        F.lit("session").alias("kind"), F.col("event_id").alias("item_id"), F.lit("stored").alias("event"), "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), nothing.alias("job_id")
    )
    taken = files.filter("item_id % 5 = 0 and job_id is null").withColumns({
        "event": F.lit("assigned"), "ts": F.col("ts") + F.expr("INTERVAL 3 DAY"), "expires_at": F.lit(None).cast("timestamp"), "job_id": F.lit("new job"),
    })
    stored = files.unionByName(sessions)
    items = cut_lineage(stored.unionByName(taken))
    parts, begun = [], F.to_timestamp(F.lit("1970-01-01"))
    for told in CLOCKS:
        clock = F.to_timestamp(F.lit(told))
        tick = spark.range(1).select(F.lit("tick").alias("kind"), F.col("id").alias("item_id"), F.lit("tick").alias("event"), clock.alias("ts"), clock.alias("expires_at"), nothing.alias("job_id"))
        parts.append(items.filter((F.col("ts") > begun) & (F.col("ts") <= clock)).unionByName(tick))
        begun = clock
    gone = run_to_end(Feed(parts, "items"), keyed.expire_stream)
    clocks = spark.createDataFrame([(c,) for c in CLOCKS], "clock string").withColumn("clock", F.to_timestamp("clock"))
    there = stored.join(F.broadcast(clocks), F.col("ts") <= F.col("clock")).select("kind", "item_id", "clock")
    dead = gone.select(F.col("kind").alias("_kind"), F.col("item_id").alias("_item"), F.col("clock").alias("_gone"))
    left = there.join(dead, (F.col("kind") == F.col("_kind")) & (F.col("item_id") == F.col("_item")) & (F.col("_gone") <= F.col("clock")), "left_anti")
    return left.select("kind", "item_id", F.date_format("clock", "yyyy-MM-dd").alias("clock"))


LISTED = """SELECT CAST(doc_id AS STRING) AS file_id, 'f' || CAST(doc_id AS STRING) AS filename, CAST(cycle AS BIGINT) AS cycle,
  'h' || CAST(CASE WHEN doc_id % 4 = 0 THEN cycle ELSE 0 END AS STRING) AS content_mark
  FROM (SELECT *, EACH(1, 2, 3) AS cycle FROM {documents}) c WHERE NOT (cycle = 1 AND doc_id % 3 = 0)"""


@query(
    "ingest_folder",
    """WITH c AS (SELECT doc_id, unnest([1, 2, 3]) AS cycle FROM documents), l AS (SELECT * FROM c WHERE NOT (cycle = 1 AND doc_id % 3 = 0))
    SELECT CAST(doc_id AS VARCHAR) AS file_id, 'h' || CASE WHEN doc_id % 4 = 0 THEN cycle ELSE 0 END AS content_mark, doc_id % 5 <> 0 OR cycle = 3 AS done FROM l
    WHERE cycle = CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END OR doc_id % 4 = 0 OR (doc_id % 5 = 0)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.sql(spark_text(LISTED), documents=table(spark, sf, "documents"))
    feed = Feed([listed.filter(F.col("cycle") == cycle) for cycle in (1, 2, 3)], "listing")

    def process(files: DataFrame) -> DataFrame:
        return files.select("file_id", "content_mark", ((F.col("file_id").cast("bigint") % 5 != 0) | (F.col("cycle") == 3)).alias("done"))

    out = fold_to_end(feed, lambda rows, *places: jobs.ingest_folder(rows, process, *places))
    return out.select("file_id", "content_mark", "done")


MAIL_STREAM = """SELECT m.arrival_id, m.message_id, m.ts, m.sender, delivered_to, to_addr, cc, x_original_to, envelope_to, filename, file_size
  FROM {mails} m JOIN {mail_files} f ON m.arrival_id = f.arrival_id"""


@query(
    "ingest_messages",
    f"""WITH RECURSIVE r AS ({ORACLES['route_mail']}), f AS MATERIALIZED (SELECT a.arrival_id, CAST(user_id AS BIGINT) AS user_id, message_id, filename, file_size, concat_ws('|', sender, filename, file_size) AS k FROM (
      {with_clause('mails', 'mail_files')} SELECT m.arrival_id, m.message_id, lower(trim(m.sender)) AS sender, filename, file_size FROM mails m JOIN mail_files f ON m.arrival_id = f.arrival_id) a
      JOIN r ON r.arrival_id = a.arrival_id WHERE user_id IS NOT NULL),
    {S_ARRIVAL_WALK}
    SELECT arrival_id, user_id, f.message_id, filename, file_size FROM f JOIN walk USING (user_id, arrival_id) WHERE list_contains(got, k)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(MAIL_STREAM, mails=table(spark, sf, "mails"), mail_files=table(spark, sf, "mail_files"))
    keys, users = table(spark, sf, "mail_keys"), table(spark, sf, "users")
    stored = fold_to_end(sliced(rows, "mails", "arrival_id"), lambda arrivals, *places: jobs.ingest_messages(arrivals, keys, users, *places))
    return stored.select("arrival_id", "user_id", "message_id", "filename", "file_size")
