"""Inbound mail and folders: routing, duplicate checks, expiry, inbox listing, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators.skew import attach_stats, top_per_key
from tabloom.session import cut_lineage

# Recipient columns in the order they are searched.
RECIPIENTS = ("delivered_to", "to_addr", "cc", "x_original_to", "envelope_to")
KEEP_DAYS = 7


def eligible_sender(messages: DataFrame, sender_contains: str = "", subject_contains: str = "") -> DataFrame:
    """Unread messages with attachments whose sender and subject contain the given texts."""
    kept = messages.filter((~F.col("is_read")) & F.col("has_attachments"))
    if sender_contains.strip():
        kept = kept.filter(F.lower("sender").contains(sender_contains.strip().lower()))
    if subject_contains.strip():
        kept = kept.filter(F.lower("subject").contains(subject_contains.strip().lower()))
    return kept


def alive_documents(docs: DataFrame, now: Column) -> DataFrame:
    return docs.filter(F.col("expires_at") > now)


def expire_documents(docs: DataFrame, now: Column) -> DataFrame:
    """What stays after a clean-up: everything but expired documents that no job has taken."""
    gone = (F.col("expires_at") < now) & F.col("job_id").isNull()
    return docs.filter(~F.coalesce(gone, F.lit(False)))


def assign_documents(docs: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """Give documents to a job (doc_id, job_id): they live another seven days."""
    picked = chosen.select("doc_id", F.col("job_id").alias("_job"))
    joined = docs.join(picked, "doc_id", "left")
    later = now + F.make_dt_interval(F.lit(KEEP_DAYS))
    taken = F.col("_job").isNotNull()
    return joined.select(
        *[
            F.when(taken, F.col("_job")).otherwise(F.col(c)).alias(c) if c == "job_id"
            else F.when(taken, later).otherwise(F.col(c)).alias(c) if c == "expires_at" else F.col(c)
            for c in docs.columns
        ]
    )


def recipient_candidates() -> Column:
    return F.array_distinct(F.flatten(F.array(*[X.tag_candidates(c) for c in RECIPIENTS])))


def route_mail(messages: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """User per message (arrival_id): the first routing candidate with an owner, else the exact sender address.

    keys: (address_key, user_id); users: (user_id, email). Columns added: user_id, matched_via.
    """
    owners = keys.groupBy(F.lower("address_key").alias("candidate")).agg(F.min("user_id").alias("owner"))
    listed = messages.select("arrival_id", F.posexplode(recipient_candidates()).alias("place", "candidate"))
    by_key = listed.join(owners, "candidate").groupBy("arrival_id").agg(F.min_by("owner", "place").alias("key_user"))
    mailbox = users.groupBy(F.lower("email").alias("sender_key")).agg(F.min("user_id").alias("mail_user"))
    joined = (
        messages.withColumn("sender_key", F.lower(X.strip("sender")))
        .join(by_key, "arrival_id", "left").join(mailbox, "sender_key", "left")
    )
    via = F.when(F.col("key_user").isNotNull(), "address_key").when(F.col("mail_user").isNotNull(), "from_email").otherwise("none")
    return joined.select(*messages.columns, F.coalesce("key_user", "mail_user").alias("user_id"), via.alias("matched_via"))


def route_by_domain(messages: DataFrame, users: DataFrame) -> DataFrame:
    """User per message: exact address for public mail domains, else the earliest user of the sender's domain."""
    sender = F.lower(X.strip("sender"))
    part = F.coalesce(F.get(F.split(sender, "@"), F.lit(1)), F.lit(""))
    public = part.isin(*X.PUBLIC_DOMAINS)
    mail = F.lower("email")
    exact = users.groupBy(mail.alias("route")).agg(F.min("user_id").alias("owner"))
    first = users.groupBy(F.concat(F.lit("@"), F.substring_index(mail, "@", -1)).alias("route")).agg(
        F.min_by("user_id", F.struct("created_at", "user_id")).alias("owner")
    )
    routed = messages.withColumn("route", F.when(public, sender).otherwise(F.concat(F.lit("@"), part)))
    return routed.join(exact.unionByName(first), "route", "left").select(*messages.columns, F.col("owner").alias("user_id"))


def skip_duplicate_attachments(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Attachments that are new to their user. Columns: arrival_id, user_id, message_id, sender, filename, file_size.

    Dropped: messages already stored for the user, files equal to a stored document without job, later copies of a
    message or file inside the batch, in order of arrival. A copy counts only if the earlier one is itself stored. Equal
    files of one message all stay. Rows with a null in a key have no copies by that key.

    A row that is first of its message and first of its file is stored whatever comes later, and ends its later copies.
    What is left waits for an earlier row that may yet be dropped, and is decided in the next round, with fewer rows.
    """
    file_key = ["user_id", "sender", "filename", "file_size"]
    waiting = existing.filter(F.col("job_id").isNull()).select(*file_key)
    fresh = new.join(existing.select("user_id", "message_id"), ["user_id", "message_id"], "left_anti").join(
        waiting, file_key, "left_anti"
    )
    mail_key = ["user_id", "message_id"]
    kept, open_rows = [], fresh
    while True:
        firsts = attach_stats(open_rows, mail_key, _mail=F.min("arrival_id"))
        firsts = attach_stats(firsts, file_key, _file=F.min("arrival_id"))
        first_mail = F.coalesce(F.col("_mail") == F.col("arrival_id"), F.lit(True))
        first_file = F.coalesce(F.col("_file") == F.col("arrival_id"), F.lit(True))
        judged = cut_lineage(firsts.select(*new.columns, first_mail.alias("_mail"), (first_mail & first_file).alias("_sure")))
        sure = judged.filter("_sure")
        kept.append(sure.select(new.columns))
        waiting_rows = judged.filter("not _sure").join(sure.select(file_key).distinct(), file_key, "left_anti")
        stored_mail = sure.select(mail_key).distinct()
        # other files of a stored arrival wait on; later arrivals of its message are copies
        later = waiting_rows.filter("not _mail").join(stored_mail, mail_key, "left_anti")
        open_rows = waiting_rows.filter("_mail").unionByName(later).select(new.columns)
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, kept)


def inbox_groups(docs: DataFrame) -> DataFrame:
    """Sender groups per user: number of documents and latest arrival. Sort by latest_at descending to list."""
    return docs.groupBy("user_id", X.group_key("sender").alias("sender_group")).agg(
        F.count("*").alias("documents"), F.max("created_at").alias("latest_at")
    )


def inbox_listing(docs: DataFrame) -> DataFrame:
    """Every document with its group's figures; a group's documents stay rows, so no group is gathered in one place.

    Order by user_id, latest_at desc, sender_group, created_at desc for the listing.
    """
    tagged = docs.withColumn("sender_group", X.group_key("sender"))
    return tagged.join(inbox_groups(docs), ["user_id", "sender_group"])


def new_or_changed_files(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Tag each listed file (file_id, content_mark) against processed (file_id, stored_mark): new, updated, processed."""
    joined = listing.join(processed.select("file_id", F.col("stored_mark"), F.lit(True).alias("_known")), "file_id", "left")
    changed = (F.col("content_mark") != "") & (F.coalesce("stored_mark", F.lit("")) != F.col("content_mark"))
    tag = F.when(F.col("_known").isNull(), "new").when(changed, "updated").otherwise("processed")
    return joined.select(*listing.columns, tag.alias("state"))


def cap_recent(messages: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The most recent n messages per mailbox and cycle."""
    return top_per_key(messages, keys, [F.desc("ts"), F.desc("arrival_id")], n)


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """Newest n runs per pipeline."""
    return top_per_key(runs, ["pipeline_id"], [F.desc("started"), F.desc("run_id")], n)


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """One page of an ordered listing; at most `most` rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def job_history(jobs: DataFrame, docs: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Page of each user's jobs, newest first, one row per job and file, with the user's total number of jobs."""
    totals = jobs.groupBy("user_id").agg(F.count("*").alias("total_jobs"))
    size = min(limit, 100)
    page = top_per_key(jobs, ["user_id"], [F.desc("created_at"), F.desc("job_id")], offset + size, "job_rank")
    shown = page.filter(F.col("job_rank") > offset).join(totals, "user_id")
    return shown.join(docs.select("job_id", "doc_ord", "filename"), "job_id", "left")


def user_stats(page: DataFrame) -> DataFrame:
    """Figures of a user's fetched job page: all jobs, files and finished jobs of the page."""
    return page.groupBy("user_id").agg(
        F.max("total_jobs").alias("total_jobs"),
        F.sum("file_count").alias("total_files"),
        F.sum((F.col("status") == "complete").cast("bigint")).alias("completed_jobs"),
    )


def idempotent_events(events: DataFrame) -> DataFrame:
    """First arrival of every event id."""
    return events.groupBy("event_key").agg(F.min_by(F.struct(*events.columns), "arrival_id").alias("_e")).select("_e.*")
