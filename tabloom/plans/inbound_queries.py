"""Inbound mail, folders, metering and subscriptions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import inbound as I
from tabloom.operators import usage as G
from tabloom.plans.bindings import table, with_clause
from tabloom.plans.catalog import query
from tabloom.plans.sqltext import q

NOW = "2024-01-15 12:00:00"
S_NOW = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "eligible_sender",
    f"{with_clause('mails')} SELECT arrival_id, sender, subject FROM mails WHERE NOT is_read AND has_attachments AND contains(lower(sender), 'corp1') AND contains(lower(subject), 'purchase')",
)
def _(spark, sf):
    return I.eligible_sender(table(spark, sf, "mails"), "Corp1", "purchase").select("arrival_id", "sender", "subject")


@query("alive_documents", f"{with_clause('stored_files')} SELECT doc_id, user_id, filename FROM stored_files WHERE expires_at > {S_NOW}")
def _(spark, sf):
    return I.alive_documents(table(spark, sf, "stored_files"), now()).select("doc_id", "user_id", "filename")


@query(
    "expire_documents",
    f"{with_clause('stored_files')} SELECT doc_id, job_id FROM stored_files WHERE NOT (expires_at < {S_NOW} AND job_id IS NULL)",
)
def _(spark, sf):
    return I.expire_documents(table(spark, sf, "stored_files"), now()).select("doc_id", "job_id")


@query(
    "assign_documents",
    f"""{with_clause('stored_files')} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new job' ELSE job_id END AS job_id,
    strftime(CASE WHEN doc_id % 5 = 0 THEN {S_NOW} + INTERVAL 7 DAY ELSE expires_at END, '%Y-%m-%d %H:%M:%S') AS expires_at FROM stored_files""",
)
def _(spark, sf):
    docs = table(spark, sf, "stored_files")
    chosen = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("new job").alias("job_id"))
    out = I.assign_documents(docs, chosen, now())
    return out.select("doc_id", "job_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


S_CAND = " || ".join(f"coalesce(regexp_extract_all(lower(coalesce({c}, '')), '\\+([a-z0-9_\\-]+)@', 1), [])" for c in I.RECIPIENTS)


@query(
    "route_mail",
    rf"""{with_clause('mails', 'mail_keys', 'users')}, tags AS (SELECT arrival_id, unnest(t) AS tag, unnest(range(len(t))) AS i FROM (SELECT arrival_id, {S_CAND} AS t FROM mails)),
    segs AS (SELECT arrival_id, i, unnest([tag] || string_split_regex(tag, '[-_]')) AS c, unnest(range(len([tag] || string_split_regex(tag, '[-_]')))) AS j FROM tags),
    hits AS (SELECT arrival_id, first(k.user_id ORDER BY i, j) AS key_user FROM segs JOIN mail_keys k ON lower(address_key) = c GROUP BY 1),
    boxes AS (SELECT lower(email) AS email, min(user_id) AS mail_user FROM users GROUP BY 1)
    SELECT arrival_id, CAST(coalesce(key_user, mail_user) AS VARCHAR) AS user_id, CASE WHEN key_user IS NOT NULL THEN 'address_key' WHEN mail_user IS NOT NULL THEN 'from_email' ELSE 'none' END AS matched_via
    FROM mails LEFT JOIN hits USING (arrival_id) LEFT JOIN boxes ON lower(trim(sender)) = boxes.email""",
)
def _(spark, sf):
    out = I.route_mail(table(spark, sf, "mails"), table(spark, sf, "mail_keys"), table(spark, sf, "users"))
    return out.select("arrival_id", F.col("user_id").cast("string"), "matched_via")


@query(
    "route_by_domain",
    f"""{with_clause('mails', 'users')}, s AS (SELECT arrival_id, lower(trim(sender)) AS s, split_part(lower(trim(sender)), '@', 2) AS d FROM mails)
    SELECT arrival_id, CASE WHEN d IN ({', '.join(map(q, X.PUBLIC_DOMAINS))}) THEN CAST(e.user_id AS VARCHAR) ELSE CAST(f.user_id AS VARCHAR) END AS user_id FROM s
    LEFT JOIN (SELECT lower(email) AS email, min(user_id) AS user_id FROM users GROUP BY 1) e ON e.email = s
    LEFT JOIN (SELECT split_part(lower(email), '@', 2) AS dom, first(user_id ORDER BY created_at, user_id) AS user_id FROM users GROUP BY 1) f ON f.dom = d""",
)
def _(spark, sf):
    return I.route_by_domain(table(spark, sf, "mails"), table(spark, sf, "users")).select("arrival_id", F.col("user_id").cast("string"))


# Walk of each user's arrivals over `f` (user_id, arrival_id, message_id, file key k): `got` lists the files stored.
S_ARRIVAL_WALK = """n AS MATERIALIZED (SELECT user_id, arrival_id, message_id, list(DISTINCT k) AS ks, row_number() OVER (PARTITION BY user_id ORDER BY arrival_id) AS pos FROM f GROUP BY 1, 2, 3),
    walk AS (SELECT user_id, arrival_id, pos, ks AS got, [message_id] AS mails, ks AS files FROM n WHERE pos = 1
      UNION ALL SELECT user_id, arrival_id, pos, got, CASE WHEN len(got) > 0 THEN list_append(mails, message_id) ELSE mails END, files || got FROM (
        SELECT n.*, mails, files, CASE WHEN list_contains(mails, n.message_id) THEN [] ELSE list_filter(n.ks, lambda k: NOT list_contains(files, k)) END AS got
        FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1))"""


@query(
    "skip_duplicate_attachments",
    f"""{with_clause('mail_files', 'stored_files').replace('WITH', 'WITH RECURSIVE', 1)}, f AS MATERIALIZED (SELECT n.*, concat_ws('|', sender, filename, file_size) AS k FROM mail_files n WHERE NOT EXISTS (SELECT 1 FROM stored_files s WHERE s.user_id = n.user_id AND s.message_id = n.message_id)
      AND NOT EXISTS (SELECT 1 FROM stored_files s WHERE s.user_id = n.user_id AND s.sender = n.sender AND s.filename = n.filename AND s.file_size = n.file_size AND s.job_id IS NULL)),
    {S_ARRIVAL_WALK}
    SELECT arrival_id, part, user_id, filename FROM f JOIN walk USING (user_id, arrival_id) WHERE list_contains(got, k)""",
)
def _(spark, sf):
    out = I.skip_duplicate_attachments(table(spark, sf, "mail_files"), table(spark, sf, "stored_files"))
    return out.select("arrival_id", "part", "user_id", "filename")


S_GROUP = f"CASE WHEN split_part(lower(sender), '@', -1) IN ({', '.join(map(q, X.CONSUMER_DOMAINS))}) THEN lower(sender) ELSE split_part(lower(sender), '@', -1) END"


@query(
    "inbox_groups",
    f"""{with_clause('stored_files')} SELECT user_id, {S_GROUP} AS sender_group, count(*) AS documents, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest_at FROM stored_files GROUP BY 1, 2""",
)
def _(spark, sf):
    return I.inbox_groups(table(spark, sf, "stored_files")).withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "inbox_listing",
    f"""{with_clause('stored_files')} SELECT doc_id, user_id, {S_GROUP} AS sender_group, count(*) OVER (PARTITION BY user_id, {S_GROUP}) AS documents FROM stored_files""",
)
def _(spark, sf):
    return I.inbox_listing(table(spark, sf, "stored_files")).select("doc_id", "user_id", "sender_group", "documents")


LISTING = "SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'h' || CAST(n_chars AS STRING) END AS content_mark FROM {documents}"
SEEN = "SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 = 0 THEN 'h0' ELSE 'h' || CAST(n_chars AS STRING) END AS stored_mark FROM {documents} WHERE doc_id % 3 <> 0"


@query(
    "new_or_changed_files",
    f"""WITH l AS ({LISTING.replace('{documents}', 'documents')}), p AS ({SEEN.replace('{documents}', 'documents')})
    SELECT l.file_id, content_mark, CASE WHEN p.file_id IS NULL THEN 'new' WHEN content_mark <> '' AND stored_mark <> content_mark THEN 'updated' ELSE 'processed' END AS state
    FROM l LEFT JOIN p USING (file_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return I.new_or_changed_files(spark.sql(LISTING, documents=docs), spark.sql(SEEN, documents=docs))


@query(
    "cap_recent",
    f"{with_clause('mails')} SELECT arrival_id, subject, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, arrival_id DESC) AS rank FROM mails QUALIFY rank <= 20",
)
def _(spark, sf):
    return I.cap_recent(table(spark, sf, "mails"), ["subject"]).select("arrival_id", "subject", F.col("rank").cast("bigint"))


RUNS = "SELECT user_id AS pipeline_id, event_id AS run_id, ts AS started FROM {events}"


@query("latest_runs", "SELECT user_id AS pipeline_id, event_id AS run_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def _(spark, sf):
    return I.latest_runs(spark.sql(RUNS, events=table(spark, sf, "events")), 3).select("pipeline_id", "run_id")


@query("page_of", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 40")
def _(spark, sf):
    return I.page_of(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 40, 500).select("event_id")


JOBS = "SELECT o_custkey AS user_id, o_orderkey AS job_id, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'queued' END AS status, 1 + o_orderkey % 3 AS file_count FROM {orders}"
JOB_DOCS = "SELECT l_orderkey AS job_id, l_linenumber AS doc_ord, 'part' || CAST(l_partkey AS STRING) || '.pdf' AS filename FROM {lineitem}"
S_JOBPAGE = f"""jobs AS ({JOBS.replace('{orders}', 'orders')}), page AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) AS job_rank,
      count(*) OVER (PARTITION BY user_id) AS total_jobs FROM jobs QUALIFY job_rank > 2 AND job_rank <= 7)"""


def _jobs(spark, sf):
    return spark.sql(JOBS, orders=table(spark, sf, "orders")), spark.sql(JOB_DOCS, lineitem=table(spark, sf, "lineitem"))


@query(
    "job_history",
    f"""WITH {S_JOBPAGE}, docs AS ({JOB_DOCS.replace('{lineitem}', 'lineitem')}) SELECT user_id, total_jobs, job_rank, job_id, status, CAST(doc_ord AS VARCHAR) AS doc_ord, filename FROM page LEFT JOIN docs USING (job_id)""",
)
def _(spark, sf):
    jobs, docs = _jobs(spark, sf)
    return I.job_history(jobs, docs, 2, 5).select("user_id", "total_jobs", F.col("job_rank").cast("bigint"), "job_id", "status", F.col("doc_ord").cast("string"), "filename")


@query(
    "user_stats",
    f"""WITH {S_JOBPAGE} SELECT user_id, max(total_jobs) AS total_jobs, CAST(sum(file_count) AS BIGINT) AS total_files,
    CAST(count(*) FILTER (WHERE status = 'complete') AS BIGINT) AS completed_jobs FROM page GROUP BY 1""",
)
def _(spark, sf):
    jobs, _ = _jobs(spark, sf)
    no_docs = spark.createDataFrame([], "job_id bigint, doc_ord int, filename string")
    return I.user_stats(I.job_history(jobs, no_docs, 2, 5))


ARRIVALS = "SELECT event_id AS arrival_id, CASE WHEN event_id % 4 = 1 THEN event_id - 1 ELSE event_id END AS event_key, event_type, value FROM {events}"


@query(
    "idempotent_events",
    f"WITH a AS ({ARRIVALS.replace('{events}', 'events')}) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY arrival_id) = 1",
)
def _(spark, sf):
    return I.idempotent_events(spark.sql(ARRIVALS, events=table(spark, sf, "events")))


# --- prices and plans ------------------------------------------------------------------------------------------------

DEFAULT_RATE = (1e-6, 2e-7, 3e-6)
S_PRICED = f"""rate AS MATERIALIZED (SELECT model, first(input_price ORDER BY length(model_key) DESC, model_key DESC) AS i, first(cached_price ORDER BY length(model_key) DESC, model_key DESC) AS c,
      first(output_price ORDER BY length(model_key) DESC, model_key DESC) AS o FROM (SELECT DISTINCT model FROM calls) JOIN prices ON contains(model, model_key) GROUP BY model),
    priced AS (SELECT calls.*, greatest(0, prompt_tokens - cached_tokens) * coalesce(i, {DEFAULT_RATE[0]}::DOUBLE) + cached_tokens * coalesce(c, {DEFAULT_RATE[1]}::DOUBLE)
      + completion_tokens * coalesce(o, {DEFAULT_RATE[2]}::DOUBLE) AS call_cost FROM calls LEFT JOIN rate USING (model))"""


def _priced(spark, sf):
    prices = table(spark, sf, "prices").select("model_key", *[F.col(c).cast("double") for c in ("input_price", "cached_price", "output_price")])
    return G.price_calls(table(spark, sf, "calls"), prices, DEFAULT_RATE)


@query(
    "price_calls",
    f"""{with_clause('calls', 'prices')}, {S_PRICED} SELECT model, count(*) AS calls, CAST(round(sum(call_cost), 6) AS DOUBLE) AS cost FROM priced GROUP BY model""",
)
def _(spark, sf):
    return _priced(spark, sf).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("call_cost"), 6).alias("cost"))


@query(
    "usage_cost",
    f"""{with_clause('calls', 'prices')}, {S_PRICED} SELECT job_id, CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(ocr_pages) AS BIGINT) AS ocr_pages, CAST(sum(greatest(0, removed_tokens)) AS BIGINT) AS removed_tokens,
    round_even((sum(call_cost) + sum(ocr_pages) * 0.001::DOUBLE + sum(greatest(0, removed_tokens)) * 5e-8::DOUBLE) * 1.2::DOUBLE, 6) AS cost_usd FROM priced GROUP BY job_id""",
)
def _(spark, sf):
    return G.usage_cost(_priced(spark, sf))


SUBS = """SELECT 'sub_' || CAST(c_custkey AS STRING) AS sub_id, CASE WHEN c_custkey % 3 = 0 THEN 'price_' || CAST(c_custkey % 12 AS STRING) END AS p1, 'price_' || CAST(c_custkey % 9 + 2 AS STRING) AS p2,
  CAST(CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 6900 WHEN 1 THEN 19900 WHEN 2 THEN 69900 ELSE 100 END AS BIGINT) AS a1, CASE WHEN c_custkey % 2 = 0 THEN 'month' ELSE 'year' END AS n1,
  CASE CAST(c_custkey % 7 AS INTEGER) WHEN 0 THEN 'pro' WHEN 1 THEN 'gold' WHEN 2 THEN 'free' END AS meta_tier, CASE WHEN c_custkey % 10 <> 0 THEN 'starter' END AS current_tier FROM {customer}"""
PRICE_MAP = "SELECT 'price_' || CAST(n_nationkey AS STRING) AS price_id, CASE WHEN n_nationkey = 3 THEN 'pro' ELSE 'business' END AS tier FROM {nation} WHERE n_nationkey IN (3, 6)"
S_RESOLVED = f"""s AS ({SUBS.replace('{customer}', 'customer')}), pm AS ({PRICE_MAP.replace('{nation}', 'nation')}),
    r AS (SELECT s.*, coalesce(x.tier, y.tier) AS price_tier, CASE WHEN meta_tier IN ('free', 'starter', 'pro', 'business') THEN meta_tier END AS meta,
      CASE WHEN n1 = 'month' THEN CASE a1 WHEN 6900 THEN 'starter' WHEN 19900 THEN 'pro' WHEN 69900 THEN 'business' END END AS amount_tier
      FROM s LEFT JOIN pm x ON x.price_id = p1 LEFT JOIN pm y ON y.price_id = p2)"""


def _resolved(spark, sf):
    subs = spark.sql(SUBS, customer=table(spark, sf, "customer"))
    def item(p, a, n):
        return F.struct(F.col(p).alias("price_id"), a.alias("unit_amount"), n.alias("interval"))
    items = F.array(item("p1", F.col("a1"), F.col("n1")), item("p2", F.lit(1).cast("bigint"), F.lit("month")))
    return G.resolve_tier(subs.withColumn("items", items), spark.sql(PRICE_MAP, nation=table(spark, sf, "nation")))


@query(
    "resolve_tier",
    f"""WITH {S_RESOLVED} SELECT sub_id, coalesce(price_tier, meta, amount_tier) AS resolved_tier, coalesce(price_tier, meta, amount_tier, current_tier) AS tier FROM r""",
)
def _(spark, sf):
    return _resolved(spark, sf).select("sub_id", "resolved_tier", "tier")


@query(
    "audit_tiers",
    f"""{with_clause('users')}, {S_RESOLVED} SELECT user_id, sub_id, subscription_tier AS stored_tier, coalesce(price_tier, meta) AS correct_tier FROM users JOIN r USING (sub_id)
    WHERE coalesce(price_tier, meta) IS NOT NULL AND subscription_tier IS DISTINCT FROM coalesce(price_tier, meta)""",
)
def _(spark, sf):
    return G.audit_tiers(table(spark, sf, "users"), _resolved(spark, sf))


S_CAP = "CASE {t} WHEN 'starter' THEN 800 WHEN 'pro' THEN 3000 WHEN 'business' THEN 10000 ELSE 100 END"
S_CAPU = S_CAP.format(t="subscription_tier")


@query(
    "usage_summary",
    f"""{with_clause('users')}, u AS (SELECT *, CASE WHEN subscription_tier = 'legacy' THEN 'free' ELSE subscription_tier END AS tier, CAST({S_CAPU} AS BIGINT) AS cap FROM users)
    SELECT user_id, tier, pages_used, cap AS pages_limit, round(least(pages_used::DOUBLE / cap * 100, 100), 6) AS usage_percent, pages_used >= cap AS at_limit,
      pages_used < cap AND pages_used::DOUBLE / cap * 100 >= 80 AS near_limit, CASE WHEN pages_used >= cap AND tier = 'free' THEN 'limit_reached_free' WHEN pages_used >= cap THEN 'limit_reached_paid'
      WHEN pages_used::DOUBLE / cap * 100 >= 80 THEN 'near_limit' END AS warning, CASE tier WHEN 'free' THEN 'starter' WHEN 'starter' THEN 'pro' WHEN 'pro' THEN 'business' END AS next_tier FROM u""",
)
def _(spark, sf):
    return G.usage_summary(table(spark, sf, "users")).withColumn("usage_percent", F.round("usage_percent", 6))


@query(
    "running_usage",
    f"{with_clause('requests')} SELECT event_id, CAST(sum(pages) OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS BIGINT) AS used_after FROM requests",
)
def _(spark, sf):
    return G.running_usage(table(spark, sf, "requests")).select("event_id", "used_after")


def s_admit(mode: str) -> str:
    over = {
        "cumulative_excess": "greatest(0, used_after - cap)",
        "new_excess": "greatest(0, used_after - greatest(used_after - pages, cap))",
        "full_request": "CASE WHEN used_after > cap THEN pages ELSE 0 END",
    }[mode]
    return f"""{with_clause('requests').replace('WITH', 'WITH RECURSIVE', 1)}, n AS MATERIALIZED (SELECT *, {S_CAP.format(t='tier')} AS cap, row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS pos,
        CASE WHEN tier IN ('starter', 'pro', 'business') THEN 'paid' ELSE 'free' END AS plan FROM requests),
    walk AS (SELECT user_id, period, event_id, pos, pages <= 100 AS ok, CASE WHEN pages <= 100 THEN pages ELSE 0 END AS used FROM n WHERE plan = 'free' AND pos = 1
      UNION ALL SELECT n.user_id, n.period, n.event_id, n.pos, w.used + n.pages <= 100, CASE WHEN w.used + n.pages <= 100 THEN w.used + n.pages ELSE w.used END
      FROM walk w JOIN n ON n.user_id = w.user_id AND n.period = w.period AND n.pos = w.pos + 1),
    paid AS (SELECT *, CAST(sum(pages) OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS BIGINT) AS used_after FROM n WHERE plan = 'paid')
    SELECT event_id, true AS admitted, used_after, CAST({over} AS BIGINT) AS overage_pages FROM paid UNION ALL SELECT event_id, ok, CAST(used AS BIGINT), CAST(0 AS BIGINT) FROM walk"""


def _admit(mode):
    def run(spark, sf):
        return G.admit_usage(table(spark, sf, "requests"), mode).select("event_id", "admitted", "used_after", "overage_pages")

    return run


query("admit_usage", s_admit("new_excess"))(_admit("new_excess"))
query("admit_usage_cumulative_excess", s_admit("cumulative_excess"))(_admit("cumulative_excess"))
query("admit_usage_full_request", s_admit("full_request"))(_admit("full_request"))


@query(
    "refund_usage",
    f"""{with_clause('refunds').replace('WITH', 'WITH RECURSIVE', 1)}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY ts, event_id) AS pos FROM refunds),
    walk AS (SELECT user_id, period, event_id, pos, greatest(0, pages) AS used FROM n WHERE pos = 1
      UNION ALL SELECT n.user_id, n.period, n.event_id, n.pos, greatest(0, w.used + n.pages) FROM walk w JOIN n ON n.user_id = w.user_id AND n.period = w.period AND n.pos = w.pos + 1)
    SELECT event_id, CAST(used AS BIGINT) AS used_after FROM walk""",
)
def _(spark, sf):
    return G.refund_usage(table(spark, sf, "refunds")).select("event_id", "used_after")


@query(
    "reset_period",
    f"""{with_clause('users')}, u AS (SELECT *, coalesce(usage_reset_at <= {S_NOW}, false) AS due FROM users) SELECT user_id, CASE WHEN due THEN 0 ELSE pages_used END AS pages_used,
    CASE WHEN due THEN 0 ELSE overage_pages END AS overage_pages, strftime(CASE WHEN due THEN CASE WHEN current_period_end > {S_NOW} THEN current_period_end ELSE {S_NOW} + INTERVAL 30 DAY END
      ELSE usage_reset_at END, '%Y-%m-%d %H:%M') AS usage_reset_at FROM u""",
)
def _(spark, sf):
    out = G.reset_period(table(spark, sf, "users"), now())
    return out.select("user_id", "pages_used", "overage_pages", F.date_format("usage_reset_at", "yyyy-MM-dd HH:mm").alias("usage_reset_at"))


@query(
    "subscription_state",
    f"""{with_clause('sub_events', 'users')}, k AS (SELECT e.* FROM sub_events e WHERE customer IN (SELECT customer FROM users)),
    p AS (SELECT *, last(CASE WHEN event_type = 'created' THEN event_id END IGNORE NULLS) OVER w AS open_id, last(CASE WHEN event_type = 'created' THEN sub_id END IGNORE NULLS) OVER w AS open_sub
      FROM k WINDOW w AS (PARTITION BY customer ORDER BY ts, event_id)),
    m AS (SELECT *, min(CASE WHEN event_type = 'deleted' THEN (ts, event_id) END) OVER (PARTITION BY customer, open_id) AS close_at FROM p WHERE sub_id = open_sub),
    live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts, event_id) AS n FROM m WHERE close_at IS NULL OR (ts, event_id) <= close_at),
    st AS (SELECT customer, arg_max(CASE WHEN event_type = 'deleted' THEN 'free' ELSE tier END, n) FILTER (WHERE event_type = 'deleted' OR (event_type IN ('created', 'updated') AND tier IS NOT NULL)) AS tier,
      arg_max(CASE WHEN event_type IN ('created', 'updated') THEN coalesce(status, 'active') WHEN event_type IN ('deleted', 'paid') THEN 'active' ELSE 'past_due' END, n) AS status,
      arg_max(event_type <> 'deleted' AND cancel, n) FILTER (WHERE event_type IN ('created', 'updated', 'deleted')) AS cancel_at_period_end,
      nullif(arg_max(CASE WHEN event_type = 'deleted' THEN '' ELSE strftime(period_end, '%Y-%m-%d') END, n) FILTER (WHERE event_type = 'deleted' OR (event_type IN ('created', 'updated', 'paid') AND period_end IS NOT NULL)), '') AS period_end,
      nullif(arg_max(CASE WHEN event_type = 'deleted' THEN '' ELSE sub_id END, n) FILTER (WHERE event_type IN ('created', 'deleted')), '') AS sub_id,
      strftime(max(ts) FILTER (WHERE event_type IN ('created', 'deleted', 'paid')), '%Y-%m-%d %H:%M:%S') AS counters_reset_at FROM live GROUP BY 1)
    SELECT customer, coalesce(tier, subscription_tier) AS tier, status, CAST(cancel_at_period_end AS VARCHAR) AS cancel_at_period_end, period_end, st.sub_id, counters_reset_at FROM users LEFT JOIN st USING (customer)""",
)
def _(spark, sf):
    users = table(spark, sf, "users").select("customer", F.col("subscription_tier").alias("tier"))
    out = G.subscription_state(table(spark, sf, "sub_events"), users)
    return out.withColumns({
        "cancel_at_period_end": F.col("cancel_at_period_end").cast("string"),
        "period_end": F.date_format("period_end", "yyyy-MM-dd"),
        "counters_reset_at": F.date_format("counters_reset_at", "yyyy-MM-dd HH:mm:ss"),
    })


@query(
    "balance_events",
    f"""{with_clause('charges', 'users').replace('WITH', 'WITH RECURSIVE', 1)}, n AS MATERIALIZED (SELECT c.*, balance::DOUBLE AS balance, auto_renew, threshold::DOUBLE AS threshold, refill::DOUBLE AS refill, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
      FROM charges c JOIN users USING (user_id)),
    walk AS (SELECT user_id, event_id, pos, greatest(0.0::DOUBLE, balance - cost) AS b, auto_renew AND greatest(0.0::DOUBLE, balance - cost) < threshold AS again, refill FROM n WHERE pos = 1
      UNION ALL SELECT n.user_id, n.event_id, n.pos, greatest(0.0::DOUBLE, w.b + CASE WHEN w.again THEN w.refill ELSE 0 END - n.cost),
        n.auto_renew AND greatest(0.0::DOUBLE, w.b + CASE WHEN w.again THEN w.refill ELSE 0 END - n.cost) < n.threshold, n.refill FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1)
    SELECT event_id, user_id, round(b + CASE WHEN again THEN refill ELSE 0 END, 4) AS balance_after, CASE WHEN again THEN refill ELSE 0 END AS renewal FROM walk""",
)
def _(spark, sf):
    users = table(spark, sf, "users").select(
        "user_id", "balance", "auto_renew", F.col("threshold").cast("double"), F.col("refill").cast("double")
    )
    out = G.balance_events(table(spark, sf, "charges"), users)
    return out.select("event_id", "user_id", F.round("balance_after", 4).alias("balance_after"), "renewal")


PROGRESS = """SELECT o_custkey AS job_id, o_orderstatus = 'F' AS done, CASE CAST(o_custkey % 6 AS INTEGER) WHEN 0 THEN '4_complete' WHEN 1 THEN '3_billing' WHEN 2 THEN '2_generating' ELSE '1_extracting' END AS phase FROM {orders}"""


@query(
    "job_progress",
    f"""WITH d AS ({PROGRESS.replace('{orders}', 'orders')}) SELECT job_id, count(*) AS total_docs, CAST(count(*) FILTER (WHERE done) AS BIGINT) AS completed_docs, max(phase) AS phase,
    CAST(CASE max(phase) WHEN '4_complete' THEN 100 WHEN '3_billing' THEN 90 WHEN '2_generating' THEN 75 ELSE 5 + floor(count(*) FILTER (WHERE done) * 65.0 / count(*)) END AS INTEGER) AS progress
    FROM d GROUP BY job_id""",
)
def _(spark, sf):
    return G.job_progress(spark.sql(PROGRESS, orders=table(spark, sf, "orders")))


CALLS_LOG = "SELECT event_type AS endpoint, value AS latency_ms, CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status, ts FROM {events}"


@query(
    "request_latency_report",
    f"""WITH c AS ({CALLS_LOG.replace('{events}', 'events')}), l AS (SELECT endpoint, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n, count(*) FILTER (WHERE status >= 400) AS errors,
      avg(latency_ms) AS a, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM c GROUP BY 1)
    SELECT endpoint, n AS requests, CAST(errors AS BIGINT) AS errors, v[greatest(1, n * 50 // 100)] AS p50_ms, v[greatest(1, n * 95 // 100)] AS p95_ms, v[greatest(1, n * 99 // 100)] AS p99_ms,
      v[-1] AS max_ms, round(a, 6) AS avg_ms, round(n / span, 6) AS rps, round(n / span * a / 1000, 6) AS capacity FROM l""",
)
def _(spark, sf):
    out = G.request_latency_report(spark.sql(CALLS_LOG, events=table(spark, sf, "events")))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_ms", "rps", "capacity")})


NAMES = """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '  ' WHEN c_custkey % 9 = 2 THEN 'José-María López' WHEN c_custkey % 9 = 3 THEN '日本 Taro'
  ELSE c_name || ' Smith' END AS name FROM {customer}"""


@query(
    "slug_name",
    f"""WITH n AS ({NAMES.replace('{customer}', 'customer')}), s AS (SELECT c_custkey, left(regexp_replace(strip_accents(lower(split_part(trim(coalesce(name, '')), ' ', 1))), '[^a-z0-9]+', '', 'g'), 12) AS s FROM n)
    SELECT c_custkey, CASE WHEN s = '' THEN 'user' ELSE s END AS slug FROM s""",
)
def _(spark, sf):
    return spark.sql(NAMES, customer=table(spark, sf, "customer")).select("c_custkey", X.slug_name("name").alias("slug"))
