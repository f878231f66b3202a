"""The tables the queries work on, derived from the given parquet tables.

A binding is one SELECT that Spark and the checking database both understand, so both sides read the same rows.
`{name}` stands for a given table or another binding, STR_LIST(text, mark) for splitting at a plain mark,
EACH(a, b, ...) for one row per value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "labels", "conversations", "benchmark",
)

BINDINGS: dict[str, str] = {}


def binding(name: str, text: str) -> None:
    BINDINGS[name] = text.strip()


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def plain(text: str) -> str:
    """Text for the checking database."""
    text = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("STR_LIST(", "string_split(")
    text = re.sub(r"EACH\(([^()]*)\)", r"unnest([\1])", text)
    return text.replace("{{", "{").replace("}}", "}")


def spark_text(text: str) -> str:
    """Text for Spark."""
    return re.sub(r"EACH\(([^()]*)\)", r"explode(array(\1))", text).replace("STR_LIST(", "split(").replace("* EXCLUDE (", "* EXCEPT (")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a binding over given tables."""
    if name in BINDINGS:
        text = spark_text(BINDINGS[name])
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_clause(*names: str) -> str:
    """WITH clause that defines the bindings, and those they build on, for the checking database."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BINDINGS and name not in ordered:
            for inner in _names(BINDINGS[name]):
                visit(inner)
            ordered.append(name)

    for name in names:
        visit(name)
    # named tables are read by name; materialised so that the checking database computes each binding once
    parts = [f"{n} AS MATERIALIZED ({plain(BINDINGS[n])})" for n in ordered]
    return "WITH " + ",\n".join(parts)


# Order records: customers' nation is the scope, blanks and odd values follow from the order key.
RECORD_FIELDS = ["order_number", "customer_name", "order_date", "total_amount", "segment", "priority"]
binding("recs", """
SELECT 'S' || CAST(c_nationkey AS STRING) AS scope_id, o_orderkey AS row_ord,
  'file_' || CAST(o_orderkey % 5 AS STRING) || '.pdf' AS source_file,
  CASE WHEN o_orderkey % 53 = 0 THEN 'failed' END AS error,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ' N/A ' ELSE CAST(o_orderkey AS STRING) END AS order_number,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
    WHEN o_orderkey % 31 = 0 THEN c_name || ', which is derived from the sum of all of the other orders placed earlier by the same buyer'
    ELSE ' ' || c_name || '  ' END AS customer_name,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'unknown' WHEN o_orderkey % 29 = 0 THEN 'someday'
    ELSE lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING) END AS order_date,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '(' || printf('%.2f', o_totalprice) || ')'
    WHEN o_orderkey % 23 = 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' million'
    WHEN o_orderkey % 37 = 0 THEN 'see note' WHEN o_orderkey % 41 = 0 THEN '100 + 20'
    ELSE '$' || printf('%.2f', o_totalprice) END AS total_amount,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '-' ELSE c_mktsegment END AS segment,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""")

# Schedule rows: several rows per customer, each with other gaps; serials tell rows of some customers apart.
ENTITY_FIELDS = ["asset_id", "street_address", "city", "listed_on", "amount", "segment", "serial", "Loc #", "Location Name"]
binding("sched", """
SELECT 'S' || CAST(o_custkey % 24 AS STRING) AS scope_id, o_orderkey AS row_ord,
  'file_' || CAST(o_orderkey % 3 AS STRING) || '.pdf' AS source_file,
  CASE WHEN o_orderkey % 97 = 0 THEN 'failed' END AS error,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'C-' || CAST(o_custkey AS STRING) END AS asset_id,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey % 997 + 1 AS STRING) || ' Market  Street' END AS street_address,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Town ' || CAST(o_custkey % 11 AS STRING) END AS city,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'day ' || CAST(day(o_orderdate) AS STRING) || ' of ' || CAST(year(o_orderdate) AS STRING) END AS listed_on,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '$' || printf('%.2f', o_totalprice) END AS amount,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 5 = 2 THEN o_orderpriority ELSE '-' END AS segment,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_custkey % 5 < 3 THEN 'SN ' || CAST(o_orderkey AS STRING) END AS serial,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 8 = 3 THEN CAST(o_custkey % 4 AS STRING) END AS `Loc #`,
  CAST(NULL AS STRING) AS `Location Name`
FROM {orders}
""".replace("`Loc #`", "loc_no").replace("`Location Name`", "loc_name"))
ENTITY_FIELDS = ["asset_id", "street_address", "city", "listed_on", "amount", "segment", "serial", "loc_no", "loc_name"]

# Baseline table and newly extracted rows of the same customers.
UPSERT_FIELDS = ["location_number", "street_address", "city", "state", "zip", "building_values"]
_PLACE = """
  CAST(c_custkey % 500 AS STRING) || ' Main St.' AS street_address, 'City ' || CAST(c_nationkey AS STRING) AS city,
  CASE WHEN c_custkey % 30 = 0 THEN '' ELSE 'ST' || CAST(c_nationkey % 7 AS STRING) END AS state,
  CASE WHEN c_custkey % 20 = 0 OR c_custkey % 30 = 0 THEN 'n/a' ELSE lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') END AS zip,"""
binding("base", f"""
SELECT 'S' || CAST(c_nationkey AS STRING) AS scope_id, c_custkey AS row_ord, 'old.csv' AS source_file,
  CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 17 = 0 THEN 'twin ' || CAST(c_custkey % 5 AS STRING)
    ELSE 'L-' || CAST(c_custkey AS STRING) END AS location_number, {_PLACE}
  printf('%.2f', c_acctbal) AS building_values, c_mktsegment AS owner_note,
  CASE WHEN c_custkey % 13 = 0 THEN 'checked' END AS record_status
FROM {{customer}}
""")
binding("fresh", f"""
SELECT 'S' || CAST(c_nationkey AS STRING) AS scope_id, c_custkey * 4 + copy_no AS row_ord,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'new_' || CAST(c_custkey % 4 AS STRING) || '.pdf' END AS source_file,
  CASE WHEN c_nationkey = 5 OR c_custkey % 41 = 0 THEN 'failed' END AS error,
  CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'twin ' || CAST(c_custkey % 5 AS STRING)
    WHEN copy_no = 3 THEN 'L-' || CAST(c_custkey + 100000000 AS STRING)
    ELSE ' l ' || CAST(c_custkey AS STRING) || ' ' END AS location_number, {_PLACE}
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE printf('%.2f', c_acctbal + 10 + copy_no) END AS building_values
FROM (SELECT *, EACH(0, 1, 3) AS copy_no FROM {{customer}}) c
WHERE c_custkey % 3 <> 0 AND c_nationkey <> 4 AND NOT (copy_no = 1 AND c_custkey % 8 <> 1) AND NOT (copy_no = 3 AND c_custkey % 15 <> 2)
""")

# Field sets: eight parts make one set, the field name follows from the part.
FIELD_NAMES = (
    "Location #", "Street Address", "City", "State", "Zip Code", "Total Value", "# of Units", "Phone No",
    "Vehicle Type", "VIN", "Invoice Number", "Date", "Amount", "Source File", " ", "Policy ID", "Site",
    "Square Ft", "County", "St.", "Number of Stories", "Vendor Name", "Premium",
)
binding("fieldsets", "SELECT p_partkey / 8 AS set_id_raw, CAST(floor(p_partkey / 8.0) AS BIGINT) AS set_id, "
    "CAST(p_partkey % 8 AS INTEGER) AS field_ord, CASE CAST((p_partkey * 7 + p_size) % " + str(len(FIELD_NAMES)) + " AS INTEGER) "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FIELD_NAMES)) + " END AS field FROM {part}")
BINDINGS["fieldsets"] = BINDINGS["fieldsets"].replace("p_partkey / 8 AS set_id_raw, ", "")

# Bookkeeping rows with dates and amounts in many notations.
binding("ledger", """
SELECT 'A' || CAST(o_custkey % 50 AS STRING) AS scope_id, o_orderkey AS row_ord, CASE WHEN o_orderkey % 61 = 0 THEN 'failed' END AS error,
  CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN m || '/' || d || '/' || y WHEN 1 THEN y || '-' || m || '-' || d
    WHEN 2 THEN m || '/' || d || '/' || right(y, 2) WHEN 3 THEN d || ' March ' || y WHEN 4 THEN 'Mar ' || d || ', ' || y
    WHEN 5 THEN y || lpad(m, 2, '0') || lpad(d, 2, '0') WHEN 6 THEN 'no date' WHEN 7 THEN ' ' || m || '-' || d || '-' || y || ' '
    ELSE lpad(d, 2, '0') || '/' || lpad(m, 2, '0') || '/' || y END AS Date,
  CASE WHEN o_orderkey % 12 = 0 THEN ' ' ELSE 'Payment, ref ' || CAST(o_orderkey AS STRING) || ', ' || o_orderpriority || repeat(' x', CAST(o_orderkey % 200 AS INTEGER)) END AS Description,
  CASE WHEN o_orderkey % 11 = 0 THEN '($' || printf('%.2f', o_totalprice) || ')' WHEN o_orderkey % 14 = 0 THEN 'see note'
    WHEN o_orderkey % 5 = 0 THEN '$1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.5' ELSE printf('%.2f', o_totalprice) END AS Amount
FROM (SELECT *, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS d, CAST(year(o_orderdate) AS STRING) AS y FROM {orders}) o
""")

# Detected tables of documents: customers are documents, their orders are grids.
binding("doc_tables", """
SELECT 'D' || CAST(o_custkey AS STRING) AS doc_id, CAST(o_orderkey AS INTEGER) AS table_ord, CAST(o_orderkey % 7 + 1 AS INTEGER) AS page_num,
  CAST(o_orderkey % 9 + 1 AS INTEGER) AS row_count, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 9 WHEN o_orderkey % 3 = 1 THEN 4 ELSE 2 END AS INTEGER) AS col_count,
  CASE WHEN o_orderkey % 3 = 2 THEN '| Loc  # | Street Address | City | St | Zip | Yr  Blt | Bldg Val: | BI | $ TIV |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- | --- |'
      || repeat(chr(10) || '| ' || CAST(o_orderkey % 40 AS STRING) || ' | 5 Main St | Rome | IT | 00100 | 1999 | 5 | 6 | 7 |', CAST(o_orderkey % 9 AS INTEGER))
    WHEN o_orderkey % 3 = 1 THEN '| Coverage | Limit | Valuation | Deductible |' || chr(10) || '| --- | --- | --- | --- |'
      || repeat(chr(10) || '| Business  Income: | $' || CAST(o_orderkey % 7 AS STRING) || ' | RCV | 5 |' || chr(10) || '| note: see $ | 1 | 2 | 3 |', CAST(o_orderkey % 9 AS INTEGER))
    ELSE 'Premium summary' || chr(10) || '| ' || o_orderpriority || ' | ' || o_orderstatus || ' |' END AS markdown
FROM {orders}
""")

# Pages: sixty documents make one long document, the third with five statement pages or more. Titles, totals and units are worked in at fixed places.
binding("doc_pages", """
SELECT 'P' || CAST(CAST(floor(doc_id / 60.0) AS BIGINT) AS STRING) AS doc_id, CAST(doc_id % 60 + 1 AS INTEGER) AS page_num,
  CASE WHEN doc_id % 37 = 5 OR (floor(doc_id / 60.0) = 2 AND doc_id % 12 = 7) THEN 'Consolidated Balance Sheets' || chr(10) || 'Total assets and revenue, in thousands' || chr(10)
    WHEN doc_id % 31 = 7 THEN 'Table of Contents' || chr(10) WHEN doc_id % 29 = 3 THEN 'Income Statement' || chr(10) || 'Total Vehicles: ' || CAST(doc_id % 50 AS STRING) || chr(10)
    WHEN doc_id % 23 = 2 THEN 'Name: value' || chr(10) || ' City: Rome' || chr(10) || 'Paid on 03/04/2021: $1,200.50' || chr(10)
    WHEN doc_id % 19 = 4 THEN 'Amounts (In Millions of US Dollars, except shares)' || chr(10) || 'record 3 of ' || CAST(doc_id % 30 AS STRING) || chr(10)
    ELSE '' END || text AS text,
  CAST(doc_id % 3 AS INTEGER) AS image_count, CASE WHEN doc_id % 4 = 0 THEN 'Header ' || source END AS header,
  CASE WHEN doc_id % 6 = 0 THEN 'Footer ' || lang END AS footer, CAST(NULL AS STRING) AS tables_markdown
FROM {documents}
""")
binding("page_tables", """
SELECT doc_id, page_num AS table_ord, page_num, CAST(page_num % 12 AS INTEGER) AS row_count, CAST(page_num % 10 + 1 AS INTEGER) AS col_count,
  '| Loc # | City ' || CAST(page_num % 2 AS STRING) || ' |' || chr(10) || '| --- | --- |' || repeat(chr(10) || '| 1 | Rome |', CAST(page_num % 12 AS INTEGER)) AS markdown
FROM {doc_pages} WHERE page_num % 5 = 0 AND doc_id <> 'P1'
""")
binding("doc_files", """
SELECT doc_id, doc_id || '.pdf' AS filename, CAST(count(*) * 1024 * 90 * (1 + max(length(doc_id)) % 3) AS BIGINT) AS size_bytes,
  CAST(count(*) AS INTEGER) AS page_count FROM {doc_pages} GROUP BY doc_id
""")

# People: customers with a mail address, a plan and counters.
binding("users", """
SELECT c_custkey AS user_id, 'Cust_' || CAST(c_custkey AS STRING) AS customer,
  'User' || CAST(c_custkey AS STRING) || '@' || CASE WHEN c_custkey % 3 = 0 THEN 'gmail.com' ELSE 'Corp' || CAST(c_custkey % 40 AS STRING) || '.com' END AS email,
  c_custkey * 37 % 1000 AS created_at, CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'business' ELSE 'legacy' END AS subscription_tier,
  CAST(floor(c_acctbal / 10) AS BIGINT) + 100 AS pages_used, CAST(c_custkey % 30 AS BIGINT) AS overage_pages, 'sub_' || CAST(c_custkey AS STRING) AS sub_id,
  c_custkey % 4 = 1 AS auto_renew, 20.0 + c_custkey % 5 AS threshold, 50.0 + c_custkey % 7 AS refill, c_custkey % 200 * 1.0 AS balance,
  CASE WHEN c_custkey % 6 <> 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 DAY * CAST(c_custkey % 30 AS INTEGER) END AS usage_reset_at,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST('2024-01-10 00:00:00' AS TIMESTAMP) + INTERVAL 1 DAY * CAST(c_custkey % 25 AS INTEGER) END AS current_period_end
FROM {customer}
""")

# Messages: events as inbound mail; some message ids and files repeat.
binding("mails", """
SELECT event_id AS arrival_id, 'm' || CAST(CASE WHEN event_id % 10 = 1 THEN event_id - 1 ELSE event_id END AS STRING) AS message_id, ts,
  CASE WHEN event_id % 10 = 1 OR event_id % 3 > 0 THEN ' User' || CAST(user_id AS STRING) || '@' || CASE WHEN user_id % 3 = 0 THEN 'Gmail.com' ELSE 'corp' || CAST(user_id % 40 AS STRING) || '.com' END
    ELSE 'stranger' || CAST(event_id % 50 AS STRING) || '@elsewhere.net' END AS sender,
  'Re: ' || event_type AS subject, event_id % 4 <> 0 AS is_read_not, event_id % 5 <> 0 AS has_attachments, event_id % 4 = 0 AS is_read,
  CASE WHEN event_id % 6 = 0 THEN 'Docs <docs+intake-K' || CAST(user_id AS STRING) || '@example.org>' END AS delivered_to,
  CASE WHEN event_id % 6 = 1 THEN 'docs+team_k' || CAST(user_id + 1 AS STRING) || '@example.org, docs+K' || CAST(user_id AS STRING) || '@example.org' WHEN event_id % 6 = 2 THEN 'docs@example.org' END AS "to",
  CASE WHEN event_id % 6 < 3 THEN 'x+k' || CAST(user_id + 2 AS STRING) || '@example.org' END AS cc,
  CAST(NULL AS STRING) AS x_original_to, CASE WHEN event_id % 7 = 0 THEN 'docs+k999999999@example.org' END AS envelope_to
FROM {events}
""".replace('AS "to"', 'AS to_addr').replace(" event_id % 4 <> 0 AS is_read_not,", ""))
binding("mail_keys", "SELECT 'K' || CAST(c_custkey AS STRING) AS address_key, c_custkey AS user_id FROM {customer} WHERE c_custkey % 2 = 0")
binding("mail_files", """
SELECT arrival_id, CAST(arrival_id % 97 AS BIGINT) AS user_id, message_id, CASE WHEN arrival_id % 30 = 0 THEN 'list@corp1.com' ELSE lower(trim(sender)) END AS sender,
  CASE WHEN arrival_id % 30 = 0 THEN 'same.pdf' ELSE 'file_' || CAST((arrival_id * 7) % 400 AS STRING) || '.pdf' END AS filename,
  CASE WHEN arrival_id % 30 = 0 THEN CAST(7 AS BIGINT) ELSE CAST(1000 + arrival_id % 3 AS BIGINT) END AS file_size, part FROM (SELECT *, EACH(0, 1) AS part FROM {mails}) p WHERE NOT (part = 1 AND arrival_id % 9 <> 0)
""".replace("CAST(arrival_id % 97 AS BIGINT) AS user_id", "CAST((arrival_id - CASE WHEN arrival_id % 10 = 1 THEN 1 ELSE 0 END) % 97 AS BIGINT) AS user_id"))
binding("stored_files", """
SELECT event_id AS doc_id, CAST(event_id % 97 AS BIGINT) AS user_id, CASE WHEN event_id % 20 = 3 THEN 'm' || CAST(event_id AS STRING) ELSE 'old' || CAST(event_id AS STRING) END AS message_id,
  'user' || CAST(user_id AS STRING) || '@' || CASE WHEN user_id % 3 = 0 THEN 'gmail.com' ELSE 'corp' || CAST(user_id % 40 AS STRING) || '.com' END AS sender,
  'file_' || CAST((event_id * 7) % 400 AS STRING) || '.pdf' AS filename, CAST(1000 + event_id % 3 AS BIGINT) AS file_size,
  CASE WHEN event_id % 4 = 0 THEN 'J' || CAST(event_id AS STRING) END AS job_id, ts AS created_at, ts + INTERVAL 7 DAY AS expires_at
FROM {events} WHERE event_id % 3 = 0 OR event_id % 20 = 3
""")

# Page requests, charges and subscription events: events seen as metering.
binding("requests", """
SELECT event_id, user_id, CAST(floor(day(ts) / 10.0) AS BIGINT) AS period, ts, event_type AS kind, CAST(1 + event_id % 23 AS BIGINT) AS pages,
  CASE CAST(user_id % 5 AS INTEGER) WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'free' ELSE 'legacy' END AS tier FROM {events}
""")
binding("refunds", "SELECT event_id, user_id, period, ts, CASE WHEN kind IN ('error', 'click') THEN -2 * pages ELSE pages END AS pages FROM {requests}")
binding("charges", "SELECT event_id, user_id, ts, value * CAST(0.25 AS DOUBLE) AS cost FROM {events}")
binding("sub_events", """
SELECT event_id, 'Cust_' || CAST(user_id AS STRING) AS customer, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'updated' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'paid' ELSE 'deleted' END AS event_type,
  'sub_' || CAST(user_id AS STRING) || '_' || CAST(event_id % 2 AS STRING) AS sub_id,
  CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'pro' WHEN 1 THEN 'starter' WHEN 2 THEN 'business' END AS tier,
  CASE WHEN event_id % 7 = 0 THEN 'trialing' WHEN event_id % 11 <> 0 THEN 'active' END AS status, event_id % 13 = 0 AS cancel,
  CASE WHEN event_id % 4 <> 0 THEN CAST('2024-02-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 DAY * CAST(event_id % 50 AS INTEGER) END AS period_end
FROM {events}
""")
binding("calls", """
SELECT 'J' || CAST(l_orderkey AS STRING) AS job_id, lower(p_type) || '-' || p_brand AS model, CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens,
  CAST(l_quantity AS BIGINT) * CAST(l_linenumber AS BIGINT) * 20 AS cached_tokens, CAST(l_quantity AS BIGINT) * 7 AS completion_tokens,
  CAST(l_linenumber % 3 AS BIGINT) AS ocr_pages, CAST(l_linenumber AS BIGINT) * 5 - 10 AS removed_tokens
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""")
binding("prices", """
SELECT p_brand AS model_key, (1 + max(p_size) % 5) * 1.37171937e-6 AS input_price, (1 + max(p_size) % 5) * 1.17317e-7 AS cached_price, 4.0171937e-6 AS output_price FROM {part} WHERE p_brand LIKE '%1%' GROUP BY p_brand
UNION ALL SELECT lower(p_type), 3.0719371e-6, 5.17317e-7, max(p_size) * 1.0137193e-6 FROM {part} WHERE p_type <> 'SMALL' GROUP BY p_type
""")


# Content resources: documents whose first line is title and summary, whose lines are the sections; lists of varying size.
LONG = "Enough words to make this item a long one ~"
binding("res", """
SELECT doc_id, 'doc-' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 41 = 0 THEN '-' ELSE '' END AS slug,
  first_line AS title, first_line AS metaTitle,
  CASE WHEN doc_id % 50 = 7 THEN NULL ELSE first_line END AS metaDescription, first_line AS h1,
  lower(split_part(flat, ' ', 1) || ' ' || split_part(flat, ' ', 2) || ' ' || split_part(flat, ' ', 3) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || split_part(flat, ' ', 4) || ' ' || lang END) AS primaryKeyword,
  CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN 'informational' WHEN 1 THEN 'transactional' WHEN 2 THEN 'commercial' WHEN 3 THEN 'navigational' ELSE 'other' END AS searchIntent,
  CASE CAST(doc_id % 9 AS INTEGER) WHEN 0 THEN 'file_conversion' WHEN 1 THEN 'document_type' WHEN 2 THEN 'workflow' WHEN 3 THEN 'use_case' WHEN 4 THEN 'comparison'
    WHEN 5 THEN 'support_education' WHEN 6 THEN 'guide' WHEN 7 THEN 'industry_insight' ELSE 'misc' END AS templateType,
  CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'published' WHEN 1 THEN 'noindex' WHEN 2 THEN 'draft' ELSE 'rejected' END AS indexationStatus,
  'https://example.org/resources/' || CAST(doc_id AS STRING) AS canonicalUrl,
  CASE WHEN doc_id % 13 = 0 THEN 'A game changer, world-class. ' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN 'Never fails; studies show it. ' ELSE '' END || first_line AS summary,
  STR_LIST(repeat('kw~', CAST(doc_id % 3 AS INTEGER)), '~') AS secondaryKeywords,
  CASE WHEN doc_id % 8 = 1 THEN NULL ELSE STR_LIST('Buyers~' || repeat('Sellers of things~', CAST(doc_id % 2 AS INTEGER)), '~') END AS whoItsFor,
  STR_LIST('now~later', '~') AS whenThisIsRelevant, STR_LIST(repeat('in~', CAST(doc_id % 4 AS INTEGER)), '~') AS supportedInputs, STR_LIST('out~put', '~') AS expectedOutputs,
  STR_LIST(repeat('Short one~', CAST(doc_id % 4 AS INTEGER)), '~') AS commonChallenges, STR_LIST(repeat('@LONG', CAST(doc_id % 6 AS INTEGER)), '~') AS howItWorksSteps,
  STR_LIST('Good fit~' || repeat('@LONG', CAST(doc_id % 3 AS INTEGER)), '~') AS whyItFits,
  CASE WHEN doc_id % 6 = 5 THEN NULL ELSE STR_LIST('Only some~' || repeat('Not others~', CAST(doc_id % 3 AS INTEGER)), '~') END AS limitations,
  CASE WHEN doc_id % 5 = 3 THEN NULL ELSE STR_LIST('a~b', '~') END AS relatedResources, CASE WHEN doc_id % 37 <> 5 THEN STR_LIST('Convert~Upload', '~') END AS relatedProductLinks,
  STR_LIST(repeat('trust~', CAST(doc_id % 3 AS INTEGER)), '~') AS trustSignals, STR_LIST('one~two', '~') AS exampleUseCases,
  STR_LIST('What?~Why?~' || repeat('Who?~', CAST(doc_id % 2 AS INTEGER)), '~') AS faq_q, STR_LIST('@LONG@LONG~short~' || repeat('@LONG', CAST(doc_id % 2 AS INTEGER)), '~') AS faq_a,
  CASE WHEN doc_id % 3 <> 2 THEN STR_LIST(text, chr(10)) END AS sec_b,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T08:00:00' AS publishedAt,
  CASE WHEN doc_id % 4 = 0 THEN '2024-02-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T09:00:00' END AS updatedAt
FROM (SELECT *, replace(text, chr(10), ' ') AS flat, split_part(text, chr(10), 1) AS first_line FROM {documents}) d
""".replace("@LONG", LONG))

# Resources ready to be decided on: whole documents as bodies, in four sections; only what validation asks for is topped up.
binding("pub", """
SELECT * EXCLUDE (slug, title, metaTitle, metaDescription, h1, templateType, searchIntent, summary, whoItsFor, commonChallenges, howItWorksSteps, whyItFits, limitations,
    relatedResources, relatedProductLinks, trustSignals, faq_q, faq_a, sec_b, canonicalUrl, body, part),
  'doc-' || CAST(doc_id AS STRING) AS slug, 'https://example.org/resources/doc-' || CAST(doc_id AS STRING) AS canonicalUrl,
  'How to: ' || primaryKeyword || ' ' || CAST(doc_id AS STRING) AS title, 'About ' || left(primaryKeyword, 70) AS metaTitle,
  'What to know of it, told in a few plain words: ' || primaryKeyword AS metaDescription, 'How to: ' || primaryKeyword AS h1,
  CASE WHEN doc_id % 2 = 0 THEN 'guide' ELSE 'use_case' END AS templateType, CASE WHEN doc_id % 2 = 0 THEN 'informational' ELSE 'commercial' END AS searchIntent,
  primaryKeyword || ': ' || summary || CASE WHEN length(summary) < 100 THEN ' ' || substr(body, 1, 200) ELSE '' END AS summary,
  coalesce(whoItsFor, STR_LIST('Those who keep such records by hand~Those who check them', '~')) AS whoItsFor,
  STR_LIST('@LONG@LONG@LONG', '~') AS commonChallenges, STR_LIST('@LONG@LONG@LONG', '~') AS howItWorksSteps, STR_LIST('@LONG@LONG', '~') AS whyItFits,
  coalesce(limitations, STR_LIST('Only some of them~Not the others', '~')) AS limitations, STR_LIST('a~b', '~') AS relatedResources,
  STR_LIST('Convert~Upload', '~') AS relatedProductLinks, STR_LIST('one~two', '~') AS trustSignals,
  STR_LIST('What is it?~Why so?~Who does it?~When is it due?~Where does it go?', '~') AS faq_q,
  STR_LIST(part || '?' || chr(1) || part || '!' || chr(1) || part || ';' || chr(1) || part || ',' || chr(1) || part || '.', chr(1)) AS faq_a,
  STR_LIST(substr(body, 1, third) || chr(1) || substr(body, third + 1, third) || chr(1) || substr(body, 2 * third + 1, third) || chr(1) || substr(body, 3 * third + 1, length(body)), chr(1)) AS sec_b
FROM (SELECT *, CAST(floor(length(body) / 4.0) AS INTEGER) AS third, substr(body, 1, 120) AS part
  FROM (SELECT *, coalesce(array_join_text, '') || CASE WHEN length(coalesce(array_join_text, '')) < 1300 THEN repeat(' ' || primaryKeyword || ' and what is told of it in full', 40) ELSE '' END AS body
    FROM (SELECT r.*, replace(replace(d.text, chr(1), ' '), chr(10), ' ') AS array_join_text FROM {res} r JOIN {documents} d ON r.doc_id = d.doc_id) j) b) p
""".replace("@LONG", LONG).replace("array_join_text", "flat").replace("body, part),", "body, part, third, flat),"))

# Form fields: twelve orders make one form.
binding("form_fields", """
SELECT CAST(floor(o_orderkey / 12.0) AS BIGINT) AS form_id, CAST(o_orderkey % 12 AS INTEGER) AS ord,
  CASE CAST(o_orderkey % 12 AS INTEGER) WHEN 0 THEN 'Page1[0].FullName_A[0]' WHEN 1 THEN 'Policy_Status_EffectiveDate_A' WHEN 2 THEN 'SignatureOwner' WHEN 3 THEN 'Owner_Title'
    WHEN 4 THEN 'Agree_True' WHEN 5 THEN 'Agree_False' WHEN 6 THEN 'f.OfficeUseOnly' WHEN 7 THEN 'City' WHEN 8 THEN 'PrintName' WHEN 9 THEN 'Pick' WHEN 10 THEN 'Witness_sig_2' ELSE 'SignDate' END AS name,
  CASE CAST(o_orderkey % 12 AS INTEGER) WHEN 4 THEN 'Do you agree ' || CAST(o_custkey % 2 AS STRING) || '? — True' WHEN 5 THEN CASE WHEN o_orderkey % 36 = 5 THEN 'Other - No' ELSE 'Do you agree ' || CAST(o_custkey % 2 AS STRING) || '? - false' END
    WHEN 7 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'For Office Use Only: city' ELSE 'City' END END AS label,
  CASE CAST(o_orderkey % 12 AS INTEGER) WHEN 4 THEN 'checkbox' WHEN 5 THEN 'checkbox' WHEN 9 THEN CASE WHEN o_orderkey % 24 = 9 THEN 'dropdown' ELSE 'radio' END ELSE 'text' END AS type,
  CASE CAST(o_orderkey % 12 AS INTEGER) WHEN 2 THEN CASE WHEN o_orderkey % 5 < 3 THEN ' ' ELSE 'J. Doe' END WHEN 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN ' Yes' ELSE 'no' END WHEN 5 THEN o_orderstatus
    WHEN 9 THEN CASE CAST(o_orderkey % 7 AS INTEGER) WHEN 0 THEN 'red' WHEN 1 THEN 'Green' WHEN 2 THEN 'GREEN' WHEN 3 THEN 'none such' ELSE NULL END
    WHEN 10 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'W' ELSE 'N/A' END
    ELSE CASE WHEN o_orderkey % 8 = 0 THEN 'Please Select...' WHEN o_orderkey % 8 = 1 THEN NULL WHEN o_orderkey % 8 = 2 THEN 'A very long text that does not fit' ELSE o_orderpriority END END AS value,
  CAST(o_orderkey % 5 * 30 AS DOUBLE) AS width, CAST(10 + o_orderkey % 4 * 10 AS DOUBLE) AS height,
  CASE WHEN o_orderkey % 2 = 0 THEN '/On' END AS checked, CAST(NULL AS STRING) AS unchecked
FROM {orders}
""")
binding("form_options", """
SELECT form_id, name, CASE option_ord WHEN 0 THEN 'Red' WHEN 1 THEN 'Green' ELSE 'green' END AS "option", option_ord FROM (SELECT *, EACH(0, 1, 2) AS option_ord FROM {form_fields}) o
WHERE type IN ('dropdown', 'radio') AND form_id % 10 <> 0
""".replace('AS "option"', "AS option"))

# Response texts: JSON, fenced JSON with stray commas, JSON inside prose, and none.
binding("model_texts", """
SELECT o_orderkey, CASE CAST(o_orderkey % 7 AS INTEGER)
    WHEN 0 THEN '@{"records": [@{"id": "' || CAST(o_orderkey AS STRING) || '", "st": "' || o_orderstatus || '"@}, @{"id": "x"@}, 5]@}'
    WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '@{"n": 1, "rows": [@{"id": "' || CAST(o_orderkey AS STRING) || '",@},]@}' || chr(10) || '```'
    WHEN 2 THEN 'The result @{"id": "' || CAST(o_orderkey AS STRING) || '", "st": "a@}b"@} as asked'
    WHEN 3 THEN 'no data' WHEN 4 THEN '@{"id": "' || CAST(o_orderkey AS STRING) || '", "st": null@}' WHEN 5 THEN '@{"records": []@}' ELSE '' END AS response
FROM {orders}
""")
BINDINGS["model_texts"] = BINDINGS["model_texts"].replace("@{", "{{").replace("@}", "}}")
