"""Form fields and extraction hook on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.functions import sql as S
from tabloom.operators import extract as E
from tabloom.operators import forms as M
from tabloom.operators import pages as P
from tabloom.operators import quality as Q
from tabloom.operators.skew import beside
from tabloom.plans.bindings import ENTITY_FIELDS, table, with_clause
from tabloom.plans.catalog import query
from tabloom.plans.sqltext import q, s_any, s_blank, s_filled, s_strip
from tabloom.schema import MARKERS_FORM, FieldSpec
from tabloom.session import settled
from tabloom.sources import mail

S_V = "coalesce(value, '')"
S_FBLANK = f"({s_strip(S_V)} IN ({', '.join(map(q, MARKERS_FORM))}))"


@query(
    "normalise_form_values",
    f"""{with_clause('form_fields', 'form_options')}, o AS MATERIALIZED (SELECT form_id, name, list(option ORDER BY option_ord) AS opts FROM form_options GROUP BY 1, 2)
    SELECT form_id, name, type, CASE WHEN type = 'checkbox' THEN CASE WHEN lower({s_strip(S_V)}) IN ({', '.join(map(q, M.YES))}) THEN coalesce(checked, '/Yes') ELSE coalesce(unchecked, '/Off') END
      WHEN type IN ('dropdown', 'radio') THEN CASE WHEN opts IS NULL OR list_contains(opts, value) THEN {S_V}
        ELSE coalesce(list_filter(opts, lambda x: lower(x) = lower({s_strip(S_V)}))[1], '') END
      WHEN {S_FBLANK} THEN '' ELSE {S_V} END AS value FROM form_fields LEFT JOIN o USING (form_id, name)""",
)
def _(spark, sf):
    return M.normalise_form_values(table(spark, sf, "form_fields"), table(spark, sf, "form_options"))


@query(
    "blank_restricted_fields",
    f"""{with_clause('form_fields')}, h AS (SELECT *, NOT {S_FBLANK} AND ({s_any(f"contains(lower(name), {q(p)})" for p in M.OFFICE_NAMES)} OR {s_any(f"contains(lower(coalesce(label, '')), {q(p)})" for p in M.OFFICE_LABELS)}
      OR (type = 'text' AND width > 0 AND height > 0 AND width <= 80 AND height <= 18 AND length({s_strip(S_V)}) > 20)) AS zeroed FROM form_fields)
    SELECT form_id, ord, CASE WHEN zeroed THEN '' ELSE value END AS value, zeroed FROM h""",
)
def _(spark, sf):
    return M.blank_restricted_fields(table(spark, sf, "form_fields")).select("form_id", "ord", "value", "zeroed")


S_SIG = s_any(f"contains(lower(name), {q(p)})" for p in M.SIGNATURE_NAMES)
S_PARTNER = f"({s_any(f'contains(lower(name), {q(p)})' for p in M.PARTNER_NAMES)} OR (lower(name) LIKE '%date' AND NOT contains(name, '/')) OR lower(name) LIKE '%title' OR contains(lower(name), '_title'))"


@query(
    "blank_signature_neighbours",
    f"""{with_clause('form_fields')}, h AS (SELECT *, {S_PARTNER} AND NOT {S_FBLANK} AND
      coalesce(bool_or({S_SIG} AND {S_FBLANK}) OVER (PARTITION BY form_id ORDER BY ord RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS zeroed FROM form_fields)
    SELECT form_id, ord, CASE WHEN zeroed THEN '' ELSE value END AS value, zeroed FROM h""",
)
def _(spark, sf):
    return M.blank_signature_neighbours(table(spark, sf, "form_fields")).select("form_id", "ord", "value", "zeroed")


@query(
    "paired_questions",
    rf"""{with_clause('form_fields')}, m AS (SELECT form_id, name, lower(trim(regexp_extract(label, {q(M.PAIR)}, 1))) AS question,
      CASE WHEN lower(regexp_extract(label, {q(M.PAIR)}, 2)) IN ('true', 'yes') THEN 'true' ELSE 'false' END AS side FROM form_fields WHERE type = 'checkbox' AND regexp_matches(trim(label), {q(M.PAIR)}))
    SELECT * FROM m QUALIFY count(DISTINCT side) OVER (PARTITION BY form_id, question) = 2""",
)
def _(spark, sf):
    return M.paired_questions(table(spark, sf, "form_fields"))


LABELS = {
    "Page1[0].FullName_A[0]": "Full Name", "Policy_Status_EffectiveDate_A": "Policy Status Effective Date", "SignatureOwner": "Signature Owner",
    "Owner_Title": "Owner Title", "Agree_True": "Agree True", "Agree_False": "Agree False", "f.OfficeUseOnly": "Office Use Only", "City": "",
    "PrintName": "Print Name", "Pick": "", "Witness_sig_2": "Witness Sig 2", "SignDate": "Sign Date",
}


@query(
    "humanise_fields",
    f"""{with_clause('form_fields')} SELECT form_id, ord, CASE name {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LABELS.items())} END AS label,
    CASE WHEN width <= 0 OR height <= 0 THEN '' WHEN width <= 30 AND height <= 18 THEN 'tiny' WHEN width <= 80 AND height <= 18 THEN 'narrow' WHEN height >= 36 THEN 'multi_line' ELSE 'normal' END AS room FROM form_fields""",
)
def _(spark, sf):
    return table(spark, sf, "form_fields").select("form_id", "ord", X.humanise("name").alias("label"), X.capacity_class("width", "height").alias("room"))


# --- extraction ------------------------------------------------------------------------------------------------------

@query(
    "parse_responses",
    f"""{with_clause('model_texts')}, k AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderstatus FROM orders)
    SELECT o_orderkey, false AS parse_error, 0 AS record_ord, CAST(o_orderkey AS VARCHAR) AS id, CASE k WHEN 0 THEN o_orderstatus WHEN 2 THEN 'a}}b' END AS st FROM k WHERE k IN (0, 1, 2, 4)
    UNION ALL SELECT o_orderkey, false, 1, 'x', NULL FROM k WHERE k = 0
    UNION ALL SELECT o_orderkey, k <> 5, NULL, NULL, NULL FROM k WHERE k IN (3, 5, 6)""".replace("0 AS record_ord", "'0' AS record_ord").replace("false, 1, 'x'", "false, '1', 'x'"),
)
def _(spark, sf):
    out = E.parse_responses(table(spark, sf, "model_texts"), "response", ["id", "st"]).drop("response")
    return out.withColumn("record_ord", F.col("record_ord").cast("string"))


ASKED = [FieldSpec("Loc #"), FieldSpec("City", "town of the site"), FieldSpec("Sum", format="0.00")]


@query(
    "extraction_requests",
    f"""{with_clause('doc_pages', 'page_tables', 'doc_files')}, n AS (SELECT doc_id, page_num, text, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 8 THEN (row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) // 12 ELSE 0 END AS chunk FROM doc_pages),
    g AS (SELECT doc_id, page_num, string_agg('[Table - page ' || page_num || ', ' || row_count || 'x' || col_count || ']' || chr(10) || markdown, chr(10) || chr(10) ORDER BY table_ord) AS t FROM page_tables GROUP BY 1, 2),
    c AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, min(page_num) AS first_page, max(page_num) AS last_page, string_agg('=== Page ' || page_num || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page_num) AS page_text,
      coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_num), '') AS tables_text FROM n LEFT JOIN g USING (doc_id, page_num) GROUP BY 1, 2),
    tc AS (SELECT doc_id, count(*) AS k FROM page_tables GROUP BY 1)
    SELECT doc_id, chunk, first_page, last_page, {q(E.field_block(ASKED))} AS field_block, 'Filename: ' || filename || chr(10) || 'Total pages: ' || page_count || chr(10) || 'Tables detected: ' || coalesce(k, 0) AS context,
      page_text, tables_text, 12000 AS token_budget FROM c JOIN doc_files USING (doc_id) LEFT JOIN tc USING (doc_id)""",
)
def _(spark, sf):
    return E.extraction_requests(table(spark, sf, "doc_files"), table(spark, sf, "doc_pages"), table(spark, sf, "page_tables"), ASKED)


@query(
    "apply_extractor",
    f"""{with_clause('doc_pages')} SELECT doc_id, page_num, length(text) AS chars FROM doc_pages""",
)
def _(spark, sf):
    def measure(batches):
        for batch in batches:
            yield batch[["doc_id", "page_num"]].assign(chars=batch["text"].str.len())

    wanted = table(spark, sf, "doc_pages").select("doc_id", "page_num", "text")
    return E.apply_extractor(wanted, measure, "doc_id string, page_num int, chars bigint")


@query(
    "extract_from_tables",
    """WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS kind, unnest(range(0, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 9 ELSE (o_orderkey % 9) * 2 END)) AS line FROM orders WHERE o_orderkey % 3 > 0)
    SELECT 'D' || o_custkey AS scope_id, o_orderkey * 4294967296 + line AS row_ord, CASE WHEN kind = 2 THEN CAST(o_orderkey % 40 AS VARCHAR) END AS location_number,
      CASE WHEN kind = 2 THEN 'Rome' END AS city, CASE WHEN kind = 1 AND line % 2 = 0 THEN '$' || (o_orderkey % 7) WHEN kind = 1 THEN '1' END AS limit_amount,
      CASE WHEN kind = 1 AND line % 2 = 0 THEN '5' WHEN kind = 1 THEN '3' END AS deductible FROM g""",
)
def _(spark, sf):
    out = E.extract_from_tables(table(spark, sf, "doc_tables"), ["location_number", "city", "limit_amount", "deductible"])
    return out.drop("source_file", "error")


@query(
    "extract_from_lines",
    rf"""{with_clause('doc_pages')} SELECT doc_id AS scope_id, CAST(page_num AS BIGINT) AS row_ord, 'value' AS name, 'Rome' AS city FROM doc_pages WHERE text LIKE 'Name: value%'""",
)
def _(spark, sf):
    return E.extract_from_lines(table(spark, sf, "doc_pages"), ["name", "city"]).drop("source_file", "error")


@query("post_process")
def _(spark, sf):
    records = table(spark, sf, "sched")
    scopes = records.select("scope_id").distinct()
    asked = scopes.select("scope_id", F.explode(F.array(*[F.lit(f) for f in ENTITY_FIELDS])).alias("field"))
    heads = scopes.select("scope_id", F.explode(F.array(F.lit("asset id"), F.lit("street address"), F.lit("city"))).alias("token"))
    texts = records.groupBy("scope_id").agg(F.max("street_address").alias("text")).fillna("no text", ["text"])
    matches = P.match_fields_to_headers(asked, heads)
    labels = P.match_fields_to_headers(asked, heads, texts)
    # what a second look finds: of half the fields, the least value that the scope's rows have
    asked_again = ENTITY_FIELDS[::2]
    known = settled(records.filter(~X.has_error()).groupBy("scope_id").agg(*[F.min(F.when(X.is_filled(f), F.col(f))).alias(f"_k_{f}") for f in asked_again]), "known")

    def second_look(active):
        found = beside(active.filter(~X.has_error()), known, "scope_id").select("scope_id", "row_ord", F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.when(~X.is_filled(f), F.col(f"_k_{f}")).alias("value")) for f in asked_again
        ])).alias("p"))
        return found.select("scope_id", "row_ord", "p.*", F.lit(1).alias("patch_ord")).filter("value is not null")

    out = E.post_process(records, ENTITY_FIELDS, matches, labels, texts, schedule=True, backfill=second_look, rounds=2)
    return out.withColumn("row_ord", F.array_join(F.transform("row_ord", lambda x: x.cast("string")), "."))


@query(
    "sql_functions",
    f"""{with_clause('recs')} SELECT row_ord, {s_filled('segment')} AS filled, regexp_replace(lower(coalesce(customer_name, '')), '[^a-z0-9]', '', 'g') AS norm,
    regexp_matches(coalesce(order_date, ''), {q(X.DATE_SEARCH)}) AS dated,
    CASE WHEN regexp_matches(total_amount, '^1,\\d\\d\\d million$') THEN left(total_amount, 5) ELSE total_amount END AS money FROM recs""",
)
def _(spark, sf):
    S.register(spark)
    return spark.sql(
        "SELECT row_ord, is_filled(segment) AS filled, norm_key(customer_name) AS norm, parses_as_date(order_date) AS dated, "
        "clean_money(total_amount) AS money FROM {recs}", recs=table(spark, sf, "recs"),
    )


@query(
    "sql_functions_amounts",
    f"""{with_clause('ledger')} SELECT row_ord, printf('%.2f', coalesce(TRY_CAST(regexp_replace(trim(Amount), '[$,()]', '', 'g') AS DOUBLE), 0) * CASE WHEN Amount LIKE '(%)' THEN -1 ELSE 1 END) AS amount FROM ledger""",
)
def _(spark, sf):
    S.register(spark)
    return spark.sql("SELECT row_ord, clean_amount(Amount) AS amount FROM {l}", l=table(spark, sf, "ledger"))


MAIL = """SELECT CAST(conv_id AS STRING) AS mail_id, role, turn, text FROM {conversations}"""


def _raw_mail(spark, sf):
    """Conversations as raw messages: first turn is the body, the others are attachments; odd mails nest one message."""
    turns = table(spark, sf, "conversations")
    mark = F.concat(F.lit("b"), F.col("conv_id").cast("string"))
    head = F.format_string(
        'Message-ID: <m%d@example.org>\nFrom: Ann <User%d@Example.org>\nTo: docs+k%d@example.org\nSubject: mail %d\nMIME-Version: 1.0\n'
        'Content-Type: multipart/mixed; boundary="%s"\n\n', "conv_id", "conv_id", "conv_id", "conv_id", mark,
    )
    part = F.concat(
        F.lit("--"), mark,
        F.when(F.col("turn") == 0, F.lit("\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n")).otherwise(
            F.format_string('\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="turn_%d.txt"\nContent-Transfer-Encoding: base64\n\n', "turn")
        ),
        F.base64(F.when(F.col("turn") == 0, F.concat(F.lit("<p>Hello<br>turn</p>"), F.lit("<b>x</b>"))).otherwise(F.col("text")).cast("binary")), F.lit("\n"),
    )
    # one conversation is a handful of turns
    plain = turns.withColumn("h", head).withColumn("p", part).groupBy("conv_id", "h").agg(F.array_sort(F.collect_list(F.struct("turn", "p"))).alias("ps"))
    body = F.concat("h", F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("--b"), F.col("conv_id").cast("string"), F.lit("--\n"))
    outer = F.concat(
        F.format_string('Message-ID: <o%d@example.org>\nFrom: outer%d@example.org\nTo: x@example.org\nSubject: fwd\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="outer"\n\n'
                        "--outer\nContent-Type: text/plain\n\nsee below\n--outer\nContent-Type: message/rfc822\n\n", "conv_id", "conv_id"),
        F.col("m"), F.lit("--outer--\n"),
    )
    mails = plain.select("conv_id", body.alias("m"))
    return mails.select(F.col("conv_id").cast("string").alias("mail_id"), F.when(F.col("conv_id") % 2 == 1, outer).otherwise(F.col("m")).cast("binary").alias("content"))


@query(
    "explode_mail",
    """WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
    SELECT CAST(conv_id AS VARCHAR) AS mail_id, CASE WHEN conv_id % 2 = 1 THEN 'outer' || conv_id ELSE 'user' || conv_id END || '@example.org' AS sender,
      CASE WHEN conv_id % 2 = 1 THEN 'see below' ELSE 'Hello' || chr(10) || 'turn' || chr(10) || ' x' END AS body,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS part_ord, 'turn_' || turn || '.txt' AS filename, 'text/plain' AS content_type, octet_length(encode(text)) AS size_bytes
    FROM conversations WHERE turn > 0
    UNION ALL SELECT CAST(conv_id AS VARCHAR), CASE WHEN conv_id % 2 = 1 THEN 'outer' || conv_id ELSE 'user' || conv_id END || '@example.org',
      CASE WHEN conv_id % 2 = 1 THEN 'see below' ELSE 'Hello' || chr(10) || 'turn' || chr(10) || ' x' END, 0, NULL, NULL, NULL FROM m WHERE last = 0""",
)
def _(spark, sf):
    out = mail.explode_mail(_raw_mail(spark, sf))
    return out.select("mail_id", "sender", "body", F.col("part_ord").cast("bigint").alias("part_ord"), "filename", "content_type", "size_bytes")
