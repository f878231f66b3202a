"""Upsert, sources and sinks on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import upsert as U
from tabloom.plans.bindings import RECORD_FIELDS, UPSERT_FIELDS, table, with_clause
from tabloom.plans.catalog import ORACLES, query
from tabloom.plans.sqltext import q, s_any, s_blank, s_filled, s_squash, s_strip
from tabloom.schema import MARKERS_UPSERT
from tabloom.session import scratch_path
from tabloom.sources import readers, sinks

UF = UPSERT_FIELDS
HEADERS = ["source_file", *UF, "owner_note"]


def s_norm(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def s_key() -> str:
    f = {c: s_filled(c, MARKERS_UPSERT) for c in UF}
    st, zp = (f"CASE WHEN {f[c]} THEN {s_norm(c)} ELSE '' END" for c in ("state", "zip"))
    return (
        f"CASE WHEN {f['location_number']} THEN 'loc::' || {s_norm('location_number')} "
        f"WHEN {f['street_address']} AND {f['city']} AND ({st}) || ({zp}) <> '' THEN "
        f"'addr::' || {s_norm('street_address')} || '|' || {s_norm('city')} || '|' || ({st}) || '|' || ({zp}) END"
    )


def s_upsert(overwrite: bool) -> str:
    hit = "n = 1 AND new_ord IS NOT NULL"

    def value(c):
        if overwrite and c in UF:
            return f"CASE WHEN {hit} THEN coalesce(new_{c}, '') ELSE {c} END AS {c}"
        if overwrite and c == "source_file":
            return f"CASE WHEN {hit} AND coalesce(new_source_file, '') <> '' THEN new_source_file ELSE source_file END AS source_file"
        return c

    return f"""{with_clause('base', 'fresh')}, old AS (SELECT *, {s_key()} AS k FROM base),
    usable AS (SELECT *, {s_key()} AS k FROM fresh WHERE coalesce(error, '') = ''),
    nums AS (SELECT *, CASE WHEN k IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY scope_id, k ORDER BY row_ord) END AS rn FROM usable),
    ones AS (SELECT scope_id, k, count(*) AS n FROM old WHERE k IS NOT NULL GROUP BY 1, 2),
    firsts AS (SELECT scope_id, k, row_ord AS new_ord, source_file AS new_source_file, {', '.join(f'{c} AS new_{c}' for c in UF)} FROM nums WHERE rn = 1),
    j AS (SELECT o.*, n, f.* EXCLUDE (scope_id, k) FROM old o LEFT JOIN ones USING (scope_id, k) LEFT JOIN firsts f USING (scope_id, k))
    SELECT scope_id, 0 AS part_ord, row_ord, {', '.join(value(c) for c in HEADERS)},
      CASE WHEN {hit} THEN '{'updated' if overwrite else 'matched_preserved'}'
        WHEN n = 1 AND scope_id IN (SELECT scope_id FROM usable) THEN 'not_found' ELSE record_status END AS record_status FROM j
    UNION ALL SELECT scope_id, 1, row_ord, coalesce(source_file, ''), {', '.join(f"coalesce({c}, '')" for c in UF)}, '', 'new' FROM nums u
      WHERE NOT (rn IS NOT NULL AND rn = 1 AND EXISTS (SELECT 1 FROM ones WHERE ones.scope_id = u.scope_id AND ones.k = u.k AND n = 1))"""


def _upsert(spark, sf, overwrite):
    return U.upsert_baseline(table(spark, sf, "base"), table(spark, sf, "fresh"), UF, overwrite)


@query("upsert_baseline", s_upsert(True))
def _(spark, sf):
    return _upsert(spark, sf, True)


@query("upsert_baseline_preserve", s_upsert(False))
def _(spark, sf):
    return _upsert(spark, sf, False)


@query(
    "first_match_only",
    f"""{with_clause('fresh')}, k AS (SELECT *, coalesce({s_key()}, 'row' || row_ord) AS k FROM fresh)
    SELECT scope_id, row_ord, location_number, building_values FROM k QUALIFY row_number() OVER (PARTITION BY scope_id, k ORDER BY row_ord) = 1""",
)
def _(spark, sf):
    columns = U.match_columns(UF, HEADERS)
    return U.first_match_only(table(spark, sf, "fresh"), columns).select("scope_id", "row_ord", "location_number", "building_values")


S_NAME = f"lower({s_strip('field')})"
S_ROLES = {
    "id_field": f"CASE WHEN regexp_matches({S_NAME}, {q(U.ID_END)}) THEN NOT regexp_matches({S_NAME}, {q(U.ID_NOT)}) ELSE regexp_matches({S_NAME}, {q(U.ID_WORD)}) END",
    "address_field": f"regexp_matches({S_NAME}, {q(U.ADDRESS_WORD)})",
    "city_field": f"regexp_matches({S_NAME}, {q(U.CITY_WORD)})",
    "state_field": f"regexp_matches({S_NAME}, {q(U.STATE_WORD)})",
    "zip_field": f"regexp_matches({S_NAME}, {q(U.ZIP_WORD)})",
}


@query(
    "infer_match_columns",
    f"""{with_clause('fieldsets')} SELECT set_id, {', '.join(f"arg_min(field, field_ord) FILTER (WHERE {e}) AS {r}" for r, e in S_ROLES.items())}
    FROM fieldsets GROUP BY set_id""",
)
def _(spark, sf):
    return U.infer_match_columns(table(spark, sf, "fieldsets"))


# --- sources ---------------------------------------------------------------------------------------------------------

@query(
    "read_delimited",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ', \"unit\"' END AS note FROM customer",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(', "unit"'))).alias("note"),
    )
    rows.toDF("﻿c_custkey", "c_name", "note").write.csv(path, header=True, escape='"', emptyValue="")
    return readers.read_delimited(spark, path)


@query(
    "header_schema",
    f"""{with_clause('fieldsets')} SELECT set_id, field_ord, field FROM fieldsets
    WHERE {s_strip(s_blank('field'))} <> '' AND lower({s_strip('field')}) <> 'source file'""",
)
def _(spark, sf):
    return readers.header_schema(table(spark, sf, "fieldsets")).select("set_id", "field_ord", "field")


@query(
    "read_baseline_non_blank",
    f"""{with_clause('recs')} SELECT scope_id, row_ord, {', '.join(RECORD_FIELDS)} FROM recs
    WHERE {s_any(f"coalesce({f}, '') <> ''" for f in RECORD_FIELDS)}""",
)
def _(spark, sf):
    return readers.read_baseline_non_blank(table(spark, sf, "recs"), RECORD_FIELDS).drop("source_file", "error")


FILES = """SELECT 'f' || CAST(doc_id AS STRING) AS file_id, 'file ' || CAST(doc_id AS STRING) || CASE CAST(doc_id % 8 AS INTEGER) WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx'
    WHEN 2 THEN '.exe' WHEN 3 THEN '.eml' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.csv' ELSE '.jpeg' END AS filename,
  CASE WHEN doc_id % 9 = 0 THEN CAST(0 AS BIGINT) WHEN doc_id % 10 = 0 THEN n_chars * 100000 ELSE n_chars END AS size_bytes,
  CAST(n_chars % 12 AS INTEGER) AS page_count, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'h' || CAST(n_chars AS STRING) END AS content_hash,
  CASE WHEN doc_id % 5 = 0 THEN 'm' || CAST(n_chars AS STRING) END AS md5, CASE WHEN doc_id % 7 <> 0 THEN '2024-01-0' || CAST(doc_id % 9 + 1 AS STRING) END AS modified
FROM {documents}"""
S_EXT = "CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1)) ELSE '' END"


@query(
    "classify_inputs",
    f"""WITH files AS ({FILES.replace('{documents}', 'documents')}), e AS (SELECT *, {S_EXT} AS ext FROM files),
    c AS (SELECT *, CASE WHEN size_bytes = 0 THEN 'empty' WHEN size_bytes > 5242880 THEN 'too_large'
      WHEN ext IN ({', '.join(map(q, readers.SPREADSHEET_EXT))}) THEN 'spreadsheet' WHEN ext IN ({', '.join(map(q, readers.DOCUMENT_EXT))}) THEN 'document'
      ELSE 'unsupported' END AS input_class FROM e)
    SELECT file_id, filename, input_class, CASE ext {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.CONTENT_TYPES.items())} ELSE 'application/octet-stream' END AS content_type,
      CASE WHEN input_class IN ('spreadsheet', 'document') THEN CASE WHEN ext = 'pdf' THEN greatest(page_count, 1) ELSE 1 END ELSE 0 END AS billable_pages FROM c""",
)
def _(spark, sf):
    files = spark.sql(FILES, documents=table(spark, sf, "documents"))
    return readers.classify_inputs(files).select("file_id", "filename", "input_class", "content_type", "billable_pages")


@query(
    "list_snapshot",
    f"""WITH files AS ({FILES.replace('{documents}', 'documents')}) SELECT file_id, filename,
    coalesce(nullif(content_hash, ''), nullif(md5, ''), nullif(modified, ''), '') AS content_mark FROM files""",
)
def _(spark, sf):
    return readers.list_snapshot(spark.sql(FILES, documents=table(spark, sf, "documents")))


def s_html(c: str) -> str:
    t = rf"regexp_replace({c}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    # the entities of the pages, each resolved once
    known = [(n, readers.ENTITIES[n[:-1]]) for n in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "eacute;", "copy;", "middot;")]
    known += [("copy", "©"), ("#39;", "'"), ("#9;", "\t"), ("#x41;", "A"), ("#150;", "–")]
    cases = " ".join(f"WHEN starts_with(p, {q(n)}) THEN {q(char)} || substr(p, {len(n) + 1})" for n, char in known)
    t = f"(string_split({t}, '&')[1] || array_to_string(list_transform(string_split({t}, '&')[2:], lambda p: CASE {cases} ELSE '&' || p END), ''))"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    return s_strip(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


# Pages of which some hold doubly escaped, bare, rare and numeric entities.
ENTITY_PAGES = """SELECT page_id, html || CASE CAST(page_id % 4 AS INTEGER) WHEN 0 THEN '<p>a &amp;lt;b caf&eacute; &copy 2024</p>' WHEN 1 THEN ' x&#9; &#x41;&#150; &unknown; &' ELSE '' END AS html FROM {pages}"""


@query("html_to_text", f"SELECT page_id, {s_html('html')} AS body FROM ({ENTITY_PAGES.replace('{pages}', 'pages')}) p")
def _(spark, sf):
    pages = spark.sql(ENTITY_PAGES, pages=table(spark, sf, "pages"))
    return pages.select("page_id", readers.html_to_text("html").alias("body"))


@query(
    "markdown_tables",
    rf"""{with_clause('doc_tables')}, l AS (SELECT doc_id, table_ord, string_split(markdown, chr(10)) AS lines FROM doc_tables),
    r AS (SELECT *, list_position(list_transform(lines, lambda x: regexp_matches(x, '^\|\s*-')), true) - 1 AS rule_at FROM l),
    e AS (SELECT doc_id, table_ord, rule_at, unnest(range(0, len(lines))) AS line_ord, unnest(lines) AS line FROM r)
    SELECT doc_id, table_ord, CAST(line_ord AS INTEGER) AS line_ord, rule_at IS NOT NULL AND line_ord < rule_at AS is_header,
      array_to_string(list_transform(string_split(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '|'), lambda x: {s_strip('x')}), '|') AS cells
    FROM e WHERE line LIKE '|%' AND line_ord IS DISTINCT FROM rule_at""",
)
def _(spark, sf):
    out = readers.markdown_tables(table(spark, sf, "doc_tables"))
    return out.withColumn("cells", F.array_join("cells", "|"))


# --- sinks -----------------------------------------------------------------------------------------------------------

OUT_FIELDS = ["order_number", "segment", "missing field"]


@query(
    "write_records",
    f"""{with_clause('recs')} SELECT coalesce(source_file, '') AS "Source File", coalesce(order_number, '') AS order_number,
    coalesce(segment, '') AS segment, '' AS "missing field" FROM recs""",
)
def _(spark, sf):
    path = scratch_path(spark, "records")
    sinks.write_records(table(spark, sf, "recs"), OUT_FIELDS, path)
    return readers.read_delimited(spark, path)


@query(
    "append_records",
    f"""{with_clause('recs')} SELECT coalesce(source_file, '') AS "Source File", coalesce(order_number, '') AS order_number,
    coalesce(segment, '') AS segment, copy FROM recs, (SELECT 'same' AS copy UNION ALL SELECT 'same') UNION ALL
    SELECT coalesce(source_file, ''), coalesce(order_number, ''), NULL, 'other' FROM recs""",
)
def _(spark, sf):
    folder, recs = scratch_path(spark, "append"), table(spark, sf, "recs")
    told = ["order_number", "segment"], folder, "Orders: new/old? "
    sinks.append_pipeline(recs, *told)
    same = sinks.append_pipeline(recs, *told)
    other = sinks.append_pipeline(recs, ["order_number"], *told[1:])
    written = spark.read.parquet(same).withColumn("copy", F.lit("same"))
    return written.unionByName(spark.read.parquet(other).withColumn("copy", F.lit("other")), allowMissingColumns=True)


FILE_NAMES = """SELECT p_partkey, ' ' || p_name || CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN ': a/b' WHEN 1 THEN '?*' WHEN 2 THEN ' <"x">|' WHEN 3 THEN chr(92) || 'y' || chr(10) ELSE '' END AS name FROM {part}"""


@query(
    "output_name",
    f"""WITH n AS ({FILE_NAMES.replace('{part}', 'part')}) SELECT p_partkey, trim(translate(name, '/:*?"<>|' || chr(92), '_________'), ' ' || chr(10)) AS file_name FROM n""",
)
def _(spark, sf):
    names = spark.sql(FILE_NAMES, part=table(spark, sf, "part"))
    return names.select("p_partkey", X.output_name("name").alias("file_name"))


@query(
    "fields_fingerprint",
    f"{with_clause('fieldsets')} SELECT set_id, left(md5(array_to_string(list_sort(list(field)), ',')), 8) AS fingerprint FROM fieldsets GROUP BY set_id",
)
def _(spark, sf):
    sets = table(spark, sf, "fieldsets").groupBy("set_id").agg(F.collect_list("field").alias("names"))
    return sets.select("set_id", sinks.fingerprint_column(F.col("names")).alias("fingerprint"))


S_D = s_squash(s_strip(s_blank("Date")))
S_DAY = rf"""coalesce(CASE WHEN regexp_matches({S_D}, '^\d{{1,2}}[/-]\d+[/-]\d{{2}}$') THEN CAST(try_strptime({S_D}, ['%m/%d/%y', '%m-%d-%y']) AS DATE) ELSE CAST(try_strptime({S_D},
  ['%m/%d/%Y', '%m-%d-%Y', '%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%d-%m-%Y', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%B %d %Y', '%b %d %Y']) AS DATE) END,
  CASE WHEN length(regexp_replace(Date, '\D', '', 'g')) = 8 THEN CAST(try_strptime(regexp_replace(Date, '\D', '', 'g'), ['%Y%m%d', '%m%d%Y']) AS DATE) END)"""
S_AMT_IN = f"regexp_replace({s_strip(s_blank('Amount'))}, '[$,()]', '', 'g')"
S_AMT = f"coalesce(TRY_CAST({S_AMT_IN} AS DOUBLE), 0) * CASE WHEN {s_strip(s_blank('Amount'))} LIKE '(%)' THEN -1 ELSE 1 END"


@query(
    "export_accounting_csv",
    f"""{with_clause('ledger')}, r AS (SELECT scope_id, row_ord, strftime({S_DAY}, '%m/%d/%Y') AS "Date",
      left({s_strip("replace(coalesce(Description, ''), ',', ' ')")}, 255) AS "Description", printf('%.2f', {S_AMT}) AS "Amount"
      FROM ledger WHERE error IS NULL) SELECT * FROM r WHERE "Date" IS NOT NULL AND "Description" <> ''""",
)
def _(spark, sf):
    return sinks.export_accounting_csv(table(spark, sf, "ledger"))


@query(
    "statement_entries",
    f"""{with_clause('ledger')}, r AS (SELECT scope_id, row_ord, {S_DAY} AS day, printf('%.2f', {S_AMT}) AS amount,
      left({s_strip(s_blank('Description'))}, 32) AS name FROM ledger WHERE error IS NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY row_ord) AS number FROM r WHERE day IS NOT NULL)
    SELECT scope_id, row_ord, number, CASE WHEN CAST(amount AS DOUBLE) >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS entry_type,
      strftime(day, '%Y%m%d') AS posted, amount, strftime(day, '%Y%m%d') || lpad(CAST(number AS VARCHAR), greatest(5, length(CAST(number AS VARCHAR)))::INTEGER, '0') AS entry_id, name FROM n""",
)
def _(spark, sf):
    return sinks.statement_entries(table(spark, sf, "ledger"), run_rows=100)


@query(
    "statement_totals",
    f"""{with_clause('ledger')} SELECT scope_id, strftime(min({S_DAY}), '%Y%m%d') AS date_start, strftime(max({S_DAY}), '%Y%m%d') AS date_end,
    CAST(sum(CAST(printf('%.2f', {S_AMT}) AS DECIMAL(30,2))) AS DOUBLE) AS balance FROM ledger WHERE error IS NULL GROUP BY scope_id""",
)
def _(spark, sf):
    return sinks.statement_totals(table(spark, sf, "ledger"))


def s_lines(lines) -> str:
    """Frame lines with the figures filled in, as a SQL list."""
    def text(line):
        out = q(line.replace("{now}", STATEMENT_NOW))
        for name, column in (("start", "date_start"), ("end", "date_end"), ("balance", "printf('%.2f', balance)")):
            out = out.replace("{" + name + "}", f"' || {column} || '")
        return out

    return "[" + ", ".join(text(line) for line in lines) + "]"


STATEMENT_NOW = "20240101000000"


@query(
    "export_statement",
    f"""WITH e AS ({ORACLES['statement_entries']}), t AS ({ORACLES['statement_totals']})
    SELECT scope_id, unnest(['<STMTTRN>', '<TRNTYPE>' || entry_type, '<DTPOSTED>' || posted, '<TRNAMT>' || amount, '<FITID>' || entry_id, '<NAME>' || name, '</STMTTRN>']) AS value FROM e
    UNION ALL SELECT scope_id, unnest({s_lines(sinks.STATEMENT_HEAD)} || {s_lines(sinks.STATEMENT_FOOT)}) FROM t""",
)
def _(spark, sf):
    path = scratch_path(spark, "statement")
    sinks.export_statement(table(spark, sf, "ledger"), path, STATEMENT_NOW)
    return spark.read.text(path)


SORT_BY = """SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand || ' ' || p_name || ' ' || CAST(p_size * 7 AS STRING) END AS label FROM {part}"""


@query(
    "natural_sort",
    rf"""WITH l AS ({SORT_BY.replace('{part}', 'part')}) SELECT p_partkey, label, array_to_string(list_transform(
      regexp_extract_all(lower(coalesce(label, '')), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(CAST(length(CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS VARCHAR), 10, '0')
        || CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END ELSE x END), '') AS sort_key FROM l""",
)
def _(spark, sf):
    labels = spark.sql(SORT_BY, part=table(spark, sf, "part"))
    return labels.withColumn("sort_key", X.natural_key("label")).orderBy(X.natural_order("label"), "p_partkey")


@query(
    "natural_sort_descending",
    rf"""SELECT label FROM ({ORACLES['natural_sort']}) ORDER BY sort_key DESC, p_partkey LIMIT 40""",
)
def _(spark, sf):
    labels = spark.sql(SORT_BY, part=table(spark, sf, "part"))
    return labels.orderBy(X.natural_order("label", ascending=False), "p_partkey").limit(40).select("label")
