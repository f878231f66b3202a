"""Page, table and section operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import pages as P
from tabloom.plans.bindings import plain, spark_text, table, with_clause
from tabloom.plans.catalog import query
from tabloom.plans.sqltext import q, s_blank, s_squash, s_strip

S_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))"
S_NUM = f"regexp_matches(text, {q(X.PAGE_NUMBER_SEARCH)})"
S_DATES = f"regexp_matches(text, {q(X.PAGE_DATE_SEARCH)})"


@query(
    "page_features",
    f"{with_clause('doc_pages')} SELECT doc_id, page_num, CAST({S_WORDS} AS INTEGER) AS word_count, {S_NUM} AS has_numbers, {S_DATES} AS has_dates FROM doc_pages",
)
def _(spark, sf):
    return P.page_features(table(spark, sf, "doc_pages")).select("doc_id", "page_num", "word_count", "has_numbers", "has_dates")


def s_hits(text: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(p)}) AS INTEGER)" for p in phrases) + ")"


S_TITLE = " + ".join(f"{s_hits('title', ps)} * ({w})" for w, ps in P.TITLE_WEIGHTS)
S_SCORED = f"""lined AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id) AS page_total,
      list_filter(list_transform(string_split(text, chr(10)), lambda s: {s_strip('s')}), lambda s: s <> '') AS lines FROM doc_pages),
    texts AS (SELECT *, lower(replace(array_to_string(lines[1:4], ' '), '’', '''')) AS title, lower(replace(array_to_string(lines[1:8], ' '), '’', '''')) AS head,
      lower(replace(array_to_string(lines[1:20], ' '), '’', '''')) AS early, {S_WORDS} AS word_count, {S_NUM} AS has_numbers, {S_DATES} AS has_dates,
      {s_hits('lower(text)', P.TABLE_WORDS)} AS word_hits FROM lined),
    scored AS MATERIALIZED (SELECT doc_id, page_num, page_total, word_count, has_numbers, has_dates, word_hits,
      CASE WHEN early <> '' THEN {s_hits('title', P.STATEMENT_PHRASES)} ELSE 0 END AS statement_hits,
      CASE WHEN early <> '' THEN CAST({s_hits('title', P.STATEMENT_PHRASES)} * 3000 + {S_TITLE} + {s_hits('title', P.TABLE_WORDS)} * 220
        + {s_hits('head', P.TABLE_WORDS)} * 120 + {s_hits('early', P.TABLE_WORDS)} * 80
        + CASE WHEN contains(title, 'item 8') AND contains(title, 'financial statements') THEN 750 ELSE 0 END
        + CASE WHEN has_numbers THEN 140 ELSE 0 END + CASE WHEN has_dates THEN 60 ELSE 0 END AS DOUBLE)
        + least(word_count, 1000) * CAST(0.08 AS DOUBLE) END AS score FROM texts WHERE page_total > 20)"""


@query(
    "score_long_doc_pages",
    f"""{with_clause('doc_pages')}, {S_SCORED} SELECT doc_id, page_num, CAST(statement_hits AS INTEGER) AS statement_hits,
    CAST(word_hits AS INTEGER) AS word_hits, round(score, 4) AS score FROM scored""",
)
def _(spark, sf):
    scored = P.score_long_doc_pages(table(spark, sf, "doc_pages"))
    return scored.select("doc_id", "page_num", "statement_hits", "word_hits", F.round("score", 4).alias("score"))


S_ANCHORS = f"""cand AS (SELECT doc_id, 0 AS stage, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS r, page_num FROM scored WHERE statement_hits > 0
      UNION ALL SELECT doc_id, 1, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word_count DESC, page_num), page_num FROM scored WHERE score > 0
      UNION ALL SELECT doc_id, 2, row_number() OVER (PARTITION BY doc_id ORDER BY word_hits DESC, has_numbers DESC, has_dates DESC, word_count DESC, page_num), page_num FROM scored),
    line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, r) AS pos, count(*) FILTER (stage = 0) OVER (PARTITION BY doc_id) >= 5 AS five FROM cand),
    walk(doc_id, pos, acc) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM line
      UNION ALL SELECT w.doc_id, l.pos, CASE WHEN len(w.acc) < CASE WHEN l.stage = 1 AND l.five THEN 6 ELSE 5 END AND len(list_filter(w.acc, lambda p: abs(p - l.page_num) <= CASE WHEN l.stage = 0 THEN 0 ELSE 2 END)) = 0
        THEN list_append(w.acc, l.page_num) ELSE w.acc END FROM walk w JOIN line l ON l.doc_id = w.doc_id AND l.pos = w.pos + 1),
    anchors AS MATERIALIZED (SELECT doc_id, unnest(acc) AS page_num FROM (SELECT doc_id, arg_max(acc, pos) AS acc FROM walk GROUP BY doc_id))"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "select_anchor_pages",
    recursive(f"{with_clause('doc_pages')}, {S_SCORED}, {S_ANCHORS} SELECT doc_id, page_num FROM anchors"),
)
def _(spark, sf):
    return P.select_anchor_pages(P.score_long_doc_pages(table(spark, sf, "doc_pages")))


S_FOCUS = """focus AS MATERIALIZED (SELECT DISTINCT p.doc_id, p.page_num FROM doc_pages p JOIN anchors a ON a.doc_id = p.doc_id
      AND p.page_num BETWEEN a.page_num - 1 AND a.page_num + 2)"""


def _focus(spark, sf):
    pages = P.page_numbers(table(spark, sf, "doc_pages"))
    return pages, P.neighbour_pages(P.select_anchor_pages(P.score_long_doc_pages(pages)), pages)


@query(
    "neighbour_pages",
    recursive(f"{with_clause('doc_pages')}, {S_SCORED}, {S_ANCHORS}, {S_FOCUS} SELECT doc_id, page_num FROM focus"),
)
def _(spark, sf):
    return _focus(spark, sf)[1]


@query(
    "select_pages",
    recursive(f"""{with_clause('doc_pages', 'page_tables')}, {S_SCORED}, {S_ANCHORS}, {S_FOCUS},
    t AS (SELECT doc_id, page_num, count(*) AS n FROM page_tables GROUP BY 1, 2),
    s AS (SELECT p.doc_id, p.page_num, count(*) OVER (PARTITION BY p.doc_id) AS page_total,
      {S_WORDS} * CAST(0.5 AS DOUBLE) + CASE WHEN {S_NUM} THEN 40 ELSE 0 END + CASE WHEN {S_DATES} THEN 30 ELSE 0 END + coalesce(n, 0) * 60 AS score,
      CASE WHEN p.page_num <= 3 OR f.page_num IS NOT NULL THEN 0 ELSE 1 END AS band
      FROM doc_pages p LEFT JOIN t USING (doc_id, page_num) LEFT JOIN focus f ON f.doc_id = p.doc_id AND f.page_num = p.page_num)
    SELECT doc_id, page_num, score FROM s QUALIFY page_total <= 20 OR band = 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY band, score DESC, page_num) <= 25"""),
)
def _(spark, sf):
    pages, focus = _focus(spark, sf)
    return P.select_pages(pages, table(spark, sf, "page_tables"), focus)


@query(
    "table_scan_pages",
    recursive(f"""{with_clause('doc_pages')}, {S_SCORED}, {S_ANCHORS}, {S_FOCUS},
    s AS (SELECT p.doc_id, p.page_num, count(*) OVER (PARTITION BY p.doc_id) AS page_total, {s_hits('lower(text)', P.TABLE_WORDS)} AS hits,
      count(f.page_num) OVER (PARTITION BY p.doc_id) AS n_focus, CASE WHEN p.page_num <= 3 OR f.page_num IS NOT NULL THEN 0 ELSE 1 END AS band
      FROM doc_pages p LEFT JOIN focus f ON f.doc_id = p.doc_id AND f.page_num = p.page_num)
    SELECT doc_id, page_num FROM s QUALIFY page_total <= 30 OR band = 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY band, hits DESC, page_num) <= greatest(40, n_focus + 10)"""),
)
def _(spark, sf):
    pages, focus = _focus(spark, sf)
    return P.table_scan_pages(pages, focus)


S_SIG = r"array_to_string(list_filter(list_transform(string_split(lower(head), '|'), lambda c: regexp_replace(c, '[^a-z0-9]+', '', 'g')), lambda c: c <> ''), '|')"
S_HEAD = r"array_to_string(CASE WHEN rule > 0 THEN lines[1:rule - 1] ELSE lines END, ' ') AS head"
S_RULED = r"""ruled AS MATERIALIZED (SELECT *, list_position(list_transform(string_split(coalesce(markdown, ''), chr(10)), lambda x: regexp_matches(x, '^\|\s*-')), true) AS rule,
      string_split(coalesce(markdown, ''), chr(10)) AS lines FROM {rel})"""


@query(
    "expected_rows",
    f"""{with_clause('doc_pages', 'page_tables')}, {S_RULED.format(rel='page_tables')}, full_text AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS text FROM doc_pages GROUP BY 1),
    nums AS (SELECT doc_id, unnest({' || '.join(f"regexp_extract_all(text, {q('(?i)' + p)}, 1)" for p in P.COUNT_PATTERNS)}) AS n FROM full_text),
    stated AS (SELECT doc_id, max(TRY_CAST(n AS INTEGER)) AS n FROM nums WHERE TRY_CAST(n AS INTEGER) BETWEEN 2 AND 9999 GROUP BY 1),
    fit AS (SELECT *, {S_HEAD} FROM ruled WHERE row_count >= 4 AND col_count >= 3),
    largest AS (SELECT doc_id, max(row_count - 1) AS n FROM fit GROUP BY 1),
    spread AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, {S_SIG} AS sig, sum(row_count - 1) AS n FROM fit WHERE {S_SIG} <> '' GROUP BY ALL
      HAVING count(*) >= 2 AND min(col_count) >= 8) GROUP BY 1)
    SELECT d.doc_id, CAST(CAST(coalesce(s.n, r.n, l.n) AS BIGINT) AS VARCHAR) AS expected_rows FROM (SELECT DISTINCT doc_id FROM doc_pages) d
    LEFT JOIN stated s USING (doc_id) LEFT JOIN spread r USING (doc_id) LEFT JOIN largest l USING (doc_id)""",
)
def _(spark, sf):
    out = P.expected_rows(table(spark, sf, "doc_pages"), table(spark, sf, "page_tables"))
    return out.withColumn("expected_rows", F.col("expected_rows").cast("string"))


@query(
    "expected_rows_from_tables",
    f"""{with_clause('doc_tables')}, {S_RULED.format(rel='doc_tables')}, fit AS (SELECT *, {S_HEAD} FROM ruled WHERE row_count >= 4 AND col_count >= 3),
    largest AS (SELECT doc_id, max(row_count - 1) AS n FROM fit GROUP BY 1),
    spread AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, {S_SIG} AS sig, sum(row_count - 1) AS n FROM fit WHERE {S_SIG} <> '' GROUP BY ALL
      HAVING count(*) >= 2 AND min(col_count) >= 8) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(r.n, l.n) AS BIGINT) AS expected_rows FROM largest l LEFT JOIN spread r USING (doc_id)""",
)
def _(spark, sf):
    tables = table(spark, sf, "doc_tables")
    return P.expected_rows(spark.createDataFrame([], "doc_id string, page_num int, text string"), tables)


@query(
    "scan_flags",
    f"""{with_clause('doc_pages', 'doc_files')}, s AS (SELECT doc_id, avg(length(text)) AS avg_chars, avg(CAST(image_count > 0 AS INTEGER)) AS image_share, count(*) AS n FROM doc_pages GROUP BY 1)
    SELECT doc_id, round(avg_chars, 4) AS avg_chars, round(image_share, 4) AS image_share, (image_share >= 0.5 AND avg_chars < 150)
      OR (image_share >= 0.5 AND avg_chars < 800 AND size_bytes / 1024.0 / n > 150) OR (size_bytes / 1024.0 / n > 200 AND avg_chars < 500) AS is_scanned
    FROM s JOIN doc_files USING (doc_id)""",
)
def _(spark, sf):
    out = P.scan_flags(table(spark, sf, "doc_pages"), table(spark, sf, "doc_files"))
    return out.withColumns({"avg_chars": F.round("avg_chars", 4), "image_share": F.round("image_share", 4)})


@query(
    "structure_hint",
    rf"""{with_clause('doc_pages', 'page_tables')}, f AS (SELECT doc_id, sum(len(regexp_extract_all(text, '(?m)^\s*[\w\s]{{2,30}}:\s+\S'))) FILTER (WHERE page_num <= 4) AS hits FROM doc_pages GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n, sum(row_count) AS rows FROM page_tables GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS table_count, CAST(coalesce(hits, 0) AS BIGINT) AS form_lines, CASE WHEN n >= 3 OR rows >= 10 THEN 'dense_tables' WHEN hits >= 6 THEN 'form'
      WHEN n > 0 THEN 'mixed' ELSE 'narrative' END AS doc_type_hint FROM f LEFT JOIN t USING (doc_id)""",
)
def _(spark, sf):
    return P.structure_hint(table(spark, sf, "doc_pages"), table(spark, sf, "page_tables"))


S_TOKENS = rf"""{S_RULED.format(rel='doc_tables')}, heads AS (SELECT doc_id, rule, lines, {S_HEAD} FROM ruled),
    cells AS (SELECT doc_id, unnest(string_split(head, '|')) AS c FROM heads
      UNION ALL SELECT doc_id, c FROM (SELECT doc_id, lower({s_squash(s_strip("string_split(line, '|')[2]"))}) AS c FROM
        (SELECT doc_id, unnest(lines[rule + 1:]) AS line FROM heads WHERE rule > 0) WHERE line LIKE '|%')
        WHERE regexp_matches(c, '[a-z]') AND NOT contains(c, '$') AND length(c) <= 50 AND (NOT contains(c, ':') OR c LIKE '%:')),
    tokens AS MATERIALIZED (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, {s_strip(f"regexp_replace(lower({s_squash(s_strip('c'))}), ':+$', '')")} AS token FROM cells)
      WHERE regexp_matches(token, '[a-z]') AND NOT contains(token, '$') AND length(token) <= 60 AND NOT contains(token, ':'))"""


@query("table_header_tokens", f"{with_clause('doc_tables')}, {S_TOKENS} SELECT doc_id, token FROM tokens")
def _(spark, sf):
    return P.table_header_tokens(table(spark, sf, "doc_tables"))


@query(
    "reporting_unit",
    rf"""{with_clause('doc_pages')}, t AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_num) AS text FROM doc_pages GROUP BY 1),
    u AS (SELECT doc_id, nullif(regexp_extract(text, {q('(?i)' + P.PAREN_UNIT)}, 1), '') AS p, nullif(regexp_extract(text, {q('(?i)' + P.INLINE_UNIT)}, 1), '') AS i FROM t)
    SELECT doc_id, coalesce(lower(regexp_replace({s_strip('p')}, 's+$', '')) || 's', lower({s_strip('i')})) AS unit FROM u""",
)
def _(spark, sf):
    return P.reporting_unit(table(spark, sf, "doc_pages"))


@query(
    "route_documents",
    f"""{with_clause('doc_pages', 'page_tables', 'doc_files')}, t AS (SELECT doc_id, bool_or(row_count >= 5 AND col_count >= 4) AS wide, bool_or(row_count >= 4 AND col_count >= 2) AS data FROM page_tables GROUP BY 1)
    SELECT doc_id, page_count, CASE WHEN page_count <= 3 AND NOT coalesce(wide, false) THEN 'individual' WHEN wide OR data THEN 'multi_record' ELSE 'individual' END AS route
    FROM doc_files LEFT JOIN t USING (doc_id)""",
)
def _(spark, sf):
    return P.route_documents(table(spark, sf, "doc_files"), table(spark, sf, "page_tables"), F.lit(2))


@query(
    "schedule_schema_predicate",
    f"""{with_clause('fieldsets')} SELECT set_id, count(*) >= 4 AND ((bool_or(contains(field, '#')) AND bool_or(regexp_matches(lower(field), {q(P.DESCRIPTOR_WORD)})))
      OR count(*) FILTER (WHERE regexp_matches(lower(field), {q(P.COMPONENT_WORD)})) >= 2
      OR (bool_or(regexp_matches(lower(field), {q(P.DESCRIPTOR_WORD)})) AND bool_or(regexp_matches(lower(field), {q(P.VALUE_WORD)}))
        AND count(*) FILTER (WHERE regexp_matches(lower(field), {q(P.COMPONENT_WORD)})) >= 1)) AS is_schedule FROM fieldsets GROUP BY set_id""",
)
def _(spark, sf):
    return P.schedule_schema_predicate(table(spark, sf, "fieldsets"))


ASKED = """SELECT scope_id, EACH('Location Number', 'Year Built', 'Business Income', 'Sprinklered', 'Valuation Basis', '#', 'Zq Xv', 'Notes') AS field
  FROM (SELECT DISTINCT doc_id AS scope_id FROM {doc_tables}) d"""
NOTES = """SELECT 'D' || CAST(c_custkey AS STRING) AS scope_id, CASE WHEN c_custkey % 4 = 0 THEN 'Sprinklered | yes' WHEN c_custkey % 4 = 1 THEN 'we are sprinklered'
  ELSE 'All notes follow below, ' || c_mktsegment END AS text FROM {customer}"""


def s_pair(f, h):
    return (
        f"(starts_with({f}, {h}) OR starts_with({h}, {f}) OR (least(length({f}), length({h})) >= 3 AND (contains({f}, {h}) OR contains({h}, {f})))"
        f" OR starts_with(translate({f}, 'aeiou', ''), {h}))"
    )


@query(
    "match_fields_to_headers",
    rf"""{with_clause('doc_tables')}, {S_TOKENS}, asked AS MATERIALIZED (SELECT scope_id, field, regexp_extract_all(lower(field), '[a-z]{{2,}}') AS ft FROM ({plain(ASKED)})),
    notes AS (SELECT scope_id, lower(text) AS text FROM ({NOTES.replace('{', '').replace('}', '')})),
    ht AS MATERIALIZED (SELECT DISTINCT scope_id, h FROM (SELECT doc_id AS scope_id, unnest(regexp_extract_all(token, '[a-z]{{2,}}') || [regexp_replace(token, '[^a-z]', '', 'g')]
      || CASE WHEN len(regexp_extract_all(token, '[a-z]{{2,}}')) >= 2 THEN [array_to_string(list_transform(regexp_extract_all(token, '[a-z]{{2,}}'), lambda t: t[1]), '')] ELSE [] END) AS h FROM tokens)
      WHERE length(h) >= 2),
    fterm AS (SELECT scope_id, field, unnest(ft) AS f FROM asked),
    hit AS (SELECT DISTINCT scope_id, field FROM (
      SELECT a.scope_id, a.field FROM fterm a JOIN ht USING (scope_id) WHERE {s_pair('f', 'h')}
      UNION ALL SELECT a.scope_id, a.field FROM asked a JOIN ht USING (scope_id) WHERE len(ft) >= 2 AND starts_with(array_to_string(list_transform(ft, lambda t: t[1]), ''), h)
      UNION ALL SELECT a.scope_id, a.field FROM fterm a JOIN notes USING (scope_id) WHERE length(f) >= 3 AND instr(text, f) > 0
        AND regexp_matches(substring(text, greatest(instr(text, f) - 40, 1), instr(text, f) - greatest(instr(text, f) - 40, 1) + length(f) + 40), '[:,|]')))
    SELECT a.scope_id, a.field, len(ft) = 0 OR hit.field IS NOT NULL AS matched FROM asked a LEFT JOIN hit USING (scope_id, field)""",
)
def _(spark, sf):
    tables = table(spark, sf, "doc_tables")
    tokens = P.table_header_tokens(tables).withColumnRenamed("doc_id", "scope_id")
    notes = spark.sql(NOTES, customer=table(spark, sf, "customer"))
    return P.match_fields_to_headers(spark.sql(spark_text(ASKED), doc_tables=tables), tokens, notes)


DOCS = """SELECT 'J' || CAST(c_nationkey AS STRING) AS job_id, c_custkey AS doc_ord, 'D' || CAST(c_custkey AS STRING) AS doc_id,
  CAST(c_custkey % 9 + 1 AS INTEGER) AS page_count, CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN 'mixed' WHEN 1 THEN 'form' WHEN 2 THEN 'narrative' END AS doc_type_hint FROM {customer}"""
S_COMBINED = f"""docs AS MATERIALIZED ({DOCS.replace('{', '').replace('}', '')}), sized AS (SELECT d.*, coalesce(m, 0) AS max_rows FROM docs d LEFT JOIN
      (SELECT doc_id, max(row_count) AS m FROM doc_tables GROUP BY 1) USING (doc_id)),
    combined AS MATERIALIZED (SELECT *, row_number() OVER w AS position, CAST(coalesce(sum(page_count) OVER (PARTITION BY job_id ORDER BY max_rows DESC, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_offset
      FROM sized WINDOW w AS (PARTITION BY job_id ORDER BY max_rows DESC, doc_ord))"""


def _combined(spark, sf):
    docs = spark.sql(DOCS, customer=table(spark, sf, "customer"))
    return docs, P.combine_documents(docs, table(spark, sf, "doc_tables"))


@query(
    "combine_documents",
    f"""{with_clause('doc_tables')}, {S_COMBINED} SELECT job_id, doc_id, position, CASE WHEN position = 1 THEN 'PRIMARY' ELSE 'SUPPLEMENTAL ' || (position - 1) END AS role,
    max_rows, page_count, page_offset FROM combined""",
)
def _(spark, sf):
    return _combined(spark, sf)[1]


@query(
    "combined_summary",
    f"""{with_clause('doc_tables')}, {S_COMBINED} SELECT job_id, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages,
    greatest(max(max_rows) FILTER (WHERE position = 1) - 1, 0) AS expected_rows,
    (list(doc_type_hint ORDER BY CASE doc_type_hint WHEN 'mixed' THEN 3 WHEN 'form' THEN 2 WHEN 'narrative' THEN 1 ELSE 0 END DESC, position))[1] AS doc_type_hint
    FROM combined GROUP BY job_id""",
)
def _(spark, sf):
    docs, combined = _combined(spark, sf)
    return P.combined_summary(combined, docs)


@query(
    "page_offsets",
    f"{with_clause('doc_tables')}, {S_COMBINED} SELECT job_id, doc_id, table_ord, t.page_num + page_offset AS page_num FROM doc_tables t JOIN combined USING (doc_id)",
)
def _(spark, sf):
    out = P.page_offsets(table(spark, sf, "doc_tables").select("doc_id", "table_ord", "page_num"), _combined(spark, sf)[1])
    return out.select("job_id", "doc_id", "table_ord", "page_num")


@query(
    "chunk_pages",
    f"""{with_clause('doc_pages')} SELECT doc_id, page_num, CAST(CASE WHEN count(*) OVER (PARTITION BY doc_id) > 8
    THEN floor((row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) / 12) ELSE 0 END AS INTEGER) AS chunk FROM doc_pages""",
)
def _(spark, sf):
    return P.chunk_pages(table(spark, sf, "doc_pages").select("doc_id", "page_num")).drop("page_total")


@query(
    "chunk_conversation_pages",
    """WITH t AS (SELECT 'C' || conv_id AS doc_id, turn + 1 AS page_num FROM conversations) SELECT doc_id, page_num, CAST(CASE WHEN count(*) OVER (PARTITION BY doc_id) > 4
    THEN floor((row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1) / 3) ELSE 0 END AS INTEGER) AS chunk FROM t""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("doc_id"), (F.col("turn") + 1).alias("page_num")
    )
    return P.chunk_pages(turns, size=3, above=4).drop("page_total")


S_SECT = rf"""SELECT doc_id, page_num, {s_strip(s_blank('header'))} AS header, array_to_string(list_slice(regexp_extract_all(
      concat_ws(' ', nullif({s_strip(s_blank('header'))}, ''), nullif({s_strip(s_blank('text'))}, ''), nullif({s_strip(s_blank('footer'))}, '')),
      '[A-Za-z0-9][A-Za-z0-9/&().,#:%-]*'), 1, 50), ' ') AS preview,
    concat_ws(chr(10), '=== Page ' || page_num || ' ===', '--- Header ---' || chr(10) || nullif({s_strip(s_blank('header'))}, ''), nullif({s_strip(s_blank('text'))}, ''),
      '--- Footer ---' || chr(10) || nullif({s_strip(s_blank('footer'))}, '')) AS content FROM doc_pages"""


@query("sections", f"{with_clause('doc_pages')} {S_SECT}")
def _(spark, sf):
    return P.sections(table(spark, sf, "doc_pages"))


@query(
    "batch_sections",
    f"""{with_clause('doc_pages')}, e AS (SELECT doc_id, CAST(count(*) * (1 + length(doc_id)) AS BIGINT) AS expected_rows FROM doc_pages GROUP BY 1),
    n AS (SELECT p.doc_id, page_num, row_number() OVER (PARTITION BY p.doc_id ORDER BY page_num) AS place, greatest(1, expected_rows // count(*) OVER (PARTITION BY p.doc_id)) AS per_section
      FROM doc_pages p JOIN e USING (doc_id)) SELECT doc_id, page_num, (place - 1) // greatest(1, 50 // per_section) AS batch FROM n""",
)
def _(spark, sf):
    pages = table(spark, sf, "doc_pages").select("doc_id", "page_num")
    expected = pages.groupBy("doc_id").agg((F.count("*") * (1 + F.max(F.length("doc_id")))).alias("expected_rows"))
    return P.batch_sections(pages, expected)


@query(
    "merge_attachments_text",
    """WITH m AS (SELECT conv_id, text AS body FROM conversations WHERE turn = 0), p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS rest
      FROM conversations WHERE turn > 0 AND coalesce(text, '') <> '' GROUP BY 1)
    SELECT conv_id AS message_id, concat_ws(chr(10) || chr(10), nullif(body, ''), rest) AS full_text FROM m LEFT JOIN p USING (conv_id)""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").withColumnRenamed("conv_id", "message_id")
    messages = turns.filter("turn = 0").select("message_id", F.col("text").alias("body"))
    parts = turns.filter("turn > 0").select("message_id", F.col("turn").alias("part_ord"), "text")
    return P.merge_attachments_text(messages, parts)


@query(
    "token_budget",
    f"""{with_clause('doc_files')} SELECT doc_id, CAST(least(32768, greatest(12000, 2000 + 18 * 22 * greatest(coalesce(nullif(page_count, 0), 8), 8))) AS INTEGER) AS budget FROM doc_files""",
)
def _(spark, sf):
    return table(spark, sf, "doc_files").select("doc_id", X.token_budget(22, F.col("page_count")).alias("budget"))
