"""Record clean-up, quality and merging on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import quality as Q
from tabloom.operators import records as R
from tabloom.plans.bindings import ENTITY_FIELDS, RECORD_FIELDS, plain, spark_text, table, with_clause
from tabloom.plans.catalog import query
from tabloom.plans.sqltext import (
    q, s_any, s_blank, s_count, s_filled, s_filled_count, s_squash, s_strip, s_sum,
)
from tabloom.schema import MARKERS_REPORT, MARKERS_SHORT

RF, EF = RECORD_FIELDS, ENTITY_FIELDS
KEYS = "scope_id, row_ord, source_file, error"


def path_text(df):
    """Position lists as text, so that results compare plainly."""
    return df.withColumn("row_ord", F.array_join(F.transform("row_ord", lambda x: x.cast("string")), "."))


# --- projections -----------------------------------------------------------------------------------------------------

def s_money(c: str) -> str:
    base = rf"regexp_extract({s_strip(c)}, '(?is)^(.*?)\s+(?:million|billion|thousand)s?$', 1)"
    return (
        rf"CASE WHEN regexp_matches({s_strip(c)}, '(?is)^(.*?)\s+(?:million|billion|thousand)s?$')"
        rf" AND regexp_matches({base}, '\d{{1,3}}(?:,\d{{3}})+') THEN {s_strip(base)} ELSE {s_strip(c)} END"
    )


def s_normal(f: str) -> str:
    return f"CASE WHEN {s_filled(f)} THEN {s_money(f)} END AS {f}"


@query("normalise_records", f"{with_clause('recs')} SELECT {KEYS}, {', '.join(map(s_normal, RF))} FROM recs")
def _(spark, sf):
    return R.normalise_records(table(spark, sf, "recs"), RF)


def s_explained(c: str) -> str:
    t = s_strip(s_blank(c))
    words = s_any(f"contains(lower({t}), {q(m)})" for m in R.EXPLANATIONS)
    return f"(regexp_matches({t}, {q(R.FORMULA)}) OR (length({t}) > 80 AND {words}))"


REASON = (
    f"CASE WHEN {s_filled_count(RF)} = 0 THEN 'no fields filled' "
    + " ".join(f"WHEN {s_explained(f)} THEN 'field ''{f}'' contains formula or explanation'" for f in RF)
    + " ELSE '' END"
)


@query(
    "flag_invalid_records",
    f"{with_clause('recs')} SELECT scope_id, row_ord, {REASON} AS reason, {REASON} = '' AS valid FROM recs",
)
def _(spark, sf):
    return R.flag_invalid_records(table(spark, sf, "recs"), RF).select("scope_id", "row_ord", "reason", "valid")


@query(
    "drop_blank_records",
    f"{with_clause('recs')} SELECT {KEYS}, {', '.join(RF)} FROM recs "
    f"WHERE {s_filled_count(RF)} > 0 OR coalesce(error, '') <> ''",
)
def _(spark, sf):
    return R.drop_blank_records(table(spark, sf, "recs"), RF)


@query(
    "drop_blank_records_page_path",
    f"{with_clause('recs')} SELECT {KEYS}, {', '.join(RF)} FROM recs WHERE {s_filled_count(RF)} > 0",
)
def _(spark, sf):
    return R.drop_blank_records(table(spark, sf, "recs"), RF, keep_errors=False)


@query(
    "derive_location_name",
    f"{with_clause('sched')} SELECT scope_id, row_ord, loc_no, CASE WHEN coalesce(error, '') = '' "
    f"AND NOT {s_filled('loc_name', MARKERS_SHORT)} AND {s_filled('loc_no', MARKERS_SHORT)} "
    f"THEN 'Location ' || {s_strip('loc_no')} ELSE loc_name END AS loc_name FROM sched",
)
def _(spark, sf):
    df = table(spark, sf, "sched").select("scope_id", "row_ord", "error", "loc_no", "loc_name")
    return R.derive_location_name(df, "loc_name", "loc_no").drop("error")


# --- quality ---------------------------------------------------------------------------------------------------------

def s_number(c: str) -> str:
    t = rf"regexp_replace({s_strip(s_blank(c))}, '[$£€¥,\s%()]', '', 'g')"
    t = rf"regexp_replace({t}, '(?:trillion|billion|million|thousand|[tbmk])$', '', 'i')"
    t = rf"regexp_replace({t}, '^-+', '')"
    return f"regexp_matches({t}, {q(X.FLOAT_GRAMMAR)})"


def s_date(c: str) -> str:
    return f"regexp_matches({s_strip(s_blank(c))}, {q(X.DATE_SEARCH)})"


def s_quality(rel: str, fields: list[str]) -> str:
    """Quality report as SQL."""
    nums, dates = X.numeric_fields(fields), X.date_fields(fields)
    present = {f: s_filled(f, MARKERS_REPORT) for f in fields}
    def sums(conds):
        return s_sum(s_count(conds)) if conds else "CAST(0 AS BIGINT)"

    return f"""SELECT *, round_even(field_fill_rate * CAST(0.6 AS DOUBLE) + numeric_parse_rate * CAST(0.2 AS DOUBLE)
        + date_parse_rate * CAST(0.2 AS DOUBLE), 4) AS overall_score FROM (
      SELECT scope_id, row_count, filled_fields, row_count * {len(fields)} AS total_fields, numeric_hits, numeric_total,
        date_hits, date_total,
        round_even(CAST(filled_fields AS DOUBLE) / (row_count * {len(fields)}), 4) AS field_fill_rate,
        CASE WHEN numeric_total > 0 THEN round_even(CAST(numeric_hits AS DOUBLE) / numeric_total, 4) ELSE 1.0::DOUBLE END AS numeric_parse_rate,
        CASE WHEN date_total > 0 THEN round_even(CAST(date_hits AS DOUBLE) / date_total, 4) ELSE 1.0::DOUBLE END AS date_parse_rate,
        round_even(CAST(errors AS DOUBLE) / row_count, 4) AS error_row_rate
      FROM (SELECT scope_id, count(*) AS row_count, {sums(present.values())} AS filled_fields,
        {sums([present[f] for f in nums])} AS numeric_total,
        {sums([f"({present[f]} AND {s_number(f)})" for f in nums])} AS numeric_hits,
        {sums([present[f] for f in dates])} AS date_total,
        {sums([f"({present[f]} AND {s_date(f)})" for f in dates])} AS date_hits,
        {sums(["(coalesce(error, '') <> '')"])} AS errors FROM {rel} GROUP BY scope_id))"""


@query("quality_report", f"{with_clause('recs')} {s_quality('recs', RF)}")
def _(spark, sf):
    return Q.quality_report(table(spark, sf, "recs"), RF)


def s_cells(rel: str, fields: list[str], keys: str = "scope_id, row_ord") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, error, '{f}' AS field, {i} AS field_ord, {f} AS value FROM {rel}" for i, f in enumerate(fields)
    )


@query(
    "field_fill_profile",
    f"""{with_clause('recs')}, cells AS ({s_cells('recs', RF)})
    SELECT scope_id, field, count(*) AS rows, CAST(count(*) FILTER (WHERE {s_filled('value')}) AS BIGINT) AS filled,
      round_even(CAST(count(*) FILTER (WHERE {s_filled('value')}) AS DOUBLE) / count(*), 4) AS fill_rate
    FROM cells WHERE coalesce(error, '') = '' GROUP BY scope_id, field""",
)
def _(spark, sf):
    return Q.field_fill_profile(table(spark, sf, "recs"), RF)


@query(
    "record_fill",
    f"""{with_clause('recs')} SELECT scope_id, row_ord, round(CAST({s_filled_count(RF)} AS DOUBLE) / {len(RF)}, 6) AS fill_rate,
      array_to_string(list_filter([{', '.join(f"CASE WHEN NOT {s_filled(f)} THEN '{f}' END" for f in RF)}],
        lambda x: x IS NOT NULL), ',') AS missing_fields,
      CAST({s_filled_count(RF)} AS DOUBLE) / {len(RF)} >= 0.7 AS passed FROM recs""",
)
def _(spark, sf):
    out = Q.record_fill(table(spark, sf, "recs"), RF, 0.7)
    return out.select(
        "scope_id", "row_ord", F.round("fill_rate", 6).alias("fill_rate"),
        F.array_join("missing_fields", ",").alias("missing_fields"), "passed",
    )


S_SHAPES = {
    "short_code": r"(length(value) <= 16 AND regexp_matches(value, '\d') AND regexp_full_match(value, '[A-Za-z0-9#/_-]+'))",
    "numeric_only": r"regexp_full_match(value, '\d+')",
    "large_number": r"regexp_full_match(value, '0*[1-9]\d{3,}')",
    "year": r"regexp_full_match(value, '(18|19|20)\d{2}')",
    "zip": r"regexp_full_match(value, '\d{5}(?:-\d{4})?|[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d')",
    "money": r"regexp_matches(value, '\$|\d{1,3}(?:,\d{3})+')",
    "address": r"(length(value) >= 8 AND regexp_matches(value, '\d') AND regexp_matches(value, '\p{L}') AND regexp_matches(value, '[ ,]'))",
}


def s_profile(rel: str, fields: list[str]) -> str:
    """CTE `profile` (and what it needs) over a records relation."""
    ratios = ", ".join(f"avg(CAST({e} AS INTEGER)) AS {s}_ratio" for s, e in S_SHAPES.items())
    return f"""cells AS MATERIALIZED ({s_cells(rel, fields)}),
    vals AS (SELECT scope_id, field, field_ord, {s_squash(s_strip('value'))} AS value FROM cells
      WHERE coalesce(error, '') = '' AND {s_filled('value')}),
    sizes AS (SELECT scope_id, count(*) AS data_rows,
      CAST(count(*) FILTER (WHERE {s_filled_count(fields)} > 0) AS BIGINT) AS nonblank_rows
      FROM {rel} WHERE coalesce(error, '') = '' GROUP BY scope_id),
    profile AS MATERIALIZED (SELECT scope_id, field, field_ord, data_rows, nonblank_rows, filled,
      CAST(filled AS DOUBLE) / data_rows AS filled_ratio, CAST(kinds AS DOUBLE) / filled AS unique_ratio, avg_len,
      {', '.join(f'{s}_ratio' for s in S_SHAPES)}
      FROM (SELECT scope_id, field, field_ord, count(*) AS filled, count(DISTINCT lower(value)) AS kinds,
        avg(length(value)) AS avg_len, {ratios} FROM vals GROUP BY scope_id, field, field_ord) JOIN sizes USING (scope_id))"""


PROFILE_OUT = ["filled_ratio", "unique_ratio", "avg_len"] + [f"{s}_ratio" for s in Q.SHAPES]


@query(
    "profile_columns",
    f"""{with_clause('sched')}, {s_profile('sched', EF)} SELECT scope_id, field, filled,
    {', '.join(f'round({c}, 6) AS {c}' for c in PROFILE_OUT)} FROM profile""",
)
def _(spark, sf):
    out = Q.profile_columns(table(spark, sf, "sched"), EF)
    return out.select("scope_id", "field", "filled", *[F.round(c, 6).alias(c) for c in PROFILE_OUT])


def s_keys(name: str, rows: str) -> str:
    """CTE `name`: key columns per scope, shares relative to `rows`."""
    filled = f"CAST(filled AS DOUBLE) / {rows}"
    return f"""{name}_s AS MATERIALIZED (SELECT *, {filled} * 1.5 + unique_ratio * 6 * ({filled}) + short_code_ratio * 2 + numeric_only_ratio
        - CASE WHEN unique_ratio < 0.8 AND NOT (short_code_ratio >= 0.5 OR numeric_only_ratio >= 0.5) THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END
        - zip_ratio * 6 - address_ratio * 4 - money_ratio * 3 - year_ratio * 4 - large_number_ratio * 4 AS id_score,
      {filled} * 1.5 + unique_ratio * 1.5 + address_ratio * 4 - zip_ratio * 4 - money_ratio * 3 - short_code_ratio * 2 AS address_score
      FROM profile),
    {name}_i AS (SELECT scope_id, field, id_score FROM {name}_s QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY id_score DESC, field_ord) = 1),
    {name}_a AS (SELECT scope_id, field, address_score FROM {name}_s QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY address_score DESC, field_ord) = 1),
    {name}_k AS (SELECT scope_id, CASE WHEN id_score >= 2.5 THEN i.field END AS id_field,
      CASE WHEN address_score >= 2.0 THEN a.field END AS address_field, round(id_score, 6) AS id_score,
      round(address_score, 6) AS address_score FROM {name}_i i JOIN {name}_a a USING (scope_id)),
    {name} AS MATERIALIZED (SELECT k.*, coalesce((SELECT list(field ORDER BY field) FROM {name}_s s WHERE s.scope_id = k.scope_id
        AND s.{rows} >= 3 AND s.filled * 2 >= s.{rows} AND s.unique_ratio >= 0.9
        AND s.field IS DISTINCT FROM k.id_field AND s.field IS DISTINCT FROM k.address_field), []) AS distinguishers FROM {name}_k k)"""


@query(
    "infer_key_fields",
    f"""{with_clause('sched')}, {s_profile('sched', EF)}, {s_keys('keys', 'data_rows')}
    SELECT scope_id, id_field, address_field, id_score, address_score, array_to_string(distinguishers, ',') AS distinguishers FROM keys""",
)
def _(spark, sf):
    keys = Q.key_columns(table(spark, sf, "sched"), EF)
    return keys.withColumn("distinguishers", F.array_join("distinguishers", ","))


@query(
    "duplicate_keys",
    f"""{with_clause('sched')} SELECT scope_id, {s_strip('asset_id')} AS id_value, count(*) AS n FROM sched
    WHERE {s_filled('asset_id')} GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "sched"), "asset_id")


TARGETS = """SELECT 'S' || CAST(n_nationkey AS STRING) AS scope_id, 0.6 + 0.01 * n_nationkey AS min_fill, 0.9 AS min_numeric,
  0.9 AS min_date, 0.02 AS max_error, 550 + 5 * n_nationkey AS expected_rows FROM {nation}"""
RUNS = """SELECT 'S' || CAST(c_nationkey AS STRING) AS scope_id, sum(CAST(o_orderkey % 100 AS BIGINT)) * 0.001 AS cost_usd,
  count(*) * 0.25 AS seconds FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey"""


@query(
    "extraction_report",
    f"""{with_clause('recs')}, targets AS ({TARGETS.replace('{', '').replace('}', '')}), runs AS ({RUNS.replace('{', '').replace('}', '')}),
    report AS ({s_quality('recs', RF)})
    SELECT scope_id, row_count, field_fill_rate, numeric_parse_rate, date_parse_rate, error_row_rate,
      CAST(round(cost_usd, 4) AS DOUBLE) AS cost_usd, CAST(round(seconds, 4) AS DOUBLE) AS seconds,
      abs(row_count - expected_rows) <= greatest(3.0, expected_rows * 0.15) AS rows_ok,
      field_fill_rate >= min_fill AND numeric_parse_rate >= min_numeric AND date_parse_rate >= min_date
        AND error_row_rate <= max_error AS passed
    FROM report JOIN targets USING (scope_id) LEFT JOIN runs USING (scope_id)""",
)
def _(spark, sf):
    targets = spark.sql(TARGETS, nation=table(spark, sf, "nation"))
    runs = spark.sql(RUNS, orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))
    out = Q.extraction_report(Q.quality_report(table(spark, sf, "recs"), RF), targets, runs)
    return out.withColumn("cost_usd", F.round("cost_usd", 4).cast("double")).withColumn(
        "seconds", F.round("seconds", 4).cast("double")
    )


ATTEMPTS = """SELECT scope_id, attempt_no, n, CAST(600 AS BIGINT) AS expected FROM (
  SELECT scope_id, CAST(row_ord % 3 AS INTEGER) AS attempt_no, count(*) * (1 + row_ord % 3) AS n FROM {recs} GROUP BY scope_id, row_ord % 3)"""


@query(
    "choose_attempt",
    f"""{with_clause('recs')}, att AS ({ATTEMPTS.replace('{recs}', 'recs')}) SELECT scope_id, attempt_no, n FROM att
    QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY abs(n - expected), attempt_no) = 1""",
)
def _(spark, sf):
    return Q.choose_attempt(spark.sql(ATTEMPTS, recs=table(spark, sf, "recs")))


@query(
    "attempt_score",
    f"""{with_clause('recs')} SELECT scope_id, attempt_no, rows, filled,
      round(errors + abs(rows - 200) - CAST(filled AS DOUBLE) / greatest(1, rows * {len(RF)}), 6) AS score
    FROM (SELECT scope_id, CAST(row_ord % 3 AS INTEGER) AS attempt_no,
      {s_sum("CAST(coalesce(error, '') = '' AS INTEGER)")} AS rows, {s_sum("CAST(coalesce(error, '') <> '' AS INTEGER)")} AS errors,
      {s_sum(f"CASE WHEN coalesce(error, '') = '' THEN {s_filled_count(RF)} ELSE 0 END")} AS filled
      FROM recs GROUP BY 1, 2)""",
)
def _(spark, sf):
    df = table(spark, sf, "recs").withColumn("attempt_no", (F.col("row_ord") % 3).cast("int"))
    expected = df.select("scope_id").distinct().withColumn("expected", F.lit(200))
    return Q.attempt_score(df, RF, expected)


# --- merging ---------------------------------------------------------------------------------------------------------

def s_key_filled(fields, key):
    return f"coalesce({s_any(f'({key} = {q(f)} AND {s_filled(f)})' for f in fields)}, false)"


def s_key_value(fields, key):
    return "CASE " + " ".join(f"WHEN {key} = {q(f)} THEN {f}" for f in fields) + " END"


def s_token(text: str, otherwise: str) -> str:
    tokens = f"regexp_extract_all({text}, '[A-Za-z0-9#/_-]+')"
    return rf"coalesce(list_filter({tokens}, lambda t: regexp_matches(t, '\d'))[1], {otherwise.format(tokens=tokens)})"


def s_merge_key(fields) -> str:
    idv = f"lower({s_strip(s_blank(s_key_value(fields, 'id_field')))})"
    adv = f"lower({s_strip(s_blank(s_key_value(fields, 'address_field')))})"
    id_here, ad_here = s_key_filled(fields, "id_field"), s_key_filled(fields, "address_field")
    spare = "CASE " + " ".join(
        f"WHEN list_contains(distinguishers, {q(f)}) AND {s_filled(f)} THEN left(lower({s_strip(f)}), 40)" for f in fields
    ) + " END"
    token = s_token(idv, "{tokens}[1], left(" + idv + ", 20)")
    parts = (
        f"list_filter([CASE WHEN {id_here} THEN {token} END, CASE WHEN {ad_here} THEN left({adv}, 40) END, "
        f"CASE WHEN NOT {id_here} AND {ad_here} THEN {spare} END], lambda p: p IS NOT NULL)"
    )
    return f"CASE WHEN id_field IS NOT NULL AND len({parts}) > 0 THEN array_to_string({parts}, '|') END"


def s_first_filled(fields, order):
    return ", ".join(
        f"coalesce(arg_min({f}, {order}) FILTER (WHERE {s_filled(f)}), first({f} ORDER BY {order})) AS {f}" for f in fields
    )


def s_merge(src: str, keys: str, fields) -> str:
    """CTE `merged` with column `pos` (text position) over rows joined with their keys."""
    varies = s_any(
        f"coalesce(count(DISTINCT CASE WHEN list_contains(distinguishers, {q(f)}) AND {s_filled(f)} THEN lower({s_strip(f)}) END) > 1, false)"
        for f in fields
    )
    cols = ", ".join(fields)
    return f"""keyed AS MATERIALIZED (SELECT r.*, k.id_field, k.address_field, k.distinguishers, {s_filled_count(fields)} AS n_filled,
        {s_merge_key(fields)} AS mkey FROM {src} r LEFT JOIN {keys} k USING (scope_id)),
    verdict AS (SELECT scope_id, mkey, min(row_ord) AS first_ord, count(*) AS n, {varies} AS apart FROM keyed WHERE mkey IS NOT NULL GROUP BY ALL),
    joined AS MATERIALIZED (SELECT keyed.*, first_ord, apart FROM keyed JOIN verdict USING (scope_id, mkey)),
    lone AS (SELECT *, CASE WHEN scope_id IN (SELECT scope_id FROM verdict WHERE n > 1) THEN 1 ELSE 0 END AS late FROM keyed WHERE mkey IS NULL),
    merged AS MATERIALIZED (
      SELECT scope_id, '0.' || first_ord || '.' || row_ord AS pos, [0, first_ord, row_ord] AS ord, source_file, error, {cols} FROM joined WHERE apart
      UNION ALL SELECT scope_id, '0.' || min(row_ord) || '.' || min(row_ord), [0, min(row_ord), min(row_ord)],
        first(source_file ORDER BY -n_filled, row_ord), first(error ORDER BY -n_filled, row_ord),
        {', '.join(f"coalesce((list({f} ORDER BY -n_filled, row_ord) FILTER (WHERE {s_filled(f)}))[1], (list({f} ORDER BY -n_filled, row_ord))[1])" for f in fields)}
        FROM joined WHERE NOT apart GROUP BY scope_id, mkey
      UNION ALL SELECT scope_id, late || '.' || row_ord || '.' || row_ord, [late, row_ord, row_ord], source_file, error, {cols} FROM lone)"""


@query(
    "merge_by_identifier",
    f"""{with_clause('sched')}, {s_profile('sched', EF)}, {s_keys('keys', 'data_rows')}, {s_merge('sched', 'keys', EF)}
    SELECT scope_id, pos AS row_ord, source_file, error, {', '.join(EF)} FROM merged""",
)
def _(spark, sf):
    return path_text(R.merge_by_identifier(table(spark, sf, "sched"), EF))


@query(
    "merge_across_documents",
    f"""{with_clause('sched')}, keyed AS (SELECT *, {s_filled_count(EF)} AS n_filled,
      CASE WHEN {s_filled('loc_no')} THEN 'k' || regexp_replace(lower({s_strip('loc_no')}), '^0*(\\d+.*)$', '\\1') ELSE 'r' || row_ord END AS mkey,
      CASE WHEN {s_filled('loc_no')} THEN 0 ELSE 1 END AS late FROM sched)
    SELECT scope_id, late || '.' || min(row_ord) AS row_ord, first(source_file ORDER BY -n_filled, row_ord) AS source_file,
      first(error ORDER BY -n_filled, row_ord) AS error,
      {', '.join(f"coalesce((list({f} ORDER BY -n_filled, row_ord) FILTER (WHERE {s_filled(f)}))[1], (list({f} ORDER BY -n_filled, row_ord))[1]) AS {f}" for f in EF)}
    FROM keyed GROUP BY scope_id, mkey, late""",
)
def _(spark, sf):
    return path_text(R.merge_across_documents(table(spark, sf, "sched"), EF, "loc_no"))


def s_keep(fields):
    return f"(coalesce(error, '') <> '' OR {s_key_filled(fields, 'id_field')} OR {s_key_filled(fields, 'address_field')})"


@query(
    "drop_orphan_records",
    f"""{with_clause('sched')}, {s_profile('sched', EF)}, {s_keys('keys', 'data_rows')},
    marked AS (SELECT s.*, {s_keep(EF)} AS keep FROM sched s LEFT JOIN keys k USING (scope_id))
    SELECT {KEYS}, {', '.join(EF)} FROM marked QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY scope_id)""",
)
def _(spark, sf):
    return R.drop_orphan_records(table(spark, sf, "sched"), EF)


def s_signature(fields):
    return " || chr(1) || ".join(f"{s_squash(f'lower({s_strip(s_blank(f))})')}" for f in sorted(fields))


@query(
    "dedup_signature",
    f"""{with_clause('recs')}, sigs AS (SELECT *, CASE WHEN coalesce(error, '') <> '' THEN 'row' || row_ord
      ELSE {s_signature(['segment', 'priority', 'customer_name'])} END AS sig FROM recs)
    SELECT scope_id, row_ord, customer_name, segment, priority FROM sigs
    QUALIFY row_number() OVER (PARTITION BY scope_id, sig ORDER BY row_ord) = 1""",
)
def _(spark, sf):
    fields = ["customer_name", "segment", "priority"]
    df = table(spark, sf, "recs").select("scope_id", "row_ord", "error", *fields)
    return R.drop_duplicate_records(df, fields).drop("error")


def s_finalise() -> str:
    loc = (
        "CASE WHEN " + s_key_filled(EF, "id_field") + " THEN lower("
        + s_token(s_strip(s_blank(s_key_value(EF, "id_field"))), "left(" + s_strip(s_key_value(EF, "id_field")) + ", 24)") + ") END"
    )
    addr = (
        "CASE WHEN " + s_key_filled(EF, "address_field") + " THEN "
        + s_squash(f"lower(left({s_strip(s_key_value(EF, 'address_field'))}, 80))") + " ELSE '' END"
    )
    firsts = ", ".join(
        f"coalesce((list({f} ORDER BY ord) FILTER (WHERE {s_filled(f)}))[1], (list({f} ORDER BY ord))[1]) AS {f}" for f in EF
    )
    return f"""{with_clause('sched')}, {s_profile('sched', EF)}, {s_keys('k_all', 'data_rows')}, {s_keys('k_data', 'nonblank_rows')},
    nonblank AS (SELECT * FROM sched WHERE {s_filled_count(EF)} > 0 OR coalesce(error, '') <> ''),
    {s_merge('nonblank', 'k_data', EF)},
    kept AS MATERIALIZED (SELECT m.*, k.id_field, k.address_field FROM merged m LEFT JOIN k_all k USING (scope_id) WHERE {s_keep(EF)}),
    located AS MATERIALIZED (SELECT *, {loc} AS loc, {addr} AS addr FROM kept),
    buckets AS (SELECT *, CASE WHEN coalesce(error, '') <> '' OR loc IS NULL THEN 'row:' || pos ELSE 'loc:' || loc || chr(1) || addr END AS bucket FROM located),
    united AS MATERIALIZED (SELECT scope_id, min(ord) AS ord, (list(pos ORDER BY ord))[1] AS pos, first(source_file ORDER BY ord) AS source_file,
      first(error ORDER BY ord) AS error, {firsts} FROM buckets GROUP BY scope_id, bucket),
    sigs AS (SELECT *, CASE WHEN coalesce(error, '') <> '' THEN 'row' || pos ELSE {s_signature(EF)} END AS sig FROM united),
    done AS (SELECT * FROM sigs QUALIFY row_number() OVER (PARTITION BY scope_id, sig ORDER BY ord) = 1)
    SELECT scope_id, pos AS row_ord, source_file, error, {', '.join(EF)} FROM done
    UNION ALL SELECT scope_id, CAST(row_ord AS VARCHAR), source_file, error, {', '.join(EF)} FROM sched
      WHERE scope_id NOT IN (SELECT scope_id FROM kept)"""


@query("finalise_records", s_finalise())
def _(spark, sf):
    return path_text(R.finalise_records(table(spark, sf, "sched"), EF))


@query(
    "propagate_dominant",
    f"""{with_clause('sched')}, cells AS ({s_cells('sched', EF)}),
    tally AS (SELECT scope_id, field, {s_strip('value')} AS value, count(*) AS n, min(row_ord) AS first_ord FROM cells
      WHERE coalesce(error, '') = '' AND {s_filled('value')} GROUP BY 1, 2, 3),
    top AS (SELECT *, sum(n) OVER (PARTITION BY scope_id, field) AS filled FROM tally
      QUALIFY row_number() OVER (PARTITION BY scope_id, field ORDER BY n DESC, first_ord) = 1),
    strong AS MATERIALIZED (SELECT * FROM top WHERE n >= 2 AND n * 2 >= filled)
    SELECT {KEYS}, {', '.join(f"CASE WHEN coalesce(error, '') = '' AND NOT {s_filled(f)} THEN coalesce((SELECT value FROM strong t WHERE t.scope_id = s.scope_id AND t.field = {q(f)}), {f}) ELSE {f} END AS {f}" for f in EF)}
    FROM sched s""",
)
def _(spark, sf):
    return R.propagate_dominant(table(spark, sf, "sched"), EF)


# Rows with a field that copies another one, and a field with one value everywhere.
UNIFORM_FIELDS = ["order_number", "ref_no", "carrier", "segment", "note"]
UNIFORM = """SELECT scope_id, row_ord, error, order_number,
  CASE WHEN row_ord % 10 = 0 THEN segment ELSE order_number END AS ref_no,
  'Carrier ' || scope_id AS carrier, segment,
  CASE WHEN row_ord % 12 = 0 THEN NULL ELSE segment END AS note FROM {recs}"""
MATCHES = """SELECT scope_id, field, CASE WHEN field = 'segment' THEN CAST(length(scope_id) AS BIGINT) = 2
  ELSE field IN ('order_number') END AS matched
  FROM (SELECT scope_id, EACH('order_number', 'ref_no', 'carrier', 'segment', 'note') AS field FROM (SELECT DISTINCT scope_id FROM {recs} WHERE scope_id <> 'S3') d) m"""
TEXTS = """SELECT 'S' || CAST(n_nationkey AS STRING) AS scope_id, CASE WHEN n_nationkey % 5 = 0 THEN ''
  WHEN n_nationkey % 2 = 0 THEN 'Shipped by CARRIER s' || CAST(n_nationkey AS STRING) || ' only' ELSE 'plain text' END AS text FROM {nation}"""
U = UNIFORM_FIELDS


@query(
    "null_uniform_unmatched",
    f"""{with_clause('recs')}, u AS MATERIALIZED ({plain(UNIFORM)}), m AS ({plain(MATCHES)}), t AS ({plain(TEXTS)}), cells AS ({s_cells('u', U)}),
    one AS (SELECT scope_id, field, min({s_strip('value')}) AS value FROM cells WHERE {s_strip(s_blank('value'))} <> ''
      GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT {s_strip('value')}) = 1),
    dead AS MATERIALIZED (SELECT scope_id, field FROM one JOIN m USING (scope_id, field) JOIN t USING (scope_id)
      WHERE NOT matched AND text <> '' AND NOT contains(lower(text), lower(value)))
    SELECT scope_id, row_ord, {', '.join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM dead d WHERE d.scope_id = u.scope_id AND d.field = {q(f)}) THEN {f} END AS {f}" for f in U)} FROM u""",
)
def _(spark, sf):
    recs = table(spark, sf, "recs")
    df, matches = spark.sql(UNIFORM, recs=recs), spark.sql(spark_text(MATCHES), recs=recs)
    texts = spark.sql(TEXTS, nation=table(spark, sf, "nation"))
    return R.null_uniform_unmatched(df, U, matches, texts).drop("error")


@query(
    "null_duplicate_columns",
    f"""{with_clause('recs')}, u AS MATERIALIZED ({plain(UNIFORM)}), m AS ({plain(MATCHES)}), cells AS MATERIALIZED (SELECT scope_id, row_ord, field,
      lower({s_strip(s_blank('value'))}) AS value FROM ({s_cells('u', U)})),
    pairs AS (SELECT scope_id, a.field AS fa, b.field AS fb, a.value AS va, b.value AS vb FROM cells a JOIN cells b USING (scope_id, row_ord)
      WHERE a.field < b.field AND a.value <> '' AND b.value <> ''),
    tops AS (SELECT scope_id, fa, fb, max(n) AS top FROM (SELECT scope_id, fa, fb, va, count(*) AS n FROM pairs WHERE va = vb GROUP BY ALL) GROUP BY ALL),
    good AS (SELECT scope_id, fa, fb FROM (SELECT scope_id, fa, fb, count(*) AS n, count(*) FILTER (WHERE va = vb) AS eq FROM pairs GROUP BY ALL)
      JOIN tops USING (scope_id, fa, fb) WHERE n >= 2 AND eq >= n * 0.8 AND top <= n * 0.65),
    dead AS MATERIALIZED (SELECT g.scope_id, CASE WHEN mb.matched THEN fa ELSE fb END AS field FROM good g
      JOIN m ma ON ma.scope_id = g.scope_id AND ma.field = fa JOIN m mb ON mb.scope_id = g.scope_id AND mb.field = fb
      WHERE NOT (ma.matched AND mb.matched))
    SELECT scope_id, row_ord, {', '.join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM dead d WHERE d.scope_id = u.scope_id AND d.field = {q(f)}) THEN {f} END AS {f}" for f in U)} FROM u""",
)
def _(spark, sf):
    recs = table(spark, sf, "recs")
    out = R.null_duplicate_columns(spark.sql(UNIFORM, recs=recs), U, spark.sql(spark_text(MATCHES), recs=recs))
    return out.drop("error")


PATCHES = """SELECT scope_id, row_ord, field, patch_ord, value FROM (
  SELECT scope_id, row_ord, 'segment' AS field, 0 AS patch_ord, CASE WHEN row_ord % 2 = 0 THEN 'n/a' ELSE 'patched' END AS value FROM {recs} WHERE row_ord % 3 = 0
  UNION ALL SELECT scope_id, row_ord, 'segment', 1, 'second patch' FROM {recs} WHERE row_ord % 3 = 0
  UNION ALL SELECT scope_id, row_ord, 'order_number', 0, 'P-' || CAST(row_ord AS STRING) FROM {recs} WHERE row_ord % 4 = 0
  UNION ALL SELECT scope_id, row_ord, 'unknown_field', 0, 'x' FROM {recs} WHERE row_ord % 4 = 0)"""


@query(
    "apply_patches",
    f"""{with_clause('recs')}, p AS MATERIALIZED (SELECT * FROM ({plain(PATCHES)}) WHERE {s_filled('value')}
      QUALIFY row_number() OVER (PARTITION BY scope_id, row_ord, field ORDER BY patch_ord) = 1)
    SELECT r.scope_id, r.row_ord, {', '.join(f"CASE WHEN {s_filled('r.' + f)} THEN r.{f} ELSE coalesce(p_{f}.value, r.{f}) END AS {f}" for f in RF)} FROM recs r
    {' '.join(f"LEFT JOIN p p_{f} ON p_{f}.scope_id = r.scope_id AND p_{f}.row_ord = r.row_ord AND p_{f}.field = {q(f)}" for f in RF)}""",
)
def _(spark, sf):
    recs = table(spark, sf, "recs")
    return R.apply_patches(recs, spark.sql(PATCHES, recs=recs), RF).drop("source_file", "error")


# Two passes over the same documents: customers are the scope, positions count within the pass.
PASS_FIELDS = ["status", "amount", "priority"]
PASSES = """SELECT 'C' || CAST(o_custkey AS STRING) AS scope_id, CAST(NULL AS STRING) AS error, pass_no,
  CAST(row_number() OVER (PARTITION BY pass_no, o_custkey ORDER BY o_orderkey) AS BIGINT) AS row_ord,
  CASE WHEN o_orderkey % 4 = 1 THEN '-' ELSE o_orderstatus || CAST(o_orderkey % 6 AS STRING) END AS status,
  CASE WHEN (o_orderkey + pass_no) % 3 = 0 THEN NULL ELSE printf('%.2f', o_totalprice + pass_no) END AS amount,
  CASE WHEN (o_orderkey + pass_no) % 5 = 0 THEN 'n/a' ELSE o_orderpriority END AS priority
FROM (SELECT *, EACH(1, 2) AS pass_no FROM {orders}) p
WHERE NOT (pass_no = 2 AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0) AND NOT (pass_no = 2 AND o_custkey % 11 = 0)"""
PF = PASS_FIELDS
PASS_KEY = "CASE " + " ".join(f"WHEN {s_filled(f)} THEN lower({s_strip(f)})" for f in PF) + " END"


@query(
    "merge_passes",
    f"""WITH passes AS MATERIALIZED (SELECT *, {PASS_KEY} AS pkey FROM ({plain(PASSES)})),
    n AS (SELECT scope_id, count(*) FILTER (WHERE pass_no = 1) AS n1, count(*) FILTER (WHERE pass_no = 2) AS n2 FROM passes GROUP BY 1),
    one AS (SELECT * FROM passes WHERE pass_no = 1), two AS (SELECT * FROM passes WHERE pass_no = 2),
    lastone AS (SELECT * FROM one WHERE pkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope_id, pkey ORDER BY row_ord DESC) = 1)
    SELECT two.scope_id, two.row_ord, {', '.join(f"CASE WHEN {s_filled('l.' + f)} THEN l.{f} ELSE two.{f} END AS {f}" for f in PF)}
      FROM two JOIN n USING (scope_id) LEFT JOIN lastone l ON l.scope_id = two.scope_id AND l.pkey = two.pkey WHERE n2 >= greatest(n1, 1)
    UNION ALL SELECT one.scope_id, one.row_ord, {', '.join(f"CASE WHEN NOT {s_filled('one.' + f)} AND {s_filled('two.' + f)} THEN two.{f} ELSE one.{f} END" for f in PF)}
      FROM one JOIN n USING (scope_id) LEFT JOIN two ON two.scope_id = one.scope_id AND two.row_ord = one.row_ord WHERE n2 < greatest(n1, 1)""",
)
def _(spark, sf):
    both = spark.sql(spark_text(PASSES), orders=table(spark, sf, "orders"))
    first, second = (both.filter(F.col("pass_no") == i).drop("pass_no") for i in (1, 2))
    return R.merge_passes(first, second, PF).select("scope_id", "row_ord", *PF)


@query(
    "concat_records",
    f"""{with_clause('recs', 'sched')} SELECT 0 AS part_ord, scope_id, row_ord, source_file, segment FROM recs
    UNION ALL SELECT 1, scope_id, row_ord, source_file, segment FROM sched""",
)
def _(spark, sf):
    cols = ["scope_id", "row_ord", "source_file", "segment"]
    return R.concat_records([table(spark, sf, "recs").select(*cols), table(spark, sf, "sched").select(*cols)])


STORED = """SELECT 'J' || CAST(o_custkey AS STRING) AS job_id, o_orderkey AS doc_ord,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL
    WHEN o_orderkey % 2 = 0 THEN '{{"status":"' || o_orderstatus || '","amount":"' || printf('%.2f', o_totalprice) || '"}}'
    ELSE '[{{"status":"' || o_orderstatus || '","amount":"' || printf('%.2f', o_totalprice) || '"}},{{"status":"' || o_orderpriority || '"}}]' END AS extracted_data
FROM {orders}"""
STORED_PLAIN = STORED.replace("{orders}", "orders").replace("{{", "{").replace("}}", "}")


@query(
    "flatten_results",
    f"""WITH docs AS ({STORED_PLAIN}), jobs AS (SELECT 'J' || c_custkey AS job_id, c_nationkey AS user_id FROM customer WHERE c_custkey % 3 = 0),
    rows AS (SELECT job_id, user_id, doc_ord, CASE WHEN extracted_data LIKE '[%' THEN json_extract(extracted_data, '$[*]') ELSE [CAST(extracted_data AS JSON)] END AS items
      FROM jobs JOIN docs USING (job_id) WHERE extracted_data IS NOT NULL)
    SELECT job_id, user_id, doc_ord, CAST(i - 1 AS BIGINT) AS row_ord, json_extract_string(items[i], '$.status') AS status,
      json_extract_string(items[i], '$.amount') AS amount
    FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM rows)""",
)
def _(spark, sf):
    docs = spark.sql(STORED, orders=table(spark, sf, "orders"))
    jobs = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(
        F.concat(F.lit("J"), F.col("c_custkey").cast("string")).alias("job_id"), F.col("c_nationkey").alias("user_id")
    )
    return R.flatten_results(jobs, docs, ["status", "amount"])
