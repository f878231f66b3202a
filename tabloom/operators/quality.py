"""Quality metrics of records and inference of key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators.skew import attach_stats
from tabloom.schema import ERROR, MARKERS_CORE, MARKERS_REPORT, SCOPE


def rate(hits: Column, total: Column, empty: float) -> Column:
    return F.bround(F.when(total > 0, hits / total).otherwise(F.lit(empty)), 4)


def quality_report(df: DataFrame, fields: list[str], scopes: DataFrame | None = None) -> DataFrame:
    """One row per scope; a single map-side combined aggregate, no reshaping of the cells."""
    numeric, dates = X.numeric_fields(fields), X.date_fields(fields)

    def present(f: str) -> Column:
        return X.is_filled(f, MARKERS_REPORT)

    def total(conditions: list[Column]) -> Column:
        return F.sum(X.count_true(conditions).cast("bigint")) if conditions else F.sum(F.lit(0).cast("bigint"))

    base = df.groupBy(SCOPE).agg(
        F.count("*").alias("row_count"),
        total([present(f) for f in fields]).alias("filled_fields"),
        total([present(f) for f in numeric]).alias("numeric_total"),
        total([present(f) & X.parses_as_number(X.strip(f)) for f in numeric]).alias("numeric_hits"),
        total([present(f) for f in dates]).alias("date_total"),
        total([present(f) & X.parses_as_date(X.strip(f)) for f in dates]).alias("date_hits"),
        total([X.has_error()]).alias("error_rows"),
    )
    if scopes is not None:
        counts = [c for c in base.columns if c != SCOPE]
        base = scopes.select(SCOPE).join(base, SCOPE, "left").fillna(0, counts)
    cells = F.col("row_count") * len(fields)
    scored = base.select(
        SCOPE, "row_count", "filled_fields", cells.alias("total_fields"), "numeric_hits", "numeric_total",
        "date_hits", "date_total",
        rate(F.col("filled_fields"), cells, 0.0).alias("field_fill_rate"),
        rate(F.col("numeric_hits"), F.col("numeric_total"), 1.0).alias("numeric_parse_rate"),
        rate(F.col("date_hits"), F.col("date_total"), 1.0).alias("date_parse_rate"),
        rate(F.col("error_rows"), F.col("row_count"), 0.0).alias("error_row_rate"),
    )
    overall = F.col("field_fill_rate") * 0.6 + F.col("numeric_parse_rate") * 0.2 + F.col("date_parse_rate") * 0.2
    return scored.withColumn("overall_score", F.bround(overall, 4))


def field_fill_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Filled share per scope and field over rows without error; gaps come first when sorted by `fill_rate`."""
    sums = df.filter(~X.has_error()).groupBy(SCOPE).agg(
        F.count("*").alias("rows"),
        *[F.sum(X.is_filled(f).cast("bigint")).alias(f) for f in fields],
    )
    long = sums.unpivot([SCOPE, "rows"], [X.col(f) for f in fields], "field", "filled")
    return long.withColumn("fill_rate", F.bround(F.col("filled") / F.col("rows"), 4))


def record_fill(df: DataFrame, fields: list[str], minimum: float) -> DataFrame:
    """Fill share, missing fields and gate per record; a plain projection."""
    missing = F.filter(F.array(*[F.when(~X.is_filled(f), F.lit(f)) for f in fields]), lambda m: m.isNotNull())
    share = X.filled_count(fields) / len(fields)
    return df.select(
        "*", share.alias("fill_rate"), missing.alias("missing_fields"), (share >= minimum).alias("passed")
    )


# Value shapes that tell what a column holds.
SHAPES = {
    "short_code": r"^(?=.{1,16}$)(?=.*\d)[A-Za-z0-9#/_-]+$",
    "numeric_only": r"^\d+$",
    "large_number": r"^0*[1-9]\d{3,}$",
    "year": r"^(?:18|19|20)\d{2}$",
    "zip": r"^(?:\d{5}(?:-\d{4})?|[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d)$",
    "money": r"\$|\d{1,3}(?:,\d{3})+",
    "address": r"^(?=.{8})(?=.*\d)(?=.*\p{L})(?=.*[ ,])",
}


def profile_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """Shape profile per (scope, field), with the scope's row counts.

    Equal values are counted before anything is grouped by column, which gives exact distinct counts from plain sums.
    """
    from tabloom.operators.records import cells

    data = df.filter(~X.has_error())
    values = cells(data, fields, keys=(SCOPE,)).filter(X.is_filled("value")).select(
        SCOPE, "field", "field_ord", X.squash(X.strip("value")).alias("value")
    )
    tally = values.groupBy(SCOPE, "field", "field_ord", "value").agg(F.count("*").alias("n"))
    shaped = tally.select(
        "*", F.lower("value").alias("low"), *[F.col("value").rlike(p).alias(s) for s, p in SHAPES.items()]
    )
    folded = shaped.groupBy(SCOPE, "field", "field_ord", "low").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.length("value")).alias("chars"),
        *[F.sum(F.when(F.col(s), F.col("n")).otherwise(0)).alias(s) for s in SHAPES],
    )
    profile = folded.groupBy(SCOPE, "field", "field_ord").agg(
        F.sum("n").alias("filled"),
        F.count("*").alias("kinds"),
        F.sum("chars").alias("chars"),
        *[F.sum(s).alias(s) for s in SHAPES],
    )
    sizes = data.groupBy(SCOPE).agg(
        F.count("*").alias("data_rows"),
        F.sum((X.filled_count(fields) > 0).cast("bigint")).alias("nonblank_rows"),
    )
    n = F.col("filled")
    return profile.join(sizes, SCOPE).select(
        SCOPE, "field", "field_ord", "data_rows", "nonblank_rows", "filled",
        (n / F.col("data_rows")).alias("filled_ratio"),
        (F.col("kinds") / n).alias("unique_ratio"),
        (F.col("chars") / n).alias("avg_len"),
        *[(F.col(s) / n).alias(f"{s}_ratio") for s in SHAPES],
    )


def infer_key_fields(profile: DataFrame, fields: list[str], rows: str = "data_rows") -> DataFrame:
    """Best id and address column per scope, and the columns that can tell entities apart.

    `rows` names the row count that filled shares refer to (all data rows, or the non-blank ones).
    """
    filled = F.col("filled") / F.col(rows)
    shaped = (F.col("short_code_ratio") >= 0.5) | (F.col("numeric_only_ratio") >= 0.5)
    penalty = F.when((F.col("unique_ratio") < 0.8) & ~shaped, F.lit(8.0)).otherwise(F.lit(0.0))
    # Weights of the two scores and their thresholds.
    id_score = (
        filled * 1.5 + F.col("unique_ratio") * 6 * filled + F.col("short_code_ratio") * 2 + F.col("numeric_only_ratio")
        - penalty - F.col("zip_ratio") * 6 - F.col("address_ratio") * 4 - F.col("money_ratio") * 3
        - F.col("year_ratio") * 4 - F.col("large_number_ratio") * 4
    )
    address_score = (
        filled * 1.5 + F.col("unique_ratio") * 1.5 + F.col("address_ratio") * 4 - F.col("zip_ratio") * 4
        - F.col("money_ratio") * 3 - F.col("short_code_ratio") * 2
    )
    scored = profile.select(
        SCOPE, "field", "field_ord", "unique_ratio", "filled", F.col(rows).alias("rows"),
        id_score.alias("id_score"), address_score.alias("address_score"),
    )

    def best(score: str) -> Column:
        return F.max_by(F.struct("field", score), F.struct(F.col(score), -F.col("field_ord")))

    distinct = (F.col("rows") >= 3) & (F.col("filled") * 2 >= F.col("rows")) & (F.col("unique_ratio") >= 0.9)
    # one row per field and scope, so the list is bounded by the number of fields
    picked = scored.groupBy(SCOPE).agg(
        best("id_score").alias("i"), best("address_score").alias("a"),
        F.collect_list(F.when(distinct, F.col("field"))).alias("d"),
    )
    named = picked.select(
        SCOPE,
        F.when(F.col("i.id_score") >= 2.5, F.col("i.field")).alias("id_field"),
        F.when(F.col("a.address_score") >= 2.0, F.col("a.field")).alias("address_field"),
        F.bround("i.id_score", 6).alias("id_score"),
        F.bround("a.address_score", 6).alias("address_score"),
        F.col("d"),
    )
    others = F.filter(
        F.col("d"),
        lambda f: (f != F.coalesce("id_field", F.lit(""))) & (f != F.coalesce("address_field", F.lit(""))),
    )
    return named.withColumn("distinguishers", F.array_sort(others)).drop("d")


def key_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    return infer_key_fields(profile_columns(df, fields), fields)


def duplicate_keys(df: DataFrame, id_field: str) -> DataFrame:
    """Id values that occur more than once in a scope."""
    return (
        df.filter(X.is_filled(id_field))
        .groupBy(SCOPE, X.strip(id_field).alias("id_value"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def extraction_report(report: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Compare a quality report with per-scope targets and run figures; row counts may differ by max(3, 15 %)."""
    joined = report.join(targets, SCOPE).join(runs, SCOPE, "left")
    off_by = F.abs(F.col("row_count") - F.col("expected_rows"))
    rows_ok = off_by <= F.greatest(F.lit(3.0), F.col("expected_rows") * 0.15)
    passed = (
        (F.col("field_fill_rate") >= F.col("min_fill"))
        & (F.col("numeric_parse_rate") >= F.col("min_numeric"))
        & (F.col("date_parse_rate") >= F.col("min_date"))
        & (F.col("error_row_rate") <= F.col("max_error"))
    )
    return joined.select(
        SCOPE, "row_count", "field_fill_rate", "numeric_parse_rate", "date_parse_rate", "error_row_rate",
        "cost_usd", "seconds", rows_ok.alias("rows_ok"), passed.alias("passed"),
    )


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """Attempt whose row count is nearest to the expected one; the first on ties. Columns attempt_no, n, expected."""
    distance = F.abs(F.col("n") - F.col("expected"))
    return attempts.groupBy(SCOPE).agg(
        F.min_by("attempt_no", F.struct(distance, F.col("attempt_no"))).alias("attempt_no"),
        F.min_by("n", F.struct(distance, F.col("attempt_no"))).alias("n"),
    )


def attempt_score(df: DataFrame, fields: list[str], expected: DataFrame) -> DataFrame:
    """Score per (scope, attempt): errors plus row distance minus fill share; lower is better."""
    sums = df.groupBy(SCOPE, "attempt_no").agg(
        F.sum((~X.has_error()).cast("bigint")).alias("rows"),
        F.sum(X.has_error().cast("bigint")).alias("errors"),
        F.sum(F.when(~X.has_error(), X.filled_count(fields)).otherwise(0).cast("bigint")).alias("filled"),
    )
    joined = sums.join(expected, SCOPE, "left")
    delta = F.when(F.coalesce("expected", F.lit(0)) > 0, F.abs(F.col("rows") - F.col("expected"))).otherwise(0)
    share = F.col("filled") / F.greatest(F.lit(1), F.col("rows") * max(1, len(fields)))
    return joined.select(
        SCOPE, "attempt_no", "rows", "filled", F.bround(F.col("errors") + delta - share, 6).alias("score")
    )
