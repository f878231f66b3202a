"""Upsert of extracted rows into a baseline table, with a status per row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.schema import MARKERS_UPSERT, ORD, SCOPE

# How field names tell their role. Valid in Java and Python regular expressions alike.
ID_END = r"(?:#|no\.?|num(?:ber)?|id)\s*$"
ID_NOT = r"(?:phone|fax|tel(?:ephone)?|contact|ext)\s*(?:#|no|num)|^#\s*of\b|number\s+of\b"
ID_WORD = r"\bloc(?:ation)?\s*#?\b|\b(?:vin|ssn|ein|tin|fein|npi)\b"
ADDRESS_WORD = r"address|street"
CITY_WORD = r"city"
STATE_WORD = r"\b(?:state|province|prov)\b|^st\.?$"
ZIP_WORD = r"zip|postal"


@dataclass(frozen=True)
class MatchColumns:
    """Columns that identify a row."""

    ident: str | None = None
    address: str | None = None
    city: str | None = None
    state: str | None = None
    zip: str | None = None


def match_columns(fields: list[str], headers: list[str]) -> MatchColumns:
    """Plan-time choice for one field list: the first field of each role that is also a header."""
    known = [f for f in fields if f in set(headers)]

    def first(test) -> str | None:
        return next((f for f in known if test(f.lower().strip())), None)

    def ident(name: str) -> bool:
        if re.search(ID_END, name):
            return not re.search(ID_NOT, name)
        return bool(re.search(ID_WORD, name))

    return MatchColumns(
        first(ident),
        *[first(lambda n, p=p: bool(re.search(p, n))) for p in (ADDRESS_WORD, CITY_WORD, STATE_WORD, ZIP_WORD)],
    )


def infer_match_columns(field_sets: DataFrame) -> DataFrame:
    """The same choice for a table of field sets (set_id, field, field_ord)."""
    name = F.lower(X.strip("field"))
    roles = {
        "id_field": F.when(name.rlike(ID_END), ~name.rlike(ID_NOT)).otherwise(name.rlike(ID_WORD)),
        "address_field": name.rlike(ADDRESS_WORD),
        "city_field": name.rlike(CITY_WORD),
        "state_field": name.rlike(STATE_WORD),
        "zip_field": name.rlike(ZIP_WORD),
    }
    return field_sets.groupBy("set_id").agg(
        *[F.min_by(F.when(test, F.col("field")), F.when(test, F.col("field_ord"))).alias(r) for r, test in roles.items()]
    )


def match_key(columns: MatchColumns) -> Column:
    """Key of a row: the id, else the address with city and at least one of state and zip. Null: cannot match."""
    def filled(c: str | None) -> Column:
        return X.is_filled(c, MARKERS_UPSERT) if c else F.lit(False)

    def part(c: str | None) -> Column:
        return F.when(filled(c), X.norm_key(c)).otherwise("") if c else F.lit("")

    by_id = F.when(filled(columns.ident), F.concat(F.lit("loc::"), part(columns.ident)))
    place = F.concat_ws("|", part(columns.address), part(columns.city), part(columns.state), part(columns.zip))
    complete = filled(columns.address) & filled(columns.city) & (F.concat(part(columns.state), part(columns.zip)) != "")
    return F.coalesce(by_id, F.when(complete, F.concat(F.lit("addr::"), place)))


def upsert_baseline(
    baseline: DataFrame,
    new: DataFrame,
    fields: list[str],
    overwrite: bool,
    status: str = "record_status",
    source_header: str = "source_file",
) -> DataFrame:
    """Match new rows to baseline rows per scope; baseline rows keep their order, unmatched new rows follow.

    Keys that repeat in the baseline never match; of several new rows with one key only the first matches. Baseline
    rows become updated / matched_preserved / not_found; rows without a usable key, and scopes without usable new rows,
    keep their status. Both joins of the baseline share one (scope, key) partitioning, and the other side holds at most
    one row per key.
    """
    headers = [c for c in baseline.columns if c not in (SCOPE, ORD, status)]
    columns = match_columns(fields, headers)
    has_source = source_header in headers
    taken = [f for f in fields if f in headers]
    own = F.concat(F.lit("row::"), F.col(ORD).cast("string"))

    if status not in baseline.columns:
        baseline = baseline.withColumn(status, F.lit(None).cast("string"))
    usable = new.filter(~X.has_error())
    old = baseline.withColumn("_key", match_key(columns))
    fresh = usable.withColumn("_key", match_key(columns))

    old_keys = old.filter("_key is not null").groupBy(SCOPE, "_key").agg(F.count("*").alias("_n"))
    payload = F.struct(F.col(ORD).alias("ord"), F.col(source_header).alias("src"), *[X.col(f).alias(f"v{i}") for i, f in enumerate(taken)])
    first_new = fresh.filter("_key is not null").groupBy(SCOPE, "_key").agg(F.min_by(payload, ORD).alias("_new"))
    # one row per key of either side; spread rows without a key instead of piling them on null
    known = old_keys.join(first_new, [SCOPE, "_key"], "left")
    active = usable.select(SCOPE).distinct().withColumn("_active", F.lit(True))

    tracked = (
        old.withColumn("_slot", F.coalesce("_key", own))
        .join(known.withColumnRenamed("_key", "_slot"), [SCOPE, "_slot"], "left")
        .join(active, SCOPE, "left")
    )
    single = F.coalesce(F.col("_n") == 1, F.lit(False))
    hit = single & F.col("_new").isNotNull()
    outcome = (
        F.when(hit, F.lit("updated" if overwrite else "matched_preserved"))
        .when(single & F.coalesce("_active", F.lit(False)), F.lit("not_found"))
        .otherwise(F.col(status))
    )

    def kept(c: str) -> Column:
        if overwrite and c in taken:
            value = F.coalesce(F.col(f"_new.v{taken.index(c)}"), F.lit(""))
            return F.when(hit, value).otherwise(X.col(c))
        if overwrite and has_source and c == source_header:
            return F.when(hit & (F.coalesce(F.col("_new.src"), F.lit("")) != ""), F.col("_new.src")).otherwise(X.col(c))
        return X.col(c)

    updated = tracked.select(
        SCOPE, F.lit(0).alias("part_ord"), ORD, *[kept(c).alias(c) for c in headers], outcome.alias(status)
    )

    matched = known.filter("_n = 1 and _new is not null").select(
        SCOPE, F.col("_key").alias("_slot"), F.col("_new.ord").alias(ORD)
    )
    rest = fresh.withColumn("_slot", F.coalesce("_key", own)).join(matched, [SCOPE, "_slot", ORD], "left_anti")

    def fill(c: str) -> Column:
        if c == source_header:
            return X.blank(c)
        return X.blank(c) if c in taken else F.lit("")

    appended = rest.select(
        SCOPE, F.lit(1).alias("part_ord"), ORD, *[fill(c).alias(c) for c in headers], F.lit("new").alias(status)
    )
    return updated.unionByName(appended)


def first_match_only(df: DataFrame, columns: MatchColumns) -> DataFrame:
    """First row per match key; rows without a key all stay."""
    own = F.concat(F.lit("row::"), F.col(ORD).cast("string"))
    keyed = df.withColumn("_slot", F.coalesce(match_key(columns), own))
    return keyed.groupBy(SCOPE, "_slot").agg(F.min_by(F.struct(*df.columns), ORD).alias("_row")).select("_row.*")
