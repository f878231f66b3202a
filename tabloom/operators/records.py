"""Record clean-up, merging and repair. Input: a records table keyed by `scope_id`, positioned by `row_ord`."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators.quality import key_columns
from tabloom.operators.skew import attach_stats, beside
from tabloom.schema import MARKERS_SHORT, ORD, RECORD_KEYS, SCOPE
from tabloom.session import discard, settled, step


def normalise_records(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Requested fields only; strip, empty marker to null, magnitude word off comma-grouped numbers."""
    present = set(raw.columns)
    keys = [c for c in RECORD_KEYS if c in present]
    cells = [
        F.when(X.is_filled(f), X.clean_money(X.strip(f), stripped=True)).alias(f) if f in present else F.lit(None).cast("string").alias(f)
        for f in fields
    ]
    return raw.select(*keys, *cells)


# Signs of a formula, and phrases of an explanation.
FORMULA = r"(?i)[\d,$.]+\s*\+\s*[\d,$.]|\d[\d,.]*\s*=\s*|sum\s+of|total\s+of\s+"
EXPLANATIONS = ("which is", "that is", "calculated as", "derived from", "i.e.", " e.g.", " because ", " equals ")


def looks_explained(c: str) -> Column:
    text = X.strip(X.blank(c))
    wordy = (F.length(text) > 80) & X.any_of(F.lower(text).contains(m) for m in EXPLANATIONS)
    return text.rlike(FORMULA) | wordy


def flag_invalid_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `valid` and `reason`: nothing filled, or the first field that holds a formula or an explanation."""
    wordy = F.coalesce(*[F.when(looks_explained(f), F.lit(f"field '{f}' contains formula or explanation")) for f in fields])
    reason = F.when(X.filled_count(fields) == 0, F.lit("no fields filled")).otherwise(F.coalesce(wordy, F.lit("")))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def drop_blank_records(df: DataFrame, fields: list[str], keep_errors: bool = True) -> DataFrame:
    kept = X.filled_count(fields) > 0
    return df.filter(kept | X.has_error() if keep_errors else kept)


def key_filled(fields: list[str], key: str) -> Column:
    """Is the column named by `key` (which varies per scope) filled in this row?"""
    return F.coalesce(X.any_of((F.col(key) == f) & X.is_filled(f) for f in fields), F.lit(False))


def key_value(fields: list[str], key: str) -> Column:
    """Value of the column named by `key`."""
    return F.coalesce(*[F.when(F.col(key) == f, X.col(f)) for f in fields])


def drop_orphan_records(df: DataFrame, fields: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Keep rows with the scope's id or address filled, and error rows; a scope that would lose all rows keeps all."""
    keys = keys if keys is not None else key_columns(df, fields)
    marked = df.join(keys.select(SCOPE, "id_field", "address_field"), SCOPE, "left").withColumn(
        "_keep", X.has_error() | key_filled(fields, "id_field") | key_filled(fields, "address_field")
    )
    judged = attach_stats(marked, [SCOPE], _any=F.bool_or("_keep"))
    return judged.filter(F.col("_keep") | ~F.col("_any")).select(df.columns)


def derive_location_name(df: DataFrame, name: str = "Location Name", number: str = "Loc #") -> DataFrame:
    """Name a location after its number where the name is missing."""
    usable = ~X.has_error() & ~X.is_filled(name, MARKERS_SHORT) & X.is_filled(number, MARKERS_SHORT)
    named = F.when(usable, F.concat(F.lit("Location "), X.strip(number))).otherwise(X.col(name))
    return df.select(*[named.alias(c) if c == name else X.col(c) for c in df.columns])


def as_path(order: str, df: DataFrame) -> Column:
    """Positions compare as number lists, so a merged row can sit at its group's place without renumbering."""
    return F.col(order) if df.schema[order].dataType.typeName() == "array" else F.array(F.col(order).cast("bigint"))


def with_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `_v` (field values), `_f` (is it filled) and `_filled` (their number) as arrays in field order.

    They come out of a generator, so that later expressions refer to them instead of repeating the test per field.
    """
    values = F.array(*[X.col(f) for f in fields])
    flags = F.array(*[X.is_filled(f) for f in fields])
    row = F.struct(values.alias("_v"), flags.alias("_f"), X.filled_count(fields).alias("_filled"))
    return df.select("*", F.inline(F.array(row)))


def place_of(fields: list[str], key: str) -> Column:
    """Position of the column named by `key` in `_v` and `_f`; null when there is none."""
    return F.nullif(F.array_position(F.array(*[F.lit(f) for f in fields]), F.col(key)), F.lit(0)).cast("int")


def at_place(array: str, place: Column) -> Column:
    """Element at a place that may be null; `element_at` overlooks a null index under ANSI rules, `get` does not."""
    return F.get(array, place - 1)


def merge_groups(df: DataFrame, fields: list[str], group: list[str], rank: Column) -> DataFrame:
    """One row per group: base row first in `rank`, gaps filled from the others in that order.

    Needs the arrays of `with_values`. Columns beside the fields come from the base row.
    """
    extra = [c for c in df.columns if c not in fields and c not in group and c not in (ORD, "_v", "_f", "_filled")]
    best = [
        F.min_by(F.element_at("_v", i + 1), F.when(F.element_at("_f", i + 1), rank)).alias(f"_b{i}") for i in range(len(fields))
    ]
    base = F.min_by(F.struct("_v", *extra), rank).alias("_base")
    merged = df.groupBy(*group).agg(F.min(ORD).alias(ORD), base, *best)
    return merged.select(
        *group, ORD, *[F.coalesce(f"_b{i}", F.element_at("_base._v", i + 1)).alias(f) for i, f in enumerate(fields)],
        *[F.col(f"_base.{c}").alias(c) for c in extra],
    )


def split_repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a `_hash` of their own or none, and those that may share their key with others: most rows move nowhere.

    Only hashes are counted. `rows` are read several times, so they should come from a table or be written.
    """
    counts = rows.filter("_hash is not null").groupBy("_hash").agg(F.count("*").alias("_n"))
    repeated = settled(counts.filter("_n > 1").select("_hash"), "repeated")
    return beside(rows, repeated, "_hash", "left_anti"), beside(rows, repeated, "_hash", "left_semi")


def merge_keys() -> Column:
    """Merge key of a row: id token, address start, and a distinguishing value when the id is missing. Null: none."""
    def low(place: Column) -> Column:
        return F.lower(X.strip(at_place("_v", place)))

    def here(place: Column) -> Column:
        return F.coalesce(at_place("_f", place), F.lit(False))

    ident, address = F.col("_id"), F.col("_address")
    spare = F.get(F.filter("_apart_by", lambda i: at_place("_f", i)), F.lit(0))
    parts = F.array(
        F.when(here(ident), X.id_token(low(ident))),
        F.when(here(address), F.substring(low(address), 1, 40)),
        F.when(~here(ident) & here(address), F.substring(low(spare), 1, 40)),
    )
    known = F.filter(parts, lambda p: p.isNotNull())
    return F.when(ident.isNotNull() & (F.size(known) > 0), F.array_join(known, "|"))


def merge_by_identifier(df: DataFrame, fields: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Merge rows of one entity. Rows that differ in a distinguishing field keep their whole group apart.

    `row_ord` becomes a position list [unkeyed, first position of the group, own position]; unkeyed rows go last only in
    scopes where some key has two rows.
    """
    keys = keys if keys is not None else key_columns(df, fields)
    names = F.array(*[F.lit(f) for f in fields])
    places = settled(keys.select(
        SCOPE, place_of(fields, "id_field").alias("_id"), place_of(fields, "address_field").alias("_address"),
        F.array_sort(F.transform("distinguishers", lambda d: F.array_position(names, d).cast("int"))).alias("_apart_by"),
    ), "places")

    def keyed(rows: DataFrame) -> DataFrame:
        return with_values(beside(rows, places, SCOPE, "left"), fields).withColumn("_key", merge_keys())

    # rows are written with a hash of scope and key; keys are worked out once more where hashes repeat
    tagged = keyed(df.withColumn(ORD, as_path(ORD, df)))
    tagged = settled(tagged.select(*df.columns, F.when(F.col("_key").isNotNull(), F.xxhash64(SCOPE, "_key")).alias("_hash")), "keyed")
    alone, several = split_repeated(tagged)
    # groups sort by a number, with the scope behind it: scopes are few, so sorting by them first compares whole keys
    group = ["_hash", SCOPE, "_key"]
    grouped = keyed(several)

    # filled values of the distinguishing fields only; two different ones in a group keep it apart
    asked = sorted(r[0] for r in places.select(F.explode("_apart_by")).distinct().collect() if r[0])
    shown = F.array(*[
        F.when(F.array_contains("_apart_by", i) & at_place("_f", F.lit(i)), F.lower(X.strip(at_place("_v", F.lit(i))))) for i in asked
    ]).cast("array<string>")
    shown_rows = grouped.select(*group, ORD, F.inline(F.array(F.struct(shown.alias("_d")))))
    varies = X.any_of(
        F.coalesce(F.min(F.element_at("_d", i + 1)) != F.max(F.element_at("_d", i + 1)), F.lit(False)) for i in range(len(asked))
    )
    verdict = shown_rows.groupBy(*group).agg(F.min(ORD).alias("_first"), varies.alias("_apart"), F.count("*").alias("_n"))
    verdict = settled(verdict, "verdict")
    judged = grouped.select(*df.columns, "_hash", "_key").join(verdict, group)
    zero = F.array(F.lit(0).cast("bigint"))
    apart = judged.filter("_apart or _n = 1").withColumn(ORD, F.concat(zero, "_first", ORD))
    rank = F.struct(-F.col("_filled"), F.col(ORD))
    together = with_values(judged.filter("not _apart and _n > 1").drop("_first", "_apart", "_n"), fields)
    united = merge_groups(together, fields, group, rank).withColumn(ORD, F.concat(zero, ORD, ORD))
    # a row that is alone with its key is merged with nothing, and is the first of its group; a scope where no key has two
    # rows keeps its order, elsewhere unkeyed rows go last
    shared = settled(verdict.filter("_n > 1").select(SCOPE).distinct().withColumn("_late", F.lit(1).cast("bigint")), "shared")
    late = F.when(F.col("_hash").isNull(), F.col("_late"))
    lone = beside(alone, shared, SCOPE, "left").withColumn(ORD, F.concat(F.array(F.coalesce(late, F.lit(0).cast("bigint"))), ORD, ORD))
    parts = (apart, united, lone)
    return functools.reduce(DataFrame.unionByName, [part.select(df.columns) for part in parts])


def merge_across_documents(df: DataFrame, fields: list[str], id_field: str) -> DataFrame:
    """Merge on the id alone, leading zeros ignored; the fullest row is the base, first filled value wins."""
    ident = F.regexp_replace(F.lower(X.strip(id_field)), r"^0*(\d+.*)$", "$1")
    placed = df.withColumn(ORD, as_path(ORD, df))
    # an unkeyed row is its own group, so they do not pile up under one null key
    own = F.concat(F.lit("r"), F.array_join(F.transform(ORD, lambda x: x.cast("string")), "."))
    keyed = X.is_filled(id_field)
    tagged = with_values(placed, fields).select(
        "*", F.when(keyed, F.concat(F.lit("k"), ident)).otherwise(own).alias("_key"), (~keyed).cast("bigint").alias("_late")
    )
    rank = F.struct(-F.col("_filled"), F.col(ORD))
    merged = merge_groups(tagged, fields, [SCOPE, "_key", "_late"], rank)
    return merged.withColumn(ORD, F.concat(F.array("_late"), ORD)).select(df.columns)


def bucket_keys() -> Column:
    """Id token and address of a row that has an id, else its own position; needs `_id`/`_address` places and `_v`, `_f`."""
    def text(key: str) -> Column:
        return X.strip(at_place("_v", F.col(key)))

    def here(key: str) -> Column:
        return F.coalesce(at_place("_f", F.col(key)), F.lit(False))

    tokens = F.regexp_extract_all(text("_id"), F.lit(r"([A-Za-z0-9#/_-]+)"), 1)
    coded = F.get(F.filter(tokens, lambda t: t.rlike(r"\d")), F.lit(0))
    loc = F.when(here("_id"), F.lower(F.coalesce(coded, F.substring(text("_id"), 1, 24))))
    address = F.when(here("_address"), X.squash(F.lower(F.substring(text("_address"), 1, 80)))).otherwise("")
    own = F.concat(F.lit("row:"), F.array_join(F.transform(ORD, lambda x: x.cast("string")), "."))
    shared = F.concat(F.lit("loc:"), loc, F.lit("\x00"), address)
    return F.when(X.has_error() | loc.isNull(), own).otherwise(shared)


def bucketed(rows: DataFrame, fields: list[str], places: DataFrame) -> DataFrame:
    """Adds `_v`, `_f`, `_filled`, the scope's `_id` and `_address` places and the `_bucket` of the row."""
    return with_values(beside(rows, places, SCOPE, "left"), fields).withColumn("_bucket", bucket_keys())


def bucket_merge(tagged: DataFrame, fields: list[str], places: DataFrame) -> DataFrame:
    """Merge rows that share id token and address, with those of one `_hash` among the written rows. Rows without id stay."""
    alone, several = split_repeated(tagged)
    repeated = bucketed(several, fields, places).drop("_id", "_address")
    merged = merge_groups(repeated, fields, ["_hash", SCOPE, "_bucket"], F.col(ORD))
    columns = [c for c in tagged.columns if c != "_hash"]
    return merged.select(columns).unionByName(alone.select(columns))


def signature(fields: list[str]) -> Column:
    """Whole-row signature; the position of an error row."""
    own = F.concat(F.lit("row:"), F.col(ORD).cast("string"))
    return F.when(X.has_error(), own).otherwise(X.cell_signature(fields))


def signed(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds a `_hash` of scope and signature."""
    return df.select("*", F.xxhash64(SCOPE, signature(fields)).alias("_hash"))


def first_per_signature(rows: DataFrame, fields: list[str]) -> DataFrame:
    """First row per signature of written rows with `_hash`."""
    columns = [c for c in rows.columns if c != "_hash"]
    alone, several = split_repeated(rows)
    kept = several.withColumn("_sig", signature(fields)).groupBy("_hash", SCOPE, "_sig").agg(
        F.min_by(F.struct(*columns), ORD).alias("_row")
    )
    return kept.select("_row.*").unionByName(alone.select(columns))


def drop_duplicate_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """First row per whole-row signature; error rows are never duplicates."""
    return first_per_signature(settled(signed(df, fields), "signed"), fields)


def finalise_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """Blank drop, entity merge, orphan drop, bucket merge, exact dedup, location naming."""
    from tabloom.operators.quality import infer_key_fields, profile_columns

    profile = profile_columns(df, fields)
    # keys over all rows steer the orphan and bucket steps, keys over non-blank rows the entity merge
    profile = settled(profile, "profile")
    all_keys = infer_key_fields(profile, fields, rows="data_rows")
    merge_by = infer_key_fields(profile, fields, rows="nonblank_rows")
    places = settled(all_keys.select(
        SCOPE, place_of(fields, "id_field").alias("_id"), place_of(fields, "address_field").alias("_address")
    ), "places")
    found = F.coalesce(at_place("_f", F.col("_id")), F.lit(False)) | F.coalesce(at_place("_f", F.col("_address")), F.lit(False))

    def surviving() -> DataFrame:
        merged = merge_by_identifier(drop_blank_records(df, fields), fields, merge_by)
        marked = bucketed(merged, fields, places).filter(X.has_error() | found)
        # rows without scope are in no group
        known = F.col(SCOPE).isNotNull() & F.col("_bucket").isNotNull()
        return marked.select(*df.columns, F.when(known, F.xxhash64(SCOPE, "_bucket")).alias("_hash"))

    spark = df.sparkSession
    kept = step(spark, "kept", surviving)
    merged = step(spark, "merged", lambda: signed(bucket_merge(kept, fields, places), fields))
    discard(kept)
    done = first_per_signature(merged, fields)
    # scopes without survivors come back unchanged
    alive = settled(merged.select(SCOPE).distinct(), "alive")
    untouched = beside(df, alive, SCOPE, "left_anti").select(df.columns).withColumn(ORD, as_path(ORD, df))
    if "Location Name" in fields and "Loc #" in fields:
        done = derive_location_name(done)
    return done.unionByName(untouched)


def cells(df: DataFrame, fields: list[str], keys: tuple[str, ...] = (SCOPE, ORD)) -> DataFrame:
    """Long form: one row per cell, with the field's position."""
    position = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, i)])
    long = df.select(*keys, *[X.col(f) for f in fields]).unpivot(list(keys), [X.col(f) for f in fields], "field", "value")
    return long.withColumn("field_ord", position[F.col("field")])


def propagate_dominant(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fill the gaps of a field with its dominant value (at least 2 and half of the filled cells); scopes of 2+ rows."""
    usable = df.filter(~X.has_error())
    tally = (
        cells(usable, fields)
        .filter(X.is_filled("value"))
        .groupBy(SCOPE, "field", X.strip("value").alias("value"))
        .agg(F.count("*").alias("n"), F.min(ORD).alias("first"))
    )
    winner = tally.groupBy(SCOPE, "field").agg(
        F.sum("n").alias("filled"),
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("first"))).alias("top"),
    )
    strong = F.when((F.col("top.n") >= 2) & (F.col("top.n") * 2 >= F.col("filled")), F.col("top.value"))
    fills = winner.groupBy(SCOPE).agg(
        *[F.max(F.when(F.col("field") == f, strong)).alias(f"_d{i}") for i, f in enumerate(fields)]
    )
    # a dominant value occurs twice, so a scope of fewer than two rows never has one
    joined = beside(df, settled(fills, "fills"), SCOPE, "left")
    filled = {
        f: F.when(~X.has_error() & ~X.is_filled(f), F.coalesce(F.col(f"_d{i}"), X.col(f))).otherwise(X.col(f)).alias(f)
        for i, f in enumerate(fields)
    }
    return joined.select(*[filled.get(c, X.col(c)) for c in df.columns])


def null_uniform_unmatched(df: DataFrame, fields: list[str], matches: DataFrame, texts: DataFrame) -> DataFrame:
    """Null a field that holds one same value everywhere, has no matching header, and whose value is not in the text.

    `matches`: (scope_id, field, matched). `texts`: (scope_id, text). Scopes without text stay as they are.
    """
    stats = cells(df, fields).withColumn("value", X.strip(X.blank("value"))).filter("value != ''")
    uniform = (
        stats.groupBy(SCOPE, "field", "value").agg(F.count("*").alias("n"))
        .groupBy(SCOPE, "field")
        .agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("value").alias("value"))
        .filter("n >= 3 and kinds = 1")
    )
    suspects = uniform.join(matches.filter("not matched").select(SCOPE, "field"), [SCOPE, "field"], "left_semi")
    # a scope's suspects, at most one per field, come to its texts, which stay where they lie
    asked = settled(suspects.groupBy(SCOPE).agg(F.collect_set(F.struct("field", F.lower("value").alias("value"))).alias("asked")), "asked")
    told = beside(texts.filter("text != ''").select(SCOPE, F.lower("text").alias("text")), asked, SCOPE)
    missing = F.transform(F.filter("asked", lambda a: ~F.col("text").contains(a["value"])), lambda a: a["field"])
    absent = told.select(SCOPE, F.explode_outer(missing).alias("field")).filter("field is not null")
    return _null_fields(df, fields, absent.select(SCOPE, "field"))


def _null_fields(df: DataFrame, fields: list[str], victims: DataFrame) -> DataFrame:
    """Null whole columns per scope; `victims` holds at most one row per scope and field."""
    lists = settled(victims.groupBy(SCOPE).agg(F.collect_set("field").alias("_victims")), "victims")
    joined = beside(df, lists, SCOPE, "left")
    hit = {f: F.when(~F.coalesce(F.array_contains("_victims", f), F.lit(False)), X.col(f)).alias(f) for f in fields}
    return joined.select(*[hit.get(c, X.col(c)) for c in df.columns])


def duplicate_column_pairs(df: DataFrame, fields: list[str]) -> DataFrame:
    """Field pairs of a scope whose values agree in 80 % of the rows without one value driving it.

    Only pairs that hold the same value in a row are emitted; the rows where both cells are filled are then counted
    for the few pairs that can still qualify. Pairs come from a row's own cells, so nothing is self-joined.
    """
    ordered = sorted(fields)
    pairs = [(i, j) for i in range(len(ordered)) for j in range(i + 1, len(ordered))]
    # cells come out of a generator: each is normalised once per row, not once per pair
    values = df.select(SCOPE, F.inline(F.array(F.struct(*[F.lower(X.strip(X.blank(f))).alias(f"_c{i}") for i, f in enumerate(ordered)]))))
    same = F.array_compact(F.array(*[
        F.when((F.col(f"_c{i}") != "") & (F.col(f"_c{i}") == F.col(f"_c{j}")), F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"_c{i}").alias("value")))
        for i, j in pairs
    ])) if pairs else F.array().cast("array<struct<a:int,b:int,value:string>>")
    # the outer explode: the plain one adds a filter that works out all pairs once more
    equal = values.select(SCOPE, F.explode_outer(same).alias("p")).filter("p is not null")
    tally = equal.groupBy(SCOPE, "p.a", "p.b", "p.value").agg(F.count("*").alias("n"))
    matching = tally.groupBy(SCOPE, "a", "b").agg(F.sum("n").alias("matching"), F.max("n").alias("top"))
    possible = settled(matching.filter("matching >= 2 and top * 80 <= matching * 65"), "pairs")
    # at most one entry per pair of fields and scope; a row looks at its scope's entries only
    wanted = possible.groupBy(SCOPE).agg(F.collect_set(F.struct("a", "b")).alias("_wanted"))
    filled_cells = values.select(SCOPE, F.array(*[F.col(f"_c{i}") != "" for i in range(len(ordered))]).alias("_there"))
    both = beside(filled_cells, wanted, SCOPE).select(
        SCOPE, F.explode_outer(F.filter("_wanted", lambda p: F.get("_there", p["a"]) & F.get("_there", p["b"]))).alias("p")
    ).filter("p is not null")
    filled = both.groupBy(SCOPE, "p.a", "p.b").agg(F.count("*").alias("filled"))
    names = F.array(*[F.lit(f) for f in ordered])
    return possible.join(filled, [SCOPE, "a", "b"]).select(
        SCOPE, F.get(names, "a").alias("field_a"), F.get(names, "b").alias("field_b"), "matching", "top", "filled"
    ).filter(
        "filled >= 2 and matching * 10 >= filled * 8 and top * 100 <= filled * 65"
    )


def null_duplicate_columns(df: DataFrame, fields: list[str], matches: DataFrame) -> DataFrame:
    """Null the copy among duplicated columns: the one without a header match, else the later name.

    `matches` (scope_id, field, matched) lists the scopes that have tables; others stay as they are.
    """
    pairs = duplicate_column_pairs(df, fields)
    a = matches.select(SCOPE, F.col("field").alias("field_a"), F.col("matched").alias("a_ok"))
    b = matches.select(SCOPE, F.col("field").alias("field_b"), F.col("matched").alias("b_ok"))
    judged = pairs.join(a, [SCOPE, "field_a"]).join(b, [SCOPE, "field_b"]).filter("not (a_ok and b_ok)")
    victim = F.when(F.col("b_ok"), F.col("field_a")).otherwise(F.col("field_b"))
    return _null_fields(df, fields, judged.select(SCOPE, victim.alias("field")).distinct())


def apply_patches(df: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Fill still-missing cells from (scope_id, row_ord, field, value); the last patch of a cell counts by `patch_ord`.

    The first filled patch of a missing cell wins, later ones find it filled.
    """
    usable = patches.filter(F.col("field").isin(*fields) & X.is_filled("value"))
    wide = usable.groupBy(SCOPE, ORD).agg(
        *[
            F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("patch_ord"))).alias(f"_p{i}")
            for i, f in enumerate(fields)
        ]
    )
    joined = df.join(wide, [SCOPE, ORD], "left")
    patched = {
        f: F.when(X.is_filled(f), X.col(f)).otherwise(F.coalesce(F.col(f"_p{i}"), X.col(f))).alias(f)
        for i, f in enumerate(fields)
    }
    return joined.select(*[patched.get(c, X.col(c)) for c in df.columns])


def pass_key(fields: list[str]) -> Column:
    return F.coalesce(*[F.when(X.is_filled(f), F.lower(X.strip(f))) for f in fields])


def merge_passes(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """Combine two extraction passes of a scope.

    Second pass at least as long: its rows, with values of the first pass where both share the first filled value
    (the last row of a repeated key). Shorter: rows of the first pass, gaps filled by position.
    `row_ord` must be the position within the pass. Scopes without second-pass rows return the first pass.
    """
    first = first.filter(~X.has_error())
    second = second.filter(~X.has_error())
    n1 = first.groupBy(SCOPE).agg(F.count("*").alias("_n1"))
    n2 = second.groupBy(SCOPE).agg(F.count("*").alias("_n2"))
    plan = n1.join(n2, SCOPE, "full").select(
        SCOPE, (F.coalesce("_n2", F.lit(0)) >= F.greatest(F.coalesce("_n1", F.lit(0)), F.lit(1))).alias("_by_key")
    )
    names = [f"_v{i}" for i in range(len(fields))]
    by_key = first.withColumn("_key", pass_key(fields)).filter(F.col("_key").isNotNull()).groupBy(SCOPE, "_key").agg(
        *[F.max_by(X.col(f), ORD).alias(v) for f, v in zip(fields, names)]
    )
    own_key = F.coalesce(pass_key(fields), F.concat(F.lit("\x00"), F.col(ORD).cast("string")))
    keyed = (
        second.join(plan.filter("_by_key"), SCOPE, "left_semi")
        .withColumn("_key", own_key)
        .join(by_key, [SCOPE, "_key"], "left")
        .select(*[
            F.when(X.is_filled(names[fields.index(c)]), F.col(names[fields.index(c)])).otherwise(X.col(c)).alias(c)
            if c in fields else X.col(c) for c in first.columns
        ])
    )
    by_place = second.select(SCOPE, ORD, *[X.col(f).alias(v) for f, v in zip(fields, names)])
    placed = (
        first.join(plan.filter("not _by_key"), SCOPE, "left_semi")
        .join(by_place, [SCOPE, ORD], "left")
        .select(*[
            F.when(~X.is_filled(c) & X.is_filled(names[fields.index(c)]), F.col(names[fields.index(c)])).otherwise(X.col(c)).alias(c)
            if c in fields else X.col(c) for c in first.columns
        ])
    )
    return keyed.unionByName(placed)


def concat_records(parts: list[DataFrame]) -> DataFrame:
    """Union in part order; `part_ord` then `row_ord` is the list position."""
    tagged = [p.withColumn("part_ord", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def flatten_results(jobs: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of all documents of a user's jobs: the stored JSON is a list of rows or one row."""
    payload = F.when(F.ltrim("extracted_data").startswith("["), F.col("extracted_data")).otherwise(
        F.concat(F.lit("["), "extracted_data", F.lit("]"))
    )
    rows = F.from_json(payload, "array<map<string,string>>")
    owned = jobs.select("job_id", "user_id").join(docs.filter(F.col("extracted_data").isNotNull()), "job_id")
    exploded = owned.select("job_id", "user_id", "doc_ord", F.posexplode(rows).alias("row_ord", "_row"))
    return exploded.select(
        "job_id", "user_id", "doc_ord", F.col("row_ord").cast("bigint").alias("row_ord"),
        *[F.try_element_at("_row", F.lit(f)).alias(f) for f in fields],
    )
