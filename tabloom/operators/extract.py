"""The extraction hook: request rows, responses, a built-in extractor and the post-processing chain."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import pages as P
from tabloom.operators import records as R
from tabloom.schema import ERROR, ORD, SCOPE, SOURCE, FieldSpec
from tabloom.operators.skew import beside
from tabloom.session import discard, settled, step


def field_block(fields: list[FieldSpec]) -> str:
    """Readable list of the requested fields."""
    lines = []
    for f in fields:
        lines.append(f"  - {f.name}")
        lines.append(f"    description: {f.description or 'best match in the document'}")
        if f.format:
            lines.append(f"    format: {f.format}")
    return "\n".join(lines)


def extraction_requests(
    files: DataFrame, pages: DataFrame, tables: DataFrame, fields: list[FieldSpec], expected: DataFrame | None = None,
    size: int = P.CHUNK_SIZE, above: int = P.CHUNK_ABOVE,
) -> DataFrame:
    """One request per document, or per chunk of a long one: fields, context, page texts, tables, token budget.

    A request never holds more than `size` pages and their tables.
    """
    chunked = P.chunk_pages(pages.select("doc_id", "page_num", "text"), size, above)
    # a page's tables become one text before they meet the page
    grid = F.format_string("[Table - page %d, %dx%d]\n%s", "page_num", "row_count", "col_count", "markdown")
    page_tables = tables.groupBy("doc_id", "page_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", grid.alias("t")))), lambda x: x["t"]), "\n\n").alias("t")
    )
    table_count = tables.groupBy("doc_id").agg(F.count("*").alias("table_count"))
    block = F.format_string("=== Page %d ===\n%s", "page_num", X.blank("text"))

    def joined(c: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.struct("page_num", c.alias("x"))))
        return F.array_join(F.filter(F.transform(listed, lambda p: p["x"]), lambda x: x.isNotNull()), "\n\n")

    texts = chunked.join(page_tables, ["doc_id", "page_num"], "left").groupBy("doc_id", "chunk").agg(
        F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"),
        joined(block).alias("page_text"), joined(F.col("t")).alias("tables_text"),
    )
    described = files.join(table_count, "doc_id", "left").join(
        expected if expected is not None else files.select("doc_id", F.lit(None).cast("bigint").alias("expected_rows")), "doc_id", "left"
    )
    context = F.format_string(
        "Filename: %s\nTotal pages: %d\nTables detected: %d", "filename", "page_count", F.coalesce("table_count", F.lit(0))
    )
    return texts.join(described, "doc_id").select(
        "doc_id", "chunk", "first_page", "last_page", F.lit(field_block(fields)).alias("field_block"),
        context.alias("context"), "page_text", "tables_text",
        X.token_budget(len(fields), F.col("expected_rows")).cast("int").alias("token_budget"),
    )


def apply_extractor(requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run a user's batch function over the requests; filter and select requests before this call."""
    return requests.mapInPandas(fn, schema)


def extract_from_tables(tables: DataFrame, fields: list[str]) -> DataFrame:
    """Built-in extractor: one record per grid row, each field from the first header cell that fits its name.

    A position is the table's number in the upper 32 bits and the row's in the lower ones, so rows of any grids never share one.
    """
    lines = F.filter(F.split("markdown", "\n"), lambda s: s.startswith("|"))
    rule = F.array_position(F.transform(lines, lambda s: s.rlike(r"^\|\s*-").cast("int")), 1).cast("int")

    def cut(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), X.strip)

    def place(field: str) -> Column:
        terms = F.regexp_extract_all(F.lit(field.lower()), F.lit("([a-z]{2,})"), 1)
        return F.array_position(F.transform("heads", lambda h: P.terms_match(terms, h).cast("int")), 1).cast("int")

    # header cells are matched once per grid, below the generator that opens its rows
    grids = tables.select("doc_id", "table_ord", lines.alias("lines"), rule.alias("rule")).filter("rule = 2").select(
        "doc_id", "table_ord", "lines", F.transform(cut(F.element_at("lines", 1)), lambda h: P.header_terms(F.lower(h))).alias("heads")
    )
    placed = grids.select("doc_id", "table_ord", "lines", F.array(*[place(f) for f in fields]).alias("places"))
    body = F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))
    first = F.shiftleft(F.col("table_ord").cast("bigint"), 32)
    rows = placed.select("doc_id", first.alias("first"), "places", F.posexplode(body).alias("line_ord", "line")).withColumn(
        "cells", F.array(cut(F.col("line")))
    ).select("doc_id", "first", "places", "line_ord", F.explode("cells").alias("cells"))

    def value(field: str) -> Column:
        at = F.element_at("places", fields.index(field) + 1)
        return F.when(at > 0, F.get("cells", at - 1))

    return rows.select(
        F.col("doc_id").alias(SCOPE), (F.col("first") + F.col("line_ord")).alias(ORD),
        F.col("doc_id").alias(SOURCE), F.lit(None).cast("string").alias(ERROR), *[value(f).alias(f) for f in fields],
    )


def extract_from_lines(pages: DataFrame, fields: list[str]) -> DataFrame:
    """Built-in extractor for forms: `label: value` lines of a page become one record per page; pages without an asked
    value give none."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*([\w #/.-]{2,40}:[ \t]+\S[^\n]*)$"), 1)
    pairs = F.transform(found, lambda s: F.struct(
        F.lower(F.substring_index(s, ":", 1)).alias("label"), X.strip(F.regexp_replace(s, "^[^:]*:", "")).alias("value")
    ))
    tagged = pages.select("doc_id", "page_num", F.explode(F.array(pairs)).alias("pairs")).filter(F.size("pairs") > 0)

    def value(field: str) -> Column:
        terms = F.regexp_extract_all(F.lit(field.lower()), F.lit("([a-z]{2,})"), 1)
        return F.get(F.filter("pairs", lambda p: P.terms_match(terms, P.header_terms(p["label"]))), F.lit(0))["value"]

    return tagged.select(
        F.col("doc_id").alias(SCOPE), F.col("page_num").cast("bigint").alias(ORD), F.col("doc_id").alias(SOURCE),
        F.lit(None).cast("string").alias(ERROR), *[value(f).alias(f) for f in fields],
    ).filter(X.any_of(F.col(f"`{f}`").isNotNull() for f in fields))


_JSON_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S)


def parse_responses(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Records from response texts: the whole text, a fenced block or the first balanced object, trailing commas forgiven.

    Keeps the other columns; one row per record with `record_ord`. A text without a JSON object gives one row with null
    fields and `parse_error` true.
    """
    text = X.strip(X.blank(column))

    def parsed(c: Column) -> Column:
        forgiven = F.regexp_replace(c, r",\s*([}\]])", "$1")
        return F.coalesce(*[
            F.when(v.startswith("{"), F.from_json(v, "map<string,string>")) for v in (c, forgiven)
        ])

    fences = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), 1), X.strip)
    from_fence = F.get(F.filter(F.transform(fences, parsed), lambda m: m.isNotNull()), F.lit(0))
    first = df.withColumn("_map", F.coalesce(parsed(text), from_fence))

    def balanced(text: str) -> str | None:
        """First object whose braces balance; braces in closed strings don't count, an open quote is plain text."""
        opened: list[int] = []
        found: tuple[int, int] | None = None
        for token in _JSON_TOKEN.finditer(text, max(text.find("{"), 0)):
            if token[0] == "{":
                opened.append(token.start())
            elif token[0] == "}" and opened:
                begin = opened.pop()
                if found is None or begin < found[0]:
                    found = begin, token.end()
                if not opened:
                    break
        return text[found[0]:found[1]] if found else None

    @F.pandas_udf("string")
    def fragment(s: pd.Series) -> pd.Series:
        return s.map(lambda t: balanced(t) if t else None)

    done = first.filter(F.col("_map").isNotNull())
    # only texts that are neither JSON nor fenced JSON go through Python
    rest = first.filter(F.col("_map").isNull()).withColumn("_fragment", fragment(X.blank(column)))
    rest = rest.withColumn("_map", parsed(F.col("_fragment"))).drop("_fragment")
    both = done.unionByName(rest)

    lists = F.transform(
        F.filter(F.map_values("_map"), lambda v: v.startswith("[") & F.from_json(v, "array<string>").isNotNull()),
        lambda v: F.from_json(v, "array<string>"),
    )
    listed = F.transform(F.filter(F.get(lists, F.lit(0)), lambda r: r.startswith("{")), lambda r: F.from_json(r, "map<string,string>"))
    rows = F.when(F.size(lists) > 0, listed).when(F.col("_map").isNotNull(), F.array("_map"))
    flat = both.select(*df.columns, F.col("_map").isNull().alias("parse_error"), F.posexplode_outer(rows).alias("record_ord", "_record"))
    return flat.select(
        *df.columns, "parse_error", "record_ord", *[F.try_element_at("_record", F.lit(f)).alias(f) for f in fields]
    )


def post_process(
    records: DataFrame, fields: list[str], matches: DataFrame, label_matches: DataFrame, texts: DataFrame,
    schedule: bool, dominant: bool = True,
    backfill: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3,
) -> DataFrame:
    """Repair chain after extraction.

    Null copied columns, null uniform values without a source, finalise rows of schedules, spread dominant values, then
    fill gaps with patches from `backfill`, scope by scope while that gains cells. `matches` are header matches, `label_matches` also
    count labels in the text.
    """
    spark = records.sparkSession

    def then(before: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """One step on, from rows that no later step reads: their files go."""
        after = step(spark, "repaired", lambda: make(before))
        discard(before)
        return after

    # every step reads its rows several times, so each begins with the written rows of the one before
    matches, label_matches = (step(spark, "matches", lambda m=m: m) for m in (matches, label_matches))

    def clean(df: DataFrame) -> DataFrame:
        apart = then(df, lambda d: R.null_duplicate_columns(d, fields, matches))
        return then(apart, lambda d: R.null_uniform_unmatched(d, fields, label_matches, texts))

    out = clean(step(spark, "records", lambda: records))
    if schedule:
        out = then(out, lambda d: R.finalise_records(d, fields))
    if dominant:
        out = then(out, lambda d: R.propagate_dominant(d, fields))
    if backfill is None:
        return out

    def gaps(df: DataFrame) -> DataFrame:
        missing = F.sum(F.when(~X.has_error(), len(fields) - X.filled_count(fields)).otherwise(0))
        return df.groupBy(SCOPE).agg(missing.alias("_gaps")).filter("_gaps > 0")

    open_scopes = step(spark, "gaps", lambda: gaps(out))
    for _ in range(rounds):
        if open_scopes.isEmpty():
            break
        # the rows a round began with stay: `backfill` has seen them, and the result has those of its closed scopes
        active = beside(out, open_scopes.select(SCOPE), SCOPE, "left_semi").select(out.columns)
        closed = beside(out, open_scopes.select(SCOPE), SCOPE, "left_anti").select(out.columns)
        patches = backfill(active)
        patched = clean(step(spark, "patched", lambda: R.apply_patches(active, patches, fields))).select(out.columns)
        out = closed.unionByName(patched)
        # a scope goes on while it has gaps, fewer than before
        before = open_scopes.withColumnRenamed("_gaps", "_before")
        left = step(spark, "gaps", lambda: gaps(patched).join(before, SCOPE).filter("_gaps < _before").select(SCOPE, "_gaps"))
        open_scopes = left
    return out
