"""Outputs: record files, accounting exports, registry and sitemap."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators.scan import RUN, counter
from tabloom.schema import ORD, SCOPE, SOURCE

SOURCE_HEADER = "Source File"


def output_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """Output layout: source file, then the fields; columns beyond are dropped, absent ones and nulls become ''."""
    present = set(df.columns)
    source = X.blank(SOURCE) if SOURCE in present else F.lit("")
    return df.select(
        source.alias(SOURCE_HEADER), *[(X.blank(f) if f in present else F.lit("")).alias(f) for f in fields]
    )


def write_records(df: DataFrame, fields: list[str], path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write records in parallel, one file per partition; positions go along as the sort inside each file."""
    ordered = df.sortWithinPartitions(SCOPE, ORD) if {SCOPE, ORD} <= set(df.columns) else df
    writer = output_columns(ordered, fields).write.mode(mode)
    if fmt == "csv":
        writer.csv(
            path, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    else:
        writer.format(fmt).save(path)


def fields_fingerprint(fields: list[str]) -> str:
    """Eight hex digits that stand for a set of field names, in any order."""
    return hashlib.md5(",".join(sorted(fields)).encode()).hexdigest()[:8]


def fingerprint_column(names: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(names), ",").cast("binary")), 1, 8)


def append_target(path: str, existing: list[str] | None, fields: list[str]) -> str:
    """Where to append: the target itself when its header fits or it is new, else the fingerprinted sibling."""
    expected = [SOURCE_HEADER, *fields]
    return path if existing is None or existing == expected else f"{path}_{fields_fingerprint(fields)}"


def pipeline_path(folder: str, name: str) -> str:
    """Place of a pipeline's output: its name without the characters that may not stand in a file name."""
    return f"{folder}/{re.sub(X.UNSAFE_IN_NAMES, '_', name).strip()}"


def append_pipeline(df: DataFrame, fields: list[str], folder: str, name: str, fmt: str = "parquet") -> str:
    """Append to the output of the pipeline `name` in `folder`, as `append_records` does. Returns the path written."""
    return append_records(df, fields, pipeline_path(folder, name), fmt)


def append_records(df: DataFrame, fields: list[str], path: str, fmt: str = "parquet") -> str:
    """Append to `path`, or to its fingerprinted sibling when the columns there differ. Returns the path written."""
    spark = df.sparkSession
    try:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        existing = reader.format(fmt).load(path).columns
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        existing = None
    target = append_target(path, existing, fields)
    write_records(df, fields, target, fmt, mode="append")
    return target


def export_accounting_csv(df: DataFrame) -> DataFrame:
    """Rows with a readable Date and a Description, as Date, Description, Amount texts."""
    day = X.parse_date("Date")
    text = F.substring(X.strip(F.translate(X.blank("Description"), ",", " ")), 1, 255)
    rows = df.filter(~X.has_error()).select(
        SCOPE, ORD, F.date_format(day, "MM/dd/yyyy").alias("Date"), text.alias("Description"),
        X.clean_amount("Amount").alias("Amount"),
    )
    return rows.filter("Date is not null and Description != ''")


def write_accounting_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the accounting export as CSV in parallel, a folder per scope; rows keep their order inside each file."""
    rows = export_accounting_csv(df).sortWithinPartitions(SCOPE, ORD).select(SCOPE, "Date", "Description", "Amount")
    rows.write.mode(mode).partitionBy(SCOPE).csv(
        path, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def statement_entries(df: DataFrame, run_rows: int = RUN) -> DataFrame:
    """Statement entries per scope: running number in input order, type by sign, id from date and number.

    Rows are numbered by range of scope and position, in runs, whatever the position is made of: a number, or the list of numbers that
    merged rows carry.
    """
    day = X.parse_date("Date")
    rows = df.filter(~X.has_error()).select(
        SCOPE, ORD, day.alias("day"), X.clean_amount("Amount").alias("amount"),
        F.substring(X.strip(X.blank("Description")), 1, 32).alias("name"),
    ).filter("day is not null")
    numbered = counter(rows, [SCOPE], [ORD], F.lit(1), "number", size=run_rows)
    posted = F.date_format("day", "yyyyMMdd")
    kind = F.when(F.col("amount").cast("double") >= 0, "CREDIT").otherwise("DEBIT")
    number = F.col("number").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0"))
    return numbered.select(
        SCOPE, ORD, "number", kind.alias("entry_type"), posted.alias("posted"), "amount",
        F.concat(posted, padded).alias("entry_id"), "name",
    )


def statement_totals(df: DataFrame) -> DataFrame:
    """Header dates and closing balance per scope. The balance also counts rows whose date does not read."""
    day = X.parse_date("Date")
    return df.filter(~X.has_error()).groupBy(SCOPE).agg(
        F.date_format(F.min(day), "yyyyMMdd").alias("date_start"),
        F.date_format(F.max(day), "yyyyMMdd").alias("date_end"),
        F.sum(X.clean_amount("Amount").cast("decimal(38,2)")).cast("double").alias("balance"),
    )


# Lines around the entries of an OFX 1.02 statement.
STATEMENT_HEAD = (
    "OFXHEADER:100", "DATA:OFXSGML", "VERSION:102", "SECURITY:NONE", "ENCODING:USASCII", "CHARSET:1252",
    "COMPRESSION:NONE", "OLDFILEUID:NONE", "NEWFILEUID:NONE", "", "<OFX>", "<SIGNONMSGSRSV1>", "<SONRS>",
    "<STATUS><CODE>0<SEVERITY>INFO</STATUS>", "<DTSERVER>{now}", "<LANGUAGE>ENG", "</SONRS>", "</SIGNONMSGSRSV1>",
    "<BANKMSGSRSV1>", "<STMTTRNRS>", "<TRNUID>0", "<STATUS><CODE>0<SEVERITY>INFO</STATUS>", "<STMTRS>",
    "<CURDEF>USD", "<BANKACCTFROM>", "<BANKID>000000000", "<ACCTID>000000000", "<ACCTTYPE>CHECKING",
    "</BANKACCTFROM>", "<BANKTRANLIST>", "<DTSTART>{start}", "<DTEND>{end}",
)
STATEMENT_FOOT = (
    "</BANKTRANLIST>", "<LEDGERBAL>", "<BALAMT>{balance}", "<DTASOF>{end}", "</LEDGERBAL>", "</STMTRS>",
    "</STMTTRNRS>", "</BANKMSGSRSV1>", "</OFX>",
)


def statement_lines(df: DataFrame, now: str) -> DataFrame:
    """All lines of every scope's statement as (scope_id, block, line_ord, line); sort by these to write a file.

    Entries become lines row by row, so a long statement is spread over tasks.
    """
    entries = statement_entries(df)
    body = entries.select(
        SCOPE, F.col("number").alias("block"),
        F.posexplode(
            F.array(
                F.lit("<STMTTRN>"), F.concat(F.lit("<TRNTYPE>"), "entry_type"), F.concat(F.lit("<DTPOSTED>"), "posted"),
                F.concat(F.lit("<TRNAMT>"), "amount"), F.concat(F.lit("<FITID>"), "entry_id"),
                F.concat(F.lit("<NAME>"), "name"), F.lit("</STMTTRN>"),
            )
        ).alias("line_ord", "line"),
    )
    totals = statement_totals(df).select(
        SCOPE, F.coalesce("date_start", F.lit(now[:8])).alias("start"), F.coalesce("date_end", F.lit(now[:8])).alias("end"),
        F.format_string("%.2f", "balance").alias("balance"),
    )

    def framed(lines: tuple[str, ...], block: Column) -> DataFrame:
        texts = []
        for line in lines:
            text = F.lit(line.replace("{now}", now))
            for name in ("start", "end", "balance"):
                text = F.replace(text, F.lit("{" + name + "}"), F.col(name)) if "{" + name + "}" in line else text
            texts.append(text)
        return totals.select(SCOPE, block.alias("block"), F.posexplode(F.array(*texts)).alias("line_ord", "line"))

    last = F.lit(2**62).cast("bigint")
    every = framed(STATEMENT_HEAD, F.lit(0).cast("bigint")).unionByName(body).unionByName(framed(STATEMENT_FOOT, last))
    return every.withColumn("line", F.regexp_replace("line", r"[^\x00-\x7F]", "?"))


def export_statement(df: DataFrame, path: str, now: str) -> None:
    """Write the statements as text, one folder per scope; ranges of one statement may span several files in order."""
    lines = statement_lines(df, now).repartitionByRange(SCOPE, "block", "line_ord").sortWithinPartitions(
        SCOPE, "block", "line_ord"
    )
    lines.select(SCOPE, "line").write.partitionBy(SCOPE).text(path)


def registry_entries(resources: DataFrame) -> DataFrame:
    """Listing of published and noindex entries; newest first when sorted by `publishedAt` descending."""
    return resources.filter(F.col("indexationStatus").isin("published", "noindex")).select(
        "slug", "title", "metaDescription", "templateType", "primaryKeyword", "indexationStatus",
        X.blank("publishedAt").alias("publishedAt"), F.col("templateType").alias("category"),
    )


def registry_summary(resources: DataFrame, now: str) -> DataFrame:
    """Head of the registry: time of the update and number of entries."""
    return registry_entries(resources).agg(F.lit(now).alias("lastUpdated"), F.count("*").alias("totalPublished"))


def write_registry(resources: DataFrame, path: str, now: str) -> None:
    """Registry as JSON lines: the entries, globally sorted newest first, in `resources`, the head in `summary`."""
    registry_entries(resources).orderBy(F.desc("publishedAt"), "slug").write.mode("overwrite").json(f"{path}/resources")
    registry_summary(resources, now).write.mode("overwrite").json(f"{path}/summary")


def sitemap_entries(resources: DataFrame, base_url: str, today: str) -> DataFrame:
    """Hub plus published pages with date, frequency and priority; `sort_key` orders the file."""
    stamp = F.substring(F.coalesce("updatedAt", "publishedAt", F.lit("")), 1, 10)
    day = F.coalesce(F.date_format(F.try_to_date(stamp, "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(today))
    pages = resources.filter(F.col("indexationStatus") == "published").select(
        F.concat(F.lit("1"), F.col("slug")).alias("sort_key"),
        F.concat(F.lit(f"{base_url}/resources/"), F.col("slug")).alias("loc"),
        day.alias("lastmod"), F.lit("monthly").alias("changefreq"), F.lit("0.6").alias("priority"),
    )
    hub = resources.sparkSession.range(1).select(
        F.lit("0").alias("sort_key"), F.lit(f"{base_url}/resources").alias("loc"), F.lit(today).alias("lastmod"),
        F.lit("weekly").alias("changefreq"), F.lit("0.7").alias("priority"),
    )
    return hub.unionByName(pages)


# The frame of a sitemap file.
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
SITEMAP_FOOT = "</urlset>"


def write_sitemap(resources: DataFrame, path: str, base_url: str, today: str) -> None:
    """Sitemap as text, its frame around one `<url>` block per entry, in slug order over the part files."""
    entry = F.format_string(
        "  <url>\n    <loc>%s</loc>\n    <lastmod>%s</lastmod>\n    <changefreq>%s</changefreq>\n"
        "    <priority>%s</priority>\n  </url>",
        "loc", "lastmod", "changefreq", "priority",
    )
    blocks = sitemap_entries(resources, base_url, today).select("sort_key", entry.alias("value"))
    frame = resources.sparkSession.createDataFrame([("", SITEMAP_HEAD), ("2", SITEMAP_FOOT)], "sort_key string, value string")
    blocks.unionByName(frame).orderBy("sort_key").select("value").write.mode("overwrite").text(path)
