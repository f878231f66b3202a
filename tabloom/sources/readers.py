"""Inputs: delimited files, nested JSON folders, file listings, HTML and markdown grids."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.schema import RESOURCE_TYPE, RUN_LOG_TYPE


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header, every column a string, byte order mark removed. Files stay splittable unless `multi_line`."""
    df = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multi_line, escape='"', encoding="UTF-8", emptyValue="",
    )
    return df.select(*[X.blank(c).alias(c.lstrip("﻿")) for c in df.columns])


def header_schema(headers: DataFrame) -> DataFrame:
    """Usable headers of a table (set_id, field, field_ord): no blank names, no source-file column."""
    return headers.filter((X.strip(X.blank("field")) != "") & (F.lower(X.strip("field")) != "source file"))


def data_headers(df: DataFrame) -> list[str]:
    """The same rule for one DataFrame, at plan time."""
    return [c for c in df.columns if c.strip() and c.strip().lower() != "source file"]


def read_baseline_non_blank(df: DataFrame, fields: list[str]) -> DataFrame:
    """Drop rows that are blank in every column."""
    return df.filter(X.any_of(X.blank(f) != "" for f in fields))


def read_resources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Folder of nested JSON documents, one per file (or one per line); what does not parse is skipped."""
    layout = RESOURCE_TYPE + ", _corrupt_record string"
    df = spark.read.schema(layout).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


OUTCOMES = ("published_index", "published_noindex", "drafted", "rejected")


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run logs flattened to one row per (run, outcome, slug); runs without outcome keep one row with nulls."""
    logs = spark.read.schema(RUN_LOG_TYPE).option("multiLine", multi_line).json(path)

    def outcome(name: str) -> Column:
        slugs = F.coalesce(F.col(f"publish_results.{name}.slug"), F.array().cast("array<string>"))
        return F.transform(slugs, lambda s: F.struct(F.lit(name).alias("outcome"), s.alias("slug")))

    tagged = F.flatten(F.array(*[outcome(name) for name in OUTCOMES]))
    flat = logs.select(
        "run_id", "started", "completed", "discovered", "generated",
        F.greatest(F.size("generation_failures"), F.lit(0)).alias("failures"), F.explode_outer(tagged).alias("o"),
    )
    return flat.select("*", "o.outcome", "o.slug").drop("o")


# Extensions by use.
SPREADSHEET_EXT = ("xlsx", "xls", "xlsm", "csv")
DOCUMENT_EXT = (
    "pdf", "png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff", "txt", "md", "markdown", "html", "htm",
    "json", "xml", "eml", "emlx", "msg",
)
MAX_FILE_BYTES = 5 * 1024 * 1024


def classify_inputs(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Class of each file (filename, size_bytes, page_count): empty, too_large, spreadsheet, document, unsupported."""
    ext = X.extension("filename")
    kind = (
        F.when(F.col("size_bytes") == 0, "empty")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(ext.isin(*SPREADSHEET_EXT), "spreadsheet")
        .when(ext.isin(*DOCUMENT_EXT), "document")
        .otherwise("unsupported")
    )
    pages = F.when(ext == "pdf", F.greatest(F.col("page_count"), F.lit(1))).otherwise(1)
    return files.select(
        "*", kind.alias("input_class"), X.file_kind("filename").alias("content_type"),
        F.when(kind.isin("spreadsheet", "document"), pages).otherwise(0).alias("billable_pages"),
    )


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """Folder listing from file metadata; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("path").alias("file_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("md5"), F.col("modificationTime").cast("string").alias("modified"),
    )


def list_snapshot(files: DataFrame) -> DataFrame:
    """Listing with one fingerprint: content hash, else md5, else modification time, else ''."""
    mark = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("content_hash", "md5", "modified")], F.lit(""))
    return files.select("file_id", "filename", mark.alias("content_mark"))


#: Named entities by the HTML standard; those that may stand without a semicolon are listed without one too.
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
BARE_ENTITIES = {name: char for name, char in html5.items() if not name.endswith(";")}
_COMMON = ("nbsp", "amp", "lt", "gt", "quot", "apos")


def _by_name(chars: dict[str, str]) -> Column:
    """Constant map, everyday names first."""
    names = sorted(chars, key=lambda n: (n not in _COMMON, len(n), n))
    return F.map_from_arrays(*[F.split(F.lit("\0".join(part)), "\0") for part in (names, [chars[n] for n in names])])


def _code_char(code: Column) -> Column:
    """Character of a numeric entity: Windows letters for 128 to 159, the replacement mark for what is no character."""
    old = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)]
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(128, 159), F.get(F.array(*[F.lit(c) for c in old]), (code - 128).cast("int")))
        .when(control | (code % 65536 >= 65534), "").otherwise(char)
    )


def unescape_html(text: Column) -> Column:
    """Every entity of the text resolved once, named or numeric, with or without its semicolon."""
    names, bare_names = _by_name(ENTITIES), _by_name(BARE_ENTITIES)
    bare = "|".join(sorted(BARE_ENTITIES, key=len, reverse=True))

    def part(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
        named = F.when(name != "", F.try_element_at(names, name))
        short = F.regexp_extract(piece, f"^({bare})", 1)
        digits = F.regexp_extract(piece, "^#0*([0-9]+);?", 1)
        hexed = F.regexp_extract(piece, "^#[xX]0*([0-9A-Fa-f]+);?", 1)
        # longer numbers are no characters; they read as null
        code = F.when(digits != "", F.when(F.length(digits) <= 7, digits).cast("int")).otherwise(
            F.conv(F.when(F.length(hexed) <= 6, hexed), 16, 10).cast("int")
        )
        rest = F.regexp_replace(piece, "^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", "")
        return (
            F.when(i == 0, piece)
            .when((digits != "") | (hexed != ""), F.concat(_code_char(code), rest))
            .when(named.isNotNull(), F.concat(named, F.substr(piece, F.length(name) + 2)))
            .when(short != "", F.concat(F.try_element_at(bare_names, short), F.substr(piece, F.length(short) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    return F.array_join(F.transform(F.split(text, "&"), part), "")


def html_to_text(c: Column | str) -> Column:
    """Readable text of HTML: scripts out, block ends to newlines, tags out, entities resolved, blanks collapsed."""
    text = F.regexp_replace(X.col(c), r"(?is)<(script|style).*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n")
    text = unescape_html(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return X.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def markdown_tables(tables: DataFrame) -> DataFrame:
    """One row per grid line of (doc_id, table_ord, markdown): cells, and whether the line is above the rule."""
    rule = F.array_position(F.transform(F.split("markdown", "\n"), lambda x: x.rlike(r"^\|\s*-").cast("int")), 1)
    lines = tables.select(
        "doc_id", "table_ord", (rule - 1).alias("rule_at"), F.posexplode(F.split("markdown", "\n")).alias("line_ord", "line")
    )
    inner = F.regexp_replace(F.col("line"), r"^\s*\||\|\s*$", "")
    return lines.filter(F.col("line").startswith("|") & (F.col("line_ord") != F.col("rule_at"))).select(
        "doc_id", "table_ord", "line_ord",
        (F.col("rule_at").isNotNull() & (F.col("line_ord") < F.col("rule_at"))).alias("is_header"),
        F.transform(F.split(inner, r"\|"), X.strip).alias("cells"),
    )
