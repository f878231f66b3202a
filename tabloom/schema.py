"""Field specs, fixed value sets and the column layout of the tables the operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCOPE = "scope_id"
ORD = "row_ord"
SOURCE = "source_file"
ERROR = "error"
RECORD_KEYS = (SCOPE, ORD, SOURCE, ERROR)


@dataclass(frozen=True)
class FieldSpec:
    """One requested field. `description` and `format` only feed the extraction requests."""

    name: str
    description: str = ""
    format: str = ""


# Markers that count as "no value" (compared after strip and lower-case).
MARKERS_CORE = ("", "null", "none", "n/a", "na", "-", "—", "–", "unknown", "not found", "not available")
MARKERS_REPORT = ("", "null", "none", "n/a", "na", "-", "unknown", "not found", "not available")
MARKERS_UPSERT = ("", "null", "none", "n/a", "na", "-", "—", "unknown", "not found", "not available")
MARKERS_POLL = ("", "null", "none", "n/a", "na", "-", "—")
MARKERS_SHORT = ("", "null", "none", "n/a", "na", "-")
MARKERS_FORM = ("", "Please Select...", "N/A", "n/a", "null", "None")

# Words in a field name that make it a numeric or a date field.
NUMERIC_WORDS = (
    "amount", "price", "total", "cost", "fee", "tax", "payment", "balance", "subtotal", "charge", "rate",
    "salary", "revenue", "income", "expense", "profit", "loss", "value", "qty", "quantity", "count", "shares",
    "dollars", "cents", "premium", "deductible", "copay", "coinsurance", "billed", "allowed", "paid", "covered",
)
DATE_WORDS = ("date", "expiry", "expiration", "effective")


def records_type(fields: list[str]) -> T.StructType:
    """Layout of a records table: keys, then one nullable string per field."""
    keys = [
        T.StructField(SCOPE, T.StringType(), False),
        T.StructField(ORD, T.LongType(), False),
        T.StructField(SOURCE, T.StringType()),
        T.StructField(ERROR, T.StringType()),
    ]
    return T.StructType(keys + [T.StructField(f, T.StringType()) for f in fields])


# Layouts as DDL text: usable without a running session.
PAGES_TYPE = (
    "doc_id string, page_num int, text string, image_count int, header string, footer string, tables_markdown string"
)
TABLES_TYPE = (
    "doc_id string, table_ord int, page_num int, row_count int, col_count int, markdown string"
)
FILES_TYPE = (
    "doc_id string, filename string, size_bytes bigint, page_count int, is_scanned boolean, doc_type_hint string"
)
CALLS_TYPE = (
    "job_id string, model string, prompt_tokens bigint, cached_tokens bigint, completion_tokens bigint, "
    "ocr_pages bigint, removed_tokens bigint"
)
USAGE_TYPE = ("event_id bigint, user_id bigint, ts timestamp, kind string, pages bigint, tier string")
RUN_LOG_TYPE = (
    "run_id string, started string, completed string, discovered int, generated int, "
    "generation_failures array<string>, "
    "publish_results struct<"
    "published_index:array<struct<slug:string>>,published_noindex:array<struct<slug:string>>,"
    "drafted:array<struct<slug:string,reason:string>>,rejected:array<struct<slug:string,reason:string>>>"
)

LIST_FIELDS = (
    "secondaryKeywords", "whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs",
    "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "relatedResources", "trustSignals",
    "exampleUseCases",
)
TEXT_FIELDS = (
    "slug", "title", "metaTitle", "metaDescription", "h1", "primaryKeyword", "searchIntent", "templateType",
    "indexationStatus", "canonicalUrl", "summary",
)
RESOURCE_TYPE = (
    ", ".join(f"{c} string" for c in TEXT_FIELDS)
    + ", "
    + ", ".join(f"{c} array<string>" for c in LIST_FIELDS)
    + ", hero struct<headline:string,subheadline:string,primaryCta:string>"
    + ", relatedProductLinks array<struct<label:string,url:string>>"
    + ", faq array<struct<question:string,answer:string>>"
    + ", sections array<struct<heading:string,body:string>>"
    + ", qualityReview struct<intentMatchScore:double,uniquenessScore:double,thinContentRisk:double,"
    "duplicationRisk:double,productTruthfulnessScore:double,helpfulnessScore:double,indexRecommendation:string>"
    + ", publishedAt string, updatedAt string"
)
