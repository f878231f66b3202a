"""Form fields: normalised values, restricted and signature fields, paired questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.schema import MARKERS_FORM

# Answers that check a box; names and labels of office and signature fields.
YES = ("yes", "y", "true", "1", "checked", "on")
OFFICE_NAMES = (
    "pg1header", "officeuse", "office_use", "for_office_use", "received_by", "receivedby", "irs_use", "irsuse",
    "for_irs_use_only", "examiner_only", "agency_use_only",
)
OFFICE_LABELS = (
    "for irs use only", "for office use only", "for agency use only", "for government use only", "received by:",
    "for examiner only", "do not write in this space", "office use only",
)
SIGNATURE_NAMES = ("signature", "sig_", "_sig", "digitalsignature", "digital_signature", "sigfield")
PARTNER_NAMES = ("printname", "print_name", "namecontracting", "datesigned", "date_signed")


def form_blank(c: Column | str) -> Column:
    return X.strip(X.blank(c)).isin(*MARKERS_FORM)


def normalise_form_values(fields: DataFrame, options: DataFrame) -> DataFrame:
    """Values ready for a form (form_id, name, type, value, checked, unchecked); options: (form_id, name, option, option_ord).

    Check boxes become their state; a choice must be one of its options, else equal one in any case, else ''.
    """
    keys = ["form_id", "name"]
    exact = options.select(*keys, F.col("option").alias("value")).distinct().withColumn("_exact", F.lit(True))
    loose = options.groupBy(*keys, F.lower("option").alias("_low")).agg(F.min_by("option", "option_ord").alias("_option"))
    known = options.select(*keys).distinct().withColumn("_choices", F.lit(True))
    joined = (
        fields.withColumn("_low", F.lower(X.strip(X.blank("value"))))
        .join(known, keys, "left").join(exact, [*keys, "value"], "left").join(loose, [*keys, "_low"], "left")
    )
    value = X.blank("value")
    box = F.when(F.lower(X.strip(value)).isin(*YES), F.coalesce("checked", F.lit("/Yes"))).otherwise(F.coalesce("unchecked", F.lit("/Off")))
    choice = F.when(F.col("_choices").isNull() | F.col("_exact"), value).otherwise(F.coalesce("_option", F.lit("")))
    text = F.when(form_blank(value), "").otherwise(value)
    out = F.when(F.col("type") == "checkbox", box).when(F.col("type").isin("dropdown", "radio"), choice).otherwise(text)
    return joined.select(*keys, "type", out.alias("value"))


def blank_restricted_fields(fields: DataFrame) -> DataFrame:
    """Blank office-use fields, and long texts in narrow fields. Adds `zeroed`."""
    name, label = F.lower(X.blank("name")), F.lower(X.blank("label"))
    office = X.any_of(name.contains(p) for p in OFFICE_NAMES) | X.any_of(label.contains(p) for p in OFFICE_LABELS)
    cramped = (
        (F.col("type") == "text") & X.capacity_class("width", "height").isin("tiny", "narrow")
        & (F.length(X.strip(X.blank("value"))) > 20)
    )
    hit = ~form_blank("value") & (office | cramped)
    return fields.select(
        *[F.when(hit, "").otherwise(F.col(c)).alias(c) if c == "value" else F.col(c) for c in fields.columns],
        hit.alias("zeroed"),
    )


def is_signature(name: Column) -> Column:
    return X.any_of(F.lower(X.blank(name)).contains(p) for p in SIGNATURE_NAMES)


def is_signature_partner(name: Column) -> Column:
    low = F.lower(X.blank(name))
    dated = low.endswith("date") & ~low.contains("/")
    return X.any_of(low.contains(p) for p in PARTNER_NAMES) | dated | low.endswith("title") | low.contains("_title")


def blank_signature_neighbours(fields: DataFrame, reach: int = 3) -> DataFrame:
    """Blank date, title and name fields within three places of a blank signature (form_id, ord, name, value).

    The places around blank signatures are an equi-join on position, so a long form needs no ordered window.
    """
    blanks = fields.filter(is_signature(F.col("name")) & form_blank("value"))
    near = blanks.select(
        "form_id", F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("ord")
    ).distinct().withColumn("_near", F.lit(True))
    joined = fields.join(near, ["form_id", "ord"], "left")
    hit = F.coalesce("_near", F.lit(False)) & is_signature_partner(F.col("name")) & ~form_blank("value")
    return joined.select(
        *[F.when(hit, "").otherwise(F.col(c)).alias(c) if c == "value" else F.col(c) for c in fields.columns],
        hit.alias("zeroed"),
    )


PAIR = r"(?i)^(.*?)\s*[—–-]\s*(true|false|yes|no)\s*$"


def paired_questions(fields: DataFrame) -> DataFrame:
    """Check boxes that form a yes/no pair: one row per member with its question and side."""
    label = X.strip(X.blank("label"))
    side = F.when(F.lower(F.regexp_extract(label, PAIR, 2)).isin("true", "yes"), "true").otherwise("false")
    members = fields.filter((F.col("type") == "checkbox") & label.rlike(PAIR)).select(
        "form_id", "name", F.lower(X.strip(F.regexp_extract(label, PAIR, 1))).alias("question"), side.alias("side")
    )
    whole = members.groupBy("form_id", "question").agg(
        F.bool_or(F.col("side") == "true").alias("t"), F.bool_or(F.col("side") == "false").alias("f")
    ).filter("t and f")
    return members.join(whole.select("form_id", "question"), ["form_id", "question"], "left_semi")
