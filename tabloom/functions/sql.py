"""SQL functions for users of `spark.sql`: plain expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabloom.functions.expr import DATE_SEARCH, FLOAT_GRAMMAR, MONTH_FIRST, NAMED_LAYOUTS, NUMERIC_LAYOUTS, RARE_SPACES, SPACES
from tabloom.schema import MARKERS_CORE

_SPACES = r" \t\n\r"


def _text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\") + '"'


def _escaped(value: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04X}" for c in value) + "'"


def _rewritten(text: str, layouts: tuple[tuple[str, str], ...]) -> str:
    for pattern, iso in layouts:
        text = f"regexp_replace({text}, {_text(pattern)}, '{iso}')"
    return text


def _to_date(text: str, layout: str) -> str:
    return f"CAST(try_to_timestamp({text}, '{layout}') AS DATE)"


_DIGITS = r"regexp_replace(t, r'\D', '')"
_EIGHT = f"CASE WHEN length({_DIGITS}) = 8 THEN {_DIGITS} END"
_NAMED = rf"initcap(regexp_replace(replace({_rewritten('t', NAMED_LAYOUTS)}, '-', ' '), r'^(\d{{4}} [A-Za-z]{{3}})[a-z]*', '$1'))"

FUNCTIONS = {
    "is_filled": (
        "x STRING", "BOOLEAN",
        f"lower(btrim(coalesce(x, ''), '{_SPACES}')) NOT IN ({', '.join(_text(m) for m in MARKERS_CORE)})",
    ),
    "norm_key": ("x STRING", "STRING", "regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', '')"),
    "clean_money": (
        "x STRING", "STRING",
        r"CASE WHEN btrim(x) RLIKE r'(?is)^(.*?)\s+(?:million|billion|thousand)s?$'"
        r" AND regexp_extract(btrim(x), r'(?is)^(.*?)\s+(?:million|billion|thousand)s?$', 1) RLIKE r'\d{1,3}(?:,\d{3})+'"
        r" THEN btrim(regexp_extract(btrim(x), r'(?is)^(.*?)\s+(?:million|billion|thousand)s?$', 1)) ELSE x END",
    ),
    "parses_as_number": (
        "x STRING", "BOOLEAN",
        r"regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), r'[$£€¥,\s%()]', ''),"
        r" r'(?i)(?:trillion|billion|million|thousand|[tbmk])$', ''), r'^-+', '') RLIKE " + _text(FLOAT_GRAMMAR),
    ),
    "parses_as_date": ("x STRING", "BOOLEAN", "coalesce(x, '') RLIKE " + _text(DATE_SEARCH)),
    "parse_date": (
        "x STRING", "DATE",
        f"date_of_text(regexp_replace(translate(btrim(coalesce(x, ''), {_escaped(SPACES)}), {_escaped(RARE_SPACES)}, '{' ' * len(RARE_SPACES)}'), r'\\s+', ' '))",
    ),
    "clean_amount": (
        "x STRING", "STRING",
        "format_string('%.2f', coalesce(CASE WHEN btrim(coalesce(x, '')) LIKE '(%)' THEN -1 ELSE 1 END"
        r" * abs_or_same(try_cast(regexp_replace(coalesce(x, ''), r'[$,()\s]', '') AS DOUBLE), btrim(coalesce(x, '')) LIKE '(%)'), 0.0D))",
    ),
    "id_token": (
        "x STRING", "STRING",
        r"coalesce(get(filter(regexp_extract_all(coalesce(x, ''), r'([A-Za-z0-9#/_-]+)', 1), t -> t RLIKE r'\d'), 0),"
        r" get(regexp_extract_all(coalesce(x, ''), r'([A-Za-z0-9#/_-]+)', 1), 0), substring(btrim(coalesce(x, '')), 1, 20))",
    ),
    "word_jaccard": (
        "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE",
        "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END",
    ),
}
# brackets mean negative whatever the sign inside
FUNCTIONS = {
    "abs_or_same": ("v DOUBLE, b BOOLEAN", "DOUBLE", "CASE WHEN b THEN abs(v) ELSE v END"),
    # the layouts of expr.parse_date, over text with single spaces
    "date_of_text": (
        "t STRING", "DATE",
        f"coalesce({_to_date(_rewritten('t', NUMERIC_LAYOUTS), 'yyyy-M-d')}, {_to_date(_rewritten('t', ((MONTH_FIRST, '$4-$3-$1'),)), 'yyyy-M-d')},"
        f" {_to_date(_NAMED, 'yyyy MMM d')}, {_to_date(_EIGHT, 'yyyyMMdd')}, {_to_date(_EIGHT, 'MMddyyyy')})",
    ),
    **FUNCTIONS,
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
