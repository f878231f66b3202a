"""Scalar building blocks. Every function returns a native Column, so plans stay inside codegen."""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.schema import DATE_WORDS, MARKERS_CORE, NUMERIC_WORDS

# All characters that count as white space, as a trim set and as a pattern class.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
RARE_SPACES = SPACES[6:]
WS = r"[\s\x1C-\x1F\x85\xA0  -     　]"


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, list(conditions), F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, list(conditions), F.lit(True))


def count_true(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.add, [c.cast("int") for c in conditions], F.lit(0))


def strip(c: Column | str) -> Column:
    """Drop leading and trailing white space of any kind (`trim` only drops blanks)."""
    return F.expr(f"btrim(`{c}`, '{SPACES}')") if isinstance(c, str) else F.btrim(c, F.lit(SPACES))


def plain_spaces(c: Column | str) -> Column:
    """Rare kinds of space as blanks; then the short pattern for white space is enough, and much quicker."""
    return F.translate(col(c), RARE_SPACES, " " * len(RARE_SPACES))


def squash(c: Column | str) -> Column:
    """Collapse runs of white space to one blank."""
    return F.regexp_replace(plain_spaces(c), r"\s+", " ")


def blank(c: Column | str) -> Column:
    """Null-safe text: null becomes ''."""
    return F.expr(f"coalesce(`{c}`, '')") if isinstance(c, str) else F.coalesce(c, F.lit(""))


def is_filled(c: Column | str, markers: Iterable[str] = MARKERS_CORE) -> Column:
    """True iff a value is present and is not one of the empty markers.

    Named columns take the text form: it builds in one call, which matters for wide field lists.
    """
    if isinstance(c, str):
        listed = ", ".join(f"'{m}'" for m in markers)
        return F.expr(f"lower(btrim(coalesce(`{c}`, ''), '{SPACES}')) NOT IN ({listed})")
    return ~F.lower(strip(blank(c))).isin(*markers)


def filled_count(fields: Iterable[str], markers: Iterable[str] = MARKERS_CORE) -> Column:
    return count_true(is_filled(f, markers) for f in fields)


def has_error(c: Column | str = "error") -> Column:
    return blank(c) != ""


def clean_money(c: Column | str, stripped: bool = False) -> Column:
    """Drop a trailing magnitude word, but only behind a comma-grouped number."""
    text = col(c) if stripped else strip(c)
    # a cheap look at the end of the value decides whether it is taken apart
    word_last = text.rlike(r"(?i)(?:million|billion|thousand)s?$")
    base = strip(F.regexp_extract(text, rf"(?is)^(.*?){WS}+(?:million|billion|thousand)s?$", 1))
    return F.when(word_last & base.rlike(r"\d{1,3}(?:,\d{3})+"), base).otherwise(col(c))


FLOAT_GRAMMAR = (
    r"^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:[eE][+-]?\d+(?:_\d+)*)?"
    r"|\.\d+(?:_\d+)*(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:inf|infinity|nan))$"
)


def parses_as_number(c: Column | str) -> Column:
    """A value reads as a number once currency signs, brackets and one magnitude suffix are gone."""
    text = F.regexp_replace(blank(c), r"[$£€¥,\s%()]", "")
    text = F.regexp_replace(text, r"(?i)(?:trillion|billion|million|thousand|[tbmk])$", "")
    text = F.regexp_replace(text, r"^-+", "")
    return (blank(c) != "") & text.rlike(FLOAT_GRAMMAR)


# The shapes that count as a date somewhere inside a value.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAY_FIRST = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
YEAR_FIRST = r"\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b"
MONTH_YEAR = r"\b\d{1,2}[/\-]\d{4}\b"
MONTH_NAME = rf"\b(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b"
DATE_SEARCH = "(?i)" + "|".join((DAY_FIRST, YEAR_FIRST, MONTH_YEAR, MONTH_NAME))
PAGE_DATE_SEARCH = "(?i)" + "|".join((DAY_FIRST, YEAR_FIRST, MONTH_NAME))
PAGE_NUMBER_SEARCH = r"[$£€]\s*[\d,]+|[\d,]+\.\d{2}\b|\b\d{1,3}(?:,\d{3})+\b"


def parses_as_date(c: Column | str) -> Column:
    return blank(c).rlike(DATE_SEARCH)


def name_words(name: str) -> set[str]:
    return set(re.split(r"[\s_\-]+", name.lower()))


def numeric_fields(fields: Iterable[str]) -> list[str]:
    """Plan-time: fields whose name carries a numeric word."""
    return [f for f in fields if name_words(f) & set(NUMERIC_WORDS)]


def date_fields(fields: Iterable[str]) -> list[str]:
    return [f for f in fields if name_words(f) & set(DATE_WORDS)]


def amount_value(c: Column | str) -> Column:
    """Amount text as a double: currency sign and commas out, brackets mean negative, unreadable is 0."""
    text = strip(blank(c))
    bracketed = (F.length(text) >= 1) & text.startswith("(") & text.endswith(")")
    inner = F.when(bracketed, text.substr(F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)
    bare = strip(F.regexp_replace(inner, r"[$,]", ""))
    number = F.when(bare.rlike(FLOAT_GRAMMAR), F.regexp_replace(bare, "_", "").try_cast("double"))
    signed = F.when(bracketed, -F.abs(number)).otherwise(number)
    return F.coalesce(signed, F.lit(0.0))


def clean_amount(c: Column | str) -> Column:
    """Amount as text with two decimals and no grouping."""
    return F.format_string("%.2f", amount_value(c))


# Accepted date layouts, rewritten to year-month-day. Two-digit years from 69 on are of the last century.
MONTH_FIRST = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"
NUMERIC_LAYOUTS = (
    (MONTH_FIRST, "$4-$1-$3"),
    (r"^(\d{4})([/-])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$1-$3"),
    (r"^(\d{1,2})([/-])(\d{1,2})\2([0-5]\d|6[0-8])$", "20$4-$1-$3"),
)
MONTH_WORD = (
    "(jan)(?:uary)?|(feb)(?:ruary)?|(mar)(?:ch)?|(apr)(?:il)?|(may)|(jun)e?|(jul)y?|(aug)(?:ust)?|(sep)(?:tember)?"
    "|(oct)(?:ober)?|(nov)(?:ember)?|(dec)(?:ember)?"
)
_MONTH_PLAIN = MONTH_WORD.replace("(?:", "(").replace("(", "(?:")
NAMED_LAYOUTS = (
    (rf"(?i)^({_MONTH_PLAIN}) (\d{{1,2}}),? (\d{{4}})$", "$3-$1-$2"),
    (rf"(?i)^(\d{{1,2}}) ({_MONTH_PLAIN}) (\d{{4}})$", "$3-$2-$1"),
)


def parse_date(c: Column | str) -> Column:
    """Date from free text: fixed layouts first, then eight digits as year-first, then month-first."""
    text = squash(strip(blank(c)))
    numeric, named = text, text
    for pattern, iso in NUMERIC_LAYOUTS:
        numeric = F.regexp_replace(numeric, pattern, iso)
    for pattern, iso in NAMED_LAYOUTS:
        named = F.regexp_replace(named, pattern, iso)
    named = F.initcap(F.regexp_replace(F.replace(named, F.lit("-"), F.lit(" ")), r"^(\d{4} [A-Za-z]{3})[a-z]*", "$1"))
    digits = F.regexp_replace(text, r"\D", "")
    eight = F.when(F.length(digits) == 8, digits)
    return F.coalesce(
        F.try_to_date(numeric, "yyyy-M-d"),
        F.try_to_date(F.regexp_replace(text, MONTH_FIRST, "$4-$3-$1"), "yyyy-M-d"),
        F.try_to_date(named, "yyyy MMM d"),
        F.try_to_date(eight, "yyyyMMdd"),
        F.try_to_date(eight, "MMddyyyy"),
    )


def norm_key(c: Column | str) -> Column:
    """Comparison form of a key: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def id_token(c: Column | str, fallback_chars: int = 20) -> Column:
    """First token with a digit, else the first token, else the first characters."""
    text = strip(blank(c))
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9#/_-]+)"), 1)
    coded = F.get(F.filter(tokens, lambda t: t.rlike(r"\d")), F.lit(0))
    return F.coalesce(coded, F.get(tokens, F.lit(0)), F.substring(text, 1, fallback_chars))


def cell_signature(fields: Iterable[str]) -> Column:
    """Whole-row signature for exact duplicate detection; a JSON text, so no hash collisions."""
    cells = [squash(F.lower(strip(blank(f)))).alias(f) for f in sorted(fields)]
    return F.to_json(F.struct(*cells))


def first_words(c: Column | str, n: int) -> Column:
    words = F.regexp_extract_all(blank(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9/&().,#:%-]*)"), 1)
    return F.array_join(F.slice(words, 1, n), " ")


def word_list(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(plain_spaces(blank(c)), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words. Texts with rare kinds of space are brought to plain ones first."""
    text = blank(c)
    rare = text.rlike(f"[{RARE_SPACES}]")
    return F.when(rare, F.regexp_count(plain_spaces(text), F.lit(r"\S+"))).otherwise(F.regexp_count(text, F.lit(r"\S+")))


def table_header_text(markdown: Column | str) -> Column:
    """Lines of a markdown grid above its separator line, joined by a blank."""
    lines = F.split(blank(markdown), "\n")
    first_rule = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\|\s*-").cast("int")), 1).cast("int")
    head = F.when(first_rule > 0, F.slice(lines, F.lit(1), first_rule - 1)).otherwise(lines)
    return F.array_join(head, " ")


def header_signature(markdown: Column | str) -> Column:
    """Header cells reduced to letters and digits, '|' separated; '' when there is no header."""
    cells = F.split(F.lower(table_header_text(markdown)), r"\|")
    reduced = F.transform(cells, lambda x: F.regexp_replace(x, "[^a-z0-9]+", ""))
    return F.array_join(F.filter(reduced, lambda x: x != ""), "|")


# Mail domains shared by many people.
CONSUMER_DOMAINS = (
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "icloud.com", "live.com", "msn.com",
    "me.com", "protonmail.com", "ymail.com", "googlemail.com",
)
PUBLIC_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com",
    "yahoo.co.uk", "ymail.com", "aol.com", "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me",
    "zoho.com", "mail.com", "gmx.com", "gmx.net",
)


def domain(email: Column | str) -> Column:
    return F.lower(F.substring_index(col(email), "@", -1))


def group_key(email: Column | str) -> Column:
    """Mailbox grouping: the full address for consumer domains, else the domain."""
    return F.when(domain(email).isin(*CONSUMER_DOMAINS), F.lower(col(email))).otherwise(domain(email))


@functools.cache
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII characters, with these: one for one, and one for several."""
    single, several = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        letter = chr(code)
        if unicodedata.decomposition(letter):
            plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
            if plain:
                (single if len(plain) == 1 else several)[letter] = plain
    return single, several


def ascii_folded(c: Column | str) -> Column:
    """Letters with marks, wide and styled forms and ligatures as the ASCII characters they are made of; other characters stay."""
    single, several = _ascii_folds()
    folded = F.translate(col(c), "".join(single), "".join(single.values()))
    letters = F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return F.when(folded.rlike("[" + "".join(several) + "]"), spelled).otherwise(folded)


def slug_name(c: Column | str, max_len: int = 12, fallback: str = "user") -> Column:
    """First name token as a mail-safe slug, with letters folded to ASCII."""
    first = F.lower(ascii_folded(F.get(word_list(c), F.lit(0))))
    cleaned = F.substring(F.regexp_replace(first, "[^a-z0-9]+", ""), 1, max_len)
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit(fallback)).otherwise(cleaned)


def tag_candidates(c: Column | str) -> Column:
    """Routing candidates of a recipient text: each plus-tag, then its '-' and '_' segments, in order."""
    tags = F.regexp_extract_all(F.lower(blank(c)), F.lit(r"\+([a-z0-9_\-]+)@"), 1)
    parts = F.transform(tags, lambda t: F.concat(F.array(t), F.split(t, "[-_]")))
    return F.array_distinct(F.filter(F.flatten(parts), lambda s: s != ""))


# Words without content for text comparison.
STOP_WORDS = (
    "the", "a", "an", "to", "for", "and", "or", "in", "of", "on", "with", "from", "by", "is", "are", "was",
    "were", "it", "its", "this", "that", "your", "how", "what", "why", "when", "where",
)
KEYWORD_STOP_WORDS = ("to", "a", "the", "and", "or", "for", "from", "with", "in", "of", "vs")


def content_words(c: Column | str, distinct: bool = True) -> Column:
    tokens = F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept) if distinct else kept


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity, 0 when either side is empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / total)


def keyword_swap(a_words: Column, b_words: Column) -> Column:
    """Same length, neither contains the other, exactly one word differs per side, at least three shared."""
    a, b = F.array_distinct(a_words), F.array_distinct(b_words)
    shared = F.size(F.array_intersect(a, b))
    only_a, only_b = F.size(a) - shared, F.size(b) - shared
    return (F.size(a_words) == F.size(b_words)) & (only_a == 1) & (only_b == 1) & (shared >= 3)


def keyword_present(keyword: Column, text: Column) -> Column:
    """At least 80 % of the keyword's significant words occur in the text, singular and plural alike."""
    words = F.filter(
        F.regexp_extract_all(F.lower(keyword), F.lit("([a-z0-9]+)"), 1),
        lambda w: (F.length(w) > 1) & ~w.isin(*KEYWORD_STOP_WORDS),
    )
    seen = F.regexp_extract_all(F.lower(blank(text)), F.lit("([a-z0-9]+)"), 1)
    hits = F.filter(
        words,
        lambda w: F.array_contains(seen, w)
        | F.array_contains(seen, F.concat(w, F.lit("s")))
        | F.array_contains(seen, F.regexp_replace(w, "s+$", "")),
    )
    return F.size(hits) * 10 >= F.size(words) * 8


# Content type by file extension.
CONTENT_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "txt": "text/plain",
    "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json",
    "xml": "application/xml", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "msg": "application/vnd.ms-outlook", "eml": "message/rfc822",
}


def extension(name: Column | str) -> Column:
    return F.when(col(name).contains("."), F.lower(F.substring_index(col(name), ".", -1))).otherwise("")


def file_kind(name: Column | str) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, extension(name)), F.lit("application/octet-stream"))


def token_budget(field_count: Column | int, expected_rows: Column) -> Column:
    n = field_count if isinstance(field_count, Column) else F.lit(field_count)
    rows = F.greatest(F.coalesce(F.when(expected_rows != 0, expected_rows), F.lit(8)), F.lit(8))
    return F.least(F.lit(32768), F.greatest(F.lit(12000), F.lit(2000) + n * rows * 18))


# Characters that may not stand in a file name.
UNSAFE_IN_NAMES = r'[\\/:*?"<>|]'


def output_name(c: Column | str) -> Column:
    """A name as file name: unsafe characters are `_`, white space around it goes."""
    return strip(F.regexp_replace(col(c), UNSAFE_IN_NAMES, "_"))


def period_end(payload: Column | str) -> Column:
    """Period end of a subscription event in JSON: of the first item, else on top level; epoch seconds as number or text.

    A missing, null or zero value of the item lets the top level speak; broken JSON gives null.
    """
    told = F.try_parse_json(col(payload))

    def epoch(path: str) -> Column:
        return F.nullif(F.try_variant_get(told, path, "bigint"), F.lit(0))

    return F.timestamp_seconds(F.coalesce(epoch("$.items.data[0].current_period_end"), epoch("$.current_period_end")))


def humanise(c: Column | str) -> Column:
    """Readable label from a technical field name; '' when it says no more than the name itself."""
    last = strip(F.regexp_replace(F.substring_index(col(c), ".", -1), r"(?:\[\d+\])+$", ""))
    bare = F.regexp_replace(last, r"_[A-Z]\d?$", "")
    pieces = F.split(F.regexp_replace(bare, r"([a-z0-9])(?=[A-Z])", "$1_"), "_")
    words = F.filter(F.transform(pieces, strip), lambda p: p != "")
    label = F.array_join(F.transform(words, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), " ")
    return F.when(F.lower(label) == F.lower(col(c)), F.lit("")).otherwise(label)


def capacity_class(width: Column | str, height: Column | str) -> Column:
    """Room in a text field: tiny, narrow, multi_line or normal; '' when unknown."""
    w, h = F.coalesce(col(width), F.lit(0)), F.coalesce(col(height), F.lit(0))
    return (
        F.when((w <= 0) | (h <= 0), F.lit(""))
        .when((w <= 30) & (h <= 18), F.lit("tiny"))
        .when((w <= 80) & (h <= 18), F.lit("narrow"))
        .when(h >= 36, F.lit("multi_line"))
        .otherwise(F.lit("normal"))
    )


def natural_key(c: Column | str) -> Column:
    """Sort key: case-insensitive text with every digit run led by its length, so runs of any length sort by value; null as ''."""
    pieces = F.regexp_extract_all(F.lower(blank(c)), F.lit(r"(\d+|\D+)"), 1)

    def led(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^0+(?=.)", "")
        return F.when(piece.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(piece)

    return F.array_join(F.transform(pieces, led), "")


def natural_order(c: Column | str, ascending: bool = True) -> Column:
    """Sort order by natural key, upwards or downwards; nulls count as ''."""
    key = natural_key(c)
    return key.asc() if ascending else key.desc()
