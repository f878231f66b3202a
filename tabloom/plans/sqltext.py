"""Snippets of checking SQL that several queries share."""

from __future__ import annotations

from tabloom.schema import MARKERS_CORE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def s_blank(c: str) -> str:
    return f"coalesce({c}, '')"


def s_filled(c: str, markers=MARKERS_CORE) -> str:
    return f"(lower({s_strip(s_blank(c))}) NOT IN ({', '.join(q(m) for m in markers)}))"


def s_count(conditions) -> str:
    return "(" + " + ".join(f"CAST({c} AS INTEGER)" for c in conditions) + ")"


def s_filled_count(fields, markers=MARKERS_CORE) -> str:
    return s_count(s_filled(f, markers) for f in fields)


def s_squash(c: str) -> str:
    return rf"regexp_replace({c}, '\s+', ' ', 'g')"


def s_any(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def s_sum(e: str) -> str:
    return f"CAST(coalesce(sum({e}), 0) AS BIGINT)"
