"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged. The template is
`<turn ROLE>TEXT</turn>` and a line end; merged texts stand side by side with `<next>` between them. Inside roles and texts a backslash,
`<` and `>` are written as backslash and a digit, so every `<` of the output begins a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.order_minhash import _run_starts, let

NEXT, CLOSE = "<next>", "</turn>\n"
LEARNT = "assistant"
#: Turns of a chunk: a long conversation is merged chunk by chunk before its chunks meet.
CHUNK = 256


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, code in (("\\", "\\0"), ("<", "\\1"), (">", "\\2")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for sign, code in ((">", "\\2"), ("<", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _merge(turns: Column) -> Column:
    """Adjacent (role, texts) of one role as one, in time that grows with the turns."""

    def join(starts: Column) -> Column:
        def one(begin: Column, j: Column) -> Column:
            count = F.coalesce(F.get(starts, j + 1), F.size(turns)) - begin
            texts = F.flatten(F.transform(F.slice(turns, begin + 1, count), lambda t: t["texts"]))
            return F.struct(F.get(turns, begin)["role"].alias("role"), texts.alias("texts"))

        return F.transform(starts, one)

    return let(_run_starts(turns, lambda x, y: x["role"] == y["role"]), join)


def merged_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turns): turns by number, ties by role and text, adjacent ones of a role merged."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.floor(F.col(turn) / CHUNK).alias("chunk"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("own"))
    plain = F.transform("own", lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    merged = chunks.select("conv", "chunk", let(plain, _merge).alias("own"))
    whole = merged.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "own"))).alias("chunks"))
    return whole.select("conv", let(F.flatten(F.transform("chunks", lambda c: c["own"])), _merge).alias("turns"))


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: str = LEARNT
) -> DataFrame:
    """(conv_id, formatted, segments) of every conversation; segments are the parts of `formatted` in order, with their loss mask.

    Only texts of the role `learnt` are under the mask, not their control strings. Null texts and roles are empty, null turns
    come first, rows without conv_id are one conversation, turns of one number are ordered by role and text, and repeated
    rows are turns of their own. Other columns don't matter. An empty table gives an empty table.
    """
    told = merged_turns(turns, conv_id, turn, role, text)

    def parts(t: Column) -> Column:
        mask = t["role"] == learnt
        plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
        texts = F.transform(t["texts"], lambda s, i: F.array(
            F.struct(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(s).alias("text"), mask.alias("loss")),
        ))
        return F.concat(F.array(plain(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")))), F.flatten(texts), F.array(plain(F.lit(CLOSE))))

    segments = told.select(F.col("conv").alias("conv_id"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """(role, text) of every original turn of a formatted conversation."""
    closed = F.split(formatted, F.lit(CLOSE), -1)
    pieces = F.slice(closed, F.lit(1), F.size(closed) - 1)

    def one(piece: Column) -> Column:
        role = unescape(F.regexp_extract(piece, "^<turn ([^>]*)>", 1))
        body = F.regexp_extract(piece, "(?s)^<turn [^>]*>(.*)$", 1)
        return F.transform(F.split(body, F.lit(NEXT), -1), lambda s: F.struct(role.alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(pieces, one))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
