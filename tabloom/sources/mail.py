"""Raw mail messages: headers, body text and attachments as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.sources.readers import html_to_text

PARTS = (
    "mail_id string, message_id string, sender string, subject string, recipients string, body_plain string, "
    "body_html string, part_ord int, filename string, size_bytes bigint, content binary"
)
MAX_DEPTH = 3


def explode_mail(raw: DataFrame) -> DataFrame:
    """One row per attachment of each message (mail_id, content): nested messages are replaced by their own attachments.

    A message without attachments gives one row without file. Only the MIME decoding runs in Python, per Arrow batch;
    the body clean-up stays native.
    """
    depth_limit = MAX_DEPTH

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        from email import policy

        def own_parts(message):
            """Parts of a message, not descending into attached messages."""
            if message.get_content_type() == "message/rfc822":
                return
            if message.is_multipart():
                for part in message.iter_parts():
                    yield from own_parts(part)
            else:
                yield message

        def attached(message, depth: int) -> list[tuple[str, bytes]]:
            found: list[tuple[str, bytes]] = []
            queue = list(message.iter_parts()) if message.is_multipart() else [message]
            for part in queue:
                kind, name = part.get_content_type(), part.get_filename()
                if kind == "message/rfc822":
                    inner = part.get_payload()
                    inner = inner[0] if isinstance(inner, list) and inner else None
                    deeper = attached(inner, depth + 1) if inner is not None and depth < depth_limit else []
                    found += deeper or [(name or "message.eml", inner.as_bytes() if inner is not None else b"")]
                elif part.is_multipart():
                    found += attached(part, depth)
                elif part.get_content_disposition() == "attachment" and (data := part.get_payload(decode=True)):
                    name = name or "unnamed"
                    deeper = []
                    if name.lower().endswith((".eml", ".emlx")) and depth < depth_limit:
                        deeper = attached(email.message_from_bytes(data, policy=policy.default), depth + 1)
                    found += deeper or [(name, data)]
            return found

        def body(message, kind: str) -> str:
            for part in own_parts(message):
                if part.get_content_type() == kind and not part.get_filename():
                    return (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            return ""

        for batch in batches:
            rows = []
            for mail_id, content in zip(batch["mail_id"], batch["content"]):
                message = email.message_from_bytes(bytes(content), policy=policy.default)
                head = (
                    mail_id, str(message.get("Message-ID", "")), str(message.get("From", "")), str(message.get("Subject", "")),
                    str(message.get("To", "")), body(message, "text/plain"), body(message, "text/html"),
                )
                for i, (name, data) in enumerate(attached(message, 0) or [(None, None)]):
                    rows.append((*head, i, name, None if data is None else len(data), data))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    parts = raw.select("mail_id", "content").mapInPandas(decode, PARTS)
    plain = X.strip(X.blank("body_plain"))
    text = F.when(plain != "", plain).otherwise(html_to_text(X.blank("body_html")))
    return parts.select(
        "mail_id", "message_id", F.lower(F.coalesce(F.nullif(F.regexp_extract("sender", "<([^>]*)>", 1), F.lit("")), X.strip("sender"))).alias("sender"),
        "subject", "recipients", text.alias("body"), "part_ord", "filename", X.file_kind("filename").alias("content_type"),
        "size_bytes", "content",
    )


def read_mail(spark, path: str) -> DataFrame:
    """Message files of a folder as explode_mail input."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml*").load(path)
    return files.select(F.col("path").alias("mail_id"), "content")
