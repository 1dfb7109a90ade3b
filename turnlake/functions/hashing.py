"""Identity hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the NUL-terminated parts.

    ``concat`` is NULL if any part is, so callers pass non-NULL parts.
    """
    pieces: list[Column] = []
    for p in parts:
        pieces += [p.cast("string"), F.lit("\u0000")]
    return F.substring(F.sha2(F.concat(*pieces).cast("binary"), 256), 1, 16)


def content_id() -> Column:
    """Identity of one exact observation; names the emitted turn."""
    return fingerprint(
        F.col("source"),
        F.coalesce(F.col("model"), F.lit("")),
        F.col("tokens_input"),
        F.col("tokens_output"),
        F.col("tokens_cache"),
        F.col("timestamp_ms"),
        F.coalesce(F.col("prompt_id"), F.lit("")),
    )


def dedup_id() -> Column:
    """De-duplication key: the source's own event id when it has one."""
    return F.when(
        F.coalesce(F.col("event_id"), F.lit("")) != "", fingerprint(F.col("source"), F.col("event_id"))
    ).otherwise(content_id())
