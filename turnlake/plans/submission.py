"""Workspace and turns to a trust verdict and a submission record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.attempts import KEY, cross_source_summary, weakest_confidence
from turnlake.operators.content import allowlisted, content_hashes, validate_bundles
from turnlake.operators.integrity import bulk_pastes, capture_summary, listed_changes, trust_tier
from turnlake.operators.ledger import final_messages, turn_messages
from turnlake.operators.redact import redact_bundles


def submission_records(
    sessions: DataFrame,
    turns: DataFrame,
    changes: DataFrame,
    files: DataFrame,
    levels: DataFrame,
    meta_dir: str,
    signed_at_ms: int,
) -> tuple[DataFrame, DataFrame]:
    """One record per session, and the canonical messages of its turns.

    ``files`` and ``levels`` are keyed like turns (``capture_id, attempt_id``);
    ``turns`` has ``turn_index``.  A session whose bundle is invalid or holds an
    uncleanable secret gets a verdict but no code hash and no terminal message.
    """
    verdicts = validate_bundles(files, levels, KEY)
    clean, redaction = redact_bundles(allowlisted(files, levels, KEY), KEY)
    hashes = content_hashes(clean, KEY, meta_dir).withColumnRenamed("content_hash", "final_code_hash")
    summary = capture_summary(sessions, turns, bulk_pastes(listed_changes(changes, levels)), signed_at_ms)
    cross = cross_source_summary(turns)
    zero = F.lit(0).cast("bigint")
    ready = (
        summary.join(cross, KEY, "left")
        .join(hashes.select(*KEY, "final_code_hash"), KEY, "left")
        .withColumns(
            {
                "turns": F.coalesce("turns", zero),
                "disagree_turns": F.coalesce("disagree_turns", zero),
                "disagree_fields": F.coalesce("disagree_fields", F.array().cast("array<string>")),
            }
        )
    )
    finals = final_messages(ready.where(F.col("final_code_hash").isNotNull())).withColumnRenamed("message", "final_message")
    attempts = sessions.select("capture_id", F.col("session_id").alias("attempt_id"), "slug")
    records = (
        attempts.join(weakest_confidence(turns, attempts), KEY)
        .join(trust_tier(sessions, turns).select(*KEY, "tier", "reason"), KEY)
        .join(verdicts.select(*KEY, F.col("verdict").alias("bundle")), KEY, "left")
        .join(redaction.select(*KEY, F.col("categories").alias("redacted"), "rejected"), KEY, "left")
        .join(finals, KEY, "left")
    )
    return records, turn_messages(turns)
