"""Log bytes to attributed turns and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.attempts import session_totals
from turnlake.operators.correlate import correlate
from turnlake.operators.sessions import attribute, clip_overlaps


def expected_spans(sessions: DataFrame) -> DataFrame:
    """When an OTLP counterpart can arrive: while a session with a token is open.

    Spans may touch or overlap; the correlator merges them.
    """
    return sessions.where(F.col("otlp_token").isNotNull()).select(
        "capture_id", F.col("started_at_ms").alias("open_ms"), F.col("stopped_at_ms").alias("close_ms")
    )


def capture(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    """De-duplicate, correlate, attribute.

    Correlation comes first: a pair keeps the OTLP time, which may fall outside
    the session although its twin's time does not.  A session ends where the
    next one of its capture starts, so a turn belongs to one session at most.
    """
    return attribute(correlate(raw, expected_spans(sessions)), clip_overlaps(sessions))


def capture_totals(raw: DataFrame, sessions: DataFrame) -> DataFrame:
    return session_totals(capture(raw, sessions))


def write_turns(turns: DataFrame, path: str) -> None:
    """Append turns, partitioned by the UTC day of the turn."""
    day = F.to_date(F.timestamp_millis("timestamp_ms"))
    turns.withColumn("capture_date", day).write.mode("append").partitionBy("capture_date").parquet(path)
