"""Keep the first arrival of every observation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.hashing import content_id, dedup_id


def with_ids(raw: DataFrame) -> DataFrame:
    """Add ``content_id`` (names the turn) and ``dedup_id`` (collapses copies)."""
    return raw.withColumn("content_id", content_id()).withColumn("dedup_id", dedup_id())


def keep_first(raw: DataFrame) -> DataFrame:
    """One row per ``(capture_id, dedup_id)``: the first to arrive.

    The block lines of one message repeat its usage but only the first carries
    the thinking text, so the first *arrival* is kept, never a maximum.  Spark
    turns the rank filter into a group limit that runs before the shuffle: each
    map task forwards at most one copy, however many copies one key has.
    """
    order = W.partitionBy("capture_id", "dedup_id").orderBy("arrival_ms", "arrival_seq", "content_id")
    ranked = with_ids(raw).withColumn("_copy", F.row_number().over(order))
    return ranked.where(F.col("_copy") == 1).drop("_copy")
