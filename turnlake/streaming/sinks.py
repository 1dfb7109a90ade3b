"""Where streams of turns go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnlake.operators.sessions import attribute


def write_batch(df: DataFrame, path: str, query: str, batch_id: int) -> None:
    """Idempotent append: a repeated micro-batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/query={query}/batch_id={batch_id}")


def attributed_sink(sessions: Callable[[], DataFrame], path: str, query: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: attribute a micro-batch, then store it.

    ``sessions`` is called per batch, so a session started or stopped since the
    last one counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(attribute(batch, sessions()), path, query, batch_id)

    return write


def store_turns(
    turns: DataFrame, sessions: Callable[[], DataFrame], path: str, checkpoint: str, query: str = "turns", available_now: bool = False
) -> StreamingQuery:
    """Start the attributed turn store.

    Offsets and state recover from ``checkpoint`` (a shared folder); together
    with the per-batch overwrite no turn is lost or counted twice.
    """
    writer = turns.writeStream.foreachBatch(attributed_sink(sessions, path, query)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.queryName(query).start()


def live_feed(turns: DataFrame, memory: str = "1 hour") -> DataFrame:
    """Each turn once, for readers that follow the stream.

    As in :func:`turnlake.streaming.ingest.stream_dedup` the watermark follows
    the clock: turns with old times pass, repeats are known for ``memory``.
    """
    timed = turns.withColumn("read_at", F.current_timestamp())
    return timed.withWatermark("read_at", memory).dropDuplicatesWithinWatermark(["turn_id"]).drop("read_at")
