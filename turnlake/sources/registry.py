"""Sources by name: each turns its landed files into raw turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnlake.schemas import RAW_TURN
from turnlake.sources.chat import read_chat_sessions
from turnlake.sources.kv import parse_kv_turns
from turnlake.sources.otlp import read_otlp_logs
from turnlake.sources.rollout import read_rollouts
from turnlake.sources.transcript import read_transcripts

Reader = Callable[[SparkSession, str], DataFrame]

_READERS: dict[str, Reader] = {
    "otel": lambda spark, path: read_otlp_logs(spark, path)[0],
    "jsonl": read_transcripts,
    "codex": read_rollouts,
    "copilot": lambda spark, path: read_chat_sessions(spark, documents=path),
    "cursor": lambda spark, path: parse_kv_turns(spark.read.parquet(path)),
}


def register(name: str, reader: Reader) -> None:
    """Add or replace a source; it must return the raw-turn columns."""
    _READERS[name] = reader


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One bag union of every named source."""
    out = None
    for name, path in paths.items():
        part = _READERS[name](spark, path).select(*RAW_TURN.fieldNames())
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source was named")
    return out


def names() -> list[str]:
    return sorted(_READERS)
