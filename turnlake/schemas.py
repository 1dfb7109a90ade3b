"""Column contracts of the turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the turn contract.
TURN_SCHEMA_VERSION = 1
SOURCES = ["otel", "jsonl", "cursor", "codex", "copilot"]
CORRELATED_SOURCES = ["otel", "jsonl"]
HARNESS_BY_SOURCE = {
    "otel": "claude_code_cli",
    "jsonl": "claude_code_cli",
    "cursor": "cursor",
    "codex": "codex_cli",
    "copilot": "copilot_chat",
}

#: One observation of a turn by one source.
RAW_TURN = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("harness", T.StringType()),
        T.StructField("tokens_input", T.LongType()),
        T.StructField("tokens_output", T.LongType()),
        T.StructField("tokens_thinking", T.LongType()),
        T.StructField("tokens_cache", T.LongType()),
        T.StructField("prompt_id", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("workspace", T.StringType()),
        T.StructField("counts_estimated", T.BooleanType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("arrival_ms", T.LongType()),
        T.StructField("arrival_seq", T.LongType()),
    ]
)

AGREEMENT = "struct<status:string,fields:array<string>>"
PLAUSIBILITY = "struct<status:string,reasons:array<string>>"

#: The columns of a normalized turn, in order.
TURN_COLUMNS = [
    "capture_id",
    "schema_version",
    "turn_id",
    "model",
    "harness",
    "tokens_input",
    "tokens_output",
    "tokens_thinking",
    "tokens_cache",
    "prompt_id",
    "timestamp_ms",
    "confidence",
    "cost_usd",
    "duration_ms",
    "sources",
    "session_id",
    "attempt_nonce",
    "workspace",
    "agreement",
    "plausibility",
    "emitted_ms",
]


def conform_raw(df: DataFrame, **fixed: Column) -> DataFrame:
    """Project ``df`` onto the raw-turn contract; absent columns become NULL."""
    have = set(df.columns)
    out = []
    for f in RAW_TURN.fields:
        if f.name in fixed:
            expr = fixed[f.name]
        elif f.name in have:
            expr = F.col(f.name)
        else:
            expr = F.lit(None)
        out.append(expr.cast(f.dataType).alias(f.name))
    return df.select(*out)


def check_source(source: str | Column) -> Column:
    """Is the source one of the five known ones?"""
    col = F.col(source) if isinstance(source, str) else source
    return col.isin(*SOURCES)
