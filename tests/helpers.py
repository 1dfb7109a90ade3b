"""Small builders shared by the tests."""

from __future__ import annotations

from turnlake.schemas import RAW_TURN

DEFAULTS = dict(
    capture_id="c1", source="otel", model="claude-sonnet-4-6", harness="claude_code_cli", tokens_input=100, tokens_output=50,
    tokens_thinking=0, tokens_cache=0, prompt_id=None, timestamp_ms=1700000000000, cost_usd=None, duration_ms=None,
    session_id=None, workspace=None, counts_estimated=False, event_id=None, arrival_ms=None, arrival_seq=0,
)


def raw(spark, rows):
    full = []
    for i, r in enumerate(rows):
        row = DEFAULTS | {"arrival_seq": i} | r
        if row["arrival_ms"] is None:
            row["arrival_ms"] = row["timestamp_ms"]
        full.append(tuple(row[f.name] for f in RAW_TURN.fields))
    return spark.createDataFrame(full, RAW_TURN)


def lines(spark, texts, log="log", capture="c1"):
    from turnlake.sources.lines import lines_of

    df = spark.createDataFrame([(capture, log, i, t) for i, t in enumerate(texts)], "c string, l string, p bigint, t string")
    return lines_of(df, "c", "l", "p", "t")
