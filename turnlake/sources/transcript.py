"""Session transcripts: one JSON line per content block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import jsonx
from turnlake.functions.hashing import fingerprint
from turnlake.functions.numbers import chars_to_tokens, saturating_add
from turnlake.functions.rows import keep_rows
from turnlake.functions.text import rfc3339_ms, trim_unicode
from turnlake.operators.segments import BLOCK, last_seen, row_index, with_ordered
from turnlake.schemas import conform_raw
from turnlake.session import cut_lineage
from turnlake.sources.lines import read_lines

# Tags of local commands that are not prompts.
COMMAND_TAGS = ["<command-name>", "<local-command"]


#: One typed parse per line; content is text or blocks and usage may be null.
ENTRY = (
    "struct<type:string,uuid:string,requestId:string,sessionId:string,cwd:string,timestamp:string,isSidechain:boolean,"
    "isMeta:boolean,message:struct<id:string,model:string,usage:variant,content:variant>>"
)


def prompt_boundary(entry: Column, line: Column) -> Column:
    """Id of the human prompt a line opens, NULL for every other line.

    Machine-written user lines (sub-agents, meta records, slash commands, pure
    tool results) continue the prompt before them.
    """
    content = entry.getField("message").getField("content")
    typed = trim_unicode(jsonx.text(content, "$"))
    is_command = F.lit(False)
    for tag in COMMAND_TAGS:
        is_command = is_command | typed.startswith(tag)
    own_text = (typed != "") & ~is_command
    blocks = F.exists(
        jsonx.items(content, "$"), lambda b: F.coalesce(jsonx.text(b, "$.type"), F.lit("")) != "tool_result"
    )
    machine = F.coalesce(entry.getField("isSidechain"), F.lit(False)) | F.coalesce(entry.getField("isMeta"), F.lit(False))
    opens = (entry.getField("type") == "user") & ~machine & F.coalesce(own_text, blocks, F.lit(False))
    return F.when(opens, F.coalesce(entry.getField("uuid"), fingerprint(line)))


def transcript_fields(lines: DataFrame, fallback_ms: Column | int = 0, keep: list[str] | None = None) -> DataFrame:
    """Turn and prompt lines as typed columns, without any carried state.

    ``is_turn`` marks assistant turns, ``opens_prompt`` holds the id of a prompt that a
    line opens.  Works on streams too; ``keep`` names the columns passed on, and
    lines that one called ``restarts`` marks are kept whatever they hold.
    """
    entry, message = F.col("_e"), F.col("_e.message")
    fallback = F.lit(fallback_ms) if isinstance(fallback_ms, int) else fallback_ms
    parsed = lines.withColumn("_e", F.from_json("line", ENTRY))
    is_turn = (entry.getField("type") == "assistant") & message.getField("usage").isNotNull()
    thinking = F.aggregate(
        jsonx.items(message.getField("content"), "$"),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc
        + F.coalesce(F.when(jsonx.text(b, "$.type") == "thinking", F.length(jsonx.text(b, "$.thinking"))), F.lit(0)),
    )
    usage = lambda k: jsonx.count(message.getField("usage"), f"$.{k}")
    fields = parsed.select(
        *(keep or ["capture_id", "log_id", BLOCK, "pos"]),
        F.coalesce(is_turn, F.lit(False)).alias("is_turn"),
        prompt_boundary(entry, F.col("line")).alias("opens_prompt"),
        message.getField("model").alias("model"),
        usage("input_tokens").alias("tokens_input"),
        usage("output_tokens").alias("tokens_output"),
        chars_to_tokens(F.coalesce(thinking, F.lit(0).cast("bigint"))).alias("tokens_thinking"),
        saturating_add(usage("cache_read_input_tokens"), usage("cache_creation_input_tokens")).alias("tokens_cache"),
        F.coalesce(rfc3339_ms(entry.getField("timestamp")), fallback).cast("bigint").alias("timestamp_ms"),
        entry.getField("sessionId").alias("session_id"),
        entry.getField("cwd").alias("workspace"),
        F.coalesce(message.getField("id"), entry.getField("requestId")).alias("event_id"),
    )
    restarts = F.col("restarts") if "restarts" in fields.columns else F.lit(False)
    return keep_rows(fields, F.col("is_turn") | F.col("opens_prompt").isNotNull() | restarts)


def parse_transcripts(lines: DataFrame, fallback_ms: Column | int = 0) -> DataFrame:
    """Assistant turns with the prompt that drove them.

    ``lines`` follows :data:`turnlake.sources.lines.LINE_COLUMNS`; the prompt is
    carried along a whole logical log, over file splits and landed chunks.  The
    lines that matter are written once, so the raw ones are parsed once.
    """
    fields = cut_lineage(transcript_fields(lines, fallback_ms))
    placed = with_ordered(
        fields, ["capture_id", "log_id"], ["pos"], {"prompt_id": last_seen(F.col("opens_prompt")), "arrival_seq": row_index()}
    )
    zero = F.lit(0).cast("bigint")
    return conform_raw(
        placed.where(F.col("is_turn")),
        source=F.lit("jsonl"),
        harness=F.lit("claude_code_cli"),
        tokens_input=F.coalesce("tokens_input", zero),
        tokens_output=F.coalesce("tokens_output", zero),
        counts_estimated=F.lit(False),
        arrival_ms=F.col("timestamp_ms"),
    )


def read_transcripts(spark: SparkSession, path: str, fallback_ms: int = 0) -> DataFrame:
    return parse_transcripts(read_lines(spark, path), fallback_ms)
