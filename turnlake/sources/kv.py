"""Editor key-value stores, exported as ``(capture_id, key, value)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import jsonx
from turnlake.functions.models import resolve_model
from turnlake.functions.numbers import chars_to_tokens
from turnlake.functions.text import comparable_path, rfc3339_ms
from turnlake.operators.paths import EMPTY_WINDOW
from turnlake.operators.segments import last_seen, range_blocks, row_index, with_ordered
from turnlake.schemas import conform_raw

# Key prefixes, bubble types and where bubbles keep their text.
BUBBLE_PREFIX = "bubbleId:"
COMPOSER_PREFIX = "composerData:"
USER, ASSISTANT = 1, 2
CONTENT_KEYS = ["value", "text", "content", "code"]
TIME_KEYS = ["createdAt", "cTime", "timestamp"]


def composers(kv: DataFrame) -> DataFrame:
    """One row per conversation: root, storage, model pick, header list."""
    doc = F.try_parse_json(F.col("value").cast("string"))
    rows = kv.where(F.col("key").startswith(COMPOSER_PREFIX)).withColumn("_doc", doc)
    d = F.col("_doc")
    pick = resolve_model(jsonx.text(d, "$.modelConfig.selectedModels[0].modelId"))
    storage = jsonx.text(d, "$.workspaceIdentifier.id")
    return rows.select(
        "capture_id",
        F.substr("key", F.lit(len(COMPOSER_PREFIX) + 1)).alias("composer_id"),
        comparable_path(jsonx.text(d, "$.workspaceIdentifier.uri.fsPath")).alias("root_path"),
        F.when(storage != EMPTY_WINDOW, storage).alias("storage_id"),
        F.coalesce(pick, resolve_model(jsonx.text(d, "$.modelConfig.modelName"))).alias("composer_model"),
        jsonx.items(d, "$.fullConversationHeadersOnly").alias("headers"),
    ).where(F.col("composer_id") != "")


def stub_composers(stubs: DataFrame) -> DataFrame:
    """Conversation ids a workspace's own store names; ``stubs`` has ``value``."""
    d = F.try_parse_json(F.col("value").cast("string"))
    listed = F.coalesce(
        F.transform(jsonx.items(d, "$.allComposers"), lambda c: jsonx.text(c, "$.composerId")), F.array().cast("array<string>")
    )
    either = lambda c: F.coalesce(jsonx.text(c, "$"), jsonx.text(c, "$.composerId"))
    for key in ("selectedComposerIds", "lastFocusedComposerIds"):
        more = F.coalesce(F.transform(jsonx.items(d, f"$.{key}"), either), F.array().cast("array<string>"))
        listed = F.concat(listed, more)
    keep = [c for c in stubs.columns if c != "value"]
    return stubs.select(*keep, F.explode(F.array_distinct(F.array_compact(listed))).alias("composer_id"))


def _when(d: Column, observed: Column) -> Column:
    options = []
    for key in TIME_KEYS:
        options += [jsonx.integer(d, f"$.{key}"), rfc3339_ms(jsonx.text(d, f"$.{key}"))]
    return F.coalesce(*options, observed.cast("bigint"))


def bubbles(kv: DataFrame, observed_ms: Column | int = 0) -> DataFrame:
    """Parsed bubbles with what the turn and the ordering need."""
    observed = F.lit(observed_ms) if isinstance(observed_ms, int) else observed_ms
    rows = kv.where(F.col("key").startswith(BUBBLE_PREFIX)).withColumn(
        "_doc", F.try_parse_json(F.col("value").cast("string"))
    )
    d = F.col("_doc")
    kind = jsonx.integer(d, "$.type")
    signal = jsonx.present(d, "$.modelInfo") | jsonx.present(d, "$.tokenCount.outputTokens")
    # One walk expression for all six places text can sit in.
    places = ["$.text", "$.codeBlocks", "$.toolFormerData.rawArgs", "$.toolFormerData.result", "$.thinking", "$.allThinkingBlocks"]
    rows = rows.withColumn(
        "_chars",
        F.transform(F.array(*[jsonx.field(d, p) for p in places]), lambda v: jsonx.content_chars(v, CONTENT_KEYS)),
    )
    chars = lambda i: F.col("_chars")[i]
    named = jsonx.text(d, "$.modelInfo.modelName")
    zero = F.lit(0).cast("bigint")
    # A value that is not JSON has neither role and drops out with the others.
    return rows.select(
        "capture_id",
        F.element_at(F.split("key", ":"), 2).alias("composer_id"),
        F.substring_index("key", ":", -1).alias("bubble_id"),
        _when(d, observed).alias("timestamp_ms"),
        F.coalesce(kind == USER, F.lit(False)).alias("is_user"),
        F.when(kind.isNull(), signal).otherwise(kind == ASSISTANT).alias("is_assistant"),
        F.when(named.isNotNull(), F.struct(resolve_model(named).alias("id"))).alias("named_model"),
        F.coalesce(jsonx.count(d, "$.tokenCount.inputTokens"), zero).alias("reported_in"),
        F.coalesce(jsonx.count(d, "$.tokenCount.outputTokens"), zero).alias("reported_out"),
        (chars(0) + chars(1) + chars(2)).alias("out_chars"),
        chars(3).alias("in_chars"),
        (chars(4) + chars(5)).alias("think_chars"),
    )


def conversation_order(found: DataFrame, meta: DataFrame) -> DataFrame:
    """Prompt and model carried along each conversation.

    Bubbles follow the conversation's header list; unlisted ones come after it
    by time and id.  A user bubble opens a prompt, and its model pick replaces
    the carried one even when it cannot be resolved.
    """
    keys = ["capture_id", "composer_id"]
    listed = (
        meta.select(*keys, F.posexplode("headers").alias("_pos", "_h"))
        .select(*keys, jsonx.text(F.col("_h"), "$.bubbleId").alias("bubble_id"), "_pos")
        .where(F.col("bubble_id").isNotNull())
        .groupBy(*keys, "bubble_id")
        .agg(F.max("_pos").cast("bigint").alias("_pos"))
    )
    placed = found.join(listed, [*keys, "bubble_id"], "left").withColumns(
        {
            "_unlisted": F.col("_pos").isNull().cast("int"),
            "_first": F.coalesce("_pos", "timestamp_ms"),
        }
    )
    order = ["_unlisted", "_first", "bubble_id"]
    carried = with_ordered(
        range_blocks(placed, keys, order),
        keys,
        order,
        {
            "current_user": last_seen(F.when(F.col("is_user"), F.col("bubble_id"))),
            "_picked": last_seen(F.when(F.col("is_user"), F.col("named_model"))),
            "arrival_seq": row_index(),
        },
    )
    models = meta.select(*keys, "composer_model")
    return carried.join(models, keys, "left").withColumn("fallback_model", F.coalesce("_picked.id", "composer_model"))


def parse_kv_turns(kv: DataFrame, observed_ms: Column | int = 0, members: DataFrame | None = None) -> DataFrame:
    """Turns of the conversations in ``members`` (all, when not given).

    Zero reported counts are estimated from the bubble's text; a bubble with
    nothing reported and nothing to estimate from is not a turn.
    """
    meta = composers(kv)
    found = bubbles(kv, observed_ms)
    if members is not None:
        ids = members.select("capture_id", "composer_id").distinct()
        found = found.join(ids, ["capture_id", "composer_id"], "left_semi")
    turns = conversation_order(found, meta).where(~F.col("is_user") & F.coalesce("is_assistant", F.lit(False)))
    silent = (F.col("reported_in") == 0) & (F.col("reported_out") == 0)
    nothing = silent & (F.col("out_chars") == 0) & (F.col("in_chars") == 0) & (F.col("think_chars") == 0)
    turns = turns.where(~nothing)
    pick = lambda rep, chars: F.when(silent, chars_to_tokens(chars)).otherwise(F.col(rep))
    named = lambda c: F.concat("composer_id", F.lit(":"), F.col(c))
    return conform_raw(
        turns,
        source=F.lit("cursor"),
        harness=F.lit("cursor"),
        model=F.coalesce("named_model.id", "fallback_model"),
        tokens_input=pick("reported_in", "in_chars"),
        tokens_output=pick("reported_out", "out_chars"),
        tokens_thinking=F.when(silent, chars_to_tokens("think_chars")).otherwise(F.lit(0)),
        tokens_cache=F.lit(0),
        prompt_id=F.coalesce(named("current_user"), named("bubble_id")),
        session_id=F.col("composer_id"),
        counts_estimated=silent,
        event_id=named("bubble_id"),
        arrival_ms=F.col("timestamp_ms"),
    )
