"""Row rules: normalization, confidence, plausibility, estimation, scoping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.hashing import content_id
from turnlake.functions.numbers import saturating_add
from turnlake.functions.text import blank_to_null, comparable_path
from turnlake.schemas import AGREEMENT, PLAUSIBILITY, TURN_COLUMNS, TURN_SCHEMA_VERSION

# The plausibility reasons and the smallest cost told from zero.
ZERO_TOKENS = "zero tokens reported"
ZERO_DURATION = "nonzero tokens with zero duration"
ZERO_COST = "nonzero tokens with zero cost"
EPSILON = 2.220446049250313e-16


def resolved_model() -> Column:
    """The reported model trimmed, NULL when blank."""
    return blank_to_null("model")


def confidence(source: Column, model: Column, estimated: Column) -> Column:
    """Trust tier of one observation."""
    return (
        F.when(model.isNull() | F.coalesce(estimated, F.lit(False)), F.lit("estimated"))
        .when(source == "otel", F.lit("otel"))
        .otherwise(F.lit("jsonl"))
    )


def plausibility() -> Column:
    """``plausible`` or ``low`` with the reasons; rows are annotated, never dropped."""
    total = saturating_add("tokens_input", "tokens_output", "tokens_thinking", "tokens_cache")
    doubts = F.array_compact(
        F.array(
            F.when(F.col("duration_ms") == 0, F.lit(ZERO_DURATION)),
            F.when(F.abs(F.col("cost_usd")) < EPSILON, F.lit(ZERO_COST)),
        )
    )
    reasons = F.when(total == 0, F.array(F.lit(ZERO_TOKENS))).otherwise(doubts)
    low = F.size(reasons) > 0
    return F.struct(
        F.when(low, F.lit("low")).otherwise(F.lit("plausible")).alias("status"),
        F.when(low, reasons).alias("reasons"),
    ).cast(PLAUSIBILITY)


def single_agreement() -> Column:
    return F.struct(F.lit("single").alias("status"), F.lit(None).cast("array<string>").alias("fields")).cast(AGREEMENT)


def normalize(raw: DataFrame, emitted: Column | None = None) -> DataFrame:
    """One turn per single-source observation."""
    model = resolved_model()
    derived = {
        "schema_version": F.lit(TURN_SCHEMA_VERSION),
        "turn_id": F.col("content_id") if "content_id" in raw.columns else content_id(),
        "model": F.coalesce(model, F.lit("")),
        "confidence": confidence(F.col("source"), model, F.col("counts_estimated")),
        "sources": F.array(F.col("source")),
        "attempt_nonce": F.lit(None).cast("string"),
        "agreement": single_agreement(),
        "plausibility": plausibility(),
        "emitted_ms": emitted if emitted is not None else F.col("arrival_ms"),
    }
    return raw.select(*[derived.get(c, F.col(c)).alias(c) for c in TURN_COLUMNS])


def scope_to_workspace(raw: DataFrame, workspace: str | Column, case_insensitive: bool = False) -> DataFrame:
    """Keep rows of the bound workspace; a row without a folder is accepted."""
    bound = F.lit(workspace) if isinstance(workspace, str) else workspace
    same = comparable_path("workspace", case_insensitive) == comparable_path(bound, case_insensitive)
    return raw.where(F.col("workspace").isNull() | same)


def turn_harness(sources: Column) -> Column:
    """Harness of a turn: the first editor source names it."""
    names = {"cursor": "cursor", "codex": "codex_cli", "copilot": "copilot_chat"}
    editor = F.element_at(F.filter(sources, lambda s: s.isin(*names)), 1)
    chosen = F.lit("claude_code_cli")
    for source, harness in names.items():
        chosen = F.when(editor == source, F.lit(harness)).otherwise(chosen)
    return F.when(F.exists(sources, lambda s: s.isin(*names)), chosen).otherwise(F.lit("claude_code_cli"))
