"""Aggregates over the turns of an attempt.

Everything is folded from one pre-aggregation keyed by the attempt and its few
distinct prompts, models and harnesses; Spark combines it on the map side, so a
dominant attempt shuffles its distinct combinations, not its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.numbers import saturating_add, saturating_sum
from turnlake.operators.normalize import turn_harness
from turnlake.session import cut_lineage

KEY = ["capture_id", "attempt_id"]
TOKENS = ["tokens_input", "tokens_output", "tokens_thinking", "tokens_cache"]
DEFAULT_HARNESS = "claude_code_cli"
MAX_PROMPTS = 4294967295

# Weakest first.
CONFIDENCE_RANK = ["estimated", "jsonl", "otel"]


def session_totals(turns: DataFrame) -> DataFrame:
    """Turn count and the four saturating token sums."""
    return turns.groupBy(*KEY).agg(F.count("*").alias("turns"), *[saturating_sum(t).alias(t) for t in TOKENS])


def _fold(turns: DataFrame) -> DataFrame:
    """Partial totals per attempt, prompt, model and harness."""
    first = F.struct("emitted_ms", "turn_id")
    return (
        turns.withColumn("_harness", turn_harness(F.col("sources")))
        .withColumn("_prompt", F.nullif("prompt_id", F.lit("")))
        .groupBy(*KEY, "_prompt", "model", "_harness")
        .agg(
            F.count("*").alias("n"),
            *[saturating_sum(t).alias(t) for t in TOKENS],
            saturating_sum(saturating_add("tokens_input", "tokens_output")).alias("mass"),
            saturating_sum(
                saturating_add("tokens_input", "tokens_output", "tokens_thinking", F.lit(1).cast("bigint"))
            ).alias("weight"),
            F.min(first).alias("first"),
            F.bool_or(F.col("confidence") == "estimated").alias("estimated"),
        )
    )


def prompt_count(turns: DataFrame) -> DataFrame:
    """Distinct prompt ids plus the turns that carry none."""
    prompt = F.nullif("prompt_id", F.lit(""))
    per = turns.groupBy(*KEY, prompt.alias("_prompt")).agg(F.count("*").alias("n"))
    return per.groupBy(*KEY).agg(_prompts().alias("prompt_count"))


def _prompts() -> Column:
    bare = F.coalesce(F.sum(F.when(F.col("_prompt").isNull(), F.col("n"))), F.lit(0))
    return (F.count_distinct("_prompt") + bare).cast("bigint")


def _leader(fold: DataFrame, by: str, total: str, name: str) -> DataFrame:
    """Largest total per attempt; a tie goes to the one seen first."""
    sums = fold.groupBy(*KEY, by).agg(saturating_sum(total).alias("_t"), F.min("first").alias("_f"))
    rank = F.struct((-F.col("_t")).alias("t"), F.col("_f"))
    return sums.groupBy(*KEY).agg(F.min_by(by, rank).alias(name))


def scored_model(turns: DataFrame) -> DataFrame:
    """The model with the largest input + output; unresolved competes as ''."""
    return _leader(_fold(turns), "model", "mass", "model")


def scored_harness(turns: DataFrame) -> DataFrame:
    """The harness with the largest turn weight."""
    return _leader(_fold(turns), "_harness", "weight", "harness")


def attempt_fold(turns: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Everything a projection needs, one row per attempt.

    With ``attempts`` (the keys) attempts without turns are kept: they count as
    estimated, with no model and the default harness.
    """
    fold = cut_lineage(_fold(turns))  # three readers, far fewer rows than turns
    totals = fold.groupBy(*KEY).agg(
        F.sum("n").cast("bigint").alias("turns"),
        *[saturating_sum(t).alias(t) for t in TOKENS],
        _prompts().alias("prompt_count"),
        F.bool_or("estimated").alias("counts_estimated"),
    )
    out = (
        totals.join(_leader(fold, "model", "mass", "model_identifier"), KEY)
        .join(_leader(fold, "_harness", "weight", "harness_used"), KEY)
    )
    if attempts is None:
        return out
    kept = attempts.select(*KEY).join(out, KEY, "left")
    fills = {
        **{c: F.lit(0).cast("bigint") for c in ["turns", *TOKENS, "prompt_count"]},
        "counts_estimated": F.lit(True),
        "model_identifier": F.lit(""),
        "harness_used": F.lit(DEFAULT_HARNESS),
    }
    return kept.select(*KEY, *[F.coalesce(F.col(c), v).alias(c) for c, v in fills.items()])


def weakest_confidence(turns: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Weakest tier over the turns of an attempt; none at all is estimated."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE_RANK]), F.col("confidence"))
    per = turns.groupBy(*KEY).agg(F.min_by("confidence", rank).alias("confidence"))
    if attempts is None:
        return per
    kept = attempts.select(*KEY).join(per, KEY, "left")
    return kept.withColumn("confidence", F.coalesce("confidence", F.lit("estimated")))


def cross_source_summary(turns: DataFrame) -> DataFrame:
    """Disagreeing turns and the sorted union of the fields they differ in.

    ``collect_set`` holds distinct field lists only - a handful per attempt.
    """
    disagree = F.col("agreement.status") == "disagree"
    return turns.groupBy(*KEY).agg(
        F.count("*").alias("turns"),
        F.count_if(disagree).alias("disagree_turns"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_set(F.when(disagree, F.col("agreement.fields")))))
        ).alias("disagree_fields"),
    )


def benign_drift() -> Column:
    """Token-only disagreement on at most half of the turns is accounting drift."""
    token_only = F.forall("disagree_fields", lambda f: f.isin("tokens_input", "tokens_output"))
    tolerated = (F.size("disagree_fields") > 0) & token_only & (F.col("disagree_turns") * 2 <= F.col("turns"))
    return (F.col("disagree_turns") == 0) | tolerated
