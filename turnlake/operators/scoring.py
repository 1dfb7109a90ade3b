"""Prompt-efficiency scores.

``score = (C * w_c / (P * M)) * (token_scale / max(T, t_floor)) * (speed_scale / (S * w_s))``
with ``T = in * W_in + out * W_out + think * W_think``.  All arithmetic is DOUBLE
in exactly this operation order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.models import canonical_model_id

# What the live and the best-case projection assume.
DEFAULT_CHALLENGE_TYPE = "implementation"
FULL_CLEAR = 100.0
LIVE_SECONDS = 2.0
BEST_CASE_SECONDS = 0.0
PARITY_SLACK = 1.01
COMPOSER_HARNESS = "cursor"


@dataclass(frozen=True)
class ScoringConstants:
    """Fixed values of the formula."""

    w_c: float = 1.0
    w_s: float = 1.0
    p_min: float = 1.0
    s_floor: float = 1.0
    t_floor: float = 100.0
    thinking_step: float = 5000.0
    thinking_per_step: float = 0.05
    thinking_max: float = 1.0
    token_scale: float = 1000.0
    speed_scale: float = 100.0
    effort_min: float = 0.5
    effort_max: float = 3.0
    composer_modifier: float = 0.2
    estimated_floor: float = 1.0


def _d(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def non_negative(x: str | Column) -> Column:
    """The value when finite and positive, else 0 (NaN and infinities too)."""
    v = _d(x)
    good = ~F.isnan(v) & (v > 0) & (v < float("inf"))
    return F.when(F.coalesce(good, F.lit(False)), v).otherwise(F.lit(0.0))


def thinking_overhead(tokens: str | Column, c: ScoringConstants = ScoringConstants()) -> Column:
    steps = F.floor(non_negative(tokens) / F.lit(c.thinking_step)).cast("double")
    return F.least(F.lit(c.thinking_per_step) * steps, F.lit(c.thinking_max))


def economics_lookup(df: DataFrame, economics: DataFrame, model: str = "model_identifier") -> DataFrame:
    """Price row of every model: by its own spelling, then its canonical one,
    else the baseline floor.

    Adds ``economics_id, base_effort_multiplier, is_baseline_floor,
    baseline_floor_fallback``.  Only fully priced rows match.  The dimension
    must hold a floor row; its absence is an error, not a NULL.
    """
    floors = economics.where("is_baseline_floor").limit(1).collect()
    if not floors:
        raise ValueError("the economics table has no baseline floor row")
    floor = floors[0]
    priced = economics.where(F.col("input_cost").isNotNull() & F.col("output_cost").isNotNull())
    priced = priced.groupBy("model_identifier").agg(
        F.first("base_effort_multiplier").alias("_base"), F.first("is_baseline_floor").alias("_floor")
    )
    raw = priced.select(F.col("model_identifier").alias("_r_id"), F.col("_base").alias("_r_base"), F.col("_floor").alias("_r_floor"))
    canon = priced.select(F.col("model_identifier").alias("_n_id"), F.col("_base").alias("_n_base"), F.col("_floor").alias("_n_floor"))
    joined = (
        df.withColumn("_canonical", canonical_model_id(model))
        .join(raw, F.col(model) == F.col("_r_id"), "left")
        .join(canon, F.col("_canonical") == F.col("_n_id"), "left")
    )
    return joined.select(
        *df.columns,
        F.coalesce("_r_id", "_n_id", F.lit(floor["model_identifier"])).alias("economics_id"),
        F.coalesce("_r_base", "_n_base", F.lit(float(floor["base_effort_multiplier"]))).alias("base_effort_multiplier"),
        F.coalesce("_r_floor", "_n_floor", F.lit(True)).alias("is_baseline_floor"),
        F.coalesce("_r_id", "_n_id").isNull().alias("baseline_floor_fallback"),
    )


def token_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of the challenge type (default ``implementation``); a usable
    per-level override in ``token_weight_overrides`` wins.

    ``weights``: ``challenge_type, w_in, w_out, w_think``.  Adds those columns.
    """
    defaults = weights.where(F.col("challenge_type") == DEFAULT_CHALLENGE_TYPE).limit(1).collect()
    if not defaults:
        raise ValueError(f"the weights table has no {DEFAULT_CHALLENGE_TYPE!r} row")
    dim = weights.select(F.col("challenge_type").alias("_type"), *[F.col(w).alias(f"_{w}") for w in ("w_in", "w_out", "w_think")])
    joined = df.join(dim, F.col("challenge_type") == F.col("_type"), "left")
    out = []
    for name, key in (("w_in", "W_in"), ("w_out", "W_out"), ("w_think", "W_think")):
        base = F.coalesce(F.col(f"_{name}"), F.lit(float(defaults[0][name])))
        if "token_weight_overrides" in df.columns:
            own = F.try_element_at("token_weight_overrides", F.lit(key))
            usable = ~F.isnan(own) & (own >= 0) & (own < float("inf"))
            base = F.coalesce(F.when(usable, own), base)
        out.append(base.alias(name))
    return joined.select(*df.columns, *out)


def score(
    df: DataFrame, economics: DataFrame, weights: DataFrame, constants: ScoringConstants = ScoringConstants()
) -> DataFrame:
    """Score rows and every factor of the score.

    ``df``: ``correctness_pct, prompt_count, tokens_input, tokens_output,
    tokens_thinking, execution_time_seconds, challenge_type, model_identifier,
    harness_used, counts_estimated`` and optionally ``token_weight_overrides``.
    """
    c = constants
    known = token_weights(economics_lookup(df, economics), weights)
    base0 = F.col("base_effort_multiplier")
    base = F.when(F.col("counts_estimated"), F.greatest(base0, F.lit(c.estimated_floor))).otherwise(base0)
    composer = F.when(F.col("harness_used") == COMPOSER_HARNESS, F.lit(c.composer_modifier)).otherwise(F.lit(0.0))
    step1 = known.withColumns(
        {
            "effort_base": base,
            "effort_base_floored": base != base0,
            "thinking_overhead": thinking_overhead("tokens_thinking", c),
            "composer_modifier": composer,
            "correctness_value": non_negative("correctness_pct") * F.lit(c.w_c),
            "_prompts": non_negative("prompt_count"),
            "_seconds": non_negative("execution_time_seconds"),
            "weighted_tokens": non_negative("tokens_input") * F.col("w_in")
            + non_negative("tokens_output") * F.col("w_out")
            + non_negative("tokens_thinking") * F.col("w_think"),
        }
    )
    raw_effort = F.col("effort_base") + F.col("thinking_overhead") + F.col("composer_modifier")
    step2 = step1.withColumns(
        {
            "effort_raw": raw_effort,
            "effort": F.least(F.greatest(raw_effort, F.lit(c.effort_min)), F.lit(c.effort_max)),
            "effort_clamped": (raw_effort < c.effort_min) | (raw_effort > c.effort_max),
            "prompts_effective": F.greatest("_prompts", F.lit(c.p_min)),
            "seconds_effective": F.greatest("_seconds", F.lit(c.s_floor)),
            "effective_weighted": F.greatest("weighted_tokens", F.lit(c.t_floor)),
        }
    )
    step3 = step2.withColumns(
        {
            "prompts_floored": F.col("prompts_effective") > F.col("_prompts"),
            "speed_floored": F.col("seconds_effective") > F.col("_seconds"),
            "tokens_floored": F.col("effective_weighted") > F.col("weighted_tokens"),
            "token_value": F.lit(c.token_scale) / F.col("effective_weighted"),
            "speed_value": F.lit(c.speed_scale) / (F.col("seconds_effective") * F.lit(c.w_s)),
        }
    )
    factor = F.col("correctness_value") / (F.col("prompts_effective") * F.col("effort"))
    return step3.withColumn("score", factor * F.col("token_value") * F.col("speed_value")).drop("_prompts", "_seconds")


def project(
    fold: DataFrame,
    economics: DataFrame,
    weights: DataFrame,
    seconds: float = LIVE_SECONDS,
    constants: ScoringConstants = ScoringConstants(),
) -> DataFrame:
    """Projected score of folded attempts: a full clear in ``seconds``.

    The live projection assumes 2 s; the best-case bound passes
    ``BEST_CASE_SECONDS`` (floored to 1 s) and must not be harmonised with it.
    ``challenge_type`` is used when the fold carries it.
    """
    kind = F.nullif("challenge_type", F.lit("")) if "challenge_type" in fold.columns else F.lit(None).cast("string")
    ready = fold.withColumns(
        {
            "challenge_type": F.coalesce(kind, F.lit(DEFAULT_CHALLENGE_TYPE)),
            "correctness_pct": F.lit(FULL_CLEAR),
            "execution_time_seconds": F.lit(seconds),
        }
    )
    return score(ready, economics, weights, constants)


def explicit_vectors(vectors: DataFrame) -> DataFrame:
    """Fill the defaults of caller-supplied score vectors."""
    fills = {
        "prompt_count": 1.0,
        "correctness_pct": 100.0,
        "execution_time_seconds": 1.0,
        "tokens_thinking": 0.0,
    }
    have = set(vectors.columns)
    out = vectors
    for name, value in fills.items():
        out = out.withColumn(name, F.coalesce(_d(name), F.lit(value)) if name in have else F.lit(value))
    return out.withColumn("counts_estimated", F.lit(False))


def score_parity(projected: DataFrame, graded: DataFrame, keys: list[str]) -> DataFrame:
    """Graded against projected: grading above the best case is a parity break."""
    joined = projected.select(*keys, F.col("score").alias("projected")).join(
        graded.select(*keys, F.col("score").alias("graded"), "correctness_pct", "recognized"), keys
    )
    return joined.withColumn("warning", F.col("graded") > F.col("projected") * F.lit(PARITY_SLACK))
