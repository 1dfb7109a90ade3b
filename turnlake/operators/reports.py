"""Read-side reports: token mix, burn trend, scoreboard, idleness, recents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.numbers import MAX_COUNT, saturating_add
from turnlake.operators.attempts import KEY, TOKENS
from turnlake.operators.normalize import turn_harness
from turnlake.operators.segments import first_seen, position_blocks, running_max, running_sum, with_ordered
from turnlake.session import cut_lineage

# Fixed values of the reports.
TREND_TURNS = 24
TREND_LEVELS = 7
RECENT_EVENTS = 50
IDLE_MS = 15 * 60 * 1000
MIX_PARTS = ["tokens_input", "tokens_output", "tokens_thinking"]


def token_mix(totals: DataFrame, width: int = 24) -> DataFrame:
    """Largest-remainder split of ``width`` cells over in / out / think.

    Leftover cells go to the largest fractions, ties to the earlier part.
    """
    parts = [F.greatest(F.col(p).cast("double"), F.lit(0.0)) for p in MIX_PARTS]
    total = parts[0] + parts[1] + parts[2]
    out = totals.withColumn("_quotas", F.array(*[p / F.nullif(total, F.lit(0.0)) * F.lit(float(width)) for p in parts]))
    out = out.withColumn("_floors", F.transform("_quotas", lambda q: F.floor(q).cast("bigint")))
    left = F.lit(width) - F.aggregate("_floors", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = out.withColumn("_left", left)

    def extra(i: int):
        mine = F.col("_quotas")[i] - F.col("_floors")[i]
        ahead = F.lit(0)
        for j in range(len(MIX_PARTS)):
            if j != i:
                other = F.col("_quotas")[j] - F.col("_floors")[j]
                ahead = ahead + F.when((other > mine) | ((other == mine) & F.lit(j < i)), 1).otherwise(0)
        return F.when(ahead < F.col("_left"), 1).otherwise(0)

    cells = [
        F.coalesce(F.col("_floors")[i] + extra(i), F.lit(0)).cast("bigint").alias(f"cells_{p.removeprefix('tokens_')}")
        for i, p in enumerate(MIX_PARTS)
    ]
    return out.select(*totals.columns, *cells)


def burn_trend(turns: DataFrame, points: int = TREND_TURNS) -> DataFrame:
    """The last turns of each attempt with their burn on an 8-step scale.

    The rank filter becomes a group limit before the shuffle, so at most
    ``points`` turns per attempt and map task are moved.
    """
    newest = W.partitionBy(*KEY).orderBy(F.desc("emitted_ms"), F.desc("turn_id"))
    burn = turns.select(
        *KEY, "emitted_ms", "turn_id", saturating_add(*MIX_PARTS).alias("burn")
    )
    last = burn.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= points)
    peak = F.max("burn").over(W.partitionBy(*KEY))
    level = F.when(peak == 0, F.lit(0.0)).otherwise(F.round(F.col("burn") / peak * F.lit(float(TREND_LEVELS))))
    return last.withColumn("level", level.cast("bigint")).withColumn("back", F.col("back").cast("bigint"))


def running_scoreboard(turns: DataFrame) -> DataFrame:
    """What an attempt stands at after every turn.

    Cumulative prompts and tokens, whether any turn so far was estimated, and
    the model and harness that lead so far (most tokens, most weight; ties go
    to the one seen first).  ``turns`` has ``turn_index``; a turn id counts
    once, at its first index.

    A total only grows at its own turns, so the leader is the one that reached
    the highest total so far: a running sum within each model, then a running
    maximum over the attempt.  Neither needs a table of all models at a turn.
    """
    values = [*TOKENS, "model", "confidence", turn_harness(F.col("sources")).alias("harness")]
    once = turns.groupBy(*KEY, "turn_id").agg(
        F.min_by(F.struct("turn_index", "prompt_id", *values), "turn_index").alias("_first")
    ).select(*KEY, "turn_id", "_first.*")
    prompt = F.nullif("prompt_id", F.lit(""))
    # A prompt counts at its first turn: a small aggregate joined back, instead
    # of a window over what may be one huge prompt.
    opened = once.where(prompt.isNotNull()).groupBy(*KEY, "prompt_id").agg(F.min("turn_index").alias("_opens"))
    marked = once.join(opened, [*KEY, "prompt_id"], "left").withColumns(
        {
            "_new": F.when(F.col("_opens").isNull() | (F.col("_opens") == F.col("turn_index")), 1).otherwise(0).cast("bigint"),
            "_estimated": F.when(F.col("confidence") == "estimated", 1).otherwise(0),
            "model": F.coalesce("model", F.lit("")),
        }
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    clamp = lambda c: F.least(F.col(c), F.lit(MAX_COUNT)).cast("bigint")
    mass = wide("tokens_input") + wide("tokens_output")
    # Model and harness side by side: a row of a turn for each, the model's last.
    sides = [F.struct(F.lit(k).alias("side"), F.col(n).alias("value"), w.alias("weight")) for k, n, w in ((0, "harness", mass + wide("tokens_thinking") + F.lit(1)), (1, "model", mass))]
    both = cut_lineage(marked.select("*", F.explode(F.array(*sides)).alias("_s")).select(*KEY, "turn_index", "turn_id", "_new", "_estimated", *TOKENS, "_s.*"))
    ranked = with_ordered(
        position_blocks(both, "turn_index"), [*KEY, "side", "value"], ["turn_index"],
        {"_total": running_sum(F.least("weight", F.lit(MAX_COUNT).cast("decimal(38,0)"))), "_since": first_seen(F.col("turn_index"))}, keep_block=True,
    )
    rank = F.struct(clamp("_total").alias("t"), (-F.col("_since")).alias("s"), F.col("value").alias("v"))
    ranked = cut_lineage(ranked.withColumn("_rank", rank).drop("_total", "_since", "weight", "value"))
    totals = {"prompts": "_new", **{f"total_{t.removeprefix('tokens_')}": t for t in TOKENS}}
    is_last = F.col("side") == 1
    ordered = {n: running_sum(F.when(is_last, wide(c))) for n, c in totals.items()}
    ordered |= {"_estimated_yet": running_max(F.col("_estimated")), "_model": running_max(F.when(is_last, F.col("_rank"))), "_harness": running_max(F.when(~is_last, F.col("_rank")))}
    out = with_ordered(ranked, KEY, ["turn_index", "side"], ordered).where(is_last)
    return out.select(
        *KEY,
        "turn_index",
        "turn_id",
        *[clamp(c).alias(c) for c in totals],
        (F.col("_estimated_yet") == 1).alias("estimated"),
        F.col("_model.v").alias("leading_model"),
        F.col("_harness.v").alias("leading_harness"),
    )


def idle_gaps(activity: DataFrame, timeout_ms: int = IDLE_MS, now_ms: int | None = None) -> DataFrame:
    """Silences of at least ``timeout_ms`` per capture.

    Activity is reduced to one row per timeout-sized bucket (two moments inside
    a bucket are never that far apart), so the ordered step costs the time span
    of a capture, not its events.  ``now_ms`` closes the last silence.
    """
    buckets = activity.groupBy("capture_id", F.expr(f"at_ms div {timeout_ms}").alias("_b")).agg(
        F.min("at_ms").alias("_first"), F.max("at_ms").alias("_last")
    )
    line = W.partitionBy("capture_id").orderBy("_b")
    ends = F.coalesce(F.lead("_first").over(line), F.lit(now_ms).cast("bigint"))
    gaps = buckets.withColumn("idle_to_ms", ends).withColumn("idle_from_ms", F.col("_last"))
    gaps = gaps.withColumn("idle_ms", F.col("idle_to_ms") - F.col("idle_from_ms"))
    return gaps.where(F.col("idle_ms") >= timeout_ms).select("capture_id", "idle_from_ms", "idle_to_ms", "idle_ms")


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """The newest warnings and errors of each capture, a group-limited top-n."""
    newest = W.partitionBy("capture_id").orderBy(F.desc("timestamp_ms"), F.desc("seq"))
    kept = events.where(F.col("level").isin("warn", "error"))
    return kept.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).drop("back")
