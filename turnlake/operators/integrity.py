"""Integrity signals and the projected trust tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.operators.attempts import KEY, MAX_PROMPTS, benign_drift, cross_source_summary, prompt_count
from turnlake.operators.paths import watched_changes

# Fixed values of the pacing and bulk-paste rules.
BURST_WINDOW_MS = 10_000
BURST_MAX_TURNS = 30
BULK_MIN_BYTES = 2_000
BULK_MAX_PRIOR_EDITS = 1


def pacing(turns: DataFrame) -> DataFrame:
    """Most turns inside any closed 10 s window, and the reason if too many.

    Turns are first counted per millisecond.  Inside a window-sized bucket the
    count in the window at a moment is a running sum: what the bucket before
    brought in, plus arrivals, minus what is older than the window.  A group
    holds at most two buckets of distinct milliseconds whatever the number of
    turns, and no sliding frame is recomputed.
    """
    width = BURST_WINDOW_MS
    per_ms = turns.groupBy(*KEY, "timestamp_ms").agg(F.count("*").alias("n"))
    t, n = F.col("timestamp_ms"), F.col("n")
    begin = t - F.pmod(t, F.lit(width))
    step = lambda bucket, at, d: F.struct(bucket.alias("bucket"), at.alias("at"), d.alias("d"))
    steps = F.array(
        step(begin, t, n),
        step(begin + width, begin + width, n),
        step(begin + width, t + width + 1, -n),
    )
    moves = per_ms.select(*KEY, F.explode(steps).alias("_s")).groupBy(*KEY, "_s.bucket", "_s.at").agg(F.sum("_s.d").alias("d"))
    upto = W.partitionBy(*KEY, "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    worst = moves.withColumn("_in", F.sum("d").over(upto)).groupBy(*KEY).agg(F.max("_in").cast("bigint").alias("worst"))
    reason = F.concat(F.col("worst").cast("string"), F.lit(" turns within 10s — tighter than an interactive session"))
    return worst.withColumn("pacing_reason", F.when(F.col("worst") > BURST_MAX_TURNS, reason))


def listed_changes(changes: DataFrame, levels: DataFrame) -> DataFrame:
    """The changes that a glob of their level covers: only these are provenance.

    The path within the workspace is ``rel_path`` where the changes have it
    (:func:`turnlake.operators.paths.watched_changes` adds it), else ``path``.
    """
    inner = "rel_path" if "rel_path" in changes.columns else "path"
    rules = levels.select(*[F.col(k).alias(f"_l_{k}") for k in KEY], F.col("allow_regexes").alias("_l_rules"))
    joined = changes.join(rules, [F.col(k) == F.col(f"_l_{k}") for k in KEY])
    path = F.replace(F.col(inner), F.lit("\\"), F.lit("/"))
    return joined.where(F.exists("_l_rules", lambda rx: F.regexp_like(path, rx))).select(*changes.columns)


def provenance_changes(changes: DataFrame, roots: DataFrame, ignores: DataFrame, levels: DataFrame, builtin: list[str]) -> DataFrame:
    """The changes that count as provenance, with the path inside the workspace: watched, then listed."""
    listed = listed_changes(watched_changes(changes, roots, ignores, builtin), levels)
    return listed.withColumn("path", F.col("rel_path")).drop("rel_path")


def bulk_pastes(changes: DataFrame) -> DataFrame:
    """Bulk-replacement signals out of file-change events, of listed files.

    ``changes``: ``capture_id, attempt_id, path, kind, size, timestamp_ms, seq``.
    A file may only be flagged on its first or second event, so only the two
    first events of a file are kept - a group limit that runs before the
    shuffle - and a file is flagged once.
    """
    order = W.partitionBy(*KEY, "path").orderBy("seq")
    first_two = changes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= BULK_MAX_PRIOR_EDITS + 1)
    seen = first_two.withColumn("previous_size", F.lag("size", 1, 0).over(order))
    bulk = (
        (F.col("kind") != "removed")
        & (F.col("size") >= BULK_MIN_BYTES)
        & (F.col("size") - F.col("previous_size") >= BULK_MIN_BYTES)
    )
    hits = seen.where(bulk)
    once = hits.groupBy(*KEY, "path").agg(
        F.min_by(F.struct("size", "previous_size", (F.col("_n") - 1).alias("prior_edits"), "timestamp_ms"), "_n").alias("s")
    )
    return once.select(
        *KEY,
        "path",
        F.lit("bulk_replace").alias("kind"),
        "s.size",
        F.col("s.previous_size").cast("bigint").alias("previous_size"),
        F.col("s.prior_edits").cast("bigint").alias("prior_edits"),
        "s.timestamp_ms",
    )


def file_provenance(changes: DataFrame) -> DataFrame:
    """Edits, last size, largest size and the flag of every file."""
    summary = changes.groupBy(*KEY, "path").agg(
        F.count("*").alias("edits"),
        F.max_by("size", "seq").alias("last_size"),
        F.max("size").alias("max_size"),
    )
    flagged = bulk_pastes(changes).select(*KEY, "path", F.lit(True).alias("_hit"))
    out = summary.join(flagged, [*KEY, "path"], "left")
    return out.withColumn("flagged", F.coalesce("_hit", F.lit(False))).drop("_hit")


def capture_integrity(turns: DataFrame) -> DataFrame:
    """Counts of doubtful turns and whether they add up to a fingerprint."""
    doubts = turns.groupBy(*KEY).agg(
        F.count_if(F.col("plausibility.status") == "low").alias("low_plausibility"),
        F.count_if(F.col("confidence") == "estimated").alias("estimated"),
    )
    joined = cross_source_summary(turns).join(doubts, KEY).join(pacing(turns), KEY)
    flagged = ~benign_drift() | (F.col("low_plausibility") > 0) | F.col("pacing_reason").isNotNull()
    return joined.withColumn("benign", benign_drift()).withColumn("flagged", flagged)


def trust_tier(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Projected tier of every session and the first gate that fails."""
    sources = F.col("sources")
    evidence = turns.groupBy(*KEY).agg(
        F.bool_or(F.col("confidence") == "estimated").alias("_estimated"),
        F.bool_or(F.exists(sources, lambda s: ~s.isin("otel", "jsonl"))).alias("_adapter"),
        F.bool_or(F.array_contains(sources, "otel")).alias("_otel"),
    )
    cross = cross_source_summary(turns).withColumn("_benign", benign_drift())
    known = sessions.withColumnRenamed("session_id", "attempt_id").join(evidence.join(cross, KEY), KEY, "left")
    gate = (
        F.when(F.col("nonce_origin") == "local", "local_nonce")
        .when(~F.col("baseline_attested"), "baseline_unattested")
        .when(F.col("turns").isNull(), "no_turns")
        .when(F.col("_estimated"), "estimated_turns")
        .when(F.col("_adapter"), "adapter_source")
        .when(~F.col("_otel"), "no_otel")
        .when(~F.col("_benign"), "cross_source_disagreement")
        .otherwise("verified")
    )
    return known.select(
        *KEY,
        F.when(gate == "verified", "verified").otherwise("unverified").alias("tier"),
        gate.alias("reason"),
        F.coalesce("turns", F.lit(0)).cast("bigint").alias("turns"),
        F.coalesce("disagree_turns", F.lit(0)).cast("bigint").alias("disagree_turns"),
    )


def capture_summary(sessions: DataFrame, turns: DataFrame, signals: DataFrame, signed_at_ms: int) -> DataFrame:
    """The provenance summary bound into the terminal chain message."""
    prompts = prompt_count(turns)
    pastes = signals.where(F.col("kind") == "bulk_replace").groupBy(*KEY).agg(F.count("*").alias("bulk_paste_events"))
    base = sessions.withColumnRenamed("session_id", "attempt_id")
    joined = base.join(prompts, KEY, "left").join(pastes, KEY, "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *KEY,
        "attempt_nonce",
        "baseline_attested",
        F.col("code_reset_count").cast("bigint").alias("baseline_reset_count"),
        F.coalesce("bulk_paste_events", zero).alias("bulk_paste_events"),
        F.lit(False).alias("ignore_changed"),
        "nonce_origin",
        zero.alias("pause_count"),
        zero.alias("paused_ms_total"),
        F.least(F.coalesce("prompt_count", zero), F.lit(MAX_PROMPTS)).cast("bigint").alias("prompt_count"),
        F.lit(signed_at_ms).cast("bigint").alias("signed_at_ms"),
        "started_at_ms",
        zero.alias("untracked_edit_windows"),
    )


def source_health(expected: DataFrame, found: DataFrame) -> DataFrame:
    """State of every expected source.

    ``expected``: ``capture_id, source, store_found`` (is the store there at
    all); ``found``: one row per container with ``recognized`` and ``turns``.
    """
    seen = found.groupBy("capture_id", "source").agg(
        F.count("*").alias("files"),
        F.count_if("recognized").alias("recognized_files"),
        F.sum("turns").cast("bigint").alias("turns"),
    )
    joined = expected.join(seen, ["capture_id", "source"], "left")
    zero = F.lit(0).cast("bigint")
    files, good = F.coalesce("files", zero), F.coalesce("recognized_files", zero)
    state = (
        F.when(~F.col("store_found"), "notfound")
        .when((files > 0) & (good == 0), "unsupported")
        .otherwise("detected")
    )
    return joined.select(
        "capture_id",
        "source",
        state.alias("state"),
        files.alias("files"),
        good.alias("recognized_files"),
        F.coalesce("turns", zero).alias("turns"),
    )
