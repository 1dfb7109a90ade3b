"""Capture sessions: windows, attribution, lifecycle, gating, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import comparable_path
from turnlake.operators.intervals import join_disjoint
from turnlake.operators.segments import lag_value, lead_value, range_blocks, running_sum, with_ordered

#: Columns of a session row that never leave the store.
SECRET_COLUMNS = ["otlp_token", "bootstrap"]


def attribute(turns: DataFrame, sessions: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Stamp every turn with the session it belongs to; others are dropped.

    A turn belongs to the session of its capture whose window contains it (both
    ends inclusive) unless it names another workspace.  Windows of one capture
    do not overlap (:func:`clip_overlaps` makes them so).  Adds ``attempt_id``.
    """
    windows = sessions.select(
        "capture_id",
        F.col("session_id").alias("attempt_id"),
        F.col("attempt_nonce").alias("_nonce"),
        F.col("workspace").alias("_workspace"),
        "started_at_ms",
        "stopped_at_ms",
    )
    same = comparable_path("workspace", case_insensitive) == comparable_path("_workspace", case_insensitive)
    inside = join_disjoint(
        turns,
        "timestamp_ms",
        windows,
        "started_at_ms",
        "stopped_at_ms",
        ["capture_id"],
        condition=F.col("workspace").isNull() | same,
    )
    stamped = {
        "attempt_nonce": F.col("_nonce"),
        "workspace": F.coalesce("workspace", "_workspace"),
    }
    return inside.select(*[stamped.get(c, F.col(c)).alias(c) for c in turns.columns], "attempt_id")


def clip_overlaps(sessions: DataFrame) -> DataFrame:
    """End each window just before the next one of the capture starts."""
    blocks = range_blocks(sessions, ["capture_id"], ["started_at_ms", "session_id"])
    nxt = with_ordered(
        blocks, ["capture_id"], ["started_at_ms", "session_id"], {"_next": lead_value(F.col("started_at_ms"))}
    )
    stop = F.least("stopped_at_ms", F.col("_next") - 1)
    return nxt.withColumn("stopped_at_ms", F.coalesce(stop, F.col("_next") - 1, "stopped_at_ms")).drop("_next")


def session_lifecycle(commands: DataFrame) -> DataFrame:
    """Sessions out of start/stop commands.

    ``commands``: ``capture_id, command (start|stop), workspace, level_id,
    at_ms, seq``.  A start for the bound workspace and level resumes (reopens)
    the session, any other start is a fresh one and supersedes what was open.
    Result: ``capture_id, attempt_no, workspace, level_id, started_at_ms,
    stopped_at_ms, starts, end_state (open|stopped|superseded)``.
    """
    keys, order = ["capture_id"], ["at_ms", "seq"]
    bound = F.struct(comparable_path("workspace").alias("w"), F.col("level_id").alias("l"))
    starts = range_blocks(commands.where(F.col("command") == "start").withColumn("_bound", bound), keys, order)
    starts = with_ordered(starts, keys, order, {"_before": lag_value(F.col("_bound"))})
    fresh = ~F.coalesce(F.col("_before") == F.col("_bound"), F.lit(False))
    marked = starts.withColumn("fresh", fresh.cast("bigint")).drop("_before", "_bound")
    stops = commands.where(F.col("command") == "stop").withColumn("fresh", F.lit(0).cast("bigint"))
    both = range_blocks(marked.unionByName(stops), keys, order)
    numbered = with_ordered(both, keys, order, {"attempt_no": running_sum(F.col("fresh"))})
    numbered = numbered.where(F.col("attempt_no") > 0)

    at = F.struct("at_ms", "seq")
    is_start = F.col("command") == "start"
    first_fresh = F.when(F.col("fresh") == 1, at)
    last_start = F.max(F.when(is_start, at))
    # Only the first stop after the last start closes the window.
    per = numbered.groupBy("capture_id", "attempt_no").agg(
        F.min_by("workspace", first_fresh).alias("workspace"),
        F.min_by("level_id", first_fresh).alias("level_id"),
        F.min(first_fresh).getField("at_ms").alias("started_at_ms"),
        F.count_if(is_start).alias("starts"),
        last_start.alias("_last_start"),
    )
    closing = (
        numbered.where(~is_start)
        .select("capture_id", "attempt_no", at.alias("_stop"))
        .join(per.select("capture_id", "attempt_no", "_last_start"), ["capture_id", "attempt_no"])
        .where(F.col("_stop") > F.col("_last_start"))
        .groupBy("capture_id", "attempt_no")
        .agg(F.min("_stop").getField("at_ms").alias("_stopped"))
    )
    after = per.select(
        "capture_id", (F.col("attempt_no") - 1).alias("attempt_no"), F.col("started_at_ms").alias("_superseded")
    )
    joined = per.join(closing, ["capture_id", "attempt_no"], "left").join(after, ["capture_id", "attempt_no"], "left")
    return joined.select(
        "capture_id",
        "attempt_no",
        "workspace",
        "level_id",
        "started_at_ms",
        F.coalesce("_stopped", "_superseded").alias("stopped_at_ms"),
        "starts",
        F.when(F.col("_stopped").isNotNull(), "stopped")
        .when(F.col("_superseded").isNotNull(), "superseded")
        .otherwise("open")
        .alias("end_state"),
    )


def adopt_sessions(sessions: DataFrame, bound: DataFrame, now_ms: int) -> DataFrame:
    """Which stored session a starting capture may adopt.

    ``bound``: ``capture_id, bound_workspace``.  Own workspace: adopted.  A
    foreign one is never adopted; if it is still open it is superseded now, if
    it is stopped it is kept for its own workspace.
    """
    own = comparable_path("workspace") == comparable_path("bound_workspace")
    verdict = (
        F.when(own, "adopted").when(F.col("stopped_at_ms").isNull(), "superseded").otherwise("kept")
    )
    joined = sessions.join(bound, "capture_id").withColumn("adoption", verdict)
    closed = F.when(F.col("adoption") == "superseded", F.lit(now_ms)).otherwise(F.col("stopped_at_ms"))
    return joined.withColumn("stopped_at_ms", closed.cast("bigint")).drop("bound_workspace")


def restorable(checkpoints: DataFrame, adopted: DataFrame) -> DataFrame:
    """Checkpoint rows of the adopted session only."""
    keys = adopted.where(F.col("adoption") == "adopted").select("capture_id", "session_id")
    return checkpoints.join(keys, ["capture_id", "session_id"], "left_semi")


def integrity_cap(sessions: DataFrame) -> DataFrame:
    """Best trust tier an attempt can reach: a local nonce can never verify."""
    cap = F.when(F.col("nonce_origin") == "server", "verified").otherwise("unverified")
    return sessions.withColumn("integrity_cap", cap)


def publish_sessions(sessions: DataFrame) -> DataFrame:
    """Session rows without the columns that hold secrets."""
    return sessions.drop(*SECRET_COLUMNS)


def gate_otlp(otlp: DataFrame, sessions: DataFrame) -> DataFrame:
    """Keep OTLP rows that carry the token of a session open on arrival.

    Tokens are compared as SHA-256 digests: ``otlp`` has ``ingest_token_sha256``
    and ``sessions`` ``otlp_token``.  A session without a token keeps its ingest
    closed; a window is open until, not including, its stop.
    """
    open_windows = sessions.where(F.col("otlp_token").isNotNull()).select(
        F.col("capture_id").alias("_capture"), F.sha2("otlp_token", 256).alias("_token"), F.col("started_at_ms").alias("_from"), F.col("stopped_at_ms").alias("_to")
    )
    # A token belongs to a session, so the key is as fine as the windows themselves.
    open_then = (F.col("arrival_ms") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("arrival_ms") < F.col("_to")))
    return otlp.join(open_windows, (F.col("capture_id") == F.col("_capture")) & (F.col("ingest_token_sha256") == F.col("_token")) & open_then, "left_semi")


def binding_mismatch(sessions: DataFrame, levels: DataFrame) -> DataFrame:
    """Is the session bound to another level than its folder now holds?

    ``levels``: one row per capture with ``manifest_slug``; blank or absent
    slugs never mismatch.
    """
    joined = sessions.join(levels.select("capture_id", "manifest_slug"), "capture_id", "left")
    slug = F.col("manifest_slug")
    return joined.withColumn("mismatch", F.coalesce((slug != "") & (slug != F.col("slug")), F.lit(False)))


def session_status(sessions: DataFrame, totals: DataFrame, warnings: DataFrame) -> DataFrame:
    """One status row per session: state, totals, resets, recent warnings.

    ``totals`` is :func:`turnlake.operators.attempts.session_totals`,
    ``warnings`` has one row per diagnostic event and is pre-aggregated here.
    """
    warned = warnings.where(F.col("level").isin("warn", "error")).groupBy("capture_id").agg(
        F.count("*").alias("warnings")
    )
    joined = integrity_cap(sessions).join(
        totals, (sessions["capture_id"] == totals["capture_id"]) & (sessions["session_id"] == totals["attempt_id"]), "left"
    ).drop(totals["capture_id"]).drop("attempt_id").join(warned, "capture_id", "left")
    active = F.col("stopped_at_ms").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select(
        "capture_id",
        "session_id",
        "slug",
        F.when(active, "capturing").otherwise("idle").alias("state"),
        "integrity_cap",
        *[zero(c) for c in ("turns", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache")],
        zero("code_reset_count"),
        zero("warnings"),
    )


def session_snapshot(sessions: DataFrame, turns: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables a session view reads: binding, its turns, its signals.

    Kept as tables: one nested document per session would gather an unbounded
    group into one row.
    """
    ids = sessions.select("capture_id", F.col("session_id").alias("attempt_id"))
    return (
        publish_sessions(sessions),
        turns.join(ids, ["capture_id", "attempt_id"], "left_semi"),
        signals.join(ids, ["capture_id", "attempt_id"], "left_semi"),
    )


def attempt_counters(events: DataFrame) -> DataFrame:
    """Resets and attempts per capture out of lifecycle events (``kind``)."""
    return events.groupBy("capture_id").agg(
        F.count_if(F.col("kind") == "reset").alias("resets"),
        F.count_if(F.col("kind") == "fresh_start").alias("attempts"),
        F.count_if(F.col("kind") == "resume").alias("resumes"),
    )
