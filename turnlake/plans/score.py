"""Captured turns to projected scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.attempts import KEY, attempt_fold
from turnlake.operators.reports import running_scoreboard
from turnlake.operators.scoring import BEST_CASE_SECONDS, LIVE_SECONDS, project


def live_scores(turns: DataFrame, sessions: DataFrame, economics: DataFrame, weights: DataFrame) -> DataFrame:
    """Projected score of every session, turns or not."""
    return _scores(turns, sessions, economics, weights, LIVE_SECONDS)


def best_case_scores(turns: DataFrame, sessions: DataFrame, economics: DataFrame, weights: DataFrame) -> DataFrame:
    """Upper bound a graded score is checked against."""
    return _scores(turns, sessions, economics, weights, BEST_CASE_SECONDS)


def running_scores(turns: DataFrame, sessions: DataFrame, economics: DataFrame, weights: DataFrame) -> DataFrame:
    """The live projection after every turn; ``turns`` has ``turn_index``."""
    board = running_scoreboard(turns).join(_attempts(sessions), KEY)
    totals = [F.col(f"total_{t}").alias(f"tokens_{t}") for t in ("input", "output", "thinking", "cache")]
    fold = board.select(
        *[c for c in board.columns if not c.startswith(("total_", "leading_", "prompts", "estimated"))],
        *totals,
        F.col("prompts").alias("prompt_count"),
        F.col("estimated").alias("counts_estimated"),
        F.col("leading_model").alias("model_identifier"),
        F.col("leading_harness").alias("harness_used"),
    )
    return project(fold, economics, weights, LIVE_SECONDS)


def _attempts(sessions: DataFrame) -> DataFrame:
    keep = [c for c in ("challenge_type", "token_weight_overrides") if c in sessions.columns]
    return sessions.select("capture_id", F.col("session_id").alias("attempt_id"), *keep)


def _scores(turns: DataFrame, sessions: DataFrame, economics: DataFrame, weights: DataFrame, seconds: float) -> DataFrame:
    attempts = _attempts(sessions)
    fold = attempt_fold(turns, attempts).join(attempts, KEY)
    return project(fold, economics, weights, seconds)
