"""Session windows that touch, overlap or lie far away."""

from helpers import raw
from pyspark.sql import functions as F

from turnlake.operators.correlate import merged_spans, with_flush_time
from turnlake.operators.intervals import join_disjoint
from turnlake.operators.sessions import attribute
from turnlake.plans.capture import capture, expected_spans

SESSION = "capture_id string, session_id string, attempt_nonce string, workspace string, started_at_ms long, stopped_at_ms long, otlp_token string"
T = 1_700_000_000_000
FAR = (1 << 63) - 1


def sessions(spark, *windows):
    rows = [("c1", f"s{k}", f"n{k}", "/w", a, b, "tok") for k, (a, b) in enumerate(windows, 1)]
    return spark.createDataFrame(rows, SESSION)


def test_a_turn_on_a_shared_boundary_is_one_row(spark):
    turns = raw(spark, [dict(source="otel", timestamp_ms=T + d, arrival_ms=T + d, arrival_seq=k, event_id=f"e{k}", tokens_input=k + 1, workspace=None) for k, d in enumerate((-5, 0, 5, 900))])
    got = capture(turns, sessions(spark, (T - 100, T), (T, T + 500), (T + 3, None))).collect()
    assert sorted((r.timestamp_ms - T, r.attempt_id) for r in got) == [(-5, "s1"), (0, "s2"), (5, "s3"), (900, "s3")]


def test_overlapping_spans_do_not_multiply_rows(spark):
    rows = raw(spark, [dict(source="jsonl", timestamp_ms=T + d, arrival_ms=T + d, event_id=f"e{d}") for d in (-50, 10, 60, 5_000)])
    spans = expected_spans(sessions(spark, (T, T + 100), (T + 50, T + 200), (T + 200, T + 300)))
    assert [(r.open_ms, r.close_ms) for r in merged_spans(spans).collect()] == [(T, T + 300)]
    got = with_flush_time(rows, spans)
    assert sorted((r.arrival_ms - T, r.flush_ms - T) for r in got.collect()) == [(-50, 0), (10, 300), (60, 300), (5_000, 5_000)]


def test_far_timestamps_neither_fail_nor_match(spark):
    rows = raw(spark, [dict(source="otel", timestamp_ms=t, arrival_ms=t, arrival_seq=k, event_id=f"e{k}", workspace=None) for k, t in enumerate((T, FAR, -FAR, 9 * 10**18))])
    open_window = sessions(spark, (T - 1, None))
    assert sorted(r.timestamp_ms for r in attribute(rows.withColumn("turn_id", F.col("event_id")), open_window).collect()) == [T, 9 * 10**18, FAR]
    assert with_flush_time(rows, expected_spans(open_window)).count() == 4
    assert with_flush_time(rows).count() == 4


def test_points_lie_in_the_last_interval_that_begins_before(spark):
    points = spark.createDataFrame([("k", t, n) for n, t in enumerate((-10**18, -1, 0, 4, 5, 10**18, 10**18 + 1, None))] + [("other", 3, 8), (None, 3, 9)], "key string, at long, n int")
    spans = spark.createDataFrame([("k", -1, -1), ("k", 0, 4), ("k", 5, 10**18), ("other", 4, None), (None, 0, None)], "key string, a long, b long")
    got = {r.n: r.a for r in join_disjoint(points, "at", spans, "a", "b", ["key"], how="left", bucket_ms=3).collect()}
    assert got == {0: None, 1: -1, 2: 0, 3: 0, 4: 5, 5: 5, 6: None, 7: None, 8: None, 9: None}
    inner = join_disjoint(points, "at", spans, "a", "b", ["key"], condition=F.col("n") % 2 == 0).collect()
    assert sorted((r.n, r.a, r.b) for r in inner) == [(2, 0, 4), (4, 5, 10**18)]


def test_many_windows_and_points_of_one_capture(spark):
    """Far more pairs than could be formed: a hundred thousand points and as many windows of one key."""
    n = 100_000
    points = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7).alias("at"))
    spans = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7 - 3).alias("a"), (F.col("id") * 7 + F.col("id") % 2 * 3 - 1).alias("b"))
    got = join_disjoint(points, "at", spans, "a", "b", ["key"])
    assert got.where("at - a = 3 and at <= b").count() == got.count() == n // 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
