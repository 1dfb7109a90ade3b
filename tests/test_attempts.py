import math

import pytest
from helpers import raw
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.functions.numbers import MAX_COUNT
from turnlake.operators import attempts as A
from turnlake.operators import integrity as I
from turnlake.operators import scoring as S
from turnlake.operators import sessions as Z
from turnlake.operators.grading import error_head, grade_outputs
from turnlake.operators.normalize import normalize
from turnlake.operators.reports import idle_gaps, token_mix

KEY = {"capture_id": "c", "attempt_id": "a"}


def turns(spark, rows):
    full = []
    for i, r in enumerate(rows):
        t = dict(
            KEY, turn_id=f"t{i:03d}", emitted_ms=i, timestamp_ms=i * 60_000, model="m", tokens_input=1, tokens_output=1, tokens_thinking=0,
            tokens_cache=0, prompt_id=f"p{i}", confidence="otel", sources=["otel", "jsonl"], fields=None, low=False,
        ) | r
        full.append(t)
    df = spark.createDataFrame(
        [tuple(t.values()) for t in full],
        "capture_id string, attempt_id string, turn_id string, emitted_ms bigint, timestamp_ms bigint, model string, tokens_input bigint, "
        "tokens_output bigint, tokens_thinking bigint, tokens_cache bigint, prompt_id string, confidence string, sources array<string>, "
        "fields array<string>, low boolean",
    )
    return df.withColumns(
        {
            "agreement": F.struct(F.when(F.col("fields").isNotNull(), "disagree").otherwise("agree").alias("status"), "fields"),
            "plausibility": F.struct(F.when(F.col("low"), "low").otherwise("plausible").alias("status")),
        }
    )


def test_totals_saturate(spark):
    df = turns(spark, [dict(tokens_input=MAX_COUNT), dict(tokens_input=5), dict(tokens_input=7, attempt_id="b")])
    got = {r.attempt_id: r for r in A.session_totals(df).collect()}
    assert (got["a"].tokens_input, got["a"].turns, got["b"].tokens_input) == (MAX_COUNT, 2, 7)
    assert A.attempt_fold(df).where("attempt_id = 'a'").first().tokens_input == MAX_COUNT


def test_fold_counts_prompts_and_leaders(spark):
    df = turns(
        spark,
        [
            dict(prompt_id="p", model="x", tokens_input=10),
            dict(prompt_id="p", model="y", tokens_input=10),
            dict(prompt_id=None, model="", tokens_input=2, sources=["cursor"], tokens_thinking=500),
            dict(prompt_id="", model="x", tokens_input=0, tokens_output=0),
        ],
    )
    got = A.attempt_fold(df).first()
    assert (got.prompt_count, got.turns) == (3, 4)
    assert (got.model_identifier, got.harness_used, got.counts_estimated) == ("x", "cursor", False)
    empty = spark.createDataFrame([("c", "none")], "capture_id string, attempt_id string")
    none = A.attempt_fold(df, empty).first()
    assert (none.counts_estimated, none.model_identifier, none.harness_used, none.prompt_count) == (True, "", "claude_code_cli", 0)
    assert A.weakest_confidence(df, empty).first().confidence == "estimated"


def test_plausibility(spark):
    rows = [
        dict(tokens_input=0, tokens_output=0, cost_usd=0.0), dict(duration_ms=0, cost_usd=-0.0), dict(cost_usd=float("nan")), dict(cost_usd=1e-15),
    ]
    got = [r.plausibility.reasons for r in normalize(raw(spark, rows)).collect()]
    assert got == [["zero tokens reported"], ["nonzero tokens with zero duration", "nonzero tokens with zero cost"], None, None]


@pytest.mark.parametrize(
    ("rows", "session", "tier", "reason"),
    [
        ([{}], {}, "verified", "verified"),
        ([{}], dict(nonce_origin="local"), "unverified", "local_nonce"),
        ([{}], dict(baseline_attested=False), "unverified", "baseline_unattested"),
        ([], {}, "unverified", "no_turns"),
        ([dict(confidence="estimated")], {}, "unverified", "estimated_turns"),
        ([dict(sources=["codex"], confidence="jsonl"), {}], {}, "unverified", "adapter_source"),
        ([dict(sources=["jsonl"], confidence="jsonl")], {}, "unverified", "no_otel"),
        ([dict(fields=["model"])] + [{}] * 9, {}, "unverified", "cross_source_disagreement"),
        ([dict(fields=["tokens_input"])] * 5 + [{}] * 5, {}, "verified", "verified"),
        ([dict(fields=["tokens_input"])] * 6 + [{}] * 4, {}, "unverified", "cross_source_disagreement"),
        ([dict(fields=[])] + [{}] * 4, {}, "unverified", "cross_source_disagreement"),
    ],
)
def test_trust_tier(spark, rows, session, tier, reason):
    s = dict(capture_id="c", session_id="a", nonce_origin="server", baseline_attested=True) | session
    sessions = spark.createDataFrame([tuple(s.values())], "capture_id string, session_id string, nonce_origin string, baseline_attested boolean")
    got = I.trust_tier(sessions, turns(spark, rows)).first()
    assert (got.tier, got.reason) == (tier, reason)


def test_pacing(spark):
    burst = [dict(timestamp_ms=i * 100) for i in range(40)]
    calm = [dict(timestamp_ms=i * 30_000, attempt_id="calm") for i in range(10)]
    edge = [dict(timestamp_ms=t, attempt_id="edge") for t in (0, 10_000, 10_001, 20_000, 20_001)]
    got = {r.attempt_id: (r.worst, r.pacing_reason) for r in I.pacing(turns(spark, burst + calm + edge)).collect()}
    assert got == {"a": (40, "40 turns within 10s — tighter than an interactive session"), "calm": (1, None), "edge": (3, None)}


def test_pacing_equals_two_pointer_sweep(spark):
    import random

    rng = random.Random(5)
    stamps = [rng.randrange(90_000) for _ in range(500)] + [33_000] * 60
    got = I.pacing(turns(spark, [dict(timestamp_ms=t) for t in stamps])).first().worst
    assert got == max(sum(1 for s in stamps if t - 10_000 <= s <= t) for t in stamps)


def test_bulk_paste(spark):
    def ch(path, sizes, kinds=None):
        return [("c", "a", path, (kinds or {}).get(i, "modified"), s, i, i) for i, s in enumerate(sizes)]

    rows = ch("one", [300, 9000, 20_000]) + ch("grown", [4000, 4500, 5000, 11_000]) + ch("late", [10, 20, 9000])
    rows += ch("gone", [5000, 0], {0: "removed"}) + ch("after", [0, 2000], {0: "removed"})
    df = spark.createDataFrame(rows, "capture_id string, attempt_id string, path string, kind string, size bigint, timestamp_ms bigint, seq bigint")
    got = {r.path: (r.size, r.previous_size, r.prior_edits) for r in I.bulk_pastes(df).collect()}
    assert got == {"one": (9000, 300, 1), "grown": (4000, 0, 0), "after": (2000, 0, 1)}


def vector(spark, **kw):
    row = dict(
        correctness_pct=100.0, prompt_count=2.0, tokens_input=5000.0, tokens_output=3000.0, tokens_thinking=0.0, execution_time_seconds=4.0,
        challenge_type="debugging", model_identifier="claude-sonnet-4-6", harness_used="claude_code_cli",
    ) | kw
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema)
    return S.score(S.explicit_vectors(df), fx.economics(spark), fx.weights(spark)).first()


def test_score_anchor_and_factors(spark):
    assert math.isclose(vector(spark).score, 183.8235294117647, rel_tol=1e-12)
    stamped = vector(spark, model_identifier="claude-haiku-4-5-20251001")
    assert (stamped.economics_id, stamped.effort, stamped.baseline_floor_fallback) == ("claude-haiku-4-5", 0.5, False)
    floor = vector(spark, model_identifier="cursor-composer", harness_used="cursor")
    assert floor.baseline_floor_fallback and floor.is_baseline_floor and math.isclose(floor.effort, 1.0)
    think = vector(spark, tokens_thinking=12_000.0)
    assert math.isclose(think.thinking_overhead, 0.1)
    assert vector(spark, tokens_thinking=1e9).thinking_overhead == 1.0
    broken = vector(spark, correctness_pct=float("nan"), prompt_count=-1.0, execution_time_seconds=float("inf"))
    assert (broken.score, broken.prompts_effective, broken.seconds_effective) == (0.0, 1.0, 1.0)
    assert broken.prompts_floored and broken.speed_floored and not broken.tokens_floored
    assert vector(spark, tokens_input=1.0, tokens_output=0.0).tokens_floored


def test_missing_floor_row_is_an_error(spark):
    with pytest.raises(ValueError):
        S.economics_lookup(spark.createDataFrame([("m",)], "model_identifier string"), fx.economics(spark).where("not is_baseline_floor"))


def test_attribution_window_and_workspace(spark):
    s = spark.createDataFrame(
        [("c1", "s1", "n1", "/w/", 1000, 1100)],
        "capture_id string, session_id string, attempt_nonce string, workspace string, started_at_ms bigint, stopped_at_ms bigint",
    )
    rows = [
        dict(timestamp_ms=1010, workspace="\\w"), dict(timestamp_ms=1020), dict(timestamp_ms=990), dict(timestamp_ms=1030, workspace="/x"),
        dict(timestamp_ms=1100), dict(timestamp_ms=1500), dict(timestamp_ms=1050, capture_id="c2"),
    ]
    got = Z.attribute(normalize(raw(spark, rows)), s).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, r.workspace) for r in got] == [(1010, "\\w"), (1020, "/w/"), (1100, "/w/")]
    opened = Z.attribute(normalize(raw(spark, rows)), s.withColumn("stopped_at_ms", F.lit(None).cast("bigint"))).count()
    assert opened == 4


def test_lifecycle(spark):
    def run(*steps):
        rows = [("c", c, w, lv, i * 10, i) for i, (c, w, lv) in enumerate(steps)]
        df = spark.createDataFrame(rows, "capture_id string, command string, workspace string, level_id string, at_ms bigint, seq bigint")
        got = Z.session_lifecycle(df).orderBy("attempt_no").collect()
        return [(r.workspace, r.level_id, r.started_at_ms, r.stopped_at_ms, r.starts, r.end_state) for r in got]

    stop = ("stop", "", "")
    assert run(stop, ("start", "/a", "1"), stop, ("start", "/a/", "1"), ("start", "/a", "2"), stop, stop, ("start", "/b", "2")) == [
        ("/a", "1", 10, 40, 2, "superseded"),
        ("/a", "2", 40, 50, 1, "stopped"),
        ("/b", "2", 70, None, 1, "open"),
    ]


def test_grading(spark):
    cases = [
        ("ok \n", "ok", None, True), ("ok", "ok!", None, False), ("1.0 x", "1.05 x", 0.1, True), ("1.0", "1.2", 0.1, False),
        ("1 2", "1", 0.1, False), ("a", "b", 9.0, False), ("", " ", 0.1, True), ("nan", "nan", 0.1, True),
    ]
    df = spark.createDataFrame(cases, "actual string, expected string, tolerance double, want boolean")
    assert [r for r in grade_outputs(df).collect() if r.passed != r.want] == []
    head = spark.range(1).select(error_head(F.lit("a\nb\r\nc\nd"), F.lit("x")), error_head(F.lit(" "), F.lit("y" * 300))).first()
    assert head[0] == "a / b / c" and head[1] == "y" * 200 + "…"


def test_token_mix_and_idle(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 0), (10, 0, 1)], "tokens_input bigint, tokens_output bigint, tokens_thinking bigint")
    got = [(r.cells_input, r.cells_output, r.cells_thinking) for r in token_mix(df, 10).collect()]
    assert got == [(4, 3, 3), (0, 0, 0), (9, 0, 1)]
    act = spark.createDataFrame([("c", t) for t in (0, 500, 900_500, 2_000_000)], "capture_id string, at_ms bigint")
    gaps = [(r.idle_from_ms, r.idle_ms) for r in idle_gaps(act, now_ms=2_900_000).orderBy("idle_from_ms").collect()]
    assert gaps == [(500, 900_000), (900_500, 1_099_500), (2_000_000, 900_000)]
