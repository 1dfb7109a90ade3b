"""Pairing: inline cases, a sequential re-statement of the rule on random
bursts, silences that cut an island, and an island of a million rows."""

import math
import random

import pytest
from helpers import raw
from pyspark.sql import functions as F

from turnlake.operators import matching
from turnlake.operators.correlate import _Part, arrival_gap, correlate, islands, pairing_fates, with_flush_time
from turnlake.operators.dedup import keep_first

T = 1700000000000


def turns(spark, rows, expected=None, **kw):
    out = correlate(raw(spark, rows), expected, **kw)
    return sorted(
        (r.sources, r.agreement.status, r.agreement.fields, r.tokens_output, r.tokens_thinking, r.model) for r in out.collect()
    )


def o(out=50, ts=T, **kw):
    return dict(source="otel", tokens_output=out, timestamp_ms=ts, **kw)


def j(out=50, ts=T, **kw):
    return dict(source="jsonl", tokens_output=out, timestamp_ms=ts, **kw)


M = "claude-sonnet-4-6"


def test_agreeing_pair_takes_thinking_from_the_transcript(spark):
    assert turns(spark, [o(), j(tokens_thinking=30)]) == [(["otel", "jsonl"], "agree", None, 50, 30, M)]


def test_inflated_output_disagrees_and_keeps_otlp_counts(spark):
    assert turns(spark, [o(), j(9000)]) == [(["otel", "jsonl"], "disagree", ["tokens_output"], 50, 0, M)]


def test_other_model_disagrees(spark):
    assert turns(spark, [o(), j(model="gpt-5")]) == [(["otel", "jsonl"], "disagree", ["model"], 50, 0, M)]


def test_lone_and_editor_rows_stay_single(spark):
    got = turns(spark, [j(), dict(source="cursor"), dict(source="otel", capture_id="c2")])
    assert [g[0] for g in got] == [["cursor"], ["jsonl"], ["otel"]]


def test_cache_split_agrees(spark):
    rows = [o(tokens_input=531, tokens_cache=0), j(tokens_input=8, tokens_cache=523)]
    assert turns(spark, rows)[0][1] == "agree"


def test_burst_pairs_by_tokens_in_any_order(spark):
    outs = [100, 900, 50]
    rows = [j(x, T + i) for i, x in enumerate(outs)] + [o(x, T + 100 + i) for i, x in enumerate(reversed(outs))]
    assert [g[1] for g in turns(spark, rows)] == ["agree"] * 3


def test_ambiguous_burst_does_not_merge(spark):
    assert len(turns(spark, [j(100), j(900, T + 1), o(5000, T + 2)])) == 3


def test_late_counterpart_is_merged_within_the_hold_and_suppressed_after(spark):
    late = [j(ts=T, arrival_ms=T), o(ts=T + 10_000, arrival_ms=T + 14_100)]
    assert len(turns(spark, late)) == 1
    gone = [j(ts=T, arrival_ms=T), o(ts=T + 10, arrival_ms=T + 25_000), o(ts=T + 20, arrival_ms=T + 26_000)]
    assert [g[0] for g in turns(spark, gone)] == [["jsonl"], ["otel"]]
    forgotten = [j(ts=T, arrival_ms=T), o(ts=T + 10, arrival_ms=T + 95_000)]
    assert len(turns(spark, forgotten)) == 2


def test_no_hold_without_an_expected_counterpart(spark):
    expected = spark.createDataFrame([("c1", T + 50_000, None)], "capture_id string, open_ms bigint, close_ms bigint")
    rows = [j(ts=T, arrival_ms=T + 1), o(ts=T, arrival_ms=T + 3_000)]
    fates = {r.fate for r in pairing_fates(with_flush_time(keep_first(raw(spark, rows)), expected)).collect()}
    assert fates == {"single", "suppressed"}


def test_extreme_timestamps(spark):
    big = 2**63 - 1
    assert len(turns(spark, [o(ts=big, arrival_ms=T), j(ts=-big, arrival_ms=T + 1)])) == 2


def test_duplicates_keep_the_first_arrival(spark):
    rows = [j(event_id="m1", tokens_thinking=7), j(ts=T + 5, event_id="m1"), j(ts=T + 9, event_id="m1")]
    got = keep_first(raw(spark, rows)).collect()
    assert len(got) == 1 and got[0].tokens_thinking == 7


# --- the rule once more, as plain sequential code --------------------------


def close(a, b):
    return abs(a - b) <= max(50, math.ceil(0.05 * max(a, b)))


def agree(a, b):
    return close(a["out"], b["out"]) and (close(a["in"], b["in"]) or close(a["in"] + a["cache"], b["in"] + b["cache"]))


def sequential(rows):
    """Every capture on its own, second by second."""
    fate = {}
    for cap in {r["cap"] for r in rows}:
        waiting, memory, tick = [], [], None
        for r in sorted((r for r in rows if r["cap"] == cap), key=lambda r: (r["arr"], r["seq"])):
            last = r["arr"] // 1000 * 1000
            tick = last if tick is None else tick
            while tick <= last:
                for p in [p for p in waiting if tick - p["arr"] >= 20_000]:
                    waiting.remove(p)
                    memory.append((p, tick))
                memory = [(p, t) for p, t in memory if tick - t < 60_000]
                tick += 1000
            near = [p for p in waiting if p["src"] != r["src"] and abs(p["ts"] - r["ts"]) <= 15_000]
            same = [p for p in near if agree(p, r)]
            mate = None
            if same:
                mate = min(same, key=lambda p: (abs(p["out"] - r["out"]) + abs(p["in"] - r["in"]), abs(p["ts"] - r["ts"])))
            elif len(near) == 1 and near[0]["model"] and near[0]["model"] == r["model"]:
                mate = near[0]
            if mate:
                waiting.remove(mate)
                fate[r["seq"]], fate[mate["seq"]] = ("pair", mate["seq"]), ("pair", r["seq"])
                continue
            hit = next(
                (
                    (p, t)
                    for p, t in memory
                    if p["src"] != r["src"]
                    and abs(p["ts"] - r["ts"]) <= 15_000
                    and ((p["model"] and p["model"] == r["model"]) or agree(p, r))
                ),
                None,
            )
            if hit:
                memory.remove(hit)
                fate[r["seq"]] = ("suppressed", hit[0]["seq"])
            else:
                waiting.append(r)
                fate[r["seq"]] = ("single", None)
    return fate


def bursts(seed, n=400, caps=3, span=400_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = T + rng.randrange(span)
        rows.append(
            {
                "cap": f"c{0 if rng.random() < 0.5 else rng.randrange(caps)}",
                "src": rng.choice(["otel", "jsonl"]),
                "model": rng.choice(["a", "a", "b", None]),
                "in": rng.choice([100, 140, 400, 8, 3000]),
                "out": rng.choice([50, 90, 500, 2000, 2080]),
                "cache": rng.choice([0, 0, 92, 392]),
                "ts": ts,
                "arr": ts + rng.choice([0, 300, 4000, 19_500, 26_000, 70_000]),
                "seq": i,
            }
        )
    return rows


@pytest.mark.parametrize(("seed", "span", "late"), [(1, 4_000_000, 0), (2, 100_000, 0), (3, 400_000, 0), (4, 60_000, 0), (5, 60_000, 200_000), (6, 10_000, 90_000)])
def test_same_fates_as_sequential_code(spark, seed, span, late):
    rows = bursts(seed, span=span)
    for r in rows:  # arrivals in waves, with silences about as long as the memory
        r["arr"] += r["seq"] % 3 * late
    df = raw(
        spark,
        [
            dict(
                capture_id=r["cap"], source=r["src"], model=r["model"], tokens_input=r["in"], tokens_output=r["out"],
                tokens_cache=r["cache"], timestamp_ms=r["ts"], arrival_ms=r["arr"], arrival_seq=r["seq"], event_id=f"e{r['seq']}",
            )
            for r in rows
        ],
    )
    unique = with_flush_time(keep_first(df))
    seq = {(r.capture_id, r.dedup_id): r.arrival_seq for r in unique.collect()}
    got = {}
    for r in pairing_fates(unique).collect():
        key = seq[(r.capture_id, r.key)]
        assert key not in got, "one fate per observation"
        got[key] = (r.fate, seq.get((r.capture_id, r.partner)))
    assert got == sequential(rows)


def test_a_silence_of_arrivals_cuts_an_island(spark):
    at = [0, 5_000, 10_000, 10_000 + 3 * arrival_gap(1000)]
    rows = raw(spark, [dict(source=("otel", "jsonl")[i % 2], timestamp_ms=T + i, arrival_ms=T + a, event_id=f"e{i}") for i, a in enumerate(at)])
    rows = rows.select("capture_id", "source", F.expr("timestamp_ms div 15000").alias("bucket"), F.expr(f"arrival_ms div {arrival_gap(1000)}").alias("arrival_bucket"))
    got = islands(rows).collect()
    assert len({r.island for r in got}) == 1 and len({r.part for r in got}) == 2
    assert not max(got, key=lambda r: r.part).two_sided


def test_an_island_of_a_million_rows(spark):
    """Half a million turns of one capture without a gap, both logs of each, in one sorted stream."""
    n = 500_000
    i = F.col("id")
    known = {"capture_id": F.lit("c"), "model": F.lit("m"), "tokens_input": i % 997 * 100, "tokens_output": i % 1009 * 200, "tokens_cache": F.lit(0), "timestamp_ms": T + i * 100}
    one = spark.range(n).withColumns({k: v.cast("string") if k in ("capture_id", "model") else v.cast("bigint") for k, v in known.items()})
    sides = [one.select("*", F.lit(s).alias("source"), (F.col("timestamp_ms") + d).alias("arrival_ms"), (2 * i + k).alias("arrival_seq")) for k, (s, d) in enumerate((("jsonl", 50), ("otel", 3_000)))]
    both = sides[0].unionByName(sides[1]).withColumn("dedup_id", F.concat("source", F.col("id").cast("string")))
    fates = pairing_fates(with_flush_time(both))
    partner = F.concat(F.when(F.col("key").startswith("otel"), "jsonl").otherwise("otel"), F.regexp_extract("key", "[0-9]+$", 0))
    counts = fates.agg(F.count("*").alias("n"), F.count_if((F.col("fate") == "pair") & (F.col("partner") == partner)).alias("paired")).first()
    assert (counts.n, counts.paired) == (2 * n, 2 * n)


def test_state_holds_only_what_may_still_pair():
    part = _Part(("c", 0, 0), 1000)
    most = 0
    for i in range(20_000):
        arrival = T + i * 1000
        part.take(("c", 0, 0, f"k{i}", "otel", "m", i, i, 0, arrival, arrival, i, arrival + 20_000))
        most = max(most, len(part.rows), *(len(p.by_time) for p in (part.state.waiting["otel"], part.state.memory["otel"])))
    assert most <= 62


def test_bursts_of_copies_are_matched_in_one_look(monkeypatch):
    """Thousands of equal turns at one time: the comparisons follow the arrivals, not their square."""
    seen = []
    agree_before = matching.tokens_agree
    monkeypatch.setattr(matching, "tokens_agree", lambda a, b: seen.append(1) or agree_before(a, b))
    state, n = matching.PairingState(), 3000
    make = lambda i, source, at: matching.Seen((at, i, ""), f"{source}{i}", source, None, 500, 500, 0, T + i % 7, at + 20_000)
    for i in range(n):
        state.arrive(make(i, "otel", T), T)
    gave_up = state.advance(T + 20_000)
    late = [state.arrive(make(i, "jsonl", T + 30_000), T + 30_000)[0] for i in range(n)]
    assert [f.fate for f in gave_up] == ["single"] * n and [f.fate for f in late] == ["suppressed"] * n
    assert [f.partner.place for f in late] == sorted(f.seen.place for f in gave_up)
    assert len(seen) <= 4 * n
