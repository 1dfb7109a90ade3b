"""Streams give what the batch jobs give on the same rows."""

import json
import time

from helpers import raw
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.operators.correlate import correlate
from turnlake.operators.dedup import keep_first
from turnlake.operators.sessions import attribute
from turnlake.schemas import RAW_TURN
from turnlake.sources.lines import read_lines
from turnlake.sources.transcript import parse_transcripts
from turnlake.streaming import ingest, pairing, sinks

COLUMNS = ["turn_id", "model", "tokens_thinking", "prompt_id", "confidence", "workspace", "agreement.status"]


def run(stream, tmp_path, name):
    # Timers of idle captures would keep an otherwise drained query busy.
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    try:
        deadline = time.time() + 120
        while time.time() < deadline and not q.exception() and (q.status["isDataAvailable"] or q.status["isTriggerActive"] or not q.recentProgress):
            time.sleep(0.5)
        assert q.exception() is None and time.time() < deadline
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def with_stops(rows):
    """Raw rows and a stop of every capture after its last one."""
    fixed = {"source": F.lit("stop"), "arrival_ms": F.col("at"), "arrival_seq": F.lit(0), "timestamp_ms": F.lit(0), "capture_id": F.col("capture_id")}
    ends = rows.groupBy("capture_id").agg((F.max("arrival_ms") + 100_000).alias("at"))
    return rows.unionByName(ends.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_TURN.fields]))


def test_pairing_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = fx.raw_turns(spark, sf_dir).where("event_id is null or event_id like '%1' or capture_id = 'cap-3'").select(*RAW_TURN.fieldNames())
    unique = keep_first(rows).select(*RAW_TURN.fieldNames())
    middle = F.lit(fx.EPOCH + 1_000_000)
    everything = with_stops(unique)
    everything.where(F.col("arrival_ms") < middle).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    everything.where(F.col("arrival_ms") >= middle).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(RAW_TURN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(pairing.correlate_stream(stream), tmp_path, "paired").select(*COLUMNS)
    assert same(got, correlate(rows).select(*COLUMNS))


def test_stop_flushes_and_remembers(spark, tmp_path):
    t = 1_700_000_000_000
    rows = raw(
        spark,
        [
            dict(source="jsonl", timestamp_ms=t, arrival_ms=t, tokens_thinking=9),
            dict(source="stop", arrival_ms=t + 1_000, timestamp_ms=0),
            dict(source="otel", timestamp_ms=t, arrival_ms=t + 5_000),
            dict(source="otel", timestamp_ms=t + 1, arrival_ms=t + 6_000),
            dict(source="stop", arrival_ms=t + 50_000, timestamp_ms=0),
        ],
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(pairing.correlate_stream(ingest.stream_raw_turns(spark, str(tmp_path / "in"))), tmp_path, "stopped").collect()
    assert sorted((r.sources, r.emitted_ms - t) for r in got) == [(["jsonl"], 1_000), (["otel"], 26_000)]


def test_transcript_stream_carries_prompts_over_chunks(spark, tmp_path):
    def user(i):
        return json.dumps({"type": "user", "uuid": f"u{i}", "message": {"content": "go"}})

    def turn(i):
        return json.dumps({"type": "assistant", "timestamp": "2026-06-16T19:00:00Z", "message": {"id": f"m{i}", "usage": {"input_tokens": i}}})

    log = tmp_path / "logs" / "s1"
    log.mkdir(parents=True)
    chunks = [[user(0), turn(1)], [turn(2), user(1)], [turn(3)], [turn(4), user(2), turn(5)]]
    for i, texts in enumerate(chunks):
        (log / f"{i}.jsonl").write_text("\n".join(texts) + "\n")
    stream = ingest.stream_transcripts(ingest.stream_lines(spark, str(tmp_path / "logs"), max_files=4))
    got = run(stream, tmp_path, "prompts").select("event_id", "prompt_id", "tokens_input")
    batch = parse_transcripts(read_lines(spark, str(tmp_path / "logs" / "*"), log_id=F.lit("s1")))
    assert same(got, batch.select("event_id", "prompt_id", "tokens_input"))
    assert {(r.event_id, r.prompt_id) for r in got.collect()} == {("m1", "u0"), ("m2", "u0"), ("m3", "u1"), ("m4", "u1"), ("m5", "u2")}


def test_dedup_never_forgets(spark, sf_dir, tmp_path):
    rows = fx.raw_turns(spark, sf_dir).where("source = 'jsonl'").select(*RAW_TURN.fieldNames())
    again = rows.withColumn("arrival_ms", F.col("arrival_ms") + 30 * 86_400_000)  # copies, a month later
    # Old turns come after new ones, a run at a time: all of them count.
    old = rows.withColumn("timestamp_ms", F.col("timestamp_ms") - 90 * 86_400_000).withColumn("event_id", F.concat("event_id", F.lit("-old")))
    stream = lambda: ingest.stream_dedup(ingest.stream_raw_turns(spark, str(tmp_path / "in" / "*")), buckets=4)
    for part, more in enumerate((rows, again, old)):
        more.coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        writer = stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream().schema).parquet(str(tmp_path / "out"))
    want = keep_first(rows.unionByName(again).unionByName(old))
    names = ["capture_id", "dedup_id", "arrival_ms", "arrival_seq", "tokens_thinking", "cost_usd"]
    assert got.columns == stream().columns and same(got.select(*names), want.select(*names))


def test_dedup_keeps_the_first_arrival_without_python_per_key(spark, tmp_path):
    t = 1_700_000_000_000
    first = [dict(event_id=f"e{i % 5}", arrival_ms=t + 50 - i, arrival_seq=i, tokens_thinking=i) for i in range(20)]
    later = [dict(event_id="e1", arrival_ms=t, tokens_thinking=99), dict(event_id="e7", arrival_ms=t, tokens_thinking=7), dict(event_id="e7", arrival_ms=None, tokens_thinking=8)]
    for part, rows in enumerate((first, later)):
        raw(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        stream = ingest.stream_dedup(ingest.stream_raw_turns(spark, str(tmp_path / "in" / "*")), buckets=2)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["dedupe"]
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((r.event_id, r.tokens_thinking) for r in got.collect()) == [("e0", 15), ("e1", 16), ("e2", 17), ("e3", 18), ("e4", 19), ("e7", 7)]


def test_drain_gives_what_still_waits(spark, sf_dir, tmp_path):
    rows = fx.raw_turns(spark, sf_dir).select(*RAW_TURN.fieldNames())
    unique = keep_first(rows).select(*RAW_TURN.fieldNames())
    for part in range(3):
        span = F.expr(f"(arrival_ms - {fx.EPOCH}) div 900000")
        unique.where(F.least(F.greatest(span, F.lit(0)), F.lit(2)) == part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        stream = pairing.correlate_stream(ingest.stream_raw_turns(spark, str(tmp_path / "in" / "*")), idle_flush=False)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    emitted = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    left = pairing.drain(spark, str(tmp_path / "state"))
    assert left.count() > 0 and left.where("size(sources) > 1").count() == 0
    flat = [*COLUMNS, "emitted_ms"]
    assert same(emitted.select(*flat).unionByName(left.select(*flat)), correlate(rows).select(*flat))


def test_state_is_written_by_the_arrivals(spark, tmp_path):
    """A batch of few arrivals writes few entries, however many still wait."""
    t = 1_700_000_000_000
    waiting = [dict(source="jsonl", timestamp_ms=t + i, arrival_ms=t + i, tokens_output=1000 * i, event_id=f"e{i}") for i in range(400)]
    few = [dict(source="otel", timestamp_ms=t + 500, arrival_ms=t + 500 + i, tokens_output=1000 * i, event_id=f"o{i}") for i in (3, 5)]
    updated = []
    for part, rows in enumerate((waiting, few)):
        raw(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
        stream = pairing.correlate_stream(ingest.stream_raw_turns(spark, str(tmp_path / "in" / "*")), idle_flush=False)
        writer = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        updated.append((state["numRowsTotal"], state["numRowsUpdated"] + state["numRowsRemoved"]))
    assert updated[0][1] >= 400
    assert updated[1][1] <= 10 and updated[1][0] >= 398


def test_captures_of_a_bucket_share_calls_to_the_state():
    """A batch looks up the state of a bucket once, however many captures arrive in it."""
    import json
    from types import SimpleNamespace

    class Entries(dict):
        calls = 0

        def iterator(self):
            Entries.calls += 1
            return iter(list(self.items()))

        updateValue, removeKey = dict.__setitem__, dict.__delitem__

    kept = {}
    handle = SimpleNamespace(getMapState=lambda name, *_: kept.setdefault(name, Entries()))
    part = pairing.Pairing(idle_flush=False)
    part.init(handle)

    def batch(source, at):
        rows = [dict(capture_id=f"c{i}", source=source, tokens_input=9, tokens_output=9, tokens_cache=0, timestamp_ms=at, arrival_ms=at, arrival_seq=0, dedup_id=f"{source}{i}", flush_ms=at + 20_000) for i in range(50)]
        return list(part.handleInputRows((0,), iter([SimpleNamespace(row=json.dumps(r)) for r in rows]), None))

    assert batch("jsonl", 1_000) == [] and len(kept["waiting"]) == 50
    pairs = batch("otel", 2_000)
    assert len(pairs) == 50 and not kept["waiting"] and not kept["memory"] and Entries.calls == 4
    assert all(json.loads(p.row)["capture_id"] == json.loads(p.twin)["capture_id"] for p in pairs)


def test_values_survive_the_state(spark, tmp_path):
    t = 1_700_000_000_000
    odd = [
        dict(source=s, timestamp_ms=t + i, arrival_ms=t + 30_000 * i + k, tokens_output=1000 * i, tokens_cache=(1 << 62) + i, model='a"b\\c\n\u00e9\u2028 </x>', prompt_id=p, event_id=f"{s}{i}",
             session_id="", workspace=w, cost_usd=c, duration_ms=0, capture_id=f"c{i % 3}")
        for i, (p, w, c) in enumerate([(None, "/w", 0.1 + 0.2), ("", None, 5e-324), ("p\t", "\\\\?\\x", float("nan")), ("q", "", float("-inf")), (None, None, -0.0), ("r", "/z", None)])
        for k, s in enumerate(["jsonl", "otel", "cursor"] if i % 2 else ["jsonl", "cursor"])
    ]
    rows = raw(spark, odd)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pairing.correlate_stream(ingest.stream_raw_turns(spark, str(tmp_path / "in")), idle_flush=False)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
    writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).unionByName(pairing.drain(spark, str(tmp_path / "state")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, correlate(rows).select(*got.columns).collect()))


def test_store_is_idempotent(spark, sf_dir, tmp_path):
    raws, sessions = fx.raw_turns(spark, sf_dir).select(*RAW_TURN.fieldNames()), fx.sessions(spark, sf_dir)
    turns = correlate(raws)
    write = sinks.attributed_sink(lambda: sessions, str(tmp_path / "out"), "turns")
    write(turns, 0)
    write(turns, 0)  # the same micro-batch again after a failure
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert same(stored.select("turn_id", "attempt_id"), attribute(turns, sessions).select("turn_id", "attempt_id"))
