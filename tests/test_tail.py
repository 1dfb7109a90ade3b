"""Growing files: lines between offsets, and the stream over them."""

import io
import json

import pytest
from helpers import lines
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.sources.rollout import classify, usage_deltas
from turnlake.streaming import tail
from turnlake.streaming.ingest import stream_transcripts
from turnlake.streaming.rollouts import carried_states, stream_rollouts


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80).map(lambda b: b.replace(b"\x00", b"\n")), st.integers(1, 20), st.integers(1, 9))
def test_ranges_hold_every_line_once(data, range_bytes, block):
    stream = io.BytesIO(data)
    end = tail.last_line_end(stream, len(data), block)
    assert end == data.rfind(b"\n") + 1
    got = [x for part in tail.ranges({}, {"f": end}, range_bytes) for x in tail.lines_in(stream, part, block)]
    want, at = [], 0
    for line in data[:end].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_offsets_decide_ranges():
    places = lambda start, end: [(r.file, r.first, r.stop) for r in tail.ranges(start, end, 10)]
    assert places({}, {}) == places({"a": 5}, {"a": 5}) == places({"a": 5}, {}) == []
    assert places({"a": 5}, {"a": 18, "b": 3}) == [("a", 5, 15), ("a", 15, 18), ("b", 0, 3)]
    assert places({"a": 18}, {"a": 6}) == [("a", 0, 6)]
    assert places({"a": 18}, {"a": 0}) == []


@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 1000), max_size=60), st.integers(1, 9), st.integers(1, 500))
def test_bundles_hold_every_range_once(ends, tasks, range_bytes):
    found = tail.ranges({}, ends, range_bytes)
    made = tail.bundles(found, tasks, range_bytes)
    assert [r for b in made for r in b.ranges] == found and all(b.ranges for b in made)


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.jsonl").write_text(f"{i}\n{i}b\n")
    rows = tail.read_tailed_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.log_id, r.line) for r in rows.collect()) == sorted((f"{i}.jsonl", line) for i in range(300) for line in (f"{i}", f"{i}b"))


def user(i):
    return json.dumps({"type": "user", "uuid": f"u{i}", "message": {"content": "go"}})


def turn(i):
    return json.dumps({"type": "assistant", "timestamp": "2025-03-04T05:06:07Z", "message": {"id": f"m{i}", "usage": {"input_tokens": i}}})


class Tailed:
    """A log folder, and what a query that is started again and again has written."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        (folder / "logs" / "a").mkdir(parents=True)

    def write(self, name, *texts, add=True):
        with (self.folder / "logs" / "a" / name).open("ab" if add else "wb") as f:
            f.write("".join(texts).encode() if not isinstance(texts[0], bytes) else b"".join(texts))

    def run(self):
        lines = tail.stream_tailed_lines(self.spark, str(self.folder / "logs"), **self.options)
        writer = stream_transcripts(lines).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state"))
        writer.option("path", str(self.folder / "out")).trigger(availableNow=True).start().awaitTermination()
        found = self.spark.read.schema("event_id string, prompt_id string").parquet(str(self.folder / "out"))
        return sorted((r.event_id, r.prompt_id) for r in found.collect())


def test_files_grow_and_are_cut_short(spark, tmp_path):
    logs = Tailed(spark, tmp_path, range_bytes=100)
    logs.write("x.jsonl", user(0) + "\n", turn(1) + "\r\n\n", turn(2)[:20])
    logs.write("other.txt", turn(9) + "\n")
    assert logs.run() == [("m1", "u0")]
    logs.write("x.jsonl", turn(2)[20:] + "\n", user(3) + "\n")
    logs.write("y.jsonl", b"\xff\n", turn(5).encode() + b"\n")
    first = [("m1", "u0"), ("m2", "u0"), ("m5", "")]
    assert [(m, p or "") for m, p in logs.run()] == first
    assert [(m, p or "") for m, p in logs.run()] == first
    # Shorter than before: from the top, without the prompt that was open.
    logs.write("x.jsonl", turn(7) + "\n", add=False)
    assert [(m, p or "") for m, p in logs.run()] == [*first, ("m7", "")]
    logs.write("x.jsonl", user(8) + "\n" + turn(8) + "\n")
    assert [(m, p or "") for m, p in logs.run()] == [*first, ("m7", ""), ("m8", "u8")]


def test_history_may_be_left_out(spark, tmp_path):
    logs = Tailed(spark, tmp_path)
    logs.write("x.jsonl", user(0) + "\n", turn(1) + "\n")
    logs.options["ends"] = tail.current_ends(str(tmp_path / "logs"))
    assert tail.read_tailed_lines(spark, str(tmp_path / "logs")).count() == 2
    assert logs.run() == []
    logs.write("x.jsonl", user(2) + "\n" + turn(2) + "\n")
    assert logs.run() == [("m2", "u2")]


def test_tenants_from_paths(spark, tmp_path):
    tenant = F.regexp_extract("log_id", "^([^/]+)/", 1)
    lines = tail.stream_tailed_lines(spark, str(tmp_path), capture_id=tenant)
    assert lines.isStreaming and lines.columns == ["capture_id", "log_id", "chunk_no", "pos", "line", "restarts"]


@pytest.mark.parametrize("path", ["file:/tmp/x", "file:///tmp/x", "/tmp/x"])
def test_spellings_of_local_folders(path):
    assert tail.open_folder(path)[1] == "/tmp/x"


def context(**payload):
    return json.dumps({"type": "turn_context", "payload": payload})


def usage(total, last=None):
    counts = lambda n: {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": n // 2, "reasoning_output_tokens": 0}
    info = {"total_token_usage": counts(total)} | ({"last_token_usage": counts(last)} if last is not None else {})
    return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": info}})


META = json.dumps({"type": "session_meta", "payload": {"id": "ses", "cwd": "/w/x"}})
PROMPT = json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "go"}})


def test_rollouts_go_on_after_history(spark, tmp_path):
    """A stream over growing files that starts where the history ended, against the batch job over all lines."""
    logs = tmp_path / "logs"
    logs.mkdir()
    old = [META, context(model="gpt-5.3"), PROMPT, usage(100), "not json", usage(150)]
    new = [usage(180), PROMPT, context(model="no-such-model"), usage(200, last=7), usage(260), usage(260)]
    (logs / "a.jsonl").write_text("\n".join(old) + "\n" + new[0][:30])
    ends = tail.current_ends(str(logs))
    history = carried_states(tail.read_tailed_lines(spark, str(logs), ends))
    state = history.first()
    assert (state.model is not None, state.workspace, state.prompt_id, state.total_input, state.seq) == (True, "/w/x", "ses#p1", 150, 5)

    def run():
        turns = stream_rollouts(tail.stream_tailed_lines(spark, str(logs), ends=ends), history)
        writer = turns.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.read.schema(turns.schema).parquet(str(tmp_path / "out")).orderBy("log_id", "arrival_seq").select("log_id", *COMPARED).collect()]

    (logs / "a.jsonl").write_text("\n".join([*old, *new[:3]]) + "\n")
    assert len(run()) == 1
    (logs / "a.jsonl").write_text("\n".join([*old, *new]) + "\n")
    (logs / "b.jsonl").write_text("\n".join([PROMPT, usage(9)]) + "\n")
    got = run()
    whole = lines(spark, [*old, *new], log="a.jsonl").unionByName(lines(spark, [PROMPT, usage(9)], log="b.jsonl"))
    batch = usage_deltas(classify(whole)).orderBy("log_id", "arrival_seq").select("log_id", *COMPARED).collect()
    assert got == [tuple(r) for r in batch if r.log_id == "b.jsonl" or r.arrival_seq >= 5]
    assert [r[3] for r in got] == [30, 7, 60, 9] and got[0][1] != got[1][1]
    # Cut short: the old totals count no more.
    (logs / "b.jsonl").write_text(usage(4) + "\n")
    assert run()[-1][1:5] == (None, None, 4, 2)


COMPARED = ["model", "prompt_id", "tokens_input", "tokens_output", "session_id", "workspace", "arrival_seq"]


def test_logs_share_the_state_of_their_bucket(spark, tmp_path):
    """Many logs make few state entries, each log still goes on from its own place."""
    logs = [f"log{i}" for i in range(60)]
    part = lambda *texts: [(log, pos, text(i) if callable(text) else text) for i, log in enumerate(logs) for pos, text in enumerate(texts)]
    frame = lambda rows, at: spark.createDataFrame([("c", log, 0, at + pos, line) for log, pos, line in rows], "capture_id string, log_id string, chunk_no bigint, pos bigint, line string")
    history = carried_states(frame(part(META, PROMPT, lambda i: usage(100 * i)), 0).where("log_id <> 'log7'"))
    for step in range(2):
        frame(part(lambda i: usage(100 * i + (step + 1) * (i + 1))), 10 + step).coalesce(1).write.parquet(str(tmp_path / "in" / f"{step}"))
        stream = stream_rollouts(spark.readStream.schema("capture_id string, log_id string, chunk_no bigint, pos bigint, line string").parquet(str(tmp_path / "in" / "*")), history, buckets=4)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    want = {(f"log{i}", 10 + step): (i + 1 if i != 7 or step else 708, "ses#p1" if i != 7 else None) for i in range(60) for step in range(2)}
    assert {(r.log_id, r.pos): (r.tokens_input, r.prompt_id) for r in got} == want and len(got) == len(want)
