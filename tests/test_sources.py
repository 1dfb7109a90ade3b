import json

from helpers import lines, raw
from pyspark.sql import functions as F

from turnlake.operators.dedup import keep_first
from turnlake.sources import chat, kv, otlp, rollout, tables, transcript, workspace
from turnlake.sources.lines import read_lines


def attr(key, **value):
    return {"key": key, "value": value}


def docs(spark, *texts):
    return spark.createDataFrame([("c1", t) for t in texts], "capture_id string, doc string")


def test_otlp_export(spark):
    record = {
        "timeUnixNano": "1790000123456789012",
        "body": {"stringValue": "api_request"},
        "attributes": [
            attr("model", stringValue="claude-haiku-4-5"), attr("input_tokens", intValue="211"), attr("output_tokens", intValue=97),
            attr("cache_read_tokens", intValue="41"), attr("cache_creation_tokens", stringValue="18"), attr("cost_usd", doubleValue=0.0457),
            attr("duration_ms", intValue="2250"), attr("prompt.id", stringValue="p-7"),
        ],
    }
    other = {"body": {"stringValue": "tool_result"}, "attributes": []}
    named = {"attributes": [attr("event.name", stringValue="api_request"), attr("input_tokens", intValue="-5")]}
    doc = {
        "resourceLogs": [
            {"resource": {"attributes": [attr("session.id", stringValue="sess-9"), attr("model", stringValue="r")]},
             "scopeLogs": [{"logRecords": [record, other, named]}]}
        ]
    }
    turns, bad = otlp.parse_otlp(docs(spark, json.dumps(doc), "{}", "not json", '{"resourceMetrics":[]}'), 77)
    a, b = sorted(turns.collect(), key=lambda r: -r.tokens_input)
    assert (a.tokens_input, a.tokens_output, a.tokens_cache, a.tokens_thinking) == (211, 97, 59, 0)
    assert (a.cost_usd, a.duration_ms, a.prompt_id, a.session_id, a.timestamp_ms) == (0.0457, 2250, "p-7", "sess-9", 1790000123456)
    assert (b.model, b.tokens_input, b.timestamp_ms, b.event_id) == ("r", 0, 77, None)
    assert [r.doc for r in bad.collect()] == ["not json"]


def user(content, **kw):
    return json.dumps({"type": "user", "message": {"content": content}, **kw})


def assistant(mid, n=5, blocks=(), **kw):
    message = {"id": mid, "model": "claude-haiku-4-5", "usage": {"input_tokens": n, "output_tokens": 2 * n, "cache_read_input_tokens": 1}}
    return json.dumps({"type": "assistant", "timestamp": "2026-06-16T19:00:00.000Z", "message": message | {"content": list(blocks)}, **kw})


def test_transcript_prompts_and_block_lines(spark):
    think = {"type": "thinking", "thinking": "x" * 9}
    texts = [
        assistant("m0"),
        user("first", uuid="u1"),
        assistant("m1", blocks=[think]) + "\r",
        assistant("m1"),
        user([{"type": "tool_result"}], uuid="no"),
        user("  ", uuid="no"), user("<command-name>x", uuid="no"), user("sub", uuid="no", isSidechain=True), user("meta", uuid="no", isMeta=True),
        assistant("m2"),
        user([{"type": "text", "text": "hi"}], uuid="u2"),
        assistant(None, requestId="r3"),
        "junk", '{"type":"assistant","message":{"id":"x"}}', '{"type":"assistant","message":{"id":"nul","usage":null}}',
    ]
    got = transcript.parse_transcripts(lines(spark, texts)).orderBy("arrival_seq").collect()
    assert [(r.event_id, r.prompt_id) for r in got] == [
        ("m0", None), ("m1", "u1"), ("m1", "u1"), ("m2", "u1"), ("r3", "u2"), ("nul", "u2")
    ]
    assert (got[1].tokens_thinking, got[1].tokens_cache, got[1].timestamp_ms) == (3, 1, 1781636400000)
    assert [r.tokens_thinking for r in keep_first(transcript.parse_transcripts(lines(spark, texts))).where("event_id = 'm1'").collect()] == [3]


def test_prompt_without_uuid_is_named_by_its_line(spark):
    import hashlib

    line = user("hello")
    got = transcript.parse_transcripts(lines(spark, [line, assistant("m1")])).first()
    assert got.prompt_id == hashlib.sha256(line.encode() + b"\0").hexdigest()[:16]


def test_prompts_cross_file_splits(spark, tmp_path):
    """A log read as many splits gives the prompts of the whole log."""
    texts = []
    for p in range(40):
        texts.append(user(f"prompt {p}", uuid=f"u{p}"))
        texts += [assistant(f"m{p}-{i}") for i in range(p % 5)]
    (tmp_path / "s.jsonl").write_text("\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        read = read_lines(spark, str(tmp_path))
        assert read.select("_block").distinct().count() > 5
        got = transcript.parse_transcripts(read).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.event_id, r.prompt_id) for r in got} == {(f"m{p}-{i}", f"u{p}") for p in range(40) for i in range(p % 5)}


def usage(kind, i, c, o, r):
    return {kind: {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}}


def counted(info):
    return json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": info}})


def test_rollout_deltas_and_context(spark):
    texts = [
        json.dumps({"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}}),
        json.dumps({"type": "turn_context", "payload": {"cwd": "/other", "model": "gpt-5.3"}}),
        json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "go"}}),
        counted(usage("total_token_usage", 100, 0, 50, 10)),
        counted(None),
        counted(usage("total_token_usage", 250, 0, 120, 40)),
        json.dumps({"type": "turn_context", "payload": {"model": "who-knows"}}),
        counted(usage("last_token_usage", 12, 2, 5, 0) | usage("total_token_usage", 900, 2, 500, 50)),
        json.dumps({"type": "response_item", "payload": {"role": "user"}}),
        counted(usage("total_token_usage", 900, 2, 520, 50)),
        counted(usage("total_token_usage", 900, 2, 520, 50)),
    ]
    got = rollout.parse_rollouts(lines(spark, texts), 9).orderBy("arrival_seq").collect()
    assert [(r.tokens_input, r.tokens_output, r.tokens_thinking, r.tokens_cache) for r in got] == [
        (100, 50, 10, 0), (150, 70, 30, 0), (10, 5, 0, 2), (0, 20, 0, 0)
    ]
    assert [r.model for r in got] == ["gpt-5-3-codex", "gpt-5-3-codex", None, None]
    assert [r.prompt_id for r in got] == ["s1#p1"] * 3 + ["s1#p2"]
    assert {r.workspace for r in got} == {"/w"} and {r.timestamp_ms for r in got} == {9}


def test_rollout_blocks_do_not_matter(spark):
    """One log cut into many blocks equals the same log in one block."""
    from turnlake.operators.segments import BLOCK

    total, texts = [0, 0, 0, 0], [json.dumps({"type": "session_meta", "payload": {"id": "s", "cwd": "/w", "model": "gpt-5"}})]
    for i in range(200):
        total = [t + (i * k) % 13 for t, k in zip(total, (3, 1, 2, 5))]
        texts.append(counted(usage("total_token_usage", *total)))
        if i % 9 == 0:
            texts.append(json.dumps({"type": "event_msg", "payload": {"type": "user_message"}}))
    whole = lines(spark, texts)
    cut = whole.withColumn(BLOCK, F.floor(F.col("pos") / 7).cast("bigint"))
    a, b = (sorted(map(tuple, rollout.parse_rollouts(x).collect()), key=repr) for x in (whole, cut))
    assert a == b and len(a) > 150


def test_rollout_events_move_once(spark):
    """Logs of one block are read back as they were written; several blocks hand on sessions, prompts, models and totals."""
    from turnlake.operators.segments import BLOCK

    def log(name, size):
        total, texts = [0, 0, 0, 0], []
        for i in range(size):
            total = [t + (i * k) % 11 for t, k in zip(total, (5, 1, 2, 3))]
            if i % 23 == 4:
                texts.append(json.dumps({"type": "session_meta", "payload": {"id": f"{name}-{i}", "cwd": f"/w/{name}/{i}"}}))
            if i % 17 == 2:
                texts.append(json.dumps({"type": "turn_context", "payload": {"model": ["gpt-5", "nobody", "gpt-5.3"][i % 3]}}))
            if i % 13 == 1:
                texts.append(json.dumps({"type": "event_msg", "payload": {"type": "user_message"}}))
            texts.append(counted(usage("last_token_usage", i % 5, 0, 1, 0) if i % 7 == 3 else usage("total_token_usage", *total)))
        return lines(spark, texts, log=name)

    logs = log("long", 150).unionByName(log("short", 4)).unionByName(log("other", 60))
    whole = rollout.usage_deltas(rollout.classify(logs))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert len(want) > 150 and len({r[8] for r in want}) > 10
    for size in (1, 6, 50):
        cut = logs.withColumn(BLOCK, F.floor(F.col("pos") / size).cast("bigint"))
        assert sorted(map(tuple, rollout.usage_deltas(rollout.classify(cut)).collect()), key=repr) == want


def test_chat_mutation_log(spark):
    request = {
        "requestId": "ask-4", "timestamp": 1785551234567, "modelId": "copilot/auto", "message": {"text": "how are you"},
        "response": [{"value": "visible"}, {"kind": "thinking", "value": "hidden"}],
        "result": {"metadata": {"toolCallRounds": [{"thinking": {"tokens": 70}}, {"phaseModelId": "gpt-5.3-codex", "thinking": {"tokens": 9}}]}},
    }
    texts = [
        json.dumps({"kind": 1, "k": ["x"], "v": 1}),
        json.dumps({"kind": 0, "v": {"requests": [{"requestId": "stale", "response": "old"}]}}),
        json.dumps({"kind": 0, "v": {}}),
        json.dumps({"kind": 2, "k": ["requests"], "v": [request]}),
        "broken", json.dumps({"kind": 7, "k": [], "v": 1}), json.dumps({"kind": 1, "k": ["requests", 5, "z"], "v": 1}),
        json.dumps({"kind": 2, "k": ["requests"], "v": {"requestId": "empty", "response": []}}),
        json.dumps({"kind": 1, "k": ["requests", 1, "deep", "er"], "v": [1]}),
    ]
    replayed = chat.replay_mutation_log(lines(spark, texts, log="s-1").unionByName(lines(spark, texts[:1], log="none")))
    rows = replayed.collect()
    assert [r.log_id for r in rows] == ["s-1"]
    assert json.loads(rows[0].doc)["requests"][1]["deep"] == {"er": [1]}
    got = chat.parse_chat_documents(replayed.withColumnRenamed("log_id", "file_stem")).collect()
    assert len(got) == 1
    t = got[0]
    assert (t.event_id, t.model, t.tokens_input, t.tokens_output, t.tokens_thinking) == ("s-1:ask-4", "gpt-5-3-codex", 3, 2, 79)
    assert t.timestamp_ms == 1785551234567 and t.counts_estimated


def test_kv_store(spark):
    def b(i, **kw):
        return ("c1", f"bubbleId:comp-A:{i}", json.dumps(kw))

    rows = [
        ("c1", "composerData:comp-A", json.dumps({
            "fullConversationHeadersOnly": [{"bubbleId": x} for x in ("u1", "z", "a", "u2", "b")],
            "modelConfig": {"selectedModels": [{"modelId": "claude-4.5-haiku"}], "modelName": "gpt-5"},
            "workspaceIdentifier": {"id": "h1", "uri": {"fsPath": "/w/"}},
        })),
        b("u1", type=1, modelInfo={"modelName": "gpt-5.5"}),
        b("z", type=2, createdAt=5, text="12345", thinking={"text": "1234567"}, toolFormerData={"rawArgs": "", "result": "123456789"}),
        b("a", type=2, createdAt=1, tokenCount={"inputTokens": 3, "outputTokens": 4}),
        b("u2", type=1, modelInfo={"modelName": "nobody-knows"}),
        b("b", type=2, text="x", modelInfo={"modelName": "gpt-5-mini"}),
        b("later", createdAt="2026-06-16T19:00:00Z", tokenCount={"outputTokens": 2}),
        b("void", type=2), b("tool", type=3, text="x"), ("c1", "bubbleId:comp-A:bad", "nope"), ("c1", "other", "{}"),
    ]
    got = kv.parse_kv_turns(spark.createDataFrame(rows, "capture_id string, key string, value string"), 42)
    by = {r.event_id.split(":")[1]: r for r in got.collect()}
    assert set(by) == {"z", "a", "b", "later"}
    assert [by[k].prompt_id for k in ("z", "a", "b", "later")] == ["comp-A:u1", "comp-A:u1", "comp-A:u2", "comp-A:u2"]
    assert [by[k].model for k in ("z", "a", "b", "later")] == ["gpt-5-5", "gpt-5-5", "gpt-5-mini", "claude-haiku-4-5"]
    assert (by["z"].tokens_input, by["z"].tokens_output, by["z"].tokens_thinking, by["z"].counts_estimated) == (3, 2, 2, True)
    assert (by["a"].tokens_input, by["a"].tokens_output, by["a"].counts_estimated) == (3, 4, False)
    assert by["later"].timestamp_ms == 1781636400000 and by["b"].timestamp_ms == 42


def test_stub_composers(spark):
    stub = {"allComposers": [{"composerId": "a"}], "selectedComposerIds": ["c", {"composerId": "d"}], "lastFocusedComposerIds": ["a", 5]}
    df = spark.createDataFrame([("h", json.dumps(stub))], "storage_id string, value string")
    assert sorted(r.composer_id for r in kv.stub_composers(df).collect()) == ["a", "c", "d"]


def test_manifests(spark):
    good = {"schema_version": 1, "level_id": "l", "baseline_hash": "h", "file_allowlist": ["src/**"], "extra": 1}
    rows = [
        ("ok", json.dumps(good)), ("bad", "{oops"), ("new", json.dumps(good | {"schema_version": 2})),
        ("id", json.dumps(good | {"level_id": " \t"})), ("hash", json.dumps({k: v for k, v in good.items() if k != "baseline_hash"})),
    ]
    ok, rejected = tables.parse_manifests(spark.createDataFrame(rows, "file string, doc string"))
    assert [(r.file, r.allow_regexes) for r in ok.collect()] == [("ok", ["(?s)^(?:src/.+)$"])]
    assert {r.file: r.reason for r in rejected.collect()} == {
        "bad": "malformed", "new": "unsupported_schema", "id": "missing_level_id", "hash": "missing_baseline_hash"
    }


def test_table_readers(spark, tmp_path):
    (tmp_path / "live.json").write_text(json.dumps({"version": 1, "session_id": "s1", "workspace": "/w", "started_at_ms": 5}))
    (tmp_path / "old.json").write_text(json.dumps({"version": 9, "session_id": "s2"}))
    assert [r.session_id for r in tables.read_sessions(spark, str(tmp_path / "*.json")).collect()] == ["s1"]
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "c.json").write_text(json.dumps({"suite": "x", "cases": [{"name": "a", "stdin": "1", "expected_stdout": "2"}]}))
    assert tables.read_cases(spark, str(tmp_path / "cases")).first().expected_stdout == "2"


def test_workspaces_and_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "TASK_WORKSPACES", 2)
    root = tmp_path / "ws"
    assert not root.exists()
    root.mkdir()
    assert workspace.read_workspace(spark, str(root), ".meta").count() == 0
    for name in ("w1", "w2", "w3", "empty"):
        (root / name / "src" / ".git").mkdir(parents=True)
        if name != "empty":
            (root / name / "src" / "a.go").write_bytes(b"x")
        (root / name / "src" / ".git" / "b").write_bytes(b"x")
        (root / name / "README.md").write_bytes(b"x")
    (root / "w1" / "src" / "README.md").write_bytes(b"inner")
    (root / "w2" / "src" / "code").symlink_to(root / "w1" / "src")  # a folder
    (root / "w3" / "src" / ".git" / "c").symlink_to("b")  # pruned with its folder
    (root / "stray.txt").write_bytes(b"x")
    entries = workspace.read_workspace(spark, str(root), ".meta")
    files, refused = workspace.without_links(entries)
    assert sorted((r.workspace, r.path, bytes(r.content)) for r in files.collect()) == [("w1", "src/README.md", b"inner"), ("w1", "src/a.go", b"x"), ("w3", "src/a.go", b"x")]
    assert [tuple(r) for r in refused.collect()] == [("w2", "symlink is not allowed in a workspace: src/code")]


def test_raw_contract(spark):
    assert raw(spark, [{}]).columns[0] == "capture_id"
