"""Chat-session documents and the mutation logs that build them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import jsonx
from turnlake.functions.models import resolve_model
from turnlake.functions.numbers import chars_to_tokens
from turnlake.functions.rows import keep_rows
from turnlake.functions.text import file_stem
from turnlake.operators.segments import BLOCK
from turnlake.schemas import conform_raw
from turnlake.sources.lines import LINE_COLUMNS, read_documents, read_lines

# Where a request keeps its text, names, ids and times.
CONTENT_KEYS = ["value", "text", "parts"]
MODEL_PATHS = ["$.modelId", "$.result.metadata.modelId", "$.result.metadata.model", "$.model"]
ID_KEYS = ["$.requestId", "$.id", "$.responseId"]
TIME_KEYS = ["$.timestamp", "$.requestTimestamp"]
ROUNDS = "$.result.metadata.toolCallRounds"


def parse_chat_documents(docs: DataFrame, observed_ms: Column | int = 0) -> DataFrame:
    """Estimated turns, one per request that has a response.

    ``docs``: ``capture_id, file_stem, doc``.  Thinking parts of a response go
    to the thinking bucket (recorded per-round counts win over the estimate),
    the rest to the output.  The first model name that resolves is taken.
    """
    observed = F.lit(observed_ms) if isinstance(observed_ms, int) else observed_ms
    req = F.col("_req")
    rows = docs.select(
        "capture_id",
        "file_stem",
        F.posexplode(jsonx.items(F.try_parse_json("doc"), "$.requests")).alias("_i", "_req"),
    )
    response = jsonx.field(req, "$.response")
    sized = rows.withColumns(
        {
            "_all": jsonx.content_chars(response, CONTENT_KEYS),
            "_visible": jsonx.content_chars(response, CONTENT_KEYS, stop_kind="thinking"),
            "_asked": jsonx.content_chars(jsonx.field(req, "$.message"), CONTENT_KEYS),
        }
    )
    sized = keep_rows(sized, F.col("_all") > 0)
    rounds = jsonx.items(req, ROUNDS)
    recorded = F.coalesce(
        F.aggregate(
            rounds,
            F.lit(0).cast("bigint"),
            lambda acc, r: acc + F.coalesce(jsonx.count(r, "$.thinking.tokens"), F.lit(0).cast("bigint")),
        ),
        F.lit(0).cast("bigint"),
    )
    routed = F.filter(
        F.transform(rounds, lambda r: resolve_model(jsonx.text(r, "$.phaseModelId"))), lambda m: m.isNotNull()
    )
    model = F.coalesce(*[resolve_model(jsonx.text(req, p)) for p in MODEL_PATHS], F.try_element_at(routed, F.lit(1)))
    ident = F.coalesce(jsonx.first_text(req, *ID_KEYS), F.concat(F.lit("idx-"), F.col("_i").cast("string")))
    keyed = sized.withColumns(
        {
            "_key": F.concat("file_stem", F.lit(":"), ident),
            "timestamp_ms": F.coalesce(jsonx.first_integer(req, *TIME_KEYS), observed.cast("bigint")),
            "_recorded": recorded,
            "model": model,
        }
    )
    estimate = chars_to_tokens(F.col("_all") - F.col("_visible"))
    return conform_raw(
        keyed,
        source=F.lit("copilot"),
        harness=F.lit("copilot_chat"),
        tokens_input=chars_to_tokens("_asked"),
        tokens_output=chars_to_tokens("_visible"),
        tokens_thinking=F.when(F.col("_recorded") == 0, estimate).otherwise(F.col("_recorded")),
        tokens_cache=F.lit(0),
        prompt_id=F.col("_key"),
        session_id=F.col("file_stem"),
        counts_estimated=F.lit(True),
        event_id=F.col("_key"),
        arrival_ms=F.col("timestamp_ms"),
        arrival_seq=F.col("_i"),
    )


def recognized_documents(docs: DataFrame) -> DataFrame:
    """Does each container hold a chat session at all (input of source health)?"""
    found = jsonx.items(F.try_parse_json("doc"), "$.requests")
    return docs.withColumn("recognized", found.isNotNull()).withColumn("turns", F.coalesce(F.size(found), F.lit(0)))


def _slot(root: Any, path: list) -> tuple[Any, Any] | None:
    """Parent and last segment of ``path``, missing levels created."""
    holder, seg = [root], 0
    for nxt in path:
        cur = holder[seg]
        if isinstance(nxt, str):
            if cur is None:
                cur = holder[seg] = {}
            if not isinstance(cur, dict):
                return None
            cur.setdefault(nxt, None)
        elif isinstance(nxt, int) and not isinstance(nxt, bool) and nxt >= 0:
            if cur is None:
                cur = holder[seg] = []
            if not isinstance(cur, list):
                return None
            if nxt == len(cur):
                cur.append(None)
            if nxt >= len(cur):
                return None
        else:
            return None
        holder, seg = cur, nxt
    return holder, seg


class _Replay:
    """One document being rebuilt."""

    def __init__(self) -> None:
        self.started = False
        self.doc: Any = None

    def apply(self, line: str) -> None:
        try:
            entry = json.loads(line)
        except ValueError:
            return
        if not isinstance(entry, dict) or "v" not in entry:
            return
        kind, value = entry.get("kind"), entry["v"]
        if isinstance(kind, bool):
            return
        if kind == 0:
            self.started, self.doc = True, value
            return
        path = entry.get("k")
        if kind not in (1, 2) or not self.started or not isinstance(path, list):
            return
        if not path:
            box = [self.doc]
            holder, seg = box, 0
        else:
            if self.doc is None:
                self.doc = {} if isinstance(path[0], str) else []
            found = _slot(self.doc, path)
            if found is None:
                return
            box, (holder, seg) = None, found
        if kind == 1:
            holder[seg] = value
        else:
            if holder[seg] is None:
                holder[seg] = []
            if isinstance(holder[seg], list):
                holder[seg].extend(value if isinstance(value, list) else [value])
        if box is not None:
            self.doc = box[0]


def _replay_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rebuild the documents of a partition sorted by log and position."""
    key, state = None, None
    for pdf in batches:
        done = []
        for cap, log, line in zip(pdf["capture_id"], pdf["log_id"], pdf["line"]):
            if (cap, log) != key:
                if state is not None and state.started:
                    done.append((*key, json.dumps(state.doc, ensure_ascii=False)))
                key, state = (cap, log), _Replay()
            state.apply(line)
        if done:
            yield pd.DataFrame(done, columns=["capture_id", "log_id", "doc"])
    if state is not None and state.started:
        yield pd.DataFrame([(*key, json.dumps(state.doc, ensure_ascii=False))], columns=["capture_id", "log_id", "doc"])


def replay_mutation_log(lines: DataFrame) -> DataFrame:
    """One document per log: snapshots, sets and appends in line order.

    A snapshot replaces everything before it, so lines before a log's last
    snapshot are dropped first (a small aggregate), and a log without one has
    no document.  The rest streams through its partition in order with only
    the document as state.
    """
    doc = F.try_parse_json("line")
    is_snapshot = F.coalesce(jsonx.integer(doc, "$.kind") == 0, F.lit(False)) & jsonx.present(doc, "$.v")
    place = F.struct(BLOCK, "pos")
    starts = lines.where(is_snapshot).groupBy("capture_id", "log_id").agg(F.max(place).alias("_from"))
    live = lines.join(starts, ["capture_id", "log_id"]).where(place >= F.col("_from")).select(*LINE_COLUMNS)
    ordered = live.repartition("capture_id", "log_id").sortWithinPartitions("capture_id", "log_id", BLOCK, "pos")
    return ordered.select("capture_id", "log_id", "line").mapInPandas(
        _replay_sorted, "capture_id string, log_id string, doc string"
    )


def read_chat_sessions(spark: SparkSession, documents: str | None = None, logs: str | None = None, observed_ms: int = 0) -> DataFrame:
    """Turns of whole-file documents (``.json``) and mutation logs (``.jsonl``)."""
    parts = []
    if documents:
        docs = read_documents(spark, documents)
        parts.append(docs.select("capture_id", file_stem("file").alias("file_stem"), "doc"))
    if logs:
        rebuilt = replay_mutation_log(read_lines(spark, logs))
        parts.append(rebuilt.select("capture_id", file_stem("log_id").alias("file_stem"), "doc"))
    docs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return parse_chat_documents(docs, observed_ms)
