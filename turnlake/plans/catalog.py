"""Every registered query: a Spark plan and, where SQL can say it, its check.

All of them read the whole test tables (through :mod:`turnlake.fixtures`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.functions.models import canonical_model_id, resolve_model
from turnlake.functions.numbers import chars_to_tokens
from turnlake.functions.text import comparable_path, glob_to_regex_column, log_folder_name
from turnlake.operators import attempts as A
from turnlake.operators import content as C
from turnlake.operators import grading as G
from turnlake.operators import integrity as I
from turnlake.operators import ledger as L
from turnlake.operators import paths as P
from turnlake.operators import reports as R
from turnlake.operators import scoring as S
from turnlake.operators import sessions as Z
from turnlake.operators.correlate import correlate, pairing_fates, with_flush_time
from turnlake.operators.dedup import keep_first, with_ids
from turnlake.operators.levels import resolve_level
from turnlake.operators.normalize import normalize, scope_to_workspace, turn_harness
from turnlake.operators.redact import redact, redact_bundles
from turnlake.plans import checks as Q
from turnlake.plans.capture import capture, capture_totals, expected_spans
from turnlake.plans.score import best_case_scores, live_scores, running_scores
from turnlake.plans.submission import submission_records
from turnlake.operators.segments import BLOCK
from turnlake.schemas import RAW_TURN
from turnlake.session import checkpoint_dir, cut_lineage
from turnlake.sources import chat, kv, otlp, rollout, tables, transcript
from turnlake.sources.lines import lines_of
from turnlake.sources.registry import read_all
from turnlake.sources.workspace import read_workspace, without_links
from turnlake.streaming.ingest import stream_dedup, stream_raw_turns, stream_transcripts
from turnlake.streaming.pairing import correlate_stream, drain
from turnlake.streaming.rollouts import carried_states, stream_rollouts
from turnlake.streaming.store import TurnStore
from turnlake.streaming.tail import stream_tailed_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DOMAIN = "turn-ledger:v1"
META_DIR = ".meta"
KEY = A.KEY


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def _csv(c: str | Column) -> Column:
    return F.array_join(c, ",")


def _status(prefix: str, joined: str, sep: str) -> Column:
    """Status and details of a tagged union as one comparable text."""
    return F.coalesce(F.array_join(F.col(joined), sep), F.col(prefix))


def _flat(turns: DataFrame, *extra: str) -> DataFrame:
    agreement = F.when(F.col("agreement.status") == "disagree", _csv("agreement.fields")).otherwise(F.col("agreement.status"))
    plaus = F.when(F.col("plausibility.status") == "low", F.array_join("plausibility.reasons", "; ")).otherwise(F.lit(""))
    return turns.select(
        "capture_id", "turn_id", "model", "harness", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache",
        "prompt_id", "timestamp_ms", "confidence", "cost_usd", "duration_ms", _csv("sources").alias("sources"), "session_id",
        "workspace", agreement.alias("agreement"), plaus.alias("plausibility"), "emitted_ms", *extra,
    )


_FLAT = (
    "capture_id, turn_id, model, harness, tokens_input, tokens_output, tokens_thinking, tokens_cache, prompt_id, timestamp_ms, "
    "confidence, cost_usd, duration_ms, sources, session_id, workspace, agreement, plausibility, emitted_ms"
)


# --- capture ---------------------------------------------------------------


@query("turn_fingerprint", f"with {Q.IDS} select capture_id, arrival_seq, content_id, dedup_id from ids")
def _(spark, sf):
    return with_ids(fx.raw_turns(spark, sf)).select("capture_id", "arrival_seq", "content_id", "dedup_id")


@query(
    "dedup_keep_first",
    f"with {Q.UNIQUE} select capture_id, dedup_id, source, tokens_thinking, timestamp_ms, arrival_seq from uniq",
)
def _(spark, sf):
    return keep_first(fx.raw_turns(spark, sf)).select(
        "capture_id", "dedup_id", "source", "tokens_thinking", "timestamp_ms", "arrival_seq"
    )


@query(
    "normalize_turns",
    f"""with {Q.IDS} select capture_id, content_id as turn_id, coalesce(nullif(trim(model), ''), '') as model, harness, tokens_input,
    tokens_output, tokens_thinking, tokens_cache, prompt_id, timestamp_ms,
    {Q._CONF.format(m=Q._MODEL.format("model"), e="counts_estimated", s="source")} as confidence, cost_usd, duration_ms,
    source as sources, session_id, workspace, 'single' as agreement, {Q._plaus()} as plausibility, arrival_ms as emitted_ms from ids""",
)
def _(spark, sf):
    return _flat(normalize(fx.raw_turns(spark, sf)))


@query(
    "plausibility_flags",
    f"""with {Q.RAW} select plausibility, source, count(*) as n from (select source, {Q._plaus()} as plausibility from raw) t group by all""",
)
def _(spark, sf):
    flat = _flat(normalize(fx.raw_turns(spark, sf)))
    return flat.groupBy("plausibility", F.col("sources").alias("source")).agg(F.count("*").alias("n"))


@query(
    "scope_workspace",
    f"""with {Q.RAW} select capture_id, arrival_seq from raw
    where workspace is null or rtrim(workspace, '/') = '/ws/u' || substr(capture_id, 5)""",
)
def _(spark, sf):
    bound = F.concat(F.lit("\\\\?\\/ws/u"), F.substr("capture_id", F.lit(5)), F.lit("\\"))
    return scope_to_workspace(fx.raw_turns(spark, sf), bound).select("capture_id", "arrival_seq")


@query("correlate_fates", f"with {Q.CORRELATED} select capture_id, key, fate, partner, at_ms from fates")
def _(spark, sf):
    return pairing_fates(cut_lineage(with_flush_time(keep_first(fx.raw_turns(spark, sf)))))


def _arrivals(spark, sf, folder: str, rows: DataFrame, steps: int = 3):
    """Land ``rows`` in the order of arrival, a part at a time; yields the stream of all parts after each."""
    low, high = rows.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
    width = (high - low) // steps + 1 if low is not None else 1
    for part in range(steps):
        rows.where(F.expr(f"(arrival_ms - {low or 0}) div {width}") == part).write.parquet(f"{folder}/in/{part}")
        yield stream_raw_turns(spark, f"{folder}/in/*")


def _run_to_end(turns: DataFrame, folder: str) -> DataFrame:
    """Everything that a query over what has landed so far writes, with what it wrote before."""
    writer = turns.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return turns.sparkSession.read.schema(turns.schema).parquet(f"{folder}/out")


@query("dedup_stream", CHECKS["dedup_keep_first"])
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/dedup-{uuid.uuid4().hex}"
    for rows in _arrivals(spark, sf, folder, cut_lineage(fx.raw_turns(spark, sf)), steps=2):
        got = _run_to_end(stream_dedup(rows), folder)
    return got.select("capture_id", "dedup_id", "source", "tokens_thinking", "timestamp_ms", "arrival_seq")


@query("correlate_turns", f"with {Q.CORRELATED} select {_FLAT} from merged")
def _(spark, sf):
    return _flat(correlate(fx.raw_turns(spark, sf)))


# What a stream emits, and what it still holds back when it ends, is what the batch job finds.
@query("correlate_drained", CHECKS["correlate_turns"])
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/drained-{uuid.uuid4().hex}"
    unique = cut_lineage(keep_first(fx.raw_turns(spark, sf)).select(*RAW_TURN.fieldNames()))
    for rows in _arrivals(spark, sf, folder, unique):
        got = _run_to_end(correlate_stream(rows, idle_flush=False), folder)
    return _flat(got.unionByName(drain(spark, f"{folder}/state")))


@query(
    "merge_agreement",
    f"with {Q.CORRELATED} select sources, agreement, confidence, count(*) as n from merged group by all",
)
def _(spark, sf):
    flat = _flat(correlate(fx.raw_turns(spark, sf)))
    return flat.groupBy("sources", "agreement", "confidence").agg(F.count("*").alias("n"))


@query("capture_turns", f"with {Q.CAPTURED} select {_FLAT}, attempt_id, attempt_nonce from attributed")
def _(spark, sf):
    return _flat(capture(fx.raw_turns(spark, sf), fx.sessions(spark, sf)), "attempt_id", "attempt_nonce")


@query("capture_totals", f"with {Q.CAPTURED} select capture_id, attempt_id, count(*) as turns, {Q._SUMS} from attributed group by all")
def _(spark, sf):
    return capture_totals(fx.raw_turns(spark, sf), fx.sessions(spark, sf))


@query(
    "attribute_sessions",
    f"""with {Q.IDS}, {Q.SESSIONS} select i.capture_id, i.content_id as turn_id, i.arrival_ms as emitted_ms, s.session_id as attempt_id, s.attempt_nonce,
    coalesce(i.workspace, s.workspace) as workspace from ids i join sessions s on s.capture_id = i.capture_id
    and i.timestamp_ms >= s.started_at_ms and (s.stopped_at_ms is null or i.timestamp_ms <= s.stopped_at_ms)
    and (i.workspace is null or rtrim(i.workspace, '/') = s.workspace)""",
)
def _(spark, sf):
    done = Z.attribute(normalize(fx.raw_turns(spark, sf)), fx.sessions(spark, sf))
    return done.select("capture_id", "turn_id", "emitted_ms", "attempt_id", "attempt_nonce", "workspace")


@query(
    "gate_otlp_rows",
    f"""with {Q.RAW}, {Q.SESSIONS} select r.capture_id, r.arrival_seq from raw r where r.source = 'otel' and exists (
    select 1 from sessions s where s.capture_id = r.capture_id and s.otlp_token is not null and r.arrival_ms >= s.started_at_ms
    and (s.stopped_at_ms is null or r.arrival_ms < s.stopped_at_ms)
    and s.otlp_token = 'tok-' || substr(r.capture_id, 5) || '-' || cast(cast(floor((r.timestamp_ms - {fx.EPOCH}) / {fx.SLOT_MS}) as bigint) as varchar))""",
)
def _(spark, sf):
    slot = F.floor((F.col("timestamp_ms") - fx.EPOCH) / fx.SLOT_MS).cast("string")
    token = F.concat(F.lit("tok-"), F.substr("capture_id", F.lit(5)), F.lit("-"), slot)
    rows = fx.raw_turns(spark, sf).where("source = 'otel'").withColumn("ingest_token_sha256", F.sha2(token, 256))
    return Z.gate_otlp(rows, fx.sessions(spark, sf)).select("capture_id", "arrival_seq")


# --- names -----------------------------------------------------------------


@query("resolve_models", f"with names as ({Q.NAMES_SQL.format(base=fx.base_sql(fx.CHECK))}), {Q.RESOLVE} select name, model from resolved")
def _(spark, sf):
    names = fx.run_sql(spark, sf, Q.NAMES_SQL.format(base=fx.base_sql(fx.SPARK)))
    return names.select("name", resolve_model("name").alias("model"))


@query(
    "canonical_model_id",
    f"with names as ({Q.NAMES_SQL.format(base=fx.base_sql(fx.CHECK))}) select name, {Q._CANON.format('name')} as canonical from names",
)
def _(spark, sf):
    names = fx.run_sql(spark, sf, Q.NAMES_SQL.format(base=fx.base_sql(fx.SPARK)))
    return names.select("name", canonical_model_id("name").alias("canonical"))


@query(
    "prefix_completion",
    f"""with names as ({Q.NAMES_SQL.format(base=fx.base_sql(fx.CHECK))}), n as (select distinct {Q._DASHED.format("name")} as model from names)
    select n.model, count(c.id) as completions, case when count(c.id) = 1 then min(c.id) end as completed, max(c.id) as latest
    from n left join (select unnest({Q._CAT}) as id) c on starts_with(c.id, n.model || '-') group by n.model""",
)
def _(spark, sf):
    from turnlake.functions.models import MODEL_CATALOG, dashed

    names = fx.run_sql(spark, sf, Q.NAMES_SQL.format(base=fx.base_sql(fx.SPARK))).select(dashed("name").alias("model")).distinct()
    catalog = spark.createDataFrame([(m,) for m in MODEL_CATALOG], "model_id string")
    return P.prefix_completions(names, "model", catalog)


@query(
    "level_lookup",
    f"""with names as ({Q.LEVEL_NAMES_SQL.format(base=fx.base_sql(fx.CHECK))}), {Q.LEVELS}, t as (select name, trim(name) as typed, lower(trim(name)) as low from names)
    select name, coalesce((select slug from levels where slug = low), (select slug from levels where word = low),
      (select slug from levels where regexp_full_match(low, '[0-9]+') and n = try_cast(low as bigint)),
      (select min(slug) from levels where starts_with(slug, low) having count(*) = 1), typed) as slug from t""",
)
def _(spark, sf):
    names = fx.run_sql(spark, sf, Q.LEVEL_NAMES_SQL.format(base=fx.base_sql(fx.SPARK)))
    return names.select("name", resolve_level("name").alias("slug"))


# --- attempts --------------------------------------------------------------


@query("session_totals", f"with {Q.TURNS} select capture_id, attempt_id, count(*) as turns, {Q._SUMS} from turns group by all")
def _(spark, sf):
    return A.session_totals(fx.turns(spark, sf))


@query(
    "prompt_count",
    f"""with {Q.TURNS} select capture_id, attempt_id, cast(count(distinct nullif(prompt_id, '')) +
    count(*) filter (where coalesce(prompt_id, '') = '') as bigint) as prompt_count from turns group by all""",
)
def _(spark, sf):
    return A.prompt_count(fx.turns(spark, sf))


@query("dominant_model", f"with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD} select capture_id, attempt_id, model from lead_model")
def _(spark, sf):
    return A.scored_model(fx.turns(spark, sf))


@query("dominant_harness", f"with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD} select capture_id, attempt_id, harness from lead_harness")
def _(spark, sf):
    return A.scored_harness(fx.turns(spark, sf))


@query("harness_attribution", f"with {Q.TURNS} select turn_id, {Q._HARNESS} as harness from turns")
def _(spark, sf):
    return fx.turns(spark, sf).select("turn_id", turn_harness(F.col("sources")).alias("harness"))


def _attempts(spark, sf):
    return fx.sessions(spark, sf).select("capture_id", F.col("session_id").alias("attempt_id"))


@query("attempt_fold", f"with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD} select * exclude (challenge_type) from fold")
def _(spark, sf):
    return A.attempt_fold(fx.turns(spark, sf), _attempts(spark, sf))


@query(
    "estimated_taint",
    f"with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD} select capture_id, attempt_id, counts_estimated from fold",
)
def _(spark, sf):
    return A.attempt_fold(fx.turns(spark, sf), _attempts(spark, sf)).select(*KEY, "counts_estimated")


@query(
    "weakest_confidence",
    f"""with {Q.TURNS}, {Q.SESSIONS} select s.capture_id, s.session_id as attempt_id,
    case when count(t.turn_id) = 0 or bool_or(t.confidence = 'estimated') then 'estimated' when bool_or(t.confidence = 'jsonl') then 'jsonl' else 'otel' end as confidence
    from sessions s left join turns t on t.capture_id = s.capture_id and t.attempt_id = s.session_id group by 1, 2""",
)
def _(spark, sf):
    return A.weakest_confidence(fx.turns(spark, sf), _attempts(spark, sf))


@query(
    "cross_source_summary",
    f"with {Q.TURNS}, {Q.CROSS} select capture_id, attempt_id, turns, disagree_turns, disagree_fields, {Q._BENIGN} as benign from cross_source",
)
def _(spark, sf):
    out = A.cross_source_summary(fx.turns(spark, sf)).withColumn("benign", A.benign_drift())
    return out.withColumn("disagree_fields", _csv("disagree_fields"))


_WORST = """paced as (select a.capture_id, a.attempt_id, a.timestamp_ms, count(*) as n from {t} a join {t} b
    on b.capture_id = a.capture_id and b.attempt_id = a.attempt_id and b.timestamp_ms between a.timestamp_ms - 10000 and a.timestamp_ms
    group by a.capture_id, a.attempt_id, a.timestamp_ms, a.turn_id),
  pacing as (select capture_id, attempt_id, max(n) as worst from paced group by all)"""
_REASON = "case when worst > 30 then cast(worst as varchar) || ' turns within 10s — tighter than an interactive session' end"


@query(
    "pacing_bursts",
    f"""with t0 as ({fx.turns_sql(fx.CHECK)}), turns as (select * replace (model as attempt_id, 'all' as capture_id,
      {fx.EPOCH} + cast(floor((timestamp_ms - {fx.EPOCH}) / 20) as bigint) as timestamp_ms) from t0),
    run as (select capture_id, attempt_id, count(*) over (partition by capture_id, attempt_id order by timestamp_ms
      range between 10000 preceding and current row) as n from turns)
    select capture_id, attempt_id, worst, {_REASON} as pacing_reason from (select capture_id, attempt_id, max(n) as worst from run group by all) p""",
)
def _(spark, sf):
    turns = fx.turns(spark, sf).withColumns(
        {
            "attempt_id": F.col("model"),
            "capture_id": F.lit("all"),
            "timestamp_ms": fx.EPOCH + F.floor((F.col("timestamp_ms") - fx.EPOCH) / 20),
        }
    )
    return I.pacing(turns)


@query(
    "capture_integrity",
    f"""with {Q.TURNS}, {Q.CROSS}, {_WORST.format(t="turns")}, low as (select capture_id, attempt_id,
      count(*) filter (where plausibility_status = 'low') as low_plausibility, count(*) filter (where confidence = 'estimated') as estimated
      from turns group by all)
    select c.capture_id, c.attempt_id, turns, disagree_turns, disagree_fields, low_plausibility, estimated, worst, {_REASON} as pacing_reason,
      {Q._BENIGN} as benign, (not {Q._BENIGN} or low_plausibility > 0 or worst > 30) as flagged
    from cross_source c join low l on l.capture_id = c.capture_id and l.attempt_id = c.attempt_id
    join pacing p on p.capture_id = c.capture_id and p.attempt_id = c.attempt_id""",
)
def _(spark, sf):
    out = I.capture_integrity(fx.turns(spark, sf))
    return out.withColumn("disagree_fields", _csv("disagree_fields"))


@query(
    "trust_tier",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.CROSS}, ev as (select capture_id, attempt_id, bool_or(confidence = 'estimated') as est,
      bool_or(src in ('cursor', 'codex', 'copilot')) as adapter, bool_or(src like '%otel%') as otel from turns group by all),
    gated as (select s.capture_id, s.session_id as attempt_id, coalesce(c.turns, 0) as turns, coalesce(c.disagree_turns, 0) as disagree_turns,
      case when nonce_origin = 'local' then 'local_nonce' when not baseline_attested then 'baseline_unattested' when c.turns is null then 'no_turns'
        when est then 'estimated_turns' when adapter then 'adapter_source' when not otel then 'no_otel'
        when not {Q._BENIGN} then 'cross_source_disagreement' else 'verified' end as reason
      from sessions s left join ev e on e.capture_id = s.capture_id and e.attempt_id = s.session_id
      left join cross_source c on c.capture_id = s.capture_id and c.attempt_id = s.session_id)
    select *, case when reason = 'verified' then 'verified' else 'unverified' end as tier from gated""",
)
def _(spark, sf):
    return I.trust_tier(fx.sessions(spark, sf), fx.turns(spark, sf))


# Edits within the allowlist of the session's level, by their path in the workspace.
_EDITS = f"""edits as ({fx.edits_sql(fx.CHECK)}), rels as (select * replace (case when path like '%/src/main.go' then 'src/main.go' when path like '%/src/gen/x.go' then 'src/gen/x.go'
      when path like '%/notes.md' then 'notes.md' when path like '%/src/util.go' then 'src/util.go' end as path) from edits),
    changes as (select * from rels where path in ('src/main.go', 'src/gen/x.go', 'src/util.go') and slot % 2 = 0 or path in ('src/main.go', 'notes.md') and slot % 2 = 1)"""
_PASTES = """seen as (select *, row_number() over w - 1 as prior, coalesce(lag(size) over w, 0) as previous_size from changes
    window w as (partition by capture_id, attempt_id, path order by seq)),
  pastes as (select capture_id, attempt_id, path, 'bulk_replace' as kind, size, previous_size, prior as prior_edits, timestamp_ms from seen
    where kind <> 'removed' and size >= 2000 and size - previous_size >= 2000 and prior <= 1
    qualify row_number() over (partition by capture_id, attempt_id, path order by prior) = 1),
  pasted as (select capture_id, attempt_id, count(*) as events from pastes group by all)"""


def _edits(spark, sf) -> DataFrame:
    edits = fx.edits(spark, sf)
    roots = edits.select("capture_id").distinct().withColumn("root", F.concat(F.lit("/ws/u"), F.substr("capture_id", F.lit(5))))
    globs = F.when(F.col("slot") % 2 == 0, F.array(F.lit("src/**/*.go"))).otherwise(F.array(F.lit("src/main.go"), F.lit("*.md")))
    levels = edits.select(*KEY, "slot").distinct().select(*KEY, F.transform(globs, glob_to_regex_column).alias("allow_regexes"))
    ignores = roots.select("capture_id", F.lit("*.tmp").alias("pattern"))
    return I.provenance_changes(edits.drop("slot"), roots, ignores, levels, [".git", META_DIR])


_SUMMARY = f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD}, {_EDITS}, {_PASTES} select s.capture_id, s.session_id as attempt_id, s.attempt_nonce, s.baseline_attested,
    s.code_reset_count as baseline_reset_count, coalesce(p.events, 0) as bulk_paste_events, false as ignore_changed, s.nonce_origin,
    cast(0 as bigint) as pause_count, cast(0 as bigint) as paused_ms_total, f.prompt_count, cast(1800000000000 as bigint) as signed_at_ms,
    s.started_at_ms, cast(0 as bigint) as untracked_edit_windows from sessions s join fold f on f.capture_id = s.capture_id and f.attempt_id = s.session_id
    left join pasted p on p.capture_id = s.capture_id and p.attempt_id = s.session_id"""


@query("capture_summary", _SUMMARY)
def _(spark, sf):
    return I.capture_summary(fx.sessions(spark, sf), fx.turns(spark, sf), I.bulk_pastes(_edits(spark, sf)), 1800000000000)


@query("bulk_paste", f"with {_EDITS}, {_PASTES} select * from pastes")
def _(spark, sf):
    return I.bulk_pastes(_edits(spark, sf))


@query(
    "file_provenance",
    f"""with {_EDITS}, {_PASTES} select c.capture_id, c.attempt_id, c.path, count(*) as edits, arg_max(c.size, c.seq) as last_size,
    max(c.size) as max_size, bool_or(p.path is not null) as flagged from changes c left join pastes p
    on p.capture_id = c.capture_id and p.attempt_id = c.attempt_id and p.path = c.path group by 1, 2, 3""",
)
def _(spark, sf):
    return I.file_provenance(_edits(spark, sf))


_CHANGES = f"changes as ({fx.changes_sql(fx.CHECK)})"


@query(
    "watched_changes",
    f"""with {_CHANGES} select capture_id, seq, substr(path, length('/w/' || substr(capture_id, 5)) + 2) as rel_path from changes
    where path not like '%/../%' and path not like '%/.git/%' and path not like '%/node_modules/%'
      and not (path like '%/src/f2.go' and capture_id = 'cap-src1')""",
)
def _(spark, sf):
    changes = fx.changes(spark, sf)
    roots = changes.select("capture_id").distinct().withColumn("root", F.concat(F.lit("/w/"), F.substr("capture_id", F.lit(5)), F.lit("/")))
    everywhere = roots.select("capture_id", F.explode(F.array(F.lit("# tools"), F.lit("./node_modules/"))).alias("pattern"))
    one = roots.where("capture_id = 'cap-src1'").select("capture_id", F.lit("f2.*").alias("pattern"))
    out = P.watched_changes(changes, roots, everywhere.unionByName(one), [".git", META_DIR])
    return out.select("capture_id", "seq", "rel_path")


# --- scores ----------------------------------------------------------------


@query(
    "economics_lookup",
    f"""with {Q.TURNS}, {Q.ECON}, f as (select turn_id, model as model_identifier from turns), {Q._priced("f")}
    select turn_id, model_identifier, economics_id, base0 as base_effort_multiplier, baseline_floor_fallback, baseline_floor_fallback as is_baseline_floor from priced""",
)
def _(spark, sf):
    rows = fx.turns(spark, sf).select("turn_id", F.col("model").alias("model_identifier"))
    return S.economics_lookup(rows, fx.economics(spark))


@query(
    "token_weights",
    f"""with {Q.SESSIONS}, {Q.WEIGHTS} select session_id, s.challenge_type, case when slot % 4 = 1 then cast(0.25 as double) else w_in end as w_in,
    w_out, case when slot % 4 = 3 then cast(2.0 as double) else w_think end as w_think from sessions s
    join weights w on w.challenge_type = coalesce(nullif(s.challenge_type, ''), 'implementation')""",
)
def _(spark, sf):
    slot = F.col("slot") % 4
    overrides = (
        F.when(slot == 1, F.create_map(F.lit("W_in"), F.lit(0.25), F.lit("W_out"), F.lit(-1.0)))
        .when(slot == 2, F.create_map(F.lit("W_out"), F.lit(float("nan"))))
        .when(slot == 3, F.create_map(F.lit("W_think"), F.lit(2.0), F.lit("W_in"), F.lit(float("inf"))))
    )
    rows = fx.sessions(spark, sf).withColumn("token_weight_overrides", overrides)
    return S.token_weights(rows, fx.weights(spark)).select("session_id", "challenge_type", "w_in", "w_out", "w_think")


_FACTORS = (
    "capture_id, attempt_id, economics_id, effort_base, thinking_overhead, composer_modifier, effort, weighted_tokens, "
    "prompts_effective, seconds_effective, score"
)
_SCORE_COLS = [c.strip() for c in _FACTORS.split(",")]


@query(
    "live_projection",
    f"with {Q.TURNS}, {Q.SESSIONS}, {Q.ECON}, {Q.WEIGHTS}, {Q.FOLD}, {Q._priced('fold')}, {Q._score('cast(2.0 as double)')} select {_FACTORS} from scored",
)
def _(spark, sf):
    out = live_scores(fx.turns(spark, sf), fx.sessions(spark, sf), fx.economics(spark), fx.weights(spark))
    return out.select(*_SCORE_COLS)


@query(
    "best_case_score",
    f"with {Q.TURNS}, {Q.SESSIONS}, {Q.ECON}, {Q.WEIGHTS}, {Q.FOLD}, {Q._priced('fold')}, {Q._score('cast(0.0 as double)')} select {_FACTORS} from scored",
)
def _(spark, sf):
    out = best_case_scores(fx.turns(spark, sf), fx.sessions(spark, sf), fx.economics(spark), fx.weights(spark))
    return out.select(*_SCORE_COLS)


_VECTOR_SQL = f"""vectors as (select event_id, model as model_identifier, cast(k as double) as correctness_pct,
    cast(case when event_id % 4 = 0 then 1 else k % 5 end as double) as prompt_count, cast(tin as double) as tokens_input, cast(tout as double) as tokens_output,
    cast(tthink * 20 as double) as tokens_thinking, cast(case when k % 9 = 0 then 0 else k / cast(10.0 as double) end as double) as execution_time_seconds,
    case k % 4 when 0 then 'debugging' when 1 then 'generation' else '' end as challenge_type, case when k % 6 = 0 then 'cursor' else 'cli' end as harness_used,
    false as counts_estimated from ({fx.base_sql(fx.CHECK)}) b)"""


@query(
    "explicit_score",
    f"""with {_VECTOR_SQL}, {Q.ECON}, {Q.WEIGHTS}, {Q._priced("vectors")}, {Q._score("execution_time_seconds", "correctness_pct")}
    select event_id, economics_id, effort, score from scored""",
)
def _(spark, sf):
    b = fx.run_sql(spark, sf, fx.base_sql(fx.SPARK))
    k = F.col("k")
    seconds = F.when(k % 9 == 0, F.lit(float("-inf"))).otherwise(k / F.lit(10.0))
    vectors = b.select(
        "event_id",
        F.coalesce("model", F.lit("")).alias("model_identifier"),
        k.cast("double").alias("correctness_pct"),
        F.when(F.col("event_id") % 4 != 0, (k % 5).cast("double")).alias("prompt_count"),
        F.col("tin").alias("tokens_input"),
        F.col("tout").alias("tokens_output"),
        (F.col("tthink") * 20).alias("tokens_thinking"),
        seconds.alias("execution_time_seconds"),
        F.when(k % 4 == 0, "debugging").when(k % 4 == 1, "generation").otherwise("").alias("challenge_type"),
        F.when(k % 6 == 0, "cursor").otherwise("cli").alias("harness_used"),
    )
    out = S.score(S.explicit_vectors(vectors), fx.economics(spark), fx.weights(spark))
    return out.select("event_id", "economics_id", "effort", "score")


@query(
    "score_parity",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.ECON}, {Q.WEIGHTS}, {Q.FOLD}, {Q._priced('fold')}, {Q._score('cast(0.0 as double)')},
    graded as (select capture_id, attempt_id, score * case when turns % 3 = 0 then cast(1.02 as double) else cast(0.5 as double) end as graded, turns from scored)
    select s.capture_id, s.attempt_id, score as projected, graded, cast(90.0 as double) as correctness_pct, s.turns % 2 = 0 as recognized,
      graded > score * cast(1.01 as double) as warning from scored s join graded g on g.capture_id = s.capture_id and g.attempt_id = s.attempt_id""",
)
def _(spark, sf):
    best = best_case_scores(fx.turns(spark, sf), fx.sessions(spark, sf), fx.economics(spark), fx.weights(spark))
    best = best.select(*KEY, "score", "turns")
    off = F.when(F.col("turns") % 3 == 0, F.lit(1.02)).otherwise(F.lit(0.5))
    graded = best.select(
        *KEY, (F.col("score") * off).alias("score"), F.lit(90.0).alias("correctness_pct"), (F.col("turns") % 2 == 0).alias("recognized")
    )
    return S.score_parity(best, graded, KEY)


# --- redaction and content -------------------------------------------------


@query(
    "redact_documents",
    f"with {Q.REDACTED} select id, case when not uncleanable then clean end as redacted_text, categories, cast(1 as int) as catalog_version, uncleanable from redacted",
)
def _(spark, sf):
    out = redact(fx.secrets(spark, sf)).withColumn("categories", F.when(F.size("categories") > 0, _csv("categories")).otherwise(""))
    return out.select("id", "redacted_text", "categories", "catalog_version", "uncleanable")


@query("uncleanable_docs", f"with {Q.REDACTED} select id from redacted where uncleanable")
def _(spark, sf):
    return redact(fx.secrets(spark, sf)).where("uncleanable").select("id")


@query(
    "redact_bundles",
    f"""with {Q.REDACTED}, cats as (select bundle, string_agg(distinct c, ',' order by c) as categories from (select bundle, unnest(string_split(categories, ',')) as c from redacted) x where c <> '' group by bundle)
    select r.bundle, count(*) as files, case when not bool_or(uncleanable) then cast(sum(strlen(clean)) as bigint) end as total_bytes, coalesce(any_value(c.categories), '') as categories,
      bool_or(uncleanable) as rejected from redacted r left join cats c on c.bundle = r.bundle group by r.bundle""",
)
def _(spark, sf):
    rows = fx.secrets(spark, sf).select("bundle", F.col("id").alias("path"), F.col("text").cast("binary").alias("content"))
    return redact_bundles(rows, ["bundle"])[1].withColumn("categories", _csv("categories"))


@query("baseline_hash", f"with {Q.HASHES} select workspace, content_hash, files from hashes")
def _(spark, sf):
    return C.content_hashes(fx.files(spark, sf), ["workspace"], META_DIR)


@query(
    "workspace_snapshots",
    f"""with {Q.FILES}, w as (select *, workspace || '-' || (doc_id // {fx.WORKSPACE_IDS}) as ws, doc_id // {fx.WORKSPACE_IDS} % 7 = 3 as linked from files)
    select ws as workspace, case when linked then 'symlink is not allowed in a workspace: src/other' end as reason,
      case when not linked then sha256(string_agg({Q._PATH} || chr(0) || {Q._BODY}, '' order by {Q._PATH}) filter (not {Q._PATH} like '.meta/%')) end as content_hash,
      case when not linked then count(*) filter (not {Q._PATH} like '.meta/%') end as files
    from w group by ws, linked having linked or count(*) filter (not {Q._PATH} like '.meta/%') > 0""",
)
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/workspaces-{uuid.uuid4().hex}"
    fx.land_workspaces(spark, sf, folder)
    files, refused = without_links(read_workspace(spark, folder, META_DIR))
    hashes = C.content_hashes(files, ["workspace"], META_DIR)
    return hashes.join(refused, "workspace", "full").select("workspace", "reason", "content_hash", "files")


@query(
    "verify_baseline",
    f"""with {Q.HASHES} select workspace, case when workspace like '%1' then 'mismatch' else 'match' end as status,
    case when workspace like '%2' then 'unattested' when workspace like '%3' then 'refused' else 'attested' end as attestation from hashes""",
)
def _(spark, sf):
    hashes = C.content_hashes(fx.files(spark, sf), ["workspace"], META_DIR)
    ends = lambda d: F.col("workspace").endswith(d)
    pin = F.when(ends("1"), F.lit("0" * 64)).otherwise(F.concat(F.lit(" "), F.col("content_hash"), F.lit("\n")))
    pinned = hashes.select(
        "workspace", pin.alias("baseline_hash"), F.when(ends("2"), None).when(ends("3"), F.lit("f" * 64)).otherwise(pin).alias("authoritative_hash")
    )
    return C.verify_baseline(hashes, pinned, ["workspace"]).select("workspace", "status", "attestation")


def _levels_of(files: DataFrame) -> DataFrame:
    """A level per workspace, with globs and entry points by its name."""
    n = F.substr("workspace", F.lit(4)).cast("int")
    globs = (
        F.when(n % 5 == 0, F.array(F.lit("nothing/**")))
        .when(n % 5 == 1, F.array(F.lit("src/**/*.go"), F.lit("*.rs")))
        .when(n % 5 == 2, F.array(F.lit("src/[ab")))
        .otherwise(F.array(F.lit("src/**"), F.lit("**/*.py")))
    )
    entries = F.when(n % 5 == 3, F.array(F.lit("src/en/main.GO"), F.lit("Service.Start"))).otherwise(F.array(F.lit("Service.Start")))
    levels = files.select("workspace").distinct().select("workspace", globs.alias("file_allowlist"), entries.alias("entry_points"))
    return levels.withColumn("allow_regexes", F.transform("file_allowlist", glob_to_regex_column))


_N = "cast(substr(workspace, 4) as int) % 5"
_KEPT = f"""kept as (select *, {_N} as n from files where ({_N} = 1 and ((path like 'src/%.go') or path like '%.rs'))
    or ({_N} in (3, 4) and (path like 'src/%' or path like '%.py')))"""


@query("allowlist_filter", f"with {Q.FILES}, {_KEPT} select workspace, doc_id from kept")
def _(spark, sf):
    files = fx.files(spark, sf)
    return C.allowlisted(files, _levels_of(files), ["workspace"]).select("workspace", "doc_id")


@query(
    "bundle_validation",
    f"""with {Q.FILES}, {_KEPT}, per as (select workspace, count(*) as files, cast(sum(strlen(body)) as bigint) as total_bytes from kept group by 1),
    w as (select distinct workspace, {_N} as n from files)
    select w.workspace, coalesce(files, 0) as files, coalesce(total_bytes, 0) as total_bytes, case when n = 3 then 'src/en/main.GO' end as missing_entry,
      case when n = 2 then 'invalid_glob' when coalesce(files, 0) = 0 then 'no_files' when total_bytes > 8388608 then 'too_large'
        when n = 3 then 'missing_entry_point' else 'ok' end as verdict from w left join per p on p.workspace = w.workspace""",
)
def _(spark, sf):
    files = fx.files(spark, sf)
    return C.validate_bundles(files, _levels_of(files), ["workspace"])


@query(
    "entry_points_missing",
    f"with {Q.FILES} select distinct workspace, 'src/en/main.GO' as entry_point from files where {_N} = 3",
)
def _(spark, sf):
    files = fx.files(spark, sf)
    return C.missing_entry_points(_levels_of(files), files, ["workspace"])


@query(
    "related_paths",
    f"""with {_CHANGES}, a as (select distinct capture_id, path as p from changes), b as (select distinct capture_id, '/w/' || substr(capture_id, 5) || '/' || attempt_id as unused,
      case when seq % 2 = 0 then '/w/' || substr(capture_id, 5) || '/src' else '/w/' || substr(capture_id, 5) || '/src/f1.go/deep' end as q from changes),
    c as (select distinct capture_id, q from b)
    select a.capture_id, a.p as path, c.q as other from a join c on c.capture_id = a.capture_id and (a.p = c.q or starts_with(a.p, c.q || '/') or starts_with(c.q, a.p || '/'))""",
)
def _(spark, sf):
    ch = fx.changes(spark, sf)
    left = ch.select("capture_id", "path").distinct()
    root = F.concat(F.lit("/w/"), F.substr("capture_id", F.lit(5)))
    other = F.when(F.col("seq") % 2 == 0, F.concat(root, F.lit("/src"))).otherwise(F.concat(root, F.lit("/src/f1.go/deep")))
    return P.related_paths(left, "path", ch.select("capture_id", other.alias("other")).distinct(), "other", ["capture_id"])


@query(
    "workspace_index",
    """select page_id, case when page_id % 5 = 0 then null when page_id % 5 = 1 then 'C:/Users/My Repo/' || page_id
    when page_id % 5 = 2 then url else '/home/me/My Repo+' || page_id || case when page_id % 5 = 3 then '/%zz' else '' end end as folder,
    regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') as log_folder from pages""",
)
def _(spark, sf):
    pages = fx.load(spark, sf, "pages")
    m, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    uri = (
        F.when(m == 1, F.concat(F.lit("file:///C%3A/Users/My%20Repo/"), n))
        .when(m == 2, F.col("url"))
        .when(m == 3, F.concat(F.lit("file:///home/me/My Repo+"), n, F.lit("/%zz")))
        .otherwise(F.concat(F.lit("file:///home/me/My%20Repo+"), n))
    )
    doc = F.when(m == 0, F.to_json(F.struct(uri.alias("workspace")))).otherwise(F.to_json(F.struct(uri.alias("folder"))))
    rows = pages.select("page_id", log_folder_name("url").alias("log_folder"), doc.alias("workspace_json"))
    return P.workspace_index(rows)


# --- ledger and chain ------------------------------------------------------

_INDEXED = """indexed as (select *, row_number() over (partition by capture_id, attempt_id order by emitted_ms, turn_id) - 1 as turn_index from turns)"""
_US = "chr(31)"
_HEADS = f"""links as (select capture_id, attempt_id, turn_index, concat_ws({_US}, turn_id, timestamp_ms, model, tokens_input, tokens_output, tokens_thinking,
      tokens_cache, confidence, agreement_status || case when agreement_status = 'disagree' then ':' || agreement_fields else '' end,
      plausibility_status || case when plausibility_status = 'low' then ':zero tokens reported' else '' end, src, 'n-' || substr(attempt_id, 3)) as enc from indexed),
  chain as (
    select capture_id, session_id as attempt_id, cast(0 as bigint) as n,
      sha256('{DOMAIN}' || {_US} || 'genesis' || {_US} || session_id || {_US} || started_at_ms) as head from sessions
    union all
    select c.capture_id, c.attempt_id, c.n + 1, sha256(c.head || {_US} || l.enc) from chain c
    join links l on l.capture_id = c.capture_id and l.attempt_id = c.attempt_id and l.turn_index = c.n),
  heads as (select capture_id, attempt_id, max(n) as turn_count, arg_max(head, n) as head from chain group by all)"""


@query("turn_index", f"with {Q.TURNS}, {_INDEXED} select turn_id, capture_id, attempt_id, turn_index from indexed")
def _(spark, sf):
    return L.turn_index(fx.turns(spark, sf).select(*KEY, "emitted_ms", "turn_id")).select("turn_id", *KEY, "turn_index")


def _heads(spark, sf) -> DataFrame:
    sessions = fx.sessions(spark, sf).withColumnRenamed("session_id", "attempt_id")
    return L.ledger_heads(sessions, fx.turns(spark, sf), DOMAIN)


@query(
    "ledger_head",
    f"with recursive {Q.TURNS}, {Q.SESSIONS}, {_INDEXED}, {_HEADS} select capture_id, attempt_id, head, turn_count, cast(1 as int) as schema from heads",
)
def _(spark, sf):
    return _heads(spark, sf)


@query(
    "verify_seals",
    f"""with recursive {Q.TURNS}, {Q.SESSIONS}, {_INDEXED}, {_HEADS} select capture_id, attempt_id, turn_count, head,
    case when turn_count % 4 = 0 then 'start_fresh' when turn_count % 4 = 1 then 'start_fresh' when turn_count % 4 = 2 then 'start_fresh' else 'trusted' end as seal from heads""",
)
def _(spark, sf):
    heads = cut_lineage(_heads(spark, sf))
    m = F.col("turn_count") % 4
    seals = heads.where(m != 0).select(
        *KEY, "turn_count", F.when(m == 1, F.lit("0" * 64)).otherwise(F.col("head")).alias("head"),
        F.when(m == 2, 2).otherwise(F.col("schema")).alias("schema"),
    )
    return L.verify_seals(heads, seals)


def _stored(spark, sf, name: str) -> TurnStore:
    """A store that a stream has written in three steps, of which the second was killed before its commit once."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, turns = TurnStore(f"{folder}/store", DOMAIN), cut_lineage(fx.turns(spark, sf))
    low, high = turns.agg(F.min("emitted_ms"), F.max("emitted_ms")).first()
    for part in range(3):
        rows = turns.where(F.expr(f"least((emitted_ms - {low}) div {(high - low) // 3 + 1}, 2)") == part)
        rows.write.parquet(f"{folder}/in/{part}")
        if part == 1:
            store.write_data(rows, "turns-killed")
        stream = spark.readStream.schema(turns.schema).parquet(f"{folder}/in/*")
        writer = stream.writeStream.foreachBatch(store.sink("turns")).option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return store


@query(
    "stored_turns",
    f"""with {Q.TURNS} select capture_id, attempt_id, turn_id, tokens_input, tokens_cache, emitted_ms, strftime(make_timestamp(emitted_ms * 1000), '%Y-%m-%d') as capture_date from turns""",
)
def _(spark, sf):
    store = _stored(spark, sf, "stored")
    store.compact(spark)
    return store.read(spark).select(*KEY, "turn_id", "tokens_input", "tokens_cache", "emitted_ms", "capture_date")


# Turns of every fourth slot are edited behind the store's back, of others deleted, of others their seal.
@query(
    "sealed_restart",
    f"""with {Q.TURNS}, per as (select capture_id, attempt_id, max(slot) % 5 as k, count(*) as turns, count(*) filter (where event_id % 2 = 0) as evens from turns group by all)
    select capture_id, attempt_id, case when k = 2 then turns - evens else turns end as turns,
      case when k in (1, 3) or k = 2 and evens > 0 then 'start_fresh' else 'trusted' end as seal from per""",
)
def _(spark, sf):
    store = _stored(spark, sf, "sealed")
    k = F.col("slot") % 5
    for commit in store.commits().values():
        data, seals = f"{store.path}/data/folder={commit['folder']}", f"{store.path}/seals/{commit['folder']}"
        turns = spark.read.parquet(data).where((k != 2) | (F.col("event_id") % 2 != 0))
        edited = cut_lineage(turns.withColumn("tokens_input", F.col("tokens_input") - F.when(k == 1, 1).otherwise(0)))
        edited.write.mode("overwrite").partitionBy("capture_date").parquet(data)
        kept = cut_lineage(spark.read.parquet(seals).where(F.regexp_extract("attempt_id", "-([0-9]+)$", 1).cast("int") % 5 != 3))
        kept.write.mode("overwrite").parquet(seals)
    return store.resume(spark)[1]


def _json_text(x: str) -> str:
    return f"cast(to_json({x}) as varchar)"


@query(
    "turn_messages",
    f"""with {Q.TURNS}, {_INDEXED} select capture_id, attempt_id, turn_index, '{{"attempt_nonce":"n-' || substr(attempt_id, 3) || '","chain_version":4,"confidence":"' || confidence
    || '","model":' || {_json_text("model")} || ',"prev_signature":' || case when turn_index = 0 then 'null' else '"sig-' || (turn_index - 1) || '"' end || ',"sources":['
    || case src when 'otel,jsonl' then '"jsonl","otel"' else '"' || src || '"' end || '],"timestamp_ms":' || timestamp_ms || ',"token_counts":{{"cache":' || tokens_cache
    || ',"input":' || tokens_input || ',"output":' || tokens_output || ',"thinking":' || tokens_thinking || '}},"turn_index":' || turn_index || '}}' as message from indexed""",
)
def _(spark, sf):
    turns = L.turn_index(fx.turns(spark, sf))
    signed = turns.withColumn("signature", F.concat(F.lit("sig-"), F.col("turn_index").cast("string")))
    return L.turn_messages(L.with_prev_signature(signed))


@query(
    "final_messages",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD}, {Q.CROSS}, {_EDITS}, {_PASTES} select s.capture_id, s.session_id as attempt_id, '{{"attempt_nonce":"' || s.attempt_nonce
    || '","capture_summary":{{"baseline_attested":' || s.baseline_attested || ',"baseline_reset_count":' || s.code_reset_count
    || ',"bulk_paste_events":' || coalesce(q.events, 0) || ',"ignore_changed":false,"nonce_origin":"' || s.nonce_origin || '","pause_count":0,"paused_ms_total":0,"prompt_count":' || f.prompt_count
    || ',"signed_at_ms":1800000000000,"started_at_ms":' || s.started_at_ms || ',"untracked_edit_windows":0}},"chain_version":4,"cross_source":{{"disagree_fields":['
    || case when c.disagree_fields = '' then '' else '"' || replace(c.disagree_fields, ',', '","') || '"' end || '],"disagree_turns":' || c.disagree_turns
    || '}},"final_code_hash":"' || sha256(s.session_id) || '","prev_signature":null,"turn_count":' || c.turns || '}}' as message
    from sessions s join fold f on f.capture_id = s.capture_id and f.attempt_id = s.session_id
    join cross_source c on c.capture_id = s.capture_id and c.attempt_id = s.session_id
    left join pasted q on q.capture_id = s.capture_id and q.attempt_id = s.session_id""",
)
def _(spark, sf):
    sessions, turns = fx.sessions(spark, sf), fx.turns(spark, sf)
    summary = I.capture_summary(sessions, turns, I.bulk_pastes(_edits(spark, sf)), 1800000000000)
    ready = summary.join(A.cross_source_summary(turns), KEY).withColumn("final_code_hash", F.sha2("attempt_id", 256))
    return L.final_messages(ready)


@query(
    "chain_continuity",
    f"""with {Q.TURNS}, {_INDEXED}, e as (select capture_id, attempt_id, 'turn' as entry, turn_index + case when event_id % 53 = 0 then 1 else 0 end as i, null as claimed from indexed where event_id % 59 <> 0),
    per as (select capture_id, attempt_id, count(*) as turns, count(distinct i) as d, min(i) as lo, max(i) as hi from e group by all),
    f as (select capture_id, attempt_id, count(*) as n, max(slot) as slot, min(event_id) as e0 from indexed group by all),
    full_ as (select f.*, coalesce(p.turns, 0) as turns, p.d, p.lo, p.hi, case when e0 % 61 = 0 then 0 when e0 % 67 = 0 then 2 else 1 end as finals, n - e0 % 2 as claimed
      from f left join per p on p.capture_id = f.capture_id and p.attempt_id = f.attempt_id)
    select capture_id, attempt_id, turns, finals, case when finals > 0 then claimed end as claimed,
      case when e0 % 71 = 0 and turns + finals > 0 then 'unknown_version' when finals <> 1 then 'terminal_entry' when turns > 0 and not (lo = 0 and hi = turns - 1 and d = turns) then 'index_gap'
        when claimed <> turns then 'turn_count' else 'ok' end as continuity from full_ where turns + finals > 0""",
)
def _(spark, sf):
    turns = L.turn_index(fx.turns(spark, sf))
    first = turns.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("event_id").alias("e0"))
    version = F.when(F.col("e0") % 71 == 0, 9).otherwise(4)
    shift = (F.col("event_id") % 53 == 0).cast("bigint")
    entries = turns.where(F.col("event_id") % 59 != 0).join(first, KEY).select(
        *KEY, F.lit("turn").alias("entry"), (F.col("turn_index") + shift).alias("turn_index"),
        F.lit(None).cast("bigint").alias("turn_count"), version.alias("chain_version"),
    )
    copies = F.when(F.col("e0") % 61 == 0, 0).when(F.col("e0") % 67 == 0, 2).otherwise(1)
    finals = first.withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).select(
        *KEY, F.lit("final").alias("entry"), F.lit(None).cast("bigint").alias("turn_index"),
        (F.col("n") - F.col("e0") % 2).alias("turn_count"), version.alias("chain_version"),
    )
    return L.chain_continuity(entries.unionByName(finals))


# --- sessions --------------------------------------------------------------

_COMMANDS = f"commands as ({fx.commands_sql(fx.CHECK)})"


@query(
    "session_lifecycle",
    f"""with {_COMMANDS}, c as (select * replace (rtrim(workspace, '/') as workspace), workspace as spelled from commands),
    starts as (select *, lag(workspace || '|' || level_id) over (partition by capture_id order by at_ms, seq) as before from c where command = 'start'),
    marked as (select capture_id, command, spelled, level_id, at_ms, seq, case when before is not distinct from workspace || '|' || level_id then 0 else 1 end as fresh from starts
      union all select capture_id, command, spelled, level_id, at_ms, seq, 0 from c where command = 'stop'),
    numbered as (select *, sum(fresh) over (partition by capture_id order by at_ms, seq) as attempt_no from marked),
    per as (select capture_id, cast(attempt_no as bigint) as attempt_no, arg_min(spelled, (at_ms, seq)) filter (where fresh = 1) as workspace,
        arg_min(level_id, (at_ms, seq)) filter (where fresh = 1) as level_id, min(at_ms) filter (where fresh = 1) as started_at_ms,
        count(*) filter (where command = 'start') as starts, max((at_ms, seq)) filter (where command = 'start') as last_start
      from numbered where attempt_no > 0 group by 1, 2),
    closing as (select n.capture_id, n.attempt_no, min(n.at_ms) as stopped from numbered n join per p on p.capture_id = n.capture_id and p.attempt_no = n.attempt_no
      where n.command = 'stop' and (n.at_ms, n.seq) > p.last_start group by 1, 2)
    select p.capture_id, p.attempt_no, p.workspace, p.level_id, p.started_at_ms, coalesce(k.stopped, nx.started_at_ms) as stopped_at_ms, p.starts,
      case when k.stopped is not null then 'stopped' when nx.started_at_ms is not null then 'superseded' else 'open' end as end_state
    from per p left join closing k on k.capture_id = p.capture_id and k.attempt_no = p.attempt_no
    left join per nx on nx.capture_id = p.capture_id and nx.attempt_no = p.attempt_no + 1""",
)
def _(spark, sf):
    return Z.session_lifecycle(fx.commands(spark, sf))


@query(
    "clip_overlaps",
    f"""with {Q.SESSIONS}, s as (select capture_id, session_id, started_at_ms, case when slot % 2 = 0 then stopped_at_ms + 900000 end as stopped_at_ms from sessions)
    select capture_id, session_id, started_at_ms, case when nx is null then stopped_at_ms else least(coalesce(stopped_at_ms, nx - 1), nx - 1) end as stopped_at_ms
    from (select *, lead(started_at_ms) over (partition by capture_id order by started_at_ms, session_id) as nx from s) t""",
)
def _(spark, sf):
    s = fx.sessions(spark, sf)
    longer = F.when(F.col("slot") % 2 == 0, F.col("stopped_at_ms") + 900000)
    rows = s.select("capture_id", "session_id", "started_at_ms", longer.alias("stopped_at_ms"))
    return Z.clip_overlaps(rows)


@query(
    "adopt_sessions",
    f"""with {Q.SESSIONS} select capture_id, session_id, case when slot % 2 = 0 then 'adopted' when slot = 999 then 'superseded' else 'kept' end as adoption,
    case when slot = 999 and slot % 2 <> 0 then 1900000000000 else stopped_at_ms end as stopped_at_ms from sessions""",
)
def _(spark, sf):
    s = fx.sessions(spark, sf)
    ws = F.when(F.col("slot") % 2 == 0, F.col("workspace")).otherwise(F.lit("/elsewhere"))
    bound = s.select("capture_id").distinct().withColumn("bound_workspace", F.concat(F.lit("/ws/u"), F.substr("capture_id", F.lit(5)), F.lit("/")))
    out = Z.adopt_sessions(s.withColumn("workspace", ws), bound, 1900000000000)
    return out.select("capture_id", "session_id", "adoption", "stopped_at_ms")


@query(
    "restorable_turns",
    f"with {Q.TURNS}, {Q.SESSIONS} select t.turn_id from turns t join sessions s on s.capture_id = t.capture_id and s.session_id = t.attempt_id where s.slot % 2 = 0",
)
def _(spark, sf):
    s = fx.sessions(spark, sf)
    adopted = s.select("capture_id", "session_id", F.when(F.col("slot") % 2 == 0, "adopted").otherwise("kept").alias("adoption"))
    kept = fx.turns(spark, sf).withColumn("session_id", F.col("attempt_id"))
    return Z.restorable(kept, adopted).select("turn_id")


@query(
    "binding_mismatch",
    f"""with {Q.SESSIONS} select session_id, case when cast(substr(capture_id, 5) as bigint) % 3 = 0 then false
    when cast(substr(capture_id, 5) as bigint) % 3 = 1 then slug <> 'level-5' else false end as mismatch from sessions""",
)
def _(spark, sf):
    s = fx.sessions(spark, sf)
    n = F.substr("capture_id", F.lit(5)).cast("bigint") % 3
    levels = s.select("capture_id").distinct().withColumn("manifest_slug", F.when(n == 0, F.lit("")).otherwise(F.lit("level-5")))
    return Z.binding_mismatch(s, levels.where(n < 2)).select("session_id", "mismatch")


_DIAG = f"""diag as (select capture_id, case when k % 4 = 0 then 'error' when k % 4 = 1 then 'warn' else 'info' end as level, ts_ms as timestamp_ms, event_id as seq from ({fx.base_sql(fx.CHECK)}) b)"""


def _diagnostics(spark, sf) -> DataFrame:
    k = F.col("k") % 4
    level = F.when(k == 0, "error").when(k == 1, "warn").otherwise("info")
    b = fx.run_sql(spark, sf, fx.base_sql(fx.SPARK))
    return b.select("capture_id", level.alias("level"), F.col("ts_ms").alias("timestamp_ms"), F.col("event_id").alias("seq"))


@query(
    "session_status",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD}, {_DIAG}, w as (select capture_id, count(*) as warnings from diag where level in ('warn', 'error') group by 1)
    select s.capture_id, s.session_id, s.slug, case when s.stopped_at_ms is null then 'capturing' else 'idle' end as state,
      case when nonce_origin = 'server' then 'verified' else 'unverified' end as integrity_cap, f.turns, f.tokens_input, f.tokens_output, f.tokens_thinking,
      f.tokens_cache, s.code_reset_count, coalesce(w.warnings, 0) as warnings from sessions s
    join fold f on f.capture_id = s.capture_id and f.attempt_id = s.session_id left join w on w.capture_id = s.capture_id""",
)
def _(spark, sf):
    return Z.session_status(fx.sessions(spark, sf), A.session_totals(fx.turns(spark, sf)), _diagnostics(spark, sf))


@query(
    "session_snapshot",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {_EDITS}, {_PASTES}, n as (select capture_id, attempt_id, count(*) as turns from turns group by all)
    select s.capture_id, s.session_id, s.slug, coalesce(n.turns, 0) as turns, coalesce(p.events, 0) as signals from sessions s
    left join n on n.capture_id = s.capture_id and n.attempt_id = s.session_id left join pasted p on p.capture_id = s.capture_id and p.attempt_id = s.session_id""",
)
def _(spark, sf):
    binding, *parts = Z.session_snapshot(fx.sessions(spark, sf), fx.turns(spark, sf), I.bulk_pastes(_edits(spark, sf)))
    out = binding.select("capture_id", F.col("session_id").alias("attempt_id"), "slug")
    for name, rows in zip(("turns", "signals"), parts):
        out = out.join(rows.groupBy(*KEY).agg(F.count("*").alias(name)), KEY, "left")
    return out.na.fill(0, ["turns", "signals"]).withColumnRenamed("attempt_id", "session_id")


@query("publish_sessions", f"with {Q.SESSIONS} select * exclude (otlp_token) from sessions")
def _(spark, sf):
    return Z.publish_sessions(fx.sessions(spark, sf))


@query(
    "attempt_counters",
    f"""with {_DIAG} select capture_id, count(*) filter (where level = 'error') as resets, count(*) filter (where level = 'warn') as attempts,
    count(*) filter (where level = 'info') as resumes from diag group by 1""",
)
def _(spark, sf):
    names = F.when(F.col("level") == "error", "reset").when(F.col("level") == "warn", "fresh_start").otherwise("resume")
    return Z.attempt_counters(_diagnostics(spark, sf).withColumn("kind", names))


# --- grading ---------------------------------------------------------------


@query(
    "pass_rate",
    """with v as (select doc_id % 20 as suite, case when quality = 1 then 'passed' when toxic = 1 then 'missing' else 'failed' end as status from labels)
    select suite, count(*) filter (where status = 'passed') as passed, count(*) as total,
      cast(count(*) filter (where status = 'passed') as double) / count(*) as ratio, count(*) filter (where status = 'passed') = count(*) as all_passed from v group by 1""",
)
def _(spark, sf):
    return G.pass_rate(G.normalize_verdicts(_verdicts(spark, sf)), ["suite"])


def _verdicts(spark, sf) -> DataFrame:
    labels = fx.load(spark, sf, "labels")
    status = F.when(F.col("quality") == 1, "passed").when(F.col("toxic") == 1, "missing").otherwise("failed")
    message = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("case "), F.col("doc_id").cast("string")))
    return labels.select((F.col("doc_id") % 20).alias("suite"), "doc_id", status.alias("status"), message.alias("message"))


@query(
    "verdict_details",
    """select doc_id, case when quality = 1 then 'passed' when toxic = 1 then 'errored' else 'failed' end as status,
    case when doc_id % 3 = 0 then 'case ' || doc_id when quality <> 1 and toxic = 1 then 'no verdict returned' end as detail from labels""",
)
def _(spark, sf):
    return G.normalize_verdicts(_verdicts(spark, sf)).select("doc_id", "status", "detail")


@query(
    "grade_outputs",
    """select event_id, case event_id % 4 when 0 then true when 1 then event_id % 3 = 0 when 2 then abs(value - (value + 0.01)) <= 0.02 else false end as passed,
    case when event_id % 4 = 3 or (event_id % 4 = 1 and event_id % 3 <> 0) then 'expected ' || strlen(case when event_id % 4 = 3 then event_type || ' 1' else event_type end)
      || ' byte(s) of output, got ' || strlen(case when event_id % 4 = 3 then event_type else event_type || '!' end) end as detail from events""",
)
def _(spark, sf):
    ev = fx.load(spark, sf, "events")
    m, value = F.col("event_id") % 4, F.col("value")
    same = F.col("event_id") % 3 == 0
    kind = F.col("event_type")
    expected = F.when(m == 2, F.concat(kind, F.lit("  "), value.cast("string"))).when(m == 3, F.concat(kind, F.lit(" 1"))).otherwise(kind)
    actual = (
        F.when(m == 0, F.concat(kind, F.lit(" \n\t\u3000")))
        .when(m == 1, F.when(same, kind).otherwise(F.concat(kind, F.lit("!"))))
        .when(m == 2, F.concat(F.lit(" "), kind, F.lit("\n"), (value + 0.01).cast("string"), F.lit("\n")))
        .otherwise(kind)
    )
    rows = ev.select("event_id", expected.alias("expected"), actual.alias("actual"), F.when(m >= 2, F.lit(0.02)).alias("tolerance"))
    return G.output_detail(G.grade_outputs(rows)).select("event_id", "passed", "detail")


@query(
    "first_case_file",
    f"""with {Q.FILES}, c as (select workspace, 'tests/public/' || case when doc_id % 17 = 3 then 'cases' else 'x' || doc_id end || '.json' as path from files)
    select workspace, coalesce(min(path) filter (where path = 'tests/public/cases.json'), min(path)) as case_file from c group by 1""",
)
def _(spark, sf):
    files = fx.files(spark, sf)
    name = F.when(F.col("doc_id") % 17 == 3, F.lit("cases")).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return G.first_case_file(files.withColumn("path", F.concat(F.lit("tests/public/"), name, F.lit(".json"))), ["workspace"])


# --- reports ---------------------------------------------------------------

_MIX = """quotas as (select *, greatest(cast(tokens_input as double), 0) + greatest(cast(tokens_output as double), 0) + greatest(cast(tokens_thinking as double), 0) as total from sums),
  q as (select *, tokens_input / nullif(total, 0) * cast(24.0 as double) as q1, tokens_output / nullif(total, 0) * cast(24.0 as double) as q2, tokens_thinking / nullif(total, 0) * cast(24.0 as double) as q3 from quotas),
  parts as (select capture_id, attempt_id, 1 as i, q1 as v, q1, q2, q3 from q union all select capture_id, attempt_id, 2, q2, q1, q2, q3 from q union all select capture_id, attempt_id, 3, q3, q1, q2, q3 from q),
  cells as (select capture_id, attempt_id, i, cast(floor(v) as bigint) + case when row_number() over (partition by capture_id, attempt_id order by v - floor(v) desc, i)
    <= 24 - (floor(q1) + floor(q2) + floor(q3)) then 1 else 0 end as c from parts)"""


@query(
    "token_mix",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.FOLD}, {_MIX} select capture_id, attempt_id, coalesce(max(c) filter (where i = 1), 0) as cells_input,
    coalesce(max(c) filter (where i = 2), 0) as cells_output, coalesce(max(c) filter (where i = 3), 0) as cells_thinking from cells group by 1, 2""",
)
def _(spark, sf):
    return R.token_mix(A.session_totals(fx.turns(spark, sf))).select(*KEY, "cells_input", "cells_output", "cells_thinking")


@query(
    "burn_trend",
    f"""with {Q.TURNS}, b as (select capture_id, attempt_id, turn_id, emitted_ms, tokens_input + tokens_output + tokens_thinking as burn,
      row_number() over (partition by capture_id, attempt_id order by emitted_ms desc, turn_id desc) as back from turns), p as (select *, max(burn) over (partition by capture_id, attempt_id) as peak from b where back <= 24)
    select capture_id, attempt_id, turn_id, emitted_ms, burn, back, case when peak = 0 then 0 else cast(round(cast(burn as double) / peak * cast(7.0 as double)) as bigint) end as level from p""",
)
def _(spark, sf):
    return R.burn_trend(fx.turns(spark, sf))


_BOARD_COLS = [
    "capture_id", "attempt_id", "turn_index", "turn_id", "prompt_count", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache",
    "counts_estimated", "model_identifier", "harness_used", "economics_id", "score",
]


# Leaders here by summing up all earlier turns of every turn.
@query(
    "running_scoreboard",
    f"""with {Q.TURNS}, {Q.SESSIONS}, {Q.ECON}, {Q.WEIGHTS}, {_INDEXED}, f as (select *, case when coalesce(prompt_id, '') = '' then 1 when row_number() over (partition by capture_id, attempt_id, prompt_id order by turn_index) = 1 then 1 else 0 end as opens,
      case src when 'cursor' then 'cursor' when 'codex' then 'codex_cli' when 'copilot' then 'copilot_chat' else 'claude_code_cli' end as used from indexed),
    upto as (select a.capture_id, a.attempt_id, a.turn_index, b.model, b.used, b.turn_index as place, b.tokens_input + b.tokens_output as mass, b.tokens_input + b.tokens_output + b.tokens_thinking + 1 as weight
      from f a join f b on a.capture_id = b.capture_id and a.attempt_id = b.attempt_id and b.turn_index <= a.turn_index),
    models as (select capture_id, attempt_id, turn_index, model as model_identifier from (select capture_id, attempt_id, turn_index, model, sum(mass) as total, min(place) as since from upto group by all) u
      qualify row_number() over (partition by capture_id, attempt_id, turn_index order by total desc, since) = 1),
    harnesses as (select capture_id, attempt_id, turn_index, used as harness_used from (select capture_id, attempt_id, turn_index, used, sum(weight) as total, min(place) as since from upto group by all) u
      qualify row_number() over (partition by capture_id, attempt_id, turn_index order by total desc, since) = 1),
    sums as (select capture_id, attempt_id, turn_index, turn_id, cast(sum(opens) over w as bigint) as prompt_count, cast(sum(tokens_input) over w as bigint) as tokens_input,
      cast(sum(tokens_output) over w as bigint) as tokens_output, cast(sum(tokens_thinking) over w as bigint) as tokens_thinking, cast(sum(tokens_cache) over w as bigint) as tokens_cache,
      bool_or(confidence = 'estimated') over w as counts_estimated from f
    window w as (partition by capture_id, attempt_id order by turn_index rows between unbounded preceding and current row)),
    board as (select x.*, model_identifier, harness_used, s.challenge_type from sums x join models using (capture_id, attempt_id, turn_index) join harnesses using (capture_id, attempt_id, turn_index)
      join sessions s on s.capture_id = x.capture_id and s.session_id = x.attempt_id), {Q._priced("board")}, {Q._score("cast(2.0 as double)")}
    select {", ".join(_BOARD_COLS)} from scored""",
)
def _(spark, sf):
    board = running_scores(L.turn_index(fx.turns(spark, sf)), fx.sessions(spark, sf), fx.economics(spark), fx.weights(spark))
    return board.select(*_BOARD_COLS)


@query(
    "idle_gaps",
    f"""with {Q.BASE}, g as (select capture_id, ts_ms as idle_from_ms, lead(ts_ms) over (partition by capture_id order by ts_ms) as idle_to_ms from base)
    select capture_id, idle_from_ms, idle_to_ms, idle_to_ms - idle_from_ms as idle_ms from g where idle_to_ms - idle_from_ms >= 100000""",
)
def _(spark, sf):
    at = fx.run_sql(spark, sf, fx.base_sql(fx.SPARK)).select("capture_id", F.col("ts_ms").alias("at_ms"))
    return R.idle_gaps(at, timeout_ms=100_000)


@query(
    "recent_events",
    f"""with {_DIAG} select capture_id, level, timestamp_ms, seq from diag where level in ('warn', 'error')
    qualify row_number() over (partition by capture_id order by timestamp_ms desc, seq desc) <= 50""",
)
def _(spark, sf):
    return R.recent_events(_diagnostics(spark, sf))


@query(
    "source_health",
    f"""with {Q.BASE}, found as (select capture_id, case event_id % 3 when 0 then 'cursor' when 1 then 'codex' else 'copilot' end as source, k % 2 = 0 and user_id % 5 <> 1 as ok, k from base where user_id % 7 <> 0),
    ex as (select distinct b.capture_id, b.user_id, s.source from base b, (values ('cursor'), ('codex'), ('copilot')) s(source)),
    per as (select capture_id, source, count(*) as files, count(*) filter (where ok) as good, cast(sum(k) as bigint) as turns from found group by 1, 2)
    select e.capture_id, e.source, case when user_id % 3 = 0 then 'notfound' when coalesce(files, 0) > 0 and good = 0 then 'unsupported' else 'detected' end as state,
      coalesce(files, 0) as files, coalesce(good, 0) as recognized_files, coalesce(turns, 0) as turns from ex e left join per p on p.capture_id = e.capture_id and p.source = e.source""",
)
def _(spark, sf):
    b = fx.run_sql(spark, sf, fx.base_sql(fx.SPARK))
    m = F.col("event_id") % 3
    source = F.when(m == 0, "cursor").when(m == 1, "codex").otherwise("copilot")
    found = b.where(F.col("user_id") % 7 != 0).select(
        "capture_id", source.alias("source"), ((F.col("k") % 2 == 0) & (F.col("user_id") % 5 != 1)).alias("recognized"), F.col("k").alias("turns")
    )
    expected = b.select("capture_id", (F.col("user_id") % 3 != 0).alias("store_found")).distinct()
    expected = expected.withColumn("source", F.explode(F.array(F.lit("cursor"), F.lit("codex"), F.lit("copilot"))))
    return I.source_health(expected, found)


# --- sources ---------------------------------------------------------------


@query(
    "otlp_turns",
    f"""with {Q.BASE} select capture_id, model, tin as tokens_input, tout as tokens_output, tcache + 7 as tokens_cache,
    prompt_id, ts_ms as timestamp_ms, duration_ms, 's-' || user_id as session_id from base
    where event_id % 50 <> 0 and event_id % 51 <> 0 and (event_id % 3 <> 0 or event_id % 2 = 0)""",
)
def _(spark, sf):
    turns, _bad = otlp.parse_otlp(fx.exports(spark, sf))
    return turns.select(
        "capture_id", "model", "tokens_input", "tokens_output", "tokens_cache", "prompt_id", "timestamp_ms", "duration_ms", "session_id"
    )


@query("otlp_rejected", f"with {Q.BASE} select capture_id, event_id from base where event_id % 50 = 0")
def _(spark, sf):
    _turns, bad = otlp.parse_otlp(fx.exports(spark, sf))
    return bad.select("capture_id", "event_id")


_TALK = f"talk as ({fx.talk_sql(fx.CHECK)})"


@query(
    "prompt_groups",
    f"""with {_TALK}, p as (select *, last_value(case when role = 'user' and not is_meta and not is_command and trim(text) <> '' then 'u-' || conv || '-' || turn end ignore nulls)
      over (partition by conv_id order by turn rows between unbounded preceding and current row) as prompt_id from talk)
    select 'm-' || conv || '-' || turn as event_id, prompt_id, cast(used_in as bigint) as tokens_input, used_out as tokens_output, k.thinking as tokens_thinking, turn + 3 as tokens_cache,
      ts_ms as timestamp_ms, 'ses-' || conv as session_id, '/w/' || conv as workspace
    from p, lateral (select cast(ceil(length(thought) / 4.0) as bigint) as thinking union all select 0) k where role = 'assistant'""",
)
def _(spark, sf):
    lines = lines_of(fx.transcript_lines(spark, sf), "capture_id", "log_id", "pos", "line")
    return transcript.parse_transcripts(lines).select(
        "event_id", "prompt_id", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache", "timestamp_ms", "session_id", "workspace"
    )


@query(
    "transcript_messages",
    f"""with {_TALK} select 'm-' || conv || '-' || turn as event_id, cast(ceil(length(thought) / 4.0) as bigint) as tokens_thinking from talk where role = 'assistant'""",
)
def _(spark, sf):
    lines = lines_of(fx.transcript_lines(spark, sf), "capture_id", "log_id", "pos", "line")
    return keep_first(transcript.parse_transcripts(lines)).select("event_id", "tokens_thinking")


_TURN_COLS = ["event_id", "prompt_id", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache", "timestamp_ms", "session_id", "workspace"]


# The batch rows; lines that a log still holds after it was cut short are read twice.
@query(
    "tailed_turns",
    f"""with {_TALK}, p as (select *, last_value(case when role = 'user' and not is_meta and not is_command and trim(text) <> '' then 'u-' || conv || '-' || turn end ignore nulls)
      over (partition by conv_id order by turn rows between unbounded preceding and current row) as prompt_id,
      cast(sum(case when role = 'assistant' then 2 else 1 end) over (partition by conv_id order by turn) as bigint) as upto,
      cast(sum(case when role = 'assistant' then 2 else 1 end) over (partition by conv_id) as bigint) as n from talk),
    t as (select 'm-' || conv || '-' || turn as event_id, prompt_id, cast(used_in as bigint) as tokens_input, used_out as tokens_output, k.thinking as tokens_thinking, turn + 3 as tokens_cache,
      ts_ms as timestamp_ms, 'ses-' || conv as session_id, '/w/' || conv as workspace, conv_id, n // 2 as half, upto - 2 + k.second as place
      from p, lateral (select 0 as second, cast(ceil(length(thought) / 4.0) as bigint) as thinking union all select 1, 0) k where role = 'assistant')
    select {", ".join(_TURN_COLS)}, cast(sum(case when conv_id % 4 = 0 and place < half then 2 else 1 end) as bigint) as readings from t group by all""",
)
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/tailed-{uuid.uuid4().hex}"
    for step in range(fx.GROWTH_STEPS):
        fx.grow_logs(spark, sf, f"{folder}/logs", step)
        got = _run_to_end(stream_transcripts(stream_tailed_lines(spark, f"{folder}/logs")).select(*_TURN_COLS), folder)
    return got.groupBy(*_TURN_COLS).agg(F.count("*").alias("readings"))


_USAGE = f"usage_log as ({fx.usage_log_sql(fx.CHECK)})"
_DELTAS = """prev as (select *, lag(c_input) over w as p_i, lag(c_cached) over w as p_c, lag(c_output) over w as p_o, lag(c_reasoning) over w as p_r from usage_log where not heartbeat
    window w as (partition by log_id order by n)),
  used as (select log_id, n, case when has_last then q else c_input - coalesce(p_i, 0) end as i, case when has_last then cached else c_cached - coalesce(p_c, 0) end as c,
    case when has_last then n * 10 else c_output - coalesce(p_o, 0) end as o, case when has_last then n else c_reasoning - coalesce(p_r, 0) end as r from prev),
  ctx as (select log_id, n, sum(case when opens then 1 else 0 end) over w as prompts, last_value(case when names_model then model end ignore nulls) over w as named from usage_log
    window w as (partition by log_id order by n rows between unbounded preceding and current row))"""


@query(
    "cumulative_delta",
    f"""with {_USAGE}, {_DELTAS} select cast(u.log_id as varchar) as log_id, u.n * 4 + 3 as pos, case named when 'gpt-5.3' then 'gpt-5-3-codex' when 'GPT-5 Mini' then 'gpt-5-mini' end as model,
    cast(greatest(i - c, 0) as bigint) as tokens_input, cast(o as bigint) as tokens_output, cast(r as bigint) as tokens_thinking, cast(c as bigint) as tokens_cache, 'ses-' || u.log_id || '#p' || prompts as prompt_id,
    'ses-' || u.log_id as session_id, '/w/' || u.log_id as workspace from used u join ctx x on x.log_id = u.log_id and x.n = u.n""",
)
def _(spark, sf):
    lines = lines_of(fx.usage_lines(spark, sf), "capture_id", "log_id", "pos", "line")
    return rollout.usage_deltas(rollout.classify(lines)).select(
        "log_id", "pos", "model", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache", "prompt_id", "session_id", "workspace"
    )


@query(
    "skip_history",
    f"""with {_USAGE}, {_DELTAS} select cast(u.log_id as varchar) as log_id, u.n * 4 + 3 as pos, cast(greatest(i - c, 0) as bigint) as tokens_input from used u where n > 2""",
)
def _(spark, sf):
    lines = lines_of(fx.usage_lines(spark, sf), "capture_id", "log_id", "pos", "line")
    turns = rollout.usage_deltas(rollout.classify(lines)).withColumn("timestamp_ms", F.col("pos"))
    starts = turns.select("capture_id").distinct().withColumn("start_ms", F.lit(12).cast("bigint"))
    return rollout.skip_history(turns, starts).select("log_id", "pos", "tokens_input")


# The same turns from a stream that starts where the history ends.
@query("stream_after_history", CHECKS["skip_history"])
def _(spark, sf):
    lines = cut_lineage(lines_of(fx.usage_lines(spark, sf), "capture_id", "log_id", "pos", "line").withColumn("chunk_no", F.lit(0).cast("bigint")).drop(BLOCK))
    folder = f"{checkpoint_dir(spark)}/after-history-{uuid.uuid4().hex}"
    history = carried_states(lines.where("pos < 12"))
    for low, high in ((12, 20), (20, 1 << 40)):
        lines.where(F.col("pos").between(low, high - 1)).write.parquet(f"{folder}/lines/{low}")
        lines_then = spark.readStream.schema(lines.schema).parquet(f"{folder}/lines/*")
        got = _run_to_end(stream_rollouts(lines_then, history).select("log_id", "pos", "tokens_input"), folder)
    return got


def _tok(x: str) -> str:
    return f"cast(ceil({x} / 4.0) as bigint)"


@query(
    "chat_turns",
    f"""with {_TALK} select 'chat-' || conv || ':r' || turn as event_id, case conv_id % 4 when 0 then 'claude-opus-4-8' when 2 then 'gpt-5-5' when 3 then 'composer-2-5' end as model,
    {_tok("length(thought)")} as tokens_input, {_tok("length(text)")} as tokens_output, {_tok("length(thought)")} as tokens_thinking, ts_ms as timestamp_ms, 'chat-' || conv as session_id
    from talk where role = 'assistant' and length(text) + length(thought) > 0""",
)
def _(spark, sf):
    lines = lines_of(fx.chat_log_lines(spark, sf), "capture_id", "log_id", "pos", "line")
    docs = chat.replay_mutation_log(lines).withColumnRenamed("log_id", "file_stem")
    return chat.parse_chat_documents(docs).select(
        "event_id", "model", "tokens_input", "tokens_output", "tokens_thinking", "timestamp_ms", "session_id"
    )


@query(
    "kv_turns",
    f"""with {_TALK}, b as (select *, case when role = 'user' and turn % 3 = 0 then 1 end as picks, 'b' || lpad(cast(turn as varchar), 4, '0') as bubble from talk where role <> 'system'),
    o as (select *, last_value(case when role = 'user' then bubble end ignore nulls) over w as opened, last_value(case when picks = 1 then coalesce(named, '') end ignore nulls) over w as picked from b
      window w as (partition by conv_id order by turn rows between unbounded preceding and current row)),
    t as (select *, turn % 3 = 0 and used_in > 0 as reported from o where role = 'assistant')
    select 'comp-' || conv || ':' || bubble as event_id, 'comp-' || conv || ':' || coalesce(opened, bubble) as prompt_id,
      coalesce(case picked when 'Claude Opus 4.8' then 'claude-opus-4-8' when 'gpt-5.5' then 'gpt-5-5' when 'composer-2.5-fast' then 'composer-2-5' end, 'claude-haiku-4-5') as model,
      case when reported then used_in else 0 end as tokens_input, case when reported then 0 else {_tok("(length(text) + length(thought))")} end as tokens_output,
      case when reported then 0 else {_tok("length(thought)")} end as tokens_thinking, not reported as counts_estimated, ts_ms as timestamp_ms from t
    where reported or length(text) > 0""",
)
def _(spark, sf):
    return kv.parse_kv_turns(fx.kv_rows(spark, sf)).select(
        "event_id", "prompt_id", "model", "tokens_input", "tokens_output", "tokens_thinking", "counts_estimated", "timestamp_ms"
    )


_ALL_COLS = "event_id, prompt_id, tokens_input, tokens_output, tokens_thinking"


@query(
    "all_sources",
    f"""select 'jsonl' as source, {_ALL_COLS} from ({CHECKS["prompt_groups"]}) t union all select 'cursor', {_ALL_COLS} from ({CHECKS["kv_turns"]}) k""",
)
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    fx.grow_logs(spark, sf, f"{folder}/logs", 1)
    fx.kv_rows(spark, sf).write.parquet(f"{folder}/kv")
    return read_all(spark, {"jsonl": f"{folder}/logs", "cursor": f"{folder}/kv"}).select("source", *_ALL_COLS.split(", "))


# Landed as JSON lines and read by schema; a grade that is not final does not count.
@query(
    "stored_grades",
    """select cast(doc_id as varchar) as submission_id, cast(doc_id as double) / cast(4.0 as double) as score, cast(doc_id % 100 as double) as correctness_pct, toxic = 0 as recognized
    from labels where quality = 1""",
)
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/grades-{uuid.uuid4().hex}"
    rows = fx.load(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("submission_id"), F.when(F.col("quality") == 1, "graded").otherwise("pending").alias("status"),
        (F.col("doc_id") / 4).alias("score"), (F.col("doc_id") % 100).cast("double").alias("correctness_pct"), (F.col("toxic") == 0).alias("recognized"), F.lit("more").alias("note"),
    )
    rows.write.json(folder)
    return tables.read_grades(spark, folder).select("submission_id", "score", "correctness_pct", "recognized")


@query(
    "stored_verdicts",
    """select cast(doc_id as varchar) as submission_id, 'case-' || k as name, case when quality = 1 then 'passed' else 'failed' end as status, case when toxic = 1 then 'x' end as message
    from labels, range(2) r(k) where k <= doc_id % 2""",
)
def _(spark, sf):
    folder = f"{checkpoint_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    case = lambda k: F.struct(F.concat(F.lit("case-"), k.cast("string")).alias("name"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"), F.when(F.col("toxic") == 1, "x").alias("message"))
    cases = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 2), case)
    fx.load(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("submission_id"), cases.alias("cases")).write.json(folder)
    return tables.read_verdicts(spark, folder)


@query(
    "conversation_members",
    f"""with {_TALK}, c as (select distinct conv_id, conv from talk)
    select 'store' as store_id, 'cap-w' as capture_id, 'comp-' || conv as composer_id from c where conv_id % 5 in (0, 1, 3)""",
)
def _(spark, sf):
    convs = fx.talk(spark, sf).select("conv_id", "conv").distinct()
    m = F.col("conv_id") % 5
    comp = F.concat(F.lit("comp-"), F.col("conv"))
    store = F.lit("store").alias("store_id")
    composers = convs.select(
        store, comp.alias("composer_id"),
        F.when(m == 0, F.concat(F.lit("/home/me/app/sub"), F.col("conv"))).when(m == 2, F.lit("/home/other")).alias("root_path"),
        F.when(m == 1, F.lit("h1")).when(m == 2, F.lit("h2")).when(m == 4, F.lit(P.EMPTY_WINDOW)).alias("storage_id"),
    )
    storages = convs.select(
        store, F.when(m == 2, F.lit("h2")).when(m == 4, F.lit(P.EMPTY_WINDOW)).otherwise(F.lit("h1")).alias("storage_id"),
        F.when(m == 2, F.lit("/home/else")).otherwise(F.lit("/home/me")).alias("folder"),
    ).distinct()
    stubs = convs.where((m == 3) | (m == 2)).select(store, F.when(m == 3, "h1").otherwise("h2").alias("storage_id"), comp.alias("composer_id"))
    bound = convs.select(store, F.lit("cap-w").alias("capture_id"), F.lit("/home/me/app/").alias("workspace")).distinct()
    return P.conversation_members(composers, storages, stubs, bound)


_MANIFEST_STATE = """case item_id % 6 when 1 then 'malformed' when 2 then 'unsupported_schema' when 3 then 'missing_level_id' when 4 then 'missing_baseline_hash' end"""


@query("manifest_validation", f"select item_id, {_MANIFEST_STATE} as reason from benchmark")
def _(spark, sf):
    items = fx.load(spark, sf, "benchmark")
    m = F.col("item_id") % 6
    doc = F.to_json(
        F.struct(
            F.when(m == 2, 2).otherwise(1).alias("schema_version"),
            F.when(m == 3, F.lit(" \u00a0")).otherwise(F.lit("lvl")).alias("level_id"),
            F.when(m != 4, F.sha2("text", 256)).alias("baseline_hash"),
            F.array(F.lit("src/**")).alias("file_allowlist"),
            F.create_map(F.lit("W_in"), F.lit(0.5)).alias("token_weight_overrides"),
        )
    )
    docs = items.select("item_id", F.when(m == 1, F.col("text")).otherwise(doc).alias("doc"))
    ok, bad = tables.parse_manifests(docs)
    return ok.select("item_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("item_id", "reason"))


@query("token_estimates", "select conv_id, turn, cast(ceil(length(text) / 4.0) as bigint) as tokens from conversations")
def _(spark, sf):
    return fx.load(spark, sf, "conversations").select("conv_id", "turn", chars_to_tokens(F.length("text")).alias("tokens"))


# --- submission ------------------------------------------------------------


@query("submission_records")
def _(spark, sf):
    """Rows only: every check of its parts is above."""
    sessions, turns = fx.sessions(spark, sf), fx.turns(spark, sf)
    keyed = fx.secrets(spark, sf).select(
        F.concat(F.lit("cap-"), F.crc32("id") % 15).alias("capture_id"),
        F.concat(F.lit("s-"), F.crc32("id") % 15, F.lit("-"), F.crc32("id") % 4).alias("attempt_id"),
        F.concat(F.lit("src/"), F.col("id"), F.lit(".go")).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )
    levels = sessions.select(
        "capture_id", F.col("session_id").alias("attempt_id"), F.array(F.lit("Service.Start")).alias("entry_points"),
        F.array(glob_to_regex_column(F.lit("src/**"))).alias("allow_regexes"),
    )
    records, _messages = submission_records(
        sessions, L.turn_index(turns), fx.changes(spark, sf), keyed, levels, META_DIR, 1800000000000
    )
    return records.withColumn("redacted", _csv("redacted"))


__all__ = ["CHECKS", "QUERIES", "comparable_path", "expected_spans"]
