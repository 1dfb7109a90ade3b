"""The same queries in plain SQL, for an independent engine to check.

Each text is self-contained: common table expressions derive the telemetry from
the test tables exactly as :mod:`turnlake.fixtures` does.
"""

from __future__ import annotations

from turnlake import fixtures as fx
from turnlake.functions.models import CLAUDE_TIERS, DEFAULT_CODEX, MODEL_CATALOG
from turnlake.operators.levels import LEVEL_CATALOG
from turnlake.operators.redact import ENV_LINE, PEM_BEGIN, SECRET_KEY, URL_PASSWORD, WHOLE_SPAN_RULES

D = fx.CHECK
RAW = f"raw as ({fx.raw_sql(D)})"
TURNS = f"turns as ({fx.turns_sql(D)})"
SESSIONS = f"sessions as ({fx.sessions_sql(D)})"
BASE = f"base as ({fx.base_sql(D)})"
ECON = f"economics as ({fx.ECONOMICS_SQL})"
WEIGHTS = f"weights as ({fx.WEIGHTS_SQL})"
MAX = 9223372036854775807

_CID = (
    "substr(sha256(source || chr(0) || coalesce(model, '') || chr(0) || tokens_input || chr(0) || tokens_output || chr(0) "
    "|| tokens_cache || chr(0) || timestamp_ms || chr(0) || coalesce(prompt_id, '') || chr(0)), 1, 16)"
)
IDS = f"""{RAW}, ids as (select *, {_CID} as content_id,
  case when coalesce(event_id, '') <> '' then substr(sha256(source || chr(0) || event_id || chr(0)), 1, 16) else {_CID} end as dedup_id
  from raw)"""
UNIQUE = f"""{IDS}, uniq as (select * from ids
  qualify row_number() over (partition by capture_id, dedup_id order by arrival_ms, arrival_seq) = 1)"""

_CONF = (
    "case when {m} is null or {e} then 'estimated' when {s} = 'otel' then 'otel' else 'jsonl' end"
)
_MODEL = "nullif(trim({}), '')"


def _plaus(p: str = "") -> str:
    total = f"({p}tokens_input + {p}tokens_output + {p}tokens_thinking + {p}tokens_cache)"
    return (
        f"case when {total} = 0 then 'zero tokens reported' else concat_ws('; ', "
        f"case when {p}duration_ms = 0 then 'nonzero tokens with zero duration' end, "
        f"case when abs({p}cost_usd) < 2.220446049250313e-16 then 'nonzero tokens with zero cost' end) end"
    )


def _close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= greatest(50, cast(ceil(cast(0.05 as double) * greatest({a}, {b})) as bigint))"


def _agree(a: str, b: str) -> str:
    ins = f"({_close(a + '.tin', b + '.tin')} or {_close(f'({a}.tin + {a}.cache)', f'({b}.tin + {b}.cache)')})"
    return f"({_close(a + '.tout', b + '.tout')} and {ins})"


def _pairing(expected: bool) -> str:
    """Greedy pairing, one arrival of every tenant per recursion step."""
    if expected:
        held = "cast(ceil((arrival_ms + 20000) / 1000.0) as bigint) * 1000"
        now = "cast(ceil(arrival_ms / 1000.0) as bigint) * 1000"
        flush = f"""case when sp.started_at_ms is null then {now} else least({held}, coalesce(sp.stopped_at_ms, {held})) end"""
        join = """left join sessions sp on sp.capture_id = u.capture_id and sp.otlp_token is not null
          and u.arrival_ms >= sp.started_at_ms and (sp.stopped_at_ms is null or u.arrival_ms <= sp.stopped_at_ms)"""
    else:
        flush, join = "cast(ceil((arrival_ms + 20000) / 1000.0) as bigint) * 1000", ""
    struct = "struct(key varchar, source varchar, model varchar, tin bigint, tout bigint, cache bigint, ts bigint, flush bigint, ord bigint)"
    return f"""
    flushed as (select u.*, {flush} as flush_ms from uniq u {join}),
    arr as (select capture_id, dedup_id as key, source, {_MODEL.format("model")} as model, tokens_input as tin, tokens_output as tout,
        tokens_cache as cache, timestamp_ms as ts, arrival_ms, flush_ms as flush,
        row_number() over (partition by capture_id order by arrival_ms, arrival_seq, dedup_id) as ord
      from flushed where source in ('otel', 'jsonl')),
    sim as (
      select capture_id, cast(0 as bigint) as ord, cast([] as {struct}[]) as live,
        cast(null as varchar) as key, cast(null as varchar) as partner, cast(null as varchar) as fate, cast(null as bigint) as at_ms
      from (select distinct capture_id from arr) c
      union all
      select capture_id, ord,
        case when mate is not null then list_filter(live, lambda x: x.key <> mate)
             when late is not null then list_filter(live, lambda x: x.key <> late)
             else list_append(list_filter(live, lambda x: ceil((x.flush + 60000) / 1000.0) * 1000 > arrival_ms), me) end,
        me.key, coalesce(mate, late),
        case when mate is not null then 'pair' when late is not null then 'suppressed' end, arrival_ms
      from (
        select *, coalesce(
            list_sort(list_transform(agreeing, lambda x: {{'d': abs(x.tout - me.tout) + abs(x.tin - me.tin), 't': abs(x.ts - me.ts), 'o': x.ord, 'k': x.key}}))[1].k,
            case when len(agreeing) = 0 and len(cand) = 1 and cand[1].model = me.model then cand[1].key end) as mate,
          list_sort(list_transform(list_filter(old, lambda x: coalesce(x.model = me.model, false) or {_agree("x", "me")}),
            lambda x: {{'f': x.flush, 'o': x.ord, 'k': x.key}}))[1].k as late
        from (
          select *, list_filter(cand, lambda x: {_agree("x", "me")}) as agreeing
          from (
            select s.capture_id, a.ord, a.arrival_ms, s.live,
              {{'key': a.key, 'source': a.source, 'model': a.model, 'tin': a.tin, 'tout': a.tout, 'cache': a.cache, 'ts': a.ts, 'flush': a.flush, 'ord': a.ord}} as me,
              list_filter(s.live, lambda x: x.source <> a.source and abs(x.ts - a.ts) <= 15000 and x.flush > a.arrival_ms) as cand,
              list_filter(s.live, lambda x: x.source <> a.source and abs(x.ts - a.ts) <= 15000 and x.flush <= a.arrival_ms
                and ceil((x.flush + 60000) / 1000.0) * 1000 > a.arrival_ms) as old
            from sim s join arr a on a.capture_id = s.capture_id and a.ord = s.ord + 1
          ) q1
        ) q2
      ) q3
    ),
    taken as (
      select capture_id, key, fate, partner, at_ms from sim where fate is not null
      union all select capture_id, partner, 'pair', key, at_ms from sim where fate = 'pair'
    ),
    fates as (
      select a.capture_id, a.key, coalesce(t.fate, 'single') as fate, t.partner, coalesce(t.at_ms, a.flush) as at_ms
      from arr a left join taken t on t.capture_id = a.capture_id and t.key = a.key
    ),
    merged as (
      select o.capture_id, o.content_id as turn_id, coalesce({_MODEL.format("o.model")}, {_MODEL.format("j.model")}, '') as model,
        o.harness, o.tokens_input, o.tokens_output, case when j.source is null then o.tokens_thinking else j.tokens_thinking end as tokens_thinking,
        o.tokens_cache, coalesce(o.prompt_id, j.prompt_id) as prompt_id, o.timestamp_ms,
        {_CONF.format(m=f"coalesce({_MODEL.format('o.model')}, {_MODEL.format('j.model')})", e="(j.source is null and o.counts_estimated)", s="o.source")} as confidence,
        coalesce(o.cost_usd, j.cost_usd) as cost_usd, coalesce(o.duration_ms, j.duration_ms) as duration_ms,
        case when j.source is null then o.source else 'otel,jsonl' end as sources,
        coalesce(j.session_id, o.session_id) as session_id, coalesce(j.workspace, o.workspace) as workspace,
        case when j.source is null then 'single' else coalesce(nullif(concat_ws(',',
          case when {_MODEL.format("o.model")} <> {_MODEL.format("j.model")} then 'model' end,
          case when not {_close("o.tokens_output", "j.tokens_output")} then 'tokens_output' end,
          case when not ({_close("o.tokens_input", "j.tokens_input")} or {_close("(o.tokens_input + o.tokens_cache)", "(j.tokens_input + j.tokens_cache)")}) then 'tokens_input' end), ''), 'agree') end as agreement,
        {_plaus("o.")} as plausibility, coalesce(f.at_ms, o.flush_ms) as emitted_ms
      from flushed o left join fates f on f.capture_id = o.capture_id and f.key = o.dedup_id
      left join flushed j on f.fate = 'pair' and j.capture_id = f.capture_id and j.dedup_id = f.partner
      where coalesce(f.fate, 'single') = 'single' or (f.fate = 'pair' and o.source = 'otel')
    )"""


CORRELATED = f"recursive {UNIQUE}, {_pairing(False)}"
CAPTURED = f"""recursive {UNIQUE}, {SESSIONS}, {_pairing(True)},
  attributed as (select m.* exclude (workspace), s.session_id as attempt_id, s.attempt_nonce, coalesce(m.workspace, s.workspace) as workspace
    from merged m join sessions s on s.capture_id = m.capture_id and m.timestamp_ms >= s.started_at_ms
      and (s.stopped_at_ms is null or m.timestamp_ms <= s.stopped_at_ms)
      and (m.workspace is null or rtrim(m.workspace, '/') = s.workspace))"""

_SUMS = ", ".join(
    f"cast(least(sum({t}), {MAX}) as bigint) as {t}"
    for t in ("tokens_input", "tokens_output", "tokens_thinking", "tokens_cache")
)
_HARNESS = "case src when 'cursor' then 'cursor' when 'codex' then 'codex_cli' when 'copilot' then 'copilot_chat' else 'claude_code_cli' end"

FOLD = f"""
  sums as (select capture_id, attempt_id, count(*) as turns, {_SUMS},
      cast(count(distinct nullif(prompt_id, '')) + count(*) filter (where coalesce(prompt_id, '') = '') as bigint) as prompt_count,
      bool_or(confidence = 'estimated') as counts_estimated
    from turns group by all),
  lead_model as (select capture_id, attempt_id, model from (
      select capture_id, attempt_id, model, sum(tokens_input + tokens_output) as m, min((emitted_ms, turn_id)) as f from turns group by all)
    qualify row_number() over (partition by capture_id, attempt_id order by m desc, f) = 1),
  lead_harness as (select capture_id, attempt_id, harness from (
      select capture_id, attempt_id, {_HARNESS} as harness, sum(tokens_input + tokens_output + tokens_thinking + 1) as m,
        min((emitted_ms, turn_id)) as f from turns group by all)
    qualify row_number() over (partition by capture_id, attempt_id order by m desc, f) = 1),
  fold as (select s.capture_id, s.session_id as attempt_id, s.challenge_type, coalesce(u.turns, 0) as turns,
      coalesce(u.tokens_input, 0) as tokens_input, coalesce(u.tokens_output, 0) as tokens_output,
      coalesce(u.tokens_thinking, 0) as tokens_thinking, coalesce(u.tokens_cache, 0) as tokens_cache,
      coalesce(u.prompt_count, 0) as prompt_count, coalesce(u.counts_estimated, true) as counts_estimated,
      coalesce(m.model, '') as model_identifier, coalesce(h.harness, 'claude_code_cli') as harness_used
    from sessions s left join sums u on u.capture_id = s.capture_id and u.attempt_id = s.session_id
    left join lead_model m on m.capture_id = s.capture_id and m.attempt_id = s.session_id
    left join lead_harness h on h.capture_id = s.capture_id and h.attempt_id = s.session_id)"""

_DASHED = "lower(regexp_replace(regexp_replace({}, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'))"
_CANON = "regexp_replace(" + _DASHED + ", '-20[0-9]{{6}}$', '')"


def _priced(source: str) -> str:
    """Economics of ``source``'s ``model_identifier``."""
    return f"""priced as (select f.*, coalesce(r.model_identifier, n.model_identifier, 'baseline-floor-tier') as economics_id,
      coalesce(r.base_effort_multiplier, n.base_effort_multiplier, cast(0.8 as double)) as base0,
      coalesce(r.model_identifier, n.model_identifier) is null as baseline_floor_fallback
    from {source} f
    left join economics r on r.model_identifier = f.model_identifier and r.input_cost is not null and r.output_cost is not null
    left join economics n on n.model_identifier = {_CANON.format("f.model_identifier")} and n.input_cost is not null and n.output_cost is not null)"""


_SCORED = """scored as (select *, cast(100.0 as double) / {scale} as unused from priced)"""


def _score(seconds: str, correctness: str = "cast(100.0 as double)", prompts: str = "cast(prompt_count as double)") -> str:
    d = lambda v: f"cast({v} as double)"
    return f"""
    factors as (select p.*, w.w_in, w.w_out, w.w_think,
      case when p.counts_estimated then greatest(p.base0, {d(1.0)}) else p.base0 end as effort_base,
      least({d(0.05)} * floor({d("p.tokens_thinking")} / {d(5000.0)}), {d(1.0)}) as thinking_overhead,
      case when p.harness_used = 'cursor' then {d(0.2)} else {d(0.0)} end as composer_modifier,
      {d("p.tokens_input")} * w.w_in + {d("p.tokens_output")} * w.w_out + {d("p.tokens_thinking")} * w.w_think as weighted_tokens
      from priced p join weights w on w.challenge_type = coalesce(nullif(p.challenge_type, ''), 'implementation')),
    effort as (select *, effort_base + thinking_overhead + composer_modifier as effort_raw,
      least(greatest(effort_base + thinking_overhead + composer_modifier, {d(0.5)}), {d(3.0)}) as effort,
      greatest({prompts}, {d(1.0)}) as prompts_effective, greatest({seconds}, {d(1.0)}) as seconds_effective,
      greatest(weighted_tokens, {d(100.0)}) as effective_weighted from factors),
    scored as (select *, ({correctness} / (prompts_effective * effort)) * ({d(1000.0)} / effective_weighted)
      * ({d(100.0)} / seconds_effective) as score from effort)"""


CROSS = """cross_source as (select t.capture_id, t.attempt_id, count(*) as turns,
    count(*) filter (where agreement_status = 'disagree') as disagree_turns,
    coalesce((select string_agg(f, ',' order by f) from (select distinct unnest(string_split(agreement_fields, ',')) as f from turns x
      where x.capture_id = t.capture_id and x.attempt_id = t.attempt_id and x.agreement_status = 'disagree')), '') as disagree_fields
    from turns t group by t.capture_id, t.attempt_id)"""
_BENIGN = """(disagree_turns = 0 or (disagree_fields <> '' and len(list_filter(string_split(disagree_fields, ','),
    lambda f: f not in ('tokens_input', 'tokens_output'))) = 0 and disagree_turns * 2 <= turns))"""

_CAT = "[" + ", ".join(f"'{m}'" for m in MODEL_CATALOG) + "]"
_TIERS = "[" + ", ".join(f"'{t}'" for t in CLAUDE_TIERS) + "]"
RESOLVE = f"""
  normed as (select name, {_DASHED.format("regexp_replace(name, '^.*/', '')")} as norm from names),
  parts as (select *, list_filter(string_split(norm, '-'), lambda s: regexp_full_match(s, '[0-9]+')) as digits,
    list_filter({_TIERS}, lambda t: list_contains(string_split(norm, '-'), t))[1] as tier, regexp_replace(norm, '-fast$', '') as base from normed),
  stems as (select *, 'claude-' || tier || '-' || array_to_string(case when regexp_full_match(coalesce(digits[-1], ''), '20[0-9]{{6}}')
    then digits[1:len(digits) - 1] else digits end, '-') as stem from parts),
  looked as (select *,
    case when list_contains({_CAT}, norm) then norm end as exact,
    case when norm like 'claude%' then coalesce(case when list_contains({_CAT}, stem) then stem end,
      list_max(list_filter({_CAT}, lambda c: starts_with(c, stem || '-')))) end as family,
    case when norm = 'codex' or norm like '%-codex' then '{DEFAULT_CODEX}' end as codex,
    list_filter({_CAT}, lambda c: starts_with(c, norm || '-')) as longer,
    case when norm like '%-fast' and list_contains({_CAT}, base) then base end as fast1,
    case when norm like '%-fast' then list_filter({_CAT}, lambda c: starts_with(c, base || '-')) end as fast2 from stems),
  resolved as (select name, case when norm <> '' then coalesce(exact, family, codex, case when len(longer) = 1 then longer[1] end, fast1,
    case when len(fast2) = 1 then fast2[1] end) end as model from looked)"""

LEVELS = "levels as (select * from (values " + ", ".join(
    f"({i + 1}, '{s}', '{w}')" for i, (s, w) in enumerate(LEVEL_CATALOG)
) + ") as v(n, slug, word))"

NAMES_SQL = """select distinct case k % 12
    when 0 then 'Claude Opus 4.' || cast(k % 10 as string) when 1 then 'claude-4.5-sonnet-thinking' when 2 then 'anthropic/claude-haiku-4-5-20251001'
    when 3 then 'gpt-' || cast(k % 8 as string) || '.' || cast(k % 7 as string) when 4 then 'gpt-' || cast(k % 9 as string) || '-codex'
    when 5 then 'composer-' || cast(k % 3 as string) || '.5-fast' when 6 then 'kimi-k2' when 7 then 'grok-build-' || cast(k % 2 as string)
    when 8 then 'claude-' || cast(k % 6 as string) || '-fable' when 9 then 'models/Gemini 3.' || cast(k % 6 as string) || ' Flash'
    when 10 then 'claude-haiku' else '  ' end as name from ({base}) b"""
LEVEL_NAMES_SQL = """select distinct case k % 9
    when 0 then ' Stage-1-01-LRU-eviction-debug ' when 1 then 'LRU' when 2 then cast(k % 25 as string) when 3 then '0' || cast(k % 12 as string)
    when 4 then 'stage-' || cast(k % 5 as string) when 5 then 'stage-1-0' || cast(k % 7 as string) when 6 then 'nan' when 7 then 'stage-4-20'
    else ' unknown ' || cast(k as string) end as name from ({base}) b"""


def _redaction() -> str:
    text, steps, flags = "text", [], []
    rules = [(c, rx, f"[REDACTED:{c}]", "g") for c, rx in WHOLE_SPAN_RULES]
    n_whole = len(rules)
    rules.append(("url_credentials", URL_PASSWORD, "\\1:[REDACTED:url_credentials]@", "gi"))
    rules.append(("env_secret", "(?m)" + ENV_LINE, "\\1[REDACTED:env_secret]", "gi"))
    quote = lambda s: s.replace("'", "''")
    for i, (cat, rx, repl, opts) in enumerate(rules):
        prev = text if i == 0 else f"t{i}"
        steps.append(f"s{i + 1} as (select *, regexp_replace({prev}, '{quote(rx)}', '{repl}', '{opts}') as t{i + 1} from {'secrets' if i == 0 else f's{i}'})")
        flags.append((cat, f"t{i + 1} <> {prev}"))
    n = len(rules)
    head = r"""(["']?""" + SECRET_KEY + r"""["']?[ \t]*[:=][ \t]*)"""
    marked = f"replace(t{n}, '[REDACTED:', chr(1))"
    double = f"regexp_replace({marked}, '{quote(head)}\"[^\"\\r\\n\\x01]{{8,}}\"', '\\1\"' || chr(1) || 'env_secret]\"', 'gi')"
    both = f"regexp_replace({double}, '{quote(head)}''[^''\\r\\n\\x01]{{8,}}''', '\\1''' || chr(1) || 'env_secret]''', 'gi')"
    steps.append(f"s{n + 1} as (select *, replace({both}, chr(1), '[REDACTED:') as t{n + 1} from s{n})")
    flags.append(("env_secret", f"t{n + 1} <> t{n}"))
    cats = {}
    for c, f in flags:
        cats.setdefault(c, []).append(f)
    listed = ", ".join(f"case when {' or '.join(fs)} then '{c}' end" for c, fs in sorted(cats.items()))
    steps.append(
        f"redacted as (select id, bundle, regexp_matches(t{n_whole}, '{PEM_BEGIN}') as uncleanable, t{n + 1} as clean, "
        f"concat_ws(',', {listed}) as categories from s{n + 1})"
    )
    return f"secrets as ({fx.secrets_sql(D)}), " + ", ".join(steps)


REDACTED = _redaction()
FILES = f"files as ({fx.files_sql(D)})"
_PATH = "regexp_replace(regexp_replace(path, '^(\\./)+', ''), '^/+', '')"
_BODY = "replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
HASHES = f"""{FILES}, hashes as (select workspace, sha256(string_agg({_PATH} || chr(0) || {_BODY}, '' order by {_PATH})) as content_hash,
    count(*) as files from files where not ({_PATH} = 'README.md' or {_PATH} = '.meta' or {_PATH} like '.meta/%') group by workspace)"""
