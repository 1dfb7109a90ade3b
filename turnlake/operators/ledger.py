"""Tamper-evident ledger heads and chain messages.

A hash chain is sequential within its session.  The links before the hashing -
the canonical encodings - are columns; the chain itself runs along one sorted
partition with the last digest as its only state, so a session of any length is
one pass and is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.operators.attempts import KEY
from turnlake.operators.segments import lag_value, position_blocks, range_blocks, row_index, with_ordered

# Fixed values of the ledger format.
LEDGER_VERSION = 1
SEP = "\u001f"
CHAIN_VERSION = 4
#: Heads of a batch handed on.
BATCH_HEADS = 10_000


def turn_index(turns: DataFrame, order: list[str] | None = None) -> DataFrame:
    """0-based position of every turn in its attempt, in emit order."""
    order = order or ["emitted_ms", "turn_id"]
    blocks = range_blocks(turns, KEY, order)
    return with_ordered(blocks, KEY, order, {"turn_index": row_index()})


def canonical_turn() -> Column:
    """The fixed-order encoding of one turn, integrity signals included."""
    agreement = F.concat(
        F.col("agreement.status"),
        F.when(F.col("agreement.status") == "disagree", F.concat(F.lit(":"), F.array_join("agreement.fields", ",")))
        .otherwise(F.lit("")),
    )
    plausibility = F.concat(
        F.col("plausibility.status"),
        F.when(F.col("plausibility.status") == "low", F.concat(F.lit(":"), F.array_join("plausibility.reasons", ",")))
        .otherwise(F.lit("")),
    )
    parts = [
        F.col("turn_id"),
        F.col("timestamp_ms").cast("string"),
        F.col("model"),
        *[F.col(t).cast("string") for t in ("tokens_input", "tokens_output", "tokens_thinking", "tokens_cache")],
        F.col("confidence"),
        agreement,
        plausibility,
        F.array_join("sources", ","),
        F.coalesce("attempt_nonce", F.lit("")),
    ]
    return F.concat_ws(SEP, *parts)


def genesis(domain: str) -> Column:
    """First link: binds the chain's domain tag and the session identity."""
    text = F.concat_ws(
        SEP, F.lit(domain), F.lit("genesis"), F.col("attempt_id"), F.col("started_at_ms").cast("string")
    )
    return F.sha2(text.cast("binary"), 256)


_HEADS = pa.schema([("capture_id", pa.string()), ("attempt_id", pa.string()), ("head", pa.string()), ("turn_count", pa.int64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads out of rows sorted by session, its first link ahead of its turns."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    done: list[tuple] = []
    for (capture, attempt), links in groupby(rows, itemgetter(0, 1)):
        head, count = None, 0
        for _, _, is_turn, text in links:
            if not is_turn:
                head = text
            elif head is not None:
                head = sha256(f"{head}{SEP}{text}".encode()).hexdigest()
                count += 1
        if head is not None:
            done.append((capture, attempt, head, count))
        if len(done) >= BATCH_HEADS:
            yield _heads_batch(done)
            done = []
    if done:
        yield _heads_batch(done)


def _heads_batch(heads: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads), _HEADS.types)], schema=_HEADS)


def ledger_heads(sessions: DataFrame, turns: DataFrame, domain: str, order: list[str] | None = None) -> DataFrame:
    """Ledger head of every session.

    ``sessions``: keys and ``started_at_ms``, a row each; ``turns``: normalized
    turns, chained by ``order`` (by ``turn_index`` where there is one, else in
    emit order); ``domain``: the tag the verifying side uses.
    """
    order = order or (["turn_index"] if "turn_index" in turns.columns else ["emitted_ms", "turn_id"])
    links = turns.select(*KEY, F.lit(True).alias("is_turn"), canonical_turn().alias("text"), *order)
    begins = sessions.select(*KEY, F.lit(False).alias("is_turn"), genesis(domain).alias("text"))
    both = begins.unionByName(links, allowMissingColumns=True).repartition(*KEY).sortWithinPartitions(*KEY, "is_turn", *order)
    heads = both.select(*KEY, "is_turn", "text").mapInArrow(_chain, "capture_id string, attempt_id string, head string, turn_count bigint")
    return heads.withColumn("schema", F.lit(LEDGER_VERSION))


def verify_seals(heads: DataFrame, seals: DataFrame) -> DataFrame:
    """Audit stored seals against recomputed heads.

    A missing seal, another version or another head means the stored turns
    cannot be trusted (``start_fresh``).
    """
    stored = seals.select(
        *KEY, F.col("schema").alias("_schema"), F.col("turn_count").alias("_count"), F.col("head").alias("_head")
    )
    joined = heads.join(stored, KEY, "left")
    good = (
        (F.col("_schema") == F.col("schema")) & (F.col("_count") == F.col("turn_count")) & (F.col("_head") == F.col("head"))
    )
    return joined.select(
        *KEY, "turn_count", "head", F.when(F.coalesce(good, F.lit(False)), "trusted").otherwise("start_fresh").alias("seal")
    )


def _json(x: Column) -> Column:
    """A JSON string literal (``to_json`` of a one-field document, unwrapped)."""
    doc = F.to_json(F.struct(x.alias("s")))
    return F.when(x.isNotNull(), F.substr(doc, F.lit(6), F.length(doc) - 6))


def _obj(fields: list[tuple[str, Column]]) -> Column:
    parts = []
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def turn_messages(turns: DataFrame, version: int = CHAIN_VERSION) -> DataFrame:
    """Canonical message of every turn: sorted keys, no white space.

    ``turns`` has ``turn_index`` and, for a chain that was signed already,
    ``prev_signature``; signing is not done here.
    """
    prev = F.col("prev_signature") if "prev_signature" in turns.columns else F.lit(None).cast("string")
    counts = _obj(
        [(n, _num(f"tokens_{n}")) for n in ("cache", "input", "output", "thinking")]
    )
    names = F.array_sort(F.array_distinct("sources"))
    sources = F.concat(F.lit("["), F.array_join(F.transform(names, _json), ","), F.lit("]"))
    fields = [
        ("attempt_nonce", _json(F.coalesce("attempt_nonce", F.lit("")))),
        ("chain_version", F.lit(str(version))),
        ("model", _json(F.col("model"))),
        ("prev_signature", F.coalesce(_json(prev), F.lit("null"))),
        ("token_counts", counts),
        ("turn_index", _num("turn_index")),
    ]
    if version >= 3:
        fields += [("confidence", _json(F.col("confidence"))), ("sources", sources), ("timestamp_ms", _num("timestamp_ms"))]
    message = _obj(sorted(fields, key=lambda f: f[0]))
    return turns.select(*KEY, "turn_index", message.alias("message"))


def final_messages(attempts: DataFrame, version: int = CHAIN_VERSION) -> DataFrame:
    """Canonical terminal message of every attempt.

    ``attempts``: keys, ``attempt_nonce, final_code_hash, turns, disagree_turns,
    disagree_fields``, the capture-summary columns and optionally
    ``prev_signature``.
    """
    prev = F.col("prev_signature") if "prev_signature" in attempts.columns else F.lit(None).cast("string")
    differ = F.concat(F.lit("["), F.array_join(F.transform("disagree_fields", _json), ","), F.lit("]"))
    summary = [
        ("baseline_attested", _num("baseline_attested")),
        ("baseline_reset_count", _num("baseline_reset_count")),
        ("bulk_paste_events", _num("bulk_paste_events")),
        ("ignore_changed", _num("ignore_changed")),
        ("nonce_origin", _json(F.col("nonce_origin"))),
        ("pause_count", _num("pause_count")),
        ("paused_ms_total", _num("paused_ms_total")),
        *([("prompt_count", _num("prompt_count"))] if version >= 4 else []),
        ("signed_at_ms", _num("signed_at_ms")),
        ("started_at_ms", _num("started_at_ms")),
        ("untracked_edit_windows", _num("untracked_edit_windows")),
    ]
    fields = [
        ("attempt_nonce", _json(F.coalesce("attempt_nonce", F.lit("")))),
        *([("capture_summary", _obj(summary))] if version >= 3 else []),
        ("chain_version", F.lit(str(version))),
        *([("cross_source", _obj([("disagree_fields", differ), ("disagree_turns", _num("disagree_turns"))]))] if version >= 2 else []),
        ("final_code_hash", _json(F.col("final_code_hash"))),
        ("prev_signature", F.coalesce(_json(prev), F.lit("null"))),
        ("turn_count", _num("turns")),
    ]
    return attempts.select(*KEY, _obj(fields).alias("message"))


def chain_continuity(entries: DataFrame, known_versions: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Audit submitted chains without ordering them.

    ``entries``: keys, ``entry (turn|final), turn_index, turn_count,
    chain_version``.  Indices are contiguous from 0 exactly when the n turns
    have n distinct indices between 0 and n - 1.
    """
    is_turn = F.col("entry") == "turn"
    per = entries.groupBy(*KEY).agg(
        F.count_if(is_turn).alias("turns"),
        F.count_distinct(F.when(is_turn, F.col("turn_index"))).alias("_distinct"),
        F.min(F.when(is_turn, F.col("turn_index"))).alias("_lo"),
        F.max(F.when(is_turn, F.col("turn_index"))).alias("_hi"),
        F.count_if(F.col("entry") == "final").alias("finals"),
        F.max(F.when(F.col("entry") == "final", F.col("turn_count"))).alias("claimed"),
        F.bool_and(F.col("chain_version").isin(*known_versions)).alias("versions_known"),
        (F.min("chain_version") == F.max("chain_version")).alias("_one_version"),
    )
    contiguous = (F.col("turns") == 0) | (
        (F.col("_lo") == 0) & (F.col("_hi") == F.col("turns") - 1) & (F.col("_distinct") == F.col("turns"))
    )
    fault = (
        F.when(~F.col("versions_known") | ~F.col("_one_version"), "unknown_version")
        .when(F.col("finals") != 1, "terminal_entry")
        .when(~contiguous, "index_gap")
        .when(F.col("claimed") != F.col("turns"), "turn_count")
        .otherwise("ok")
    )
    return per.select(*KEY, "turns", "finals", "claimed", fault.alias("continuity"))


def with_prev_signature(entries: DataFrame) -> DataFrame:
    """Each entry's predecessor signature, in ``turn_index`` order."""
    blocks = position_blocks(entries, "turn_index")
    return with_ordered(blocks, KEY, ["turn_index"], {"prev_signature": lag_value(F.col("signature"))})
