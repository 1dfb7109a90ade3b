"""Cross-source correlation: two logs of one turn become one turn.

The pairing itself is greedy in arrival order (:mod:`.matching`).  What Spark
does here is find the groups inside which it must be sequential.  Two
observations can only interact when their event times are within the pairing
window, so a tenant's time line is cut wherever a whole window-sized bucket is
empty.  The resulting *islands* are independent.  An island is cut once more
wherever nothing arrives for longer than an observation can wait and be
remembered.  Parts seen by one source only need no pairing at all; the others
stream through sorted partitions, where memory holds what may still pair and
nothing that is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.numbers import saturating_add
from turnlake.functions.text import blank_to_null
from turnlake.operators.dedup import keep_first
from turnlake.operators.intervals import join_disjoint
from turnlake.operators.matching import HOLD_MS, MEMORY_MS, TOKEN_FRACTION, TOKEN_SLACK, WINDOW_MS, PairingState, Seen
from turnlake.operators.normalize import confidence, plausibility, resolved_model, single_agreement
from turnlake.schemas import AGREEMENT, CORRELATED_SOURCES, TURN_COLUMNS, TURN_SCHEMA_VERSION
from turnlake.session import cut_lineage

TICK_MS = 1000

_ARRIVAL = (
    "capture_id string, island bigint, part bigint, key string, source string, model string, tin bigint, tout bigint, "
    "cache bigint, ts bigint, arrival_ms bigint, arrival_seq bigint, flush_ms bigint"
)
_FATE = _ARRIVAL + ", fate string, partner string, at_ms bigint"


def tokens_close(a: Column, b: Column) -> Column:
    slack = F.ceil(F.lit(TOKEN_FRACTION) * F.greatest(a, b))
    return F.abs(a - b) <= F.greatest(F.lit(TOKEN_SLACK).cast("bigint"), slack)


def input_close(a_in: Column, a_cache: Column, b_in: Column, b_cache: Column) -> Column:
    return tokens_close(a_in, b_in) | tokens_close(saturating_add(a_in, a_cache), saturating_add(b_in, b_cache))


#: Arrival times beyond this, of broken clocks, count as this when adding to them.
FAR_MS = 1 << 61


def _near(ms: Column) -> Column:
    return F.greatest(F.least(ms, F.lit(FAR_MS)), F.lit(-FAR_MS))


def merged_spans(spans: DataFrame) -> DataFrame:
    """Disjoint spans that cover what ``spans (capture_id, open_ms, close_ms)`` cover; a NULL close is open.

    So a row lies in one span at most, however sessions touch or overlap.
    """
    order = W.partitionBy("capture_id").orderBy("open_ms", "close")
    ends = spans.withColumn("close", F.coalesce("close_ms", F.lit((1 << 63) - 1)))
    reach = F.max("close").over(order.rowsBetween(W.unboundedPreceding, -1))
    begins = ends.withColumn("fresh", (reach.isNull() | (F.col("open_ms") > reach)).cast("long"))
    numbered = begins.withColumn("span", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = numbered.groupBy("capture_id", "span").agg(F.min("open_ms").alias("open_ms"), F.max("close").alias("close"))
    return whole.select("capture_id", "open_ms", F.nullif("close", F.lit((1 << 63) - 1)).alias("close_ms"))


def _ceil_tick(ms: Column, tick_ms: int) -> Column:
    return (ms + F.pmod(-ms, F.lit(tick_ms))).cast("bigint")


def with_flush_time(raw: DataFrame, otel_expected: DataFrame | None = None, tick_ms: int = TICK_MS) -> DataFrame:
    """Add ``flush_ms``, the time at which an unpaired observation gives up.

    ``otel_expected`` holds the spans ``(capture_id, open_ms, close_ms)`` during
    which a counterpart can arrive at all: inside a span the wait is the full
    hold, cut short when the span closes; outside it ends at the next tick.
    Without the table a counterpart is always expected.
    """
    held = _ceil_tick(_near(F.col("arrival_ms")) + F.lit(HOLD_MS), tick_ms)
    if otel_expected is None:
        return raw.withColumn("flush_ms", held)
    spans = merged_spans(otel_expected.select("capture_id", "open_ms", "close_ms"))
    known = join_disjoint(raw, "arrival_ms", spans, "open_ms", "close_ms", ["capture_id"], how="left")
    flush = F.when(
        F.col("open_ms").isNotNull(), F.least(held, F.coalesce(F.col("close_ms"), held))
    ).otherwise(_ceil_tick(_near(F.col("arrival_ms")), tick_ms))
    return known.withColumn("flush_ms", flush).drop("open_ms", "close_ms")


def arrival_gap(tick_ms: int) -> int:
    """After a silence of this long nothing waits or is remembered any more."""
    return HOLD_MS + MEMORY_MS + 2 * tick_ms


def islands(arrivals: DataFrame) -> DataFrame:
    """``(capture_id, bucket, arrival_bucket)`` -> island, part of it and
    whether both sources are in that part.

    Works on one row per occupied pair of buckets (pre-aggregated), so a tenant
    costs its time span, not its rows.
    """
    buckets = arrivals.groupBy("capture_id", "bucket", "arrival_bucket").agg(
        F.bool_or(F.col("source") == "otel").alias("o"), F.bool_or(F.col("source") == "jsonl").alias("j")
    )
    cut = _runs(_runs(buckets, ["capture_id"], "bucket", "island"), ["capture_id", "island"], "arrival_bucket", "part")
    whole = W.partitionBy("capture_id", "island", "part")
    return cut.select(
        "capture_id", "bucket", "arrival_bucket", "island", "part", (F.max("o").over(whole) & F.max("j").over(whole)).alias("two_sided")
    )


def _runs(buckets: DataFrame, keys: list[str], bucket: str, name: str) -> DataFrame:
    """Add the first of each run of neighbouring buckets."""
    line = W.partitionBy(*keys).orderBy(bucket)
    starts = buckets.withColumn("_start", F.when(F.coalesce(F.col(bucket) - F.lag(bucket).over(line) > 1, F.lit(True)), F.col(bucket)))
    return starts.withColumn(name, F.max("_start").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_start")


_ARRIVAL_NAMES = [f.split()[0] for f in _ARRIVAL.split(", ")]
_FATE_NAMES = [f.split()[0] for f in _FATE.split(", ")]


class _Part:
    """The replay of one part of an island; ``rows`` keeps what is not reported yet."""

    def __init__(self, key: tuple, tick_ms: int) -> None:
        self.key = key
        self.state = PairingState(tick_ms)
        self.rows: dict[tuple, tuple] = {}

    def _out(self, fates: list) -> list[tuple]:
        # Everyone is reported once.  A remembered observation may still be
        # another's partner, which only takes its key.
        return [(*self.rows.pop(f.seen.place), f.fate, f.partner.key if f.partner else None, f.at) for f in fates]

    def take(self, row: tuple) -> list[tuple]:
        _, _, _, key, source, model, tin, tout, cache, ts, arrival, seq, flush = row
        seen = Seen((arrival, seq, key), key, source, model, tin, tout, cache, ts, flush)
        self.rows[seen.place] = row
        return self._out(self.state.advance(arrival)) + self._out(self.state.arrive(seen, arrival))

    def finish(self) -> list[tuple]:
        return [(*self.rows[s.place], "single", None, s.flush) for s in self.state.still_waiting()]


def _play(batches: Iterator[pd.DataFrame], tick_ms: int) -> Iterator[pd.DataFrame]:
    """Replay the parts of one partition, one after the other."""
    part = None
    for pdf in batches:
        out: list[tuple] = []
        columns = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in _ARRIVAL_NAMES]
        for row in zip(*columns):
            if part is None or part.key != row[:3]:
                if part is not None:
                    out += part.finish()
                part = _Part(row[:3], tick_ms)
            out += part.take(row)
        if out:
            yield pd.DataFrame(out, columns=_FATE_NAMES)
    if part is not None:
        yield pd.DataFrame(part.finish(), columns=_FATE_NAMES)


def _replay(rows: DataFrame, tick_ms: int) -> DataFrame:
    """Parts are hashed to partitions and streamed in arrival order."""
    part = ["capture_id", "island", "part"]
    ordered = rows.repartition(*part).sortWithinPartitions(*part, "arrival_ms", "arrival_seq", "key")
    return ordered.select(*_ARRIVAL_NAMES).mapInPandas(lambda it: _play(it, tick_ms), _FATE)


def pairing_fates(unique: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    """Fate of every observation of the two correlating sources.

    ``unique`` is de-duplicated and has ``flush_ms``.  Result: ``capture_id,
    key, fate (pair|single|suppressed), partner, at_ms``.
    """
    arrivals = unique.where(F.col("source").isin(*CORRELATED_SOURCES)).select(
        "capture_id",
        F.col("dedup_id").alias("key"),
        "source",
        resolved_model().alias("model"),
        F.col("tokens_input").alias("tin"),
        F.col("tokens_output").alias("tout"),
        F.col("tokens_cache").alias("cache"),
        F.col("timestamp_ms").alias("ts"),
        "arrival_ms",
        "arrival_seq",
        "flush_ms",
        F.expr(f"timestamp_ms div {WINDOW_MS}").alias("bucket"),
        F.expr(f"arrival_ms div {arrival_gap(tick_ms)}").alias("arrival_bucket"),
    )
    line = cut_lineage(islands(arrivals))  # a few rows per tenant, not computed again for each branch
    placed = arrivals.join(line, ["capture_id", "bucket", "arrival_bucket"]).drop("bucket", "arrival_bucket")
    alone = placed.where(~F.col("two_sided")).select(
        "capture_id",
        "key",
        F.lit("single").alias("fate"),
        F.lit(None).cast("string").alias("partner"),
        F.col("flush_ms").alias("at_ms"),
    )
    played = _replay(placed.where("two_sided"), tick_ms)
    return played.select("capture_id", "key", "fate", "partner", "at_ms").unionByName(alone)


def _agreement(twin: Column) -> Column:
    """Field-by-field comparison of the main observation with its twin."""
    mine, theirs = resolved_model(), blank_to_null(twin.getField("model"))
    fields = F.array_compact(
        F.array(
            F.when(mine != theirs, F.lit("model")),
            F.when(~tokens_close(F.col("tokens_output"), twin.getField("tokens_output")), F.lit("tokens_output")),
            F.when(
                ~input_close(
                    F.col("tokens_input"), F.col("tokens_cache"), twin.getField("tokens_input"), twin.getField("tokens_cache")
                ),
                F.lit("tokens_input"),
            ),
        )
    )
    differ = F.size(fields) > 0
    return F.struct(
        F.when(differ, F.lit("disagree")).otherwise(F.lit("agree")).alias("status"),
        F.when(differ, fields).alias("fields"),
    ).cast(AGREEMENT)


def merge_turns(observed: DataFrame) -> DataFrame:
    """One turn per observation, merged with its ``twin`` where it has one.

    The OTLP observation is the main one of a pair: its counts, time, identity
    and plausibility stand.  The transcript twin supplies thinking, session and
    folder, and whatever else the main one lacks.
    """
    twin = F.col("twin")
    paired = twin.isNotNull()
    theirs = twin.getField
    model = F.coalesce(resolved_model(), blank_to_null(theirs("model")))
    estimated = F.when(paired, F.lit(False)).otherwise(F.col("counts_estimated"))
    derived = {
        "schema_version": F.lit(TURN_SCHEMA_VERSION),
        "turn_id": F.col("content_id"),
        "model": F.coalesce(model, F.lit("")),
        "tokens_thinking": F.when(paired, theirs("tokens_thinking")).otherwise(F.col("tokens_thinking")),
        "prompt_id": F.coalesce("prompt_id", theirs("prompt_id")),
        "confidence": confidence(F.col("source"), model, estimated),
        "cost_usd": F.coalesce("cost_usd", theirs("cost_usd")),
        "duration_ms": F.coalesce("duration_ms", theirs("duration_ms")),
        "sources": F.when(paired, F.array(F.lit("otel"), F.lit("jsonl"))).otherwise(F.array("source")),
        "session_id": F.coalesce(theirs("session_id"), F.col("session_id")),
        "attempt_nonce": F.lit(None).cast("string"),
        "workspace": F.coalesce(theirs("workspace"), F.col("workspace")),
        "agreement": F.when(paired, _agreement(twin)).otherwise(single_agreement()),
        "plausibility": plausibility(),
    }
    return observed.select(*[derived.get(c, F.col(c)).alias(c) for c in TURN_COLUMNS])


TWIN_COLUMNS = [
    "model", "tokens_input", "tokens_output", "tokens_thinking", "tokens_cache",
    "prompt_id", "cost_usd", "duration_ms", "session_id", "workspace",
]


def correlate(
    raw: DataFrame,
    otel_expected: DataFrame | None = None,
    tick_ms: int = TICK_MS,
) -> DataFrame:
    """Raw observations -> turns: de-duplicate, pair, merge, pass the rest on.

    The de-duplicated rows and the fates are written once, since each has
    several readers; both stay hashed on ``(capture_id, dedup_id)``, so only
    the twins move again.
    """
    unique = cut_lineage(with_flush_time(keep_first(raw), otel_expected, tick_ms))
    fates = pairing_fates(unique, tick_ms)
    fates = cut_lineage(fates.withColumnRenamed("key", "dedup_id").repartition("capture_id", "dedup_id"))
    twins = (
        unique.where(F.col("source") == "jsonl")
        .join(fates.where(F.col("fate") == "pair"), ["capture_id", "dedup_id"])
        .select("capture_id", F.col("partner").alias("dedup_id"), F.struct(*TWIN_COLUMNS).alias("twin"))
    )
    # Editor sources have no fate: each of their rows is a turn of its own.
    known = unique.join(fates, ["capture_id", "dedup_id"], "left").join(twins, ["capture_id", "dedup_id"], "left")
    fate = F.coalesce("fate", F.lit("single"))
    main = known.where((fate == "single") | ((fate == "pair") & (F.col("source") == "otel")))
    return merge_turns(main.withColumn("emitted_ms", F.coalesce("at_ms", "flush_ms")))
