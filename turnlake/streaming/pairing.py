"""Cross-source pairing on a stream, by capture.

The same rule as the batch job (:mod:`turnlake.operators.matching`).  The state
of a capture has an entry for each observation that waits and each that gave up
recently, both bounded by the rule's hold and memory times.  A micro-batch
writes the entries it changes, not the others.  Captures of a hash bucket share
a key of the state, and an observation travels and is kept as one JSON text, so
calls and cells between Python and the state store stay few.  A processing-time
timer lets idle captures give up too; :func:`drain` reads what still waits when
a query has ended.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnlake.functions.hashing import content_id, dedup_id
from turnlake.operators.correlate import TICK_MS, TWIN_COLUMNS, merge_turns
from turnlake.operators.matching import HOLD_MS, PairingState, Seen
from turnlake.schemas import CORRELATED_SOURCES, RAW_TURN
from turnlake.streaming.ingest import use_rocksdb

#: A control row makes its capture give up everything at once (session stop).
STOP = "stop"

#: Fixed for a query: captures share the state of their hash bucket.
BUCKETS = 1 << 13
_ROW = T.StructType(
    RAW_TURN.fields
    + [
        T.StructField("content_id", T.StringType()),
        T.StructField("dedup_id", T.StringType()),
        T.StructField("flush_ms", T.LongType()),
    ]
)
#: Where an observation of a capture stands in the order of arrival, and what is held of it.
_PLACE = T.StructType(
    [T.StructField("capture_id", T.StringType()), T.StructField("arrival_ms", T.LongType()), T.StructField("arrival_seq", T.LongType()), T.StructField("dedup_id", T.StringType())]
)
_HELD = T.StructType([T.StructField("row", T.StringType()), T.StructField("flush_ms", T.LongType())])
#: Rows as JSON: the main observation and, of a pair, its twin.
_OUT = T.StructType([T.StructField("row", T.StringType()), T.StructField("emitted_ms", T.LongType()), T.StructField("twin", T.StringType())])
_TWIN = T.StructType([RAW_TURN[c] for c in TWIN_COLUMNS])


class Pairing(StatefulProcessor):
    """Waiting and remembered observations of the captures of one bucket.

    ``idle_flush`` is for queries that follow live logs: timers run by the
    clock, so on a replay of old logs they would end every wait at once.
    """

    def __init__(self, tick_ms: int = TICK_MS, idle_flush: bool = True) -> None:
        self.tick_ms, self.idle_flush = tick_ms, idle_flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _PLACE, _HELD)
        self.memory = handle.getMapState("memory", _PLACE, _HELD)

    def _restore(self) -> None:
        self.states: dict[str | None, PairingState] = {}
        self.texts: dict[tuple, str] = {}
        for stored, remembered in ((self.waiting, False), (self.memory, True)):
            for (capture, *_), (text, flush) in stored.iterator():
                state = self.states.setdefault(capture, PairingState(self.tick_ms))
                seen = self._seen(json.loads(text), text)._replace(flush=flush)
                state.remember(seen) if remembered else state.wait(seen)
        self.before = {c: {n: {s.place for s in now} for n, now in self._now(state).items()} for c, state in self.states.items()}

    @staticmethod
    def _now(state: PairingState) -> dict[str, list[Seen]]:
        return {"waiting": state.still_waiting(), "memory": state.still_remembered()}

    def _store(self) -> None:
        """Write the entries that are new, remove those that are gone."""
        for capture, state in self.states.items():
            for name, seen in self._now(state).items():
                stored, places = getattr(self, name), {s.place for s in seen}
                before = self.before.get(capture, {}).get(name, set())
                for place in before - places:
                    stored.removeKey((capture, *place))
                for s in seen:
                    if s.place not in before:
                        stored.updateValue((capture, *s.place), (self.texts[capture, s.place], s.flush))
        if self.idle_flush:
            self._keep_timer(min((s.flush for state in self.states.values() for s in state.still_waiting()), default=None))

    def _keep_timer(self, due: int | None) -> None:
        """One timer, for the first that gives up; none if nothing waits."""
        set_before = list(self.handle.listTimers())
        if due is not None:
            at = max(due, int(time.time() * 1000) + self.tick_ms)
            if any(t <= at for t in set_before):
                return
            self.handle.registerTimer(at)
        for t in set_before:
            self.handle.deleteTimer(t)

    def _seen(self, row: dict, text: str) -> Seen:
        model = (row.get("model") or "").strip() or None
        seen = Seen(
            self._place(row), row.get("dedup_id"), row.get("source"), model, row.get("tokens_input"), row.get("tokens_output"),
            row.get("tokens_cache"), row.get("timestamp_ms"), row.get("flush_ms"),
        )
        self.texts[row.get("capture_id"), seen.place] = text
        return seen

    @staticmethod
    def _place(row: dict) -> tuple:
        return row.get("arrival_ms"), row.get("arrival_seq"), row.get("dedup_id")

    def _emit(self, capture: str | None, fates: list) -> Iterator[Row]:
        for f in fates:
            if f.fate == "suppressed" or (f.fate == "pair" and f.seen.source != "otel"):
                continue
            twin = self.texts[capture, f.partner.place] if f.fate == "pair" else None
            yield Row(*_OUT.fieldNames())(self.texts[capture, f.seen.place], f.at, twin)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._restore()
        arrivals: dict[str | None, list[tuple]] = {}
        for packed in rows:
            row = json.loads(packed.row)
            arrivals.setdefault(row.get("capture_id"), []).append((row, packed.row))
        for capture, own in arrivals.items():
            state = self.states.setdefault(capture, PairingState(self.tick_ms))
            # One capture's part of one micro-batch, put back in order.
            for row, text in sorted(own, key=lambda r: self._place(r[0])):
                now = row.get("arrival_ms")
                yield from self._emit(capture, state.advance(now))
                if row.get("source") == STOP:
                    yield from self._emit(capture, state.give_up(now))
                elif row.get("source") in CORRELATED_SOURCES:
                    yield from self._emit(capture, state.arrive(self._seen(row, text), now))
                else:
                    yield Row(*_OUT.fieldNames())(text, row.get("flush_ms"), None)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._restore()
        for capture, state in self.states.items():
            yield from self._emit(capture, state.advance(timerValues.getCurrentProcessingTimeInMs()))
        self._store()

    def close(self) -> None:
        pass


def correlate_stream(raw: DataFrame, tick_ms: int = TICK_MS, idle_flush: bool = True) -> DataFrame:
    """Turns of a de-duplicated stream of raw observations.

    Batches must come in arrival order.  ``idle_flush`` lets observations of
    idle captures give up by the clock; switch it off to replay old logs, and
    :func:`drain` the query when it has ended.  ``raw`` may have ``otel_expected`` (default true): without an expected
    counterpart an observation gives up at the next tick.  Rows whose source is
    ``stop`` are session stops; they carry ``capture_id`` and ``arrival_ms``.
    """
    use_rocksdb(raw.sparkSession)
    expected = F.col("otel_expected") if "otel_expected" in raw.columns else F.lit(True)
    wait = F.when(expected, F.lit(HOLD_MS)).otherwise(F.lit(0))
    due = F.col("arrival_ms") + wait
    rows = raw.withColumns(
        {
            "content_id": F.coalesce(content_id(), F.lit("")),
            "dedup_id": F.coalesce(dedup_id(), F.lit("")),
            "flush_ms": (due + F.pmod(-due, F.lit(tick_ms))).cast("bigint"),
        }
    )
    row = F.to_json(F.struct(*_ROW.fieldNames())).alias("row")
    bucket = F.pmod(F.xxhash64("capture_id"), F.lit(BUCKETS)).alias("_bucket")
    paired = rows.select(bucket, row).groupBy("_bucket").transformWithState(
        statefulProcessor=Pairing(tick_ms, idle_flush), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime" if idle_flush else "None"
    )
    return _turns(paired)


def drain(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Turns of the observations that an ended query (with that checkpoint) still held back.

    Together with what the query has emitted these are the turns that the batch
    job finds in the same observations: nothing is lost when a query stops for
    good.  The state stays as it is, so a query that goes on later must not be
    drained.
    """
    use_rocksdb(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "waiting").load()
    return _turns(state.select("user_map_value.row", F.col("user_map_value.flush_ms").alias("emitted_ms"), F.lit(None).cast("string").alias("twin")))


def _turns(paired: DataFrame) -> DataFrame:
    rows = paired.select(F.from_json("row", _ROW).alias("_r"), "emitted_ms", F.from_json("twin", _TWIN).alias("twin"))
    return merge_turns(rows.select("_r.*", "emitted_ms", "twin"))
