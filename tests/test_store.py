"""The committed store: kills, repeats, compaction, seals."""

import json

import pytest
from pyspark.sql import functions as F

from turnlake import fixtures as fx
from turnlake.streaming.store import TurnStore


@pytest.fixture
def turns(spark, sf_dir):
    return fx.turns(spark, sf_dir).where("capture_id in ('cap-1', 'cap-2', 'cap-5')")


@pytest.fixture
def store(tmp_path):
    return TurnStore(str(tmp_path / "store"), "d")


def ids(df):
    return sorted(r.turn_id for r in df.select("turn_id").collect())


def halves(turns):
    return [turns.where(F.col("event_id") % 2 == k) for k in (0, 1)]


def test_kills_and_repeats_count_once(spark, store, turns):
    first, second = halves(turns)
    assert store.read(spark) is None
    store.write(first, "q", 0)
    store.write_data(second, "q-killed")  # before its commit
    assert ids(store.read(spark)) == ids(first)
    store.write(second, "q", 1)
    store.write(second, "q", 1)  # after its commit
    store.write(first, "q", 0)
    assert ids(store.read(spark)) == ids(turns)
    assert "PartitionFilters: [isnotnull(capture_date" in store.read(spark).where("capture_date = '2024-01-01'")._jdf.queryExecution().toString()


def test_compaction_keeps_rows_and_writes_few_files(spark, store, turns):
    for k in range(4):
        store.write(turns.where(F.col("event_id") % 4 == k).repartition(5), "q", k)
    before = ids(store.read(spark))
    store.compact(spark)
    store.write(turns.where(F.col("event_id") % 4 == 1), "q", 1)  # a repeat of what is compacted
    assert ids(store.read(spark)) == before == ids(turns)
    assert len(store.read(spark).inputFiles()) <= store.read(spark).select("capture_date").distinct().count()
    assert store.resume(spark)[1].where("seal <> 'trusted'").count() == 0


def test_broken_seals_start_fresh(spark, store, turns, tmp_path):
    for k, rows in enumerate(halves(turns)):
        store.write(rows, "q", k)
    trusted, status = store.resume(spark)
    assert ids(trusted) == ids(turns) and {r.seal for r in status.collect()} == {"trusted"}
    # One turn's tokens lowered in one batch: its session is out with all its turns, the others stay.
    commit = store.commits()["q-000000000001"]
    data = f"{store.path}/data/folder={commit['folder']}"
    rows = spark.read.parquet(data).checkpoint()
    victim = rows.orderBy("turn_id").first()
    lower = F.when(F.col("turn_id") == victim.turn_id, F.col("tokens_output") - 1).otherwise(F.col("tokens_output"))
    rows.withColumn("tokens_output", lower).write.mode("overwrite").partitionBy("capture_date").parquet(data)
    trusted, status = store.resume(spark)
    assert [(r.capture_id, r.attempt_id) for r in status.where("seal = 'start_fresh'").collect()] == [(victim.capture_id, victim.attempt_id)]
    assert ids(trusted) == ids(turns.where(F.col("attempt_id") != victim.attempt_id))


def test_another_version_starts_fresh(spark, store, turns, tmp_path):
    store.write(turns, "q", 0)
    file = tmp_path / "store" / "commits" / "q-000000000000.json"
    file.write_text(json.dumps(json.loads(file.read_text()) | {"version": 0}))
    trusted, status = store.resume(spark)
    assert trusted.count() == 0 and {r.seal for r in status.collect()} == {"start_fresh"}
