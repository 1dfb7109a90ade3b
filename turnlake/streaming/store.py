"""The committed, sealed store of turns.

A micro-batch is written to a folder of its own, by capture date, and counts
only once a commit names that folder.  A batch killed before its commit is
written again to another folder; one repeated after it changes nothing.  So
readers, who follow the commits, see every batch whole and once.

Each batch carries a seal per session, the ledger head over the session's turns
in it.  On a restart the heads are computed again: a session with a missing or
different seal, or in a store of another version, starts fresh instead of
resuming what somebody may have edited.

Layout below the store's path: ``data/folder=<folder>/capture_date=.../``,
``seals/<folder>/``, ``commits/<query>-<batch>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators.attempts import KEY
from turnlake.operators.ledger import ledger_heads
from turnlake.streaming.tail import open_folder

#: Bump when turns or seals change their form; sessions of an older store start fresh.
STORE_VERSION = 1
#: Turns of a file that compaction writes.
FILE_TURNS = 1_000_000


@dataclass(frozen=True)
class TurnStore:
    """Turns with ``capture_id, attempt_id, emitted_ms, turn_id`` and the columns a ledger covers."""

    path: str
    domain: str

    # --- writing

    def write(self, batch: DataFrame, query: str, batch_id: int) -> None:
        """Store a micro-batch of ``query`` once, however often it comes; a ``foreachBatch`` function."""
        name = f"{query}-{batch_id:012d}"
        if name not in self.commits():
            self.commit(name, self.write_data(batch, name), [])

    def sink(self, query: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: self.write(batch, query, batch_id)

    def write_data(self, turns: DataFrame, name: str) -> str:
        """Write turns and their seals to a new folder, which no reader sees yet."""
        folder = f"{name}-{uuid.uuid4().hex}"
        dated = turns.withColumn("capture_date", F.date_format(F.timestamp_millis("emitted_ms"), "yyyy-MM-dd"))
        dated.write.partitionBy("capture_date").parquet(f"{self.path}/data/folder={folder}")
        # The seals cover what was written, not what would be computed again.
        self._heads(self._data(turns.sparkSession, [folder])).write.parquet(f"{self.path}/seals/{folder}")
        return folder

    def commit(self, name: str, folder: str, replaces: list[str]) -> None:
        """Make a folder count, in one step, instead of the commits it ``replaces``."""
        system, base = open_folder(self.path)
        system.create_dir(f"{base}/commits", recursive=True)
        waiting = f"{base}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(waiting) as out:
            out.write(json.dumps({"version": STORE_VERSION, "folder": folder, "replaces": replaces}).encode())
        system.move(waiting, f"{base}/commits/{name}.json")

    def compact(self, spark: SparkSession) -> None:
        """Put the trusted sessions of all batches into few files; the old folders stay until they are cleaned up."""
        before = self.commits()
        turns = self.resume(spark)[0].drop("capture_date").repartition(1 + sum(self._rows(spark, c["folder"]) for c in self._live(before).values()) // FILE_TURNS)
        name = f"compact-{uuid.uuid4().hex}"
        self.commit(name, self.write_data(turns, name), sorted(before))

    # --- reading

    def commits(self) -> dict[str, dict]:
        from pyarrow import fs

        system, base = open_folder(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with system.open_input_file(info.path) as f:
                    found[info.base_name.removesuffix(".json")] = json.loads(f.read())
        return found

    @staticmethod
    def _live(commits: dict[str, dict]) -> dict[str, dict]:
        gone = {r for c in commits.values() for r in c["replaces"]}
        return {n: c for n, c in sorted(commits.items()) if n not in gone}

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All committed turns, with ``capture_date`` to prune by; None before the first commit."""
        folders = [c["folder"] for c in self._live(self.commits()).values()]
        return self._data(spark, folders).drop("_folder") if folders else None

    def resume(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Turns of the sessions that may go on, and ``capture_id, attempt_id, turns, seal`` of all.

        ``seal`` is trusted or start_fresh.
        """
        live = self._live(self.commits())
        current = [c["folder"] for c in live.values() if c["version"] == STORE_VERSION]
        turns = self._data(spark, [c["folder"] for c in live.values()])
        seals = [spark.read.parquet(f"{self.path}/seals/{f}") for f in current]
        heads = self._heads(turns)
        stored = heads.limit(0) if not seals else seals[0]
        for more in seals[1:]:
            stored = stored.unionByName(more)
        at = [*KEY, "_folder"]
        both = heads.join(stored.select(*at, F.col("head").alias("_head"), F.col("turn_count").alias("_count")), at, "full")
        # A seal without turns tells of turns that were deleted.
        good = F.coalesce((F.col("head") == F.col("_head")) & (F.col("turn_count") == F.col("_count")), F.lit(False))
        status = both.groupBy(*KEY).agg(F.coalesce(F.sum("turn_count"), F.lit(0)).alias("turns"), F.bool_and(good).alias("good"))
        status = status.select(*KEY, "turns", F.when(F.col("good"), "trusted").otherwise("start_fresh").alias("seal"))
        trusted = turns.drop("_folder").join(status.where("seal = 'trusted'").select(*KEY), KEY, "left_semi")
        return trusted, status

    def _data(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        base = f"{self.path}/data"
        rows = spark.read.option("basePath", base).parquet(*[f"{base}/folder={f}" for f in folders])
        return rows.withColumnRenamed("folder", "_folder").withColumn("capture_date", F.col("capture_date").cast("string"))

    def _rows(self, spark: SparkSession, folder: str) -> int:
        return spark.read.parquet(f"{self.path}/seals/{folder}").agg(F.coalesce(F.sum("turn_count"), F.lit(0))).first()[0]

    def _heads(self, turns: DataFrame) -> DataFrame:
        """Ledger head of each session's turns in each folder."""
        one = F.to_json(F.struct("attempt_id", "_folder"))
        sessions = turns.groupBy(*KEY, "_folder").agg(F.min("emitted_ms").alias("started_at_ms"))
        heads = ledger_heads(sessions.withColumn("attempt_id", one), turns.withColumn("attempt_id", one), self.domain, ["emitted_ms", "turn_id"])
        place = F.from_json("attempt_id", "attempt_id string, _folder string")
        return heads.select("capture_id", place.alias("p"), "head", "turn_count").select("capture_id", "p.attempt_id", "p._folder", "head", "turn_count")
