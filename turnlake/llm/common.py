"""Helpers the operators share: whole texts, cuts, per-worker caches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import ClassVar, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.session import checkpoint_dir

V = TypeVar("V")

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str) -> Column:
    """The whole text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile deletes the files it shuffled when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Column format, so later readers prune what they do not need.  Lost
    executors cost nothing, as nothing before the cut is computed again.
    What was shuffled on the way goes from the disks at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, what)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*cuts: DataFrame) -> None:
    """Delete the files of ``cuts``, made by :func:`cut`, that nothing will read again."""
    for df in cuts:
        spark = df.sparkSession
        for file in df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(file)  # type: ignore[union-attr]
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


class Cache(dict[str, V]):
    """Values by string, computed when missing, of two bounded generations.

    When the young generation is full it becomes the old one, so memory is
    bounded and what is used often stays.  Very long keys are never kept.  A
    worker serves one operator after another: the cache that misses is the one
    in use, and empties the one before it.
    """

    in_use: ClassVar[Cache | None] = None

    def __init__(self, compute: Callable[[str], V], limit: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.old: dict[str, V] = {}

    def __missing__(self, key: str) -> V:
        before = Cache.in_use
        if before is not self:
            if before is not None:
                before.clear()
                before.old = {}
            Cache.in_use = self
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges (a, b)``.

    The component is the smallest node reachable.  Each round hangs every node
    and its larger neighbours below the smallest one it knows (alternating
    large and small stars), all by joins-free grouping; rounds grow with the
    logarithm of the longest chain.  Each round is cut, only its count of
    changed edges comes to the driver.  No edges give no rows; loops are
    ignored unless they are all a node has, NULL nodes are dropped.
    """
    known = cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    links = known.where("a <> b")
    seen, last = None, None
    for _ in range(most_rounds):
        links = cut(_small_star(_large_star(links)), "stars")
        if last is not None:
            discard(last)
        last = links
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    own = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return own.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    hung = both.where("b > a").join(least, F.col("a") == F.col("n"))
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them; links point down (a > b)."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    hung = links.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
