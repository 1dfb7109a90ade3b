"""Approximate nearest neighbours by the largest inner product.

A forest of random-projection trees is fitted on a bounded sample.  A node cuts
its space at the median along a random direction; leaves hold about ``LEAF``
sample rows.  For inner products the vectors get one more component that makes
all norms equal (0 for queries), so that nearness is an angle again.

A query walks all trees at once through one priority queue, nearest first: a
node's priority is how far the query lies beyond the cuts on the way to it (sum
of squares).  How many leaves it takes from the queue follows from a recall
target, measured against brute force within the sample.  Each row of the table
is in one leaf of each tree; shards of rows hold these lists, every query's
leaves name its candidates in a shard, and these are ranked by the exact
measure.  Only a shard's best leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.llm.common import cut, scratch_path
from turnlake.llm.token_files import open_fs

#: Rows the forest is fitted on (those of the least hashes), trees, sample rows of a leaf.
SAMPLE_ROWS, TREES, LEAF = 16_384, 16, 32
#: Recall the number of leaves is chosen for, and sample rows it is measured with.
RECALL, MEASURED = 0.95, 256
#: Bytes of a shard's vectors, bytes of an Arrow batch of queries.
SHARD_BYTES, QUERY_BATCH = 64 << 20, 1024


@dataclass
class Forest:
    """Complete binary trees of one depth; nodes count from 1, the children of i are 2i and 2i + 1.

    ``directions[t, i - 1]`` and ``cuts[t, i - 1]`` belong to inner node i of
    tree t; what lies beyond the cut goes to the second child.  Leaves of all
    trees are numbered through.  ``norm`` is the largest norm of the table's
    vectors, ``leaves`` how many of them a search takes.
    """

    directions: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float
    leaves: int = 0

    @classmethod
    def fit(cls, rows: np.ndarray, norm: float, k: int, trees: int = TREES, seed: int = 1) -> Forest:
        """Trees over the distinct vectors of a sample, and the number of leaves for the recall target at ``k``."""
        rng, sample = np.random.default_rng(seed), np.unique(rows, axis=0)
        depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / LEAF))))
        inner = (1 << depth) - 1
        directions = rng.standard_normal((trees, inner, sample.shape[1] + 1)).astype(np.float32)
        made = cls(directions, np.zeros((trees, inner)), depth, norm)
        points = made.raised(sample)
        for t in range(trees):
            nodes = np.ones(len(points), np.int64)
            for level in range(depth):
                along = made._along(points, t, nodes)
                order = np.lexsort((along, nodes))
                bounds = np.searchsorted(nodes[order], np.arange(1 << level, (2 << level) + 1))
                for i, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    made.cuts[t, (1 << level) + i - 1] = np.median(along[order[begin:end]]) if end > begin else 0
                nodes = 2 * nodes + (along > made.cuts[t, nodes - 1])
        made.leaves = made._needed(rows[:MEASURED], sample, points, k)
        return made

    def raised(self, vectors: np.ndarray) -> np.ndarray:
        """Table vectors at norm 1, with one component more."""
        scaled = vectors / self.norm
        return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))])

    def _along(self, points: np.ndarray, t: int, nodes: np.ndarray) -> np.ndarray:
        """Each point along the direction of its node, the same whatever other points there are."""
        return np.einsum("ij,ij->i", points, self.directions[t, nodes - 1])

    def routed(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree, ``(trees, points)``."""
        found = np.empty((len(self.cuts), len(points)), np.int64)
        for begin in range(0, len(points), 4096):
            some = points[begin : begin + 4096]
            for t in range(len(self.cuts)):
                nodes = np.ones(len(some), np.int64)
                for _ in range(self.depth):
                    nodes = 2 * nodes + (self._along(some, t, nodes) > self.cuts[t, nodes - 1])
                found[t, begin : begin + 4096] = nodes - (1 << self.depth) + (t << self.depth)
        return found

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """How far each query lies beyond each cut, ``(queries, trees, inner nodes)``."""
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        scaled /= np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
        return np.tensordot(scaled, self.directions[:, :, :-1], ([1], [2])) - self.cuts

    def search(self, margins: list[list[float]]) -> list[int]:
        """A query's first leaves, nearest first, from one queue for all trees."""
        first, found = 1 << self.depth, []
        queue = [(0.0, t, 1) for t in range(len(margins))]
        while queue and len(found) < self.leaves:
            far, t, node = heapq.heappop(queue)
            tree = margins[t]
            while node < first:
                beyond = tree[node - 1]
                node = 2 * node + (beyond > 0)
                heapq.heappush(queue, (far + beyond * beyond, t, node ^ 1))
            found.append(node - first + (t << self.depth))
        return found

    def _needed(self, queries: np.ndarray, sample: np.ndarray, points: np.ndarray, k: int) -> int:
        """Leaves after which ``RECALL`` of the true neighbours of ``queries`` within the sample have been met."""
        if len(sample) < 2:
            return 1
        n, scores = len(queries), queries @ sample.T
        at = {v.tobytes(): i for i, v in enumerate(sample)}
        scores[np.arange(n), [at[q.tobytes()] for q in queries]] = -np.inf  # the query itself
        true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        margins = self.margins(queries)
        far = np.zeros((n, len(self.cuts), 1))
        for level in range(self.depth):
            beyond = margins[:, :, (1 << level) - 1 : (2 << level) - 1]
            steps = np.stack([np.maximum(beyond, 0), np.maximum(-beyond, 0)], axis=-1) ** 2
            far = (far[..., None] + steps).reshape(n, len(self.cuts), -1)
        order = np.argsort(far.reshape(n, -1), axis=1, kind="stable")
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :].repeat(n, 0), 1)
        leaf = self.routed(points)
        met = np.concatenate([turn[i][leaf[:, true[i]]].min(axis=0) for i in range(n)])
        return int(np.quantile(met, RECALL, method="higher")) + 1


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each of ``queries``.

    Nearness is the inner product in double precision, summed from the first
    component to the last; ranks count from 1, ties go to the smaller id.
    Candidates are all rows of another id than the query's.  All are given if
    there are no more than ``k``.

    Vectors that are NULL, zero, or hold NULL or non-finite components take no
    part, nor do rows with a NULL id or of another length than most (ties: the
    longer).  Equal rows count once; rows of one id with different vectors are
    rows, or queries, of their own.  An empty table gives no rows.  Other
    columns are not read.

    ``sample_rows`` bounds what the forest is fitted on; all rows are indexed.
    Products must stay within the range of doubles.
    """
    spark = rows.sparkSession
    usable = _usable(rows, id_column, vector_column)
    length = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], shape)
    dim = length.n
    known = cut(usable.where(F.size("vector") == dim).distinct(), "vectors")
    count, norm = known.select("vector").mapInArrow(_norms(dim), "n long, norm double").agg(F.sum("n"), F.max("norm")).first()
    if not count:
        return spark.createDataFrame([], shape)
    sample = known.orderBy(F.xxhash64("id", "vector"), "id").limit(sample_rows).select("vector").toArrow()
    forest = spark.sparkContext.broadcast(Forest.fit(_matrix(sample["vector"], dim) + 0.0, min(norm, np.finfo(float).max), k))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each: not left to AQE
    asked = _usable(queries, id_column, vector_column).where(F.size("vector") == dim).distinct().withColumn("form", F.xxhash64("vector")).repartition(tasks, "id", "form")
    path = scratch_path(spark, "queries")
    asked.mapInArrow(_walk(forest, dim), f"id long, form long, vector {known.schema['vector'].dataType.simpleString()}, leaves array<int>").write.parquet(path)

    shards = max(tasks, 1 + count * dim * 8 // SHARD_BYTES)
    spread = known.repartition(shards, "id", F.xxhash64("vector"))
    best = spread.mapInArrow(_rerank(forest, path, dim, k), "query_id long, form long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column)
    if rows.schema[vector_column].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    found = rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    return found.where(F.col("id").isNotNull() & F.forall("vector", _finite) & F.exists("vector", lambda x: x != 0))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _matrix(vectors: pa.ChunkedArray | pa.ListArray, dim: int) -> np.ndarray:
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _norms(dim: int):
    """Number of vectors and largest norm of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0), dim)
                largest = np.abs(vectors).max(axis=1)
                scaled = vectors / largest[:, None]
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "norm": [float((largest * np.sqrt(np.einsum("ij,ij->i", scaled, scaled))).max())]})

    return run


def _walk(forest, dim: int):
    """Queries with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Forest = forest.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                margins = trees.margins(_matrix(some.column(1), dim))
                leaves = [trees.search(one.tolist()) for one in margins]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(1), pa.array(leaves, pa.list_(pa.int32()))], ["id", "form", "vector", "leaves"])

    return run


def _rerank(forest, path: str, dim: int, k: int):
    """The best ``k`` candidates of every query in each shard, by the exact measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.dataset import dataset

        system, folder = open_fs(path)
        for ids, vectors in _shards(batches, dim):
            leaf = forest.value.routed(forest.value.raised(vectors))
            named = np.zeros(len(forest.value.cuts) << forest.value.depth, bool)
            for batch in dataset(folder, filesystem=system, format="parquet").to_batches(batch_size=QUERY_BATCH):
                if not batch.num_rows:
                    continue
                asked, found = _matrix(batch.column("vector"), dim), []
                begins = batch.column("leaves").offsets.to_numpy()
                leaves = batch.column("leaves").values.to_numpy()
                for i, own in enumerate(batch.column("id").to_pylist()):
                    named[:] = False
                    named[leaves[begins[i] : begins[i + 1]]] = True
                    near = np.flatnonzero(named[leaf].any(axis=0) & (ids != own))
                    found.append(_best(vectors, ids, near, asked[i], k))
                sizes = [len(x) for x, _ in found]
                query = np.repeat(np.arange(batch.num_rows), sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(query), batch.column("form").take(query), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))],
                    ["query_id", "form", "vec_id", "score"],
                )

    return run


def _best(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best of ``near``."""
    if len(near) > k:
        rough = vectors[near] @ query
        # A sum in another order is off by less than this; what may be among the best is summed in order.
        off = 4 * len(query) * np.finfo(float).eps * np.abs(vectors[near]).max(initial=0) * np.abs(query).sum()
        near = near[rough >= np.partition(rough, -k)[-k] - 2 * off]
    scores = np.cumsum(vectors[near] * query, axis=1)[:, -1]
    order = np.lexsort((ids[near], -scores))[:k]
    return ids[near][order], scores[order]


def _shards(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a partition, ``SHARD_BYTES`` of them at a time."""
    ids, vectors, held = [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        vectors.append(_matrix(batch.column(1), dim))
        held += vectors[-1].nbytes
        if held >= SHARD_BYTES:
            yield np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(vectors)
