"""Forest search against brute force."""

import numpy as np
import pytest

from llm.conftest import SF
from turnlake.llm import neighbours, queries


def plain(rows, asked, k):
    """The true neighbours by (query id, query vector)."""
    found = {}
    for q, v in asked:
        scored = sorted((-sum_in_order(v, w), i) for i, w in rows if i != q)
        found[q, tuple(v)] = [(i, -s) for s, i in scored[:k]]
    return found


def sum_in_order(v, w):
    total = 0.0
    for x, y in zip(v, w, strict=True):
        total += float(x) * float(y)
    return total


def results(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def recall(got, true):
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) / max(1, len(best)) for (q, _), best in true.items()]
    return float(np.mean(hits))


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters"])
def test_recall_and_exact_scores(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = x * 0.2 + rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)]
    x = x * rng.lognormal(0, 1, (3000, 1)) if kind == "norms" else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = rows[::50]
    found = neighbours.nearest(docs, docs.where("vec_id % 50 = 0"), k=10)
    got, true = results(found), plain(rows, asked, 10)
    assert recall(got, true) >= 0.9
    vectors = dict(rows)
    for q, near in got.items():
        assert len(near) == 10
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(s == sum_in_order(vectors[q], vectors[i]) for i, s in near)


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    true = plain(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert recall(results(queries.op12_neighbours(spark, SF)), true) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, []), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [-1.0, 0.0]), (20, [1e-200, 0.0]), (40, None), (60, [nan, 0.0])]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = results(neighbours.nearest(docs, docs.where("vec_id % 20 = 0"), k=20))
    assert got == {0: [(9, 2.0), (8, 1.0), (20, 1e-200), (10, -1.0)], 20: [(9, 2e-200), (0, 1e-200), (8, 1e-200), (10, -1e-200)]}


def test_copies_and_ties(spark):
    """A third of all rows is one vector; the smallest ids of equal scores win."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 else [float(c) for c in rng.integers(-3, 4, 4)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [r for r in rows if r[0] % 20 == 0 and any(r[1])]
    got = results(neighbours.nearest(docs, docs.where("vec_id % 20 = 0"), k=5))
    true = plain([r for r in rows if any(r[1])], asked, 5)
    assert np.mean([sum(x >= best[-1][1] for _, x in got[q]) / 5 for (q, _), best in true.items()]) >= 0.9
    assert got[20] == [(i, s) for i, s in plain([r for r in rows if any(r[1])], [(20, rows[20][1])], 5)[20, tuple(rows[20][1])]]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = results(neighbours.nearest(docs, docs, k=20))
    assert got == ({} if n < 2 else {0: [(20, 1.0)], 20: [(0, 1.0)]})


def test_queue_takes_nearest_leaves_first():
    """The walk through the queue gives the order that sorting all leaves by their distance gives."""
    x = np.random.default_rng(2).standard_normal((1000, 8))
    forest = neighbours.Forest.fit(x, float(np.linalg.norm(x, axis=1).max()), 10, trees=4)
    leaves = 4 << forest.depth
    forest.leaves = leaves
    margins = forest.margins(x[:5])
    for m in margins:
        far = {}
        for t in range(4):
            for leaf in range(1 << forest.depth):
                node, total = leaf + (1 << forest.depth), 0.0
                while node > 1:
                    beyond = m[t, node // 2 - 1]
                    total += beyond**2 if (beyond > 0) != (node & 1) else 0.0
                    node //= 2
                far[leaf + (t << forest.depth)] = total
        order = forest.search(m.tolist())
        assert sorted(order) == list(range(leaves))
        assert np.allclose([far[i] for i in order], sorted(far.values()))
