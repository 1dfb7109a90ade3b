"""Decontamination against all windows."""

import random
import re

import numpy as np
import pytest
from llm.conftest import ODD, SF

from turnlake.llm import decontaminate as D
from turnlake.llm import queries as Q


def plain_words(text):
    return [w for w in (re.sub(r"[\W_]+", "", p.lower()) for p in (text or "").split()) if w]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain(docs, items):
    """Smallest distance by (row, item) over all windows, where it is small enough."""
    found = {}
    for d, (_, text) in enumerate(docs):
        w = plain_words(text)
        for k, (_, item) in enumerate(items):
            x = plain_words(item)
            if not x:
                continue
            bag = set(x)
            for s in range(len(w)):
                window = w[s : s + len(x)]
                if sum(y not in bag for y in window) <= D.allowed(len(x)) and (dist := plain_distance(x, window)) <= D.allowed(len(x)):
                    found[d, k] = min(found.get((d, k), 99), dist)
    return found


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, what = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (what != 1)] = [f"new{rng.randrange(99)}"] * (what != 2)
    return words


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        for most in (0, 2, 20):
            assert D.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_runs_are_kept():
    """No window within the distance is passed over before the buckets."""
    rng = random.Random(3)
    for n in [*range(1, 30), 60, 100]:
        for _ in range(40):
            a = list(range(n))
            b = [-1, -2, -3, *edited(rng, a, D.allowed(n)), -4, -5]
            b = [x if isinstance(x, int) else hash(x) % 1000 + 500 for x in b]
            items = D.Items([0], [np.array(a, np.int64).astype(np.uint64) + np.uint64(10)])
            h = (np.array(b, np.int64) + 10).astype(np.uint64)
            starts, lengths, sizes = items.windows(h, np.zeros(len(h), np.int64), np.full(len(h), len(h)))
            passed = set(zip(starts.tolist(), lengths.tolist()))
            for s in range(len(h)):
                window = h[s : s + n].tolist()
                if plain_distance(items.words[0].tolist(), window) <= D.allowed(n):
                    assert (s, len(window)) in passed


@pytest.mark.parametrize("n", [1, 4, 5, 10, 15, 40, 60, 120, 400])
def test_meetings_reach_the_rate_assumed(n):
    assert D.collision_rate(n, 400) >= D.meets(n)


@pytest.mark.parametrize("n", [5, 15, 30, 60, 200])
def test_unrelated_windows_do_not_meet(n):
    """Windows of other words share no bucket, also shorter ones and over all repetitions."""
    rng = np.random.default_rng(n)
    item, others = rng.integers(1, 1 << 62, n).astype(np.uint64), rng.integers(1, 1 << 62, 200 * n).astype(np.uint64)
    begin, length = np.arange(200) * n, np.full(200, n)
    length[::3] = n - D.allowed(n)
    met = 0
    for r in range(D.repeats(n)):
        (own,), (stood,) = D.embed(item, np.zeros(1, int), np.array([n]), np.array([n]), r)
        keys, alive = D.embed(others, begin, length, np.full(200, n), r)
        met += int((alive & stood & (keys == own)).sum())
    assert met <= 0.01 * 200


def test_buckets_alone_find_windows_at_the_full_distance():
    """Recall of the buckets, whatever the runs would let pass."""
    rng = np.random.default_rng(8)
    for n in (5, 12, 30, 60, 150):
        found = 0
        for t in range(60):
            a, b = rng.integers(1, 1 << 62, n).astype(np.uint64), None
            b = a.tolist()
            for _ in range(D.allowed(n)):
                at, what = int(rng.integers(len(b))), int(rng.integers(3))
                b[at : at + (what != 1)] = [int(rng.integers(1, 1 << 62))] * (what != 2)
            b = np.array(b[:n], np.uint64)
            both, sizes = np.concatenate([a, b]), np.array([n, len(b)])
            met = False
            for r in range(D.repeats(n)):
                keys, stood = D.embed(both, np.array([0, n]), sizes, np.array([n, n]), r)
                met |= bool(stood.all() and keys[0] == keys[1])
            found += met
        assert found >= 0.97 * 60, n


def test_recall_and_exactness(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 30, 45, 60])))) for k in range(40)] + [(90, None), (91, "..."), (3, "w1 w2 w3 w4")]
    docs = []
    for d in range(120):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 80))]
        item = plain_words(items[d % 40][1])
        w += edited(rng, item, rng.randrange(0, D.allowed(len(item)) + 2)) + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 30))]
        docs.append((d, ", ".join(w).title()))
    want = plain(docs, items)
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, distance int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    exact = {(docs[d][0], items[k][0]): x for (d, k), x in want.items()}
    assert got.keys() <= exact.keys()
    assert len(got) >= 0.99 * len(exact)
    assert all(got[k] >= exact[k] for k in got) and sum(got[k] == exact[k] for k in got) >= 0.98 * len(got)
    text = dict(docs)
    for r in rows[:50]:
        window = plain_words(text[r["doc_id"]][r["begin"] : r["end"]])
        assert r["distance"] in [plain_distance(plain_words(t), window) for i, t in items if i == r["item_id"]]
    kept = {r["doc_id"] for r in D.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)
    items = [(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k}") for k in range(12)]
    docs = [(k, f"some text before {t} and after") for k, t in items] + [(50, "clean")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r[0], r[1]) for r in D.contaminated(df, bench).collect()} == {(k, k) for k in range(12)}
    assert [r["doc_id"] for r in D.drop_contaminated(df, bench).collect()] == [50]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "word " * 40), (2, None), (3, "")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()} == {(10, 1)}
    assert D.drop_contaminated(docs, bench).count() == len(ODD) - 1
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == len(ODD)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in Q.op1_decontamination(spark, SF).collect()}
    whole = {(d, i) for d, t in docs for i, x in items if f" {' '.join(plain_words(x))} " in f" {' '.join(plain_words(t))} "}
    assert whole and whole <= got
