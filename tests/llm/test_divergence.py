"""Source divergence against plain counting."""

import re
from collections import Counter

import compare as cmp
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import ODD, SF
from turnlake.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(rows, least, shown):
    """All result rows, from texts to prices in plain Python."""
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for lang, source, text in rows]
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def price(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, priced = price(whole), {s: price(c) for s, c in counts.items()}
        for s, p in priced.items():
            pairs = [(o, sum(abs(p[t] - x[t]) for t in kept)) for o, x in priced.items() if o != s]
            over = [(t, p[t] - q[t]) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", over, shown)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(found)


def got(docs, **more):
    return sorted(tuple(r) for r in divergence.audit(docs, **more).collect())


SCHEMA = "lang string, source string, text string, term string, n int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("tile", [1, 16])
def test_against_plain_counting(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CHUNK", 8)
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "日本", "A", "Zzİ"]
    rows = [(["en", "de", None][rng.integers(3)], [None, "", "s1", "s2", "s3", "é", "hot", "hot"][rng.integers(8)], " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(200)]
    rows += [("en", "odd", t) for _, t in ODD] + [("xx", "a", "alone"), ("xx", "b", None), ("yy", "only", "1 2 3")]
    assert got(frame(spark, rows), least_docs=5, shown=7) == plain(rows, 5, 7)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("en", "a", "x y"), ("en", "b", "x"), ("en", "c", None)]
    assert got(frame(spark, rows)) == [("en", s, "pair", o, 0, r) for s in "abc" for r, o in enumerate((x for x in "abc" if x != s), 1)]
    assert got(frame(spark, [])) == []


def test_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "GATHERED", 10)
    rows = [("en", "a", "x Y z " * 500)] * 3 + [("en", "b", "x " * 1000 + "only")] * 2
    assert got(frame(spark, rows), least_docs=2) == plain(rows, 2, 50)


def test_query_against_sql(spark):
    result, _ = cmp.compare(spark, SF, "op13", queries.op13_source_divergence, queries.CHECKS["op13_source_divergence"])
    assert result.startswith("ok")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 300_000), max_size=2000), st.booleans())
def test_galloping_finds_common_ids(a, b, dense):
    b = set(range(0, 3000, 2)) | b if dense else b
    x, y = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    left, right = divergence.met(x, y)
    assert x[left].tolist() == y[right].tolist() == sorted(a & b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9 * 10**14), min_size=1, max_size=20), st.integers(0, 10**14))
def test_prices_are_exact(counts, more):
    everything = sum(counts) % (9 * 10**15) + more + 5 * len(counts)
    assert divergence.prices(np.array(counts, np.int64), everything).tolist() == [1 + 10**9 * (c + 5) // everything for c in counts]
