"""URL models that grow with the URLs, broadcast and joined."""

import numpy as np
import pytest
from llm.conftest import SF

from turnlake.llm import queries as Q
from turnlake.llm import urls


def test_contexts_do_not_share_counts():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789/"), 40)) for _ in range(2000)]
    slots, _, _ = urls._grams(texts)
    data = [bytes(urls.ORDER) + t.encode() + b"\n" for t in texts]
    for k in range(1, urls.ORDER + 1):
        assert len(np.unique(slots[k])) == len({d[i - k : i] for d in data for i in range(urls.ORDER, len(d))})


def test_joined_scores_equal_broadcast_ones(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "http://a.b/c?casino=1"), (-4, "http://a.b/c"), (-5, "http://ÄB.com/fr/#a"), (-4, "http://a.b/c")]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    sort = lambda rows: sorted(rows, key=lambda r: (r["page_id"], r["host"]))
    one = sort(urls.judge_urls(pages, Q.RULES).collect())
    monkeypatch.setattr(urls, "MOST_KEYS", 0)
    two = sort(urls.judge_urls(pages, Q.RULES).collect())
    assert len(one) == pages.count()
    assert [r["verdict"] for r in one] == [r["verdict"] for r in two]
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two], abs=1e-9)
    score = {r["page_id"]: r["score"] for r in one}
    assert score[-3] != score[-4]
