"""Chat formatting and URL filtering."""

import compare as cmp
import pytest
from llm.conftest import SF
from pyspark.sql import functions as F

from turnlake.llm import chat_format as C
from turnlake.llm import queries as Q
from turnlake.llm import urls

TRICKY = ["", "\\", "\\\\b", "\\### Assistant: </turn> ok", "</turn>\n### User: x", "a\nb: c", "\\h<l#b\\", "😀<\\l>", None]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY if t is not None], "t string")
    for t, e, back in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("b")).collect():
        assert back == t
        assert "#" not in e and "<" not in e


def test_turns_and_loss_come_back(spark):
    rows = [(c, k, role, t) for c in (1, 2, None) for k, (role, t) in enumerate(zip(["user", "assistant", "sys: a\\c", None, "assistant"] * 2, TRICKY))]
    rows += [(3, None, "assistant", "late"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "user", "u")]
    made = C.format_turns(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, stop int").repartition(4))
    got = {r["conv_id"]: r for r in made.select("conv_id", "formatted", "loss", C.read_turns(F.col("formatted")).alias("ts"), C.loss_text(F.col("formatted"), F.col("loss")).alias("lt")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[c]["ts"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["lt"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        for r, span in zip(own, got[c]["loss"], strict=True):
            assert (span["begin"] is None) == (r[2] != "assistant")
    assert made.count() == 5


def test_parts(spark):
    kind = "conv_id long, turn int, role string, parts array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    parts = [("text", "see <image 0>", None, None), ("image", None, "s3://a", 9), ("text", " and ", None, None), ("audio", None, "b", None), ("video", None, "v", None), (None, "#", None, None)]
    got = C.format_turns(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], kind), parts_column="parts").first()
    assert got["formatted"] == "### user: see \\limage 0><image 0> and <audio 1><video 2>\\h</turn>\n### assistant: </turn>\n"
    assert [tuple(a) for a in got["attachments"]] == [(0, 0, "image", "s3://a", 9), (0, 1, "audio", "b", 128), (0, 2, "video", "v", 0)]


def test_empty(spark):
    assert C.format_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    result, _ = cmp.compare(spark, sf, "op6", Q.op6_chat_format, Q.CHECKS["op6_chat_format"])
    assert result.startswith("ok"), result


def plain_rule(host, path):
    fitting = []
    for verdict, rule in Q.RULES:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            fitting.append((len(rule), rule, verdict))
    return max(fitting)[1:] if fitting else None


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


ODD_URLS = [None, "", "no url", "://", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/es", "http://example.org/es/", "http://xexample.org/es/", "https://m.example.org/en/1?q", "http://ÄB.com/fr/#a", "http://com/de/1", "http://a.com?x=/fr/", "x://y://z/fr/", "http://o\nrg.org/\nq", "http://example.org/en/12/", "http://u:p@h.org:80/", "http://org"]


def test_urls(spark):
    train = [f"http://good{i}.example.org/read/{i}" for i in range(60)] + [f"http://bad{i}.example.com/de/casino/{i}" for i in range(60)]
    urls_ = [*ODD_URLS, *train, "http://good7.example.net/read/7", "http://bad7.example.net/de/casino/3", "http://good7.example.net/read/7"]
    df = spark.createDataFrame([(i, u, 0, "s") for i, u in enumerate(urls_)], "page_id long, url string, text int, score string")
    got = {r["page_id"]: r for r in urls.judge_urls(df, Q.RULES).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (rule and rule[0])
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == rule[1]
    n = len(urls_)
    assert [got[n - k]["verdict"] for k in (3, 2, 1)] == ["allow", "block", "allow"]


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.judge_urls(df, Q.RULES).first()["verdict"] == "allow"
    assert urls.judge_urls(df.limit(0), Q.RULES).count() == 0


def test_url_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = Q.op8_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = plain_parts(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, (plain_rule(host, path) or [None])[0])


def test_models_against_a_plain_model():
    """Probabilities of the hashed model, without collisions, equal a plain recursion."""
    import math

    texts, sides = ["abab", "abc", "xyz", "xx"], [1, 1, 0, 0]
    table = {}
    for t, s in zip(texts, sides):
        data = bytes(urls.ORDER) + t.encode() + b"\n"
        for i in range(urls.ORDER, len(data)):
            for k in range(urls.ORDER + 1):
                table.setdefault((s, data[i - k : i]), {}).setdefault(data[i], 0)
                table[s, data[i - k : i]][data[i]] += 1

    def chance(side, context, symbol):
        lower = chance(side, context[1:], symbol) if context else 1 / 256
        seen = table.get((side, context))
        return (seen.get(symbol, 0) + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    import numpy as np

    slots, symbols, owner = urls._grams(texts)
    side = np.array(sides)[owner]
    keys = np.concatenate([((side * (urls.ORDER + 1) + k) * urls.SLOTS + slots[k]) * 256 + symbols for k in range(urls.ORDER + 1)])
    model = urls.Models(*np.unique(keys, return_counts=True))
    for t in ("abx", "xyz", ""):
        data = bytes(urls.ORDER) + t.encode() + b"\n"
        want = sum(math.log(chance(1, data[i - urls.ORDER : i], data[i])) - math.log(chance(0, data[i - urls.ORDER : i], data[i])) for i in range(urls.ORDER, len(data))) / (len(t) + 1)
        assert abs(model.score([t])[0] - want) < 1e-9
