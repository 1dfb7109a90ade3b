"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import compare as cmp
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, SF
from turnlake.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def plain_tree(nodes, fanout):
    """The last node, and each leaf's (siblings, turns)."""
    paths = [("", "") for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            first = at - at % fanout
            left, right = nodes[first:at], nodes[at + 1 : first + fanout]
            paths[i] = (paths[i][0] + "".join(left + right), paths[i][1] + f"{len(left)}{len(right)}")
            places[i] = at // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout=3):
    """Sorted (doc_id, leaf, subroot, root, siblings, turns)."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    ordered = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in ordered:
        members = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[s] = members, *plain_tree([leaf(r) for r in members], fanout)
    root, tops = plain_tree([made[s][1] for s in ordered], fanout)
    found = []
    for s, top in zip(ordered, tops, strict=True):
        members, subroot, paths = made[s]
        found += [(r["doc_id"], leaf(r), subroot, root, p[0] + top[0], p[1] + top[1]) for r, p in zip(members, paths, strict=True)]
    return sorted(found, key=repr)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, row string, grp int, position string")


def found(docs, fanout=3, every=4):
    rows = docs.select("*", merkle.leaf_digest(*map(F.col, FIELDS)).alias("leaf")).drop("text")
    manifest = merkle.build_manifest(rows, "source", ["doc_id"], "leaf", fanout, every)
    proofs = merkle.proofs(manifest)
    cols = (F.col("leaf"), F.col("siblings"), F.col("turns"))
    got = proofs.select("row.doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), "siblings", "turns", merkle.folded(*cols).alias("folded")).collect()
    assert all(r.folded == r.root for r in got)
    return sorted((tuple(r)[:6] for r in got), key=repr), manifest


@pytest.mark.parametrize(("fanout", "every"), [(3, 4), (3, 1), (2, 3), (10, 2)])
def test_against_plain_trees(spark, fanout, every):
    sizes = {None: 1, "": 2, "b": 3, "é": 4, "a": 28, "ab": 82, "z": 9, "y": 10}
    rows = [(i, s, "en", 5, f"text {s} {i}", "x", 7, "p") for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", None, None, None, None, None, None), (3, "a", None, None, "", None, None, None), (3, "a", None, None, "", None, None, None), (4, "b", "x", 1, "y" * 300_000, None, None, None)]
    docs = documents(spark, rows)
    got, manifest = found(docs, fanout, every)
    assert got == plain([r.asDict() for r in docs.collect()], fanout)
    kept = sum(x.count() for x in manifest.levels[1:])
    assert kept <= sum(-(-n // fanout**every) + 5 for n in (*sizes.values(), 4))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = documents(spark, [(i, None, None, None, None, None, None, None) for i in range(n)])
    got, manifest = found(docs)
    assert got == (plain([r.asDict() for r in docs.collect()]) if n else [])
    assert (manifest.root is None) == (n == 0)


def test_one_group_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    got, _ = found(docs.repartition(7))
    assert got == plain([r.asDict() for r in docs.collect()])


def test_odd_texts_and_lost_lines(spark, tmp_path):
    rows = [(i, f"s{(i or 0) % 3}" if i else None, None, None, t) for i, t in ODD] + [(i, "big", "en", 3, "a\nb" if i % 3 else "ab") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op11_merkle(spark, str(tmp_path)).collect():
        got.setdefault((r.doc_id, r.leaf), r)
    root = plain([r.asDict() for r in docs.collect()])[0][3]
    for r in docs.collect():
        result = got[r.doc_id, leaf(r)]
        altered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")
        assert result.root == root
        assert result.verified == (not altered) == (result.folded_root == root)


def test_query_against_sql(spark):
    result, _ = cmp.compare(spark, SF, "op11_merkle", queries.op11_merkle, queries.CHECKS["op11_merkle"])
    assert result == "ok 200"
