"""Toxicity: folding, lexicon, exceptions, held-out accuracy."""

import numpy as np
import pytest
from llm.conftest import ODD

from turnlake.llm import queries as Q
from turnlake.llm import toxicity as T


def test_fold():
    assert T.fold("You 1D10T, i.d-i0t") == " you idiot i d iot "
    assert T.fold("іdіоt") == " idiot "
    assert T.fold("ID\u200bIOT! in 2024") == " idiot in 2024 "
    assert T.fold("") == " "
    assert T.fold("$cum") == " scum "


def test_exceptions_and_heaviest_entry():
    lexicon = T.Lexicon({" trash ": 2.0, " tra": 1.0}, frozenset({"trash can"}))
    automaton = lexicon.automaton()
    assert lexicon.features("a trash can", automaton)[0] == 0
    assert np.isclose(lexicon.features("trash tram", automaton)[0], np.log1p(3.0))
    assert lexicon.features("", automaton) == (0.0, 0.0)
    assert T.Lexicon().features("trash", T.Lexicon().automaton()) == (0.0, 0.0)


def test_learns_words_beginnings_and_exceptions(spark):
    clean = [(i, f"the good sun dump truck {i} rises") for i in range(60)]
    toxic = [(100 + i, f"the zzgrub{chr(97 + i % 26)}{i} dump person dump {'vile' if i % 2 else 'V1LE'} {i}") for i in range(60)]
    docs = spark.createDataFrame([*clean, *toxic], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in [*clean, *toxic]] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    lexicon = T.fit(docs, labels)
    assert " zzgr" in lexicon.weights and " vile " in lexicon.weights and " dump " not in lexicon.weights
    probe = spark.createDataFrame([(1, "such v1le talk"), (2, "such mild talk"), (3, None), (4, ""), (5, "zzgrubnew person")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in T.toxicity_scores(probe, lexicon).collect()}
    assert min(score[1], score[5]) > 0.7 > max(score[2], score[3], score[4])
    assert {r["doc_id"] for r in T.drop_toxic(probe, lexicon).collect()} == {2, 3, 4}


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t, 1.0, "e") for i, t in ODD], "doc_id long, text string, score double, x string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = T.fit(docs, none)
    rows = T.toxicity_scores(docs, lexicon).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.7 for r in rows)
    assert T.drop_toxic(docs, lexicon).columns == docs.columns
    assert T.toxicity_scores(docs.limit(0), lexicon).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op7_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(a == b == 1 for a, b in held)
    # A fifth of these labels is set on texts without any toxic word.
    assert hit >= 0.75 * sum(a for a, _ in held)
    assert hit >= 0.95 * sum(b for _, b in held)
