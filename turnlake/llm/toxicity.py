"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes homoglyphs, digit and sign substitutions and zero-width marks
and leaves words between single blanks.  The lexicon is learned from labelled
documents: words and word beginnings that are frequent in toxic and rare in
clean ones, weighted by their log odds.  Hits inside an exception phrase (a
hit with its neighbour that is about as usual in clean text) do not count.
The weight found, absolute and by length, goes through a fitted logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Cache, cut, text_of

#: Labelled rows the lexicon and the curve are fitted on, at most; those of the
#: smallest hash of their id.  Everything else covers all documents.
FIT_ROWS = 20_000
#: Lexicon entries, at most, by support; and what an entry needs.
MAX_ENTRIES, MIN_SUPPORT, MIN_SHARE, MIN_WEIGHT = 5_000, 8, 0.02, 3.0
#: Lengths of word beginnings that may be entries.
BEGINNINGS = (4, 5, 6)

#: Look-alike letters, and digits and signs that stand for letters.
HOMOGLYPHS = str.maketrans("аеорсухіѕјԁһкмтвнαεορτυικνабɑɡⅼı", "aeopcyxisjdhkmtbhaeoptuiknabagli")
SUBSTITUTES = str.maketrans("01345789@$!|", "oieastbgasil")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_DISGUISED = re.compile(r"[^\W_]*[^\W\d_](?:[0-9@$!|]+[^\W_]+)+|[0-9@$|]+[^\W\d_][\w@$|]*")
_SIGNS = re.compile("[0-9@$!|]")
_WORD = re.compile(r"[^\W_]+")


def fold_piece(piece: str) -> str:
    """Words of a piece without white space, disguise undone, each with a blank before it."""
    piece = piece.lower()
    if not piece.isascii():
        piece = _HIDDEN.sub("", piece).translate(HOMOGLYPHS)
    if _SIGNS.search(piece):
        piece = _DISGUISED.sub(lambda m: m[0].translate(SUBSTITUTES), piece)
    return "".join([f" {w}" for w in _WORD.findall(piece)])


#: Folded pieces; each worker has its own.
_FOLDED: Cache[str] = Cache(fold_piece, limit=300_000)


def fold(text: str) -> str:
    """Words in lower case, disguise undone, each with a blank on both sides."""
    return "".join(map(_FOLDED.__getitem__, text.split())) + " "


@dataclass
class Lexicon:
    """Weights of entries (``" word "`` or ``" begin"``), exception phrases and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        if self.weights:
            found.make_automaton()
        return found

    def features(self, text: str, automaton) -> tuple[float, float]:
        """Weight of all hit words (the heaviest entry of each), and that per 100 words; both as log(1 + x)."""
        folded = fold(text)
        hits: dict[int, float] = {}
        if self.weights:
            for end, (size, weight) in automaton.iter(folded):
                begin = end - size + 1
                if weight > hits.get(begin, 0.0) and not (self.exceptions and self._excepted(folded, begin)):
                    hits[begin] = weight
        total = sum(hits.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def _excepted(self, folded: str, begin: int) -> bool:
        return any(p in self.exceptions for p in phrases(folded, begin))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def phrases(folded: str, begin: int) -> list[str]:
    """The word at ``begin`` (its leading blank) with the word before and with the word after."""
    end = folded.find(" ", begin + 1)
    before, after = folded.rfind(" ", 0, begin), folded.find(" ", end + 1)
    return ([folded[before + 1 : end]] if before >= 0 else []) + ([folded[begin + 1 : after]] if after > 0 else [])


def entries(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for n in BEGINNINGS for w in words if len(w) >= n}


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """Texts of the sampled labelled rows, exact copies once; the sample's size bounds what is broadcast."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(id_column).agg(F.max(label_column).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64(id_column), id_column).limit(rows)
    return docs.select(F.col(id_column), text_of(text_column).alias("text")).join(F.broadcast(picked), id_column).select("text", "label").dropDuplicates()


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Lexicon:
    """Learn lexicon, exceptions and curve from ``labels (id, toxic 0/1)`` joined with ``docs``.

    Labels of other values are left out, an id labelled twice takes the
    larger.  Without toxic rows the lexicon is empty and every score is that
    of a text without hits.
    """
    sample = cut(_sample(docs, labels, rows, id_column, text_column, label_column), "sample")

    def grouped(make) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    seen[label].update(make(fold(text.as_py()), label))
            keys = [*(seen[0].keys() | seen[1].keys())]
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"entry": pa.array(part, pa.string()), "clean": pa.array([seen[0][k] for k in part], pa.int64()), "toxic": pa.array([seen[1][k] for k in part], pa.int64())})

        return sample.mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    # The empty entry counts the rows themselves.
    often = grouped(lambda folded, label: [""] + [*entries(folded)] * (label == 1)).where(F.col("toxic") >= MIN_SUPPORT)
    supported = {r["entry"]: r["toxic"] for r in often.orderBy(F.desc("toxic"), "entry").limit(4 * MAX_ENTRIES).collect()}
    if not supported:
        return Lexicon()
    toxic_rows = supported.pop("", 0)
    wanted = frozenset(supported)
    beginnings = sorted({len(e) - 1 for e in wanted if e[-1] != " "})

    def found(folded: str, label: int) -> list[str]:
        words = set(folded.split())
        return [] if label else ["", *(({f" {w} " for w in words} | {f" {w[:n]}" for n in beginnings for w in words}) & wanted)]

    clean = {r["entry"]: r["clean"] for r in grouped(found).collect()}  # bounded by the entries wanted
    clean_rows = clean.pop("", 0)
    odds = lambda t, c: float(np.log((t + 0.5) / (toxic_rows + 1)) - np.log((c + 0.5) / (clean_rows + 1)))
    heavy = {e: odds(t, clean.get(e, 0)) for e, t in supported.items()}
    # A weight needs support in proportion: what copies of a few documents repeat is left out.
    least = max(MIN_SUPPORT, MIN_SHARE * toxic_rows)
    kept = {e: w for e, w in heavy.items() if w >= MIN_WEIGHT and supported[e] >= least}
    best = sorted(kept, key=lambda e: (-supported[e], e))[:MAX_ENTRIES]
    lexicon = Lexicon({e: kept[e] for e in best})

    def around(folded: str, label: int) -> set[str]:
        return {p for end, (size, _) in automaton[0].iter(folded) for p in phrases(folded, end - size + 1)} if lexicon.weights else set()

    automaton = _Lazy(lexicon)
    usual = grouped(around).where((F.col("clean") >= MIN_SUPPORT) & (F.col("clean") * (toxic_rows + 1) >= F.col("toxic") * (clean_rows + 1)))
    lexicon.exceptions = frozenset(r["entry"] for r in usual.orderBy(F.desc("clean"), "entry").limit(MAX_ENTRIES).collect())
    points = sample.mapInArrow(_measured(lexicon, ["label"]), "label int, x double, y double").toArrow()  # the sample's rows
    lexicon.curve = fit_curve(np.column_stack([points.column("x"), points.column("y")]), points.column("label").to_numpy())
    return lexicon


class _Lazy:
    """The automaton of a lexicon, built once per task."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.built = lexicon, None

    def __getitem__(self, _: int):
        if self.built is None:
            self.built = self.lexicon.automaton()
        return self.built


def _measured(lexicon: Lexicon, keep: list[str]):
    """Map batches of ``text`` and the columns ``keep`` to ``keep`` with both features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = np.array([lexicon.features(t.as_py(), automaton) for t in named["text"]], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[named[k] for k in keep], pa.array(x[:, 0]), pa.array(x[:, 1])], [*keep, "x", "y"])

    return run


def fit_curve(x: np.ndarray, label: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, slopes not negative."""
    if len(x) == 0 or label.min() == label.max():
        return Lexicon().curve
    rows, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    active = np.array([True, True, True])
    for _ in range(3):
        w = np.where(active, w, 0.0)
        a = np.flatnonzero(active)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            gradient = rows.T @ (p - label) + penalty * w
            hessian = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + penalty * np.eye(3)
            w[a] -= np.linalg.solve(hessian[np.ix_(a, a)], gradient[a])
        if (w[1:] >= 0).all():
            break
        active[1:] &= w[1:] >= 0
        w = np.where(active, w, 0.0)
    return float(w[0]), float(w[1]), float(w[2])


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``score`` (0 to 1) per row of ``docs``, over whole texts of any length.

    NULL texts score as empty ones; equal texts score alike, so repeated rows
    give repeated results; an empty table gives no rows.  Other columns are not
    read.
    """
    rows = docs.select(F.col(id_column), text_of(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    measured = rows.mapInArrow(_measured(lexicon, [id_column]), f"`{id_column}` {kind}, x double, y double")
    return measured.select(id_column, _curve(lexicon).alias("score"))


def _curve(lexicon: Lexicon) -> Column:
    a, b, c = lexicon.curve
    return 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x") + F.lit(c) * F.col("y"))))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, bar: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``bar``, all columns as they were; NULL texts score as empty ones."""
    automaton = _Lazy(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            x = np.array([lexicon.features(t.as_py() or "", automaton[0]) for t in texts], np.float64).reshape(-1, 2)
            yield batch.filter(pa.array(lexicon.score(x) < bar))

    return docs.mapInArrow(run, docs.schema)
