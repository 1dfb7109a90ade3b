"""Source divergence audit: how far the sources of a language are from each other in their words.

A *member* is a source within a language.  Per language the terms found in
enough documents are kept and numbered densely.  A member prices each kept
term: a smoothed share of its own occurrences, in billionths, as an exact
integer.  Two members differ by the sum of price differences over all kept terms.

Terms and documents are counted where the texts are read, so only sums move.
A member's counts become arrays of (term id, count) sorted by id, cut into
chunks of term ids; what two members differ by is a sum over chunks.  A pair
task meets the arrays of two members: a galloping intersection finds the terms
of both; those of one alone are priced against the other's price of an absent
term, both ways; terms of neither are only counted.  A task holds a chunk of
two tiles of members, so neither a large vocabulary nor many sources of a
language gather in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.llm.common import cut, text_of
from turnlake.llm.positions import numbered

LEAST_DOCS, SMOOTHING, BILLIONTHS, SHOWN = 30, 5, 1_000_000_000, 50
#: Term ids of a chunk, members of a tile.
CHUNK, TILE = 1 << 15, 16
#: Distinct (member, term) counts a task gathers before it hands them on, and bytes of a text split at a time.
GATHERED, PIECE = 300_000, 1 << 22
#: Ids probed at a time by the galloping search.
STRIDE = 64

#: Bytes of terms, A-Z lower-cased; all others are blanks.  Every byte of a character beyond ASCII is one of a term.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it: runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    data, at = text.translate(_LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, shown: int = SHOWN) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all members of ``docs``.

    ``part`` 'pair': ``item`` is each other source of the language, ``value``
    the difference; 'term': ``item`` is a kept term that the member has and
    prices above the whole language, ``value`` by how much, the ``shown``
    highest.  Ranks count from 1, highest value first, ties by the UTF-8 bytes
    of ``item``.

    Each row is a document, repeated ids and equal rows too.  NULL in ``text``,
    ``lang`` or ``source`` is the empty string.  Members without terms are
    members; in a language without kept terms all differences are 0.  An empty
    table gives no rows; other columns are not read.  Exact for up to 9e15
    occurrences in a language.
    """
    rows = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    known = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    known = cut(numbered(known, ["lang"], ["term"], position="id"), "terms")
    own = cut(counted.join(known, ["lang", "term"]).select("lang", "source", "term", "id", "n", "lang_n"), "own")

    langs = known.groupBy("lang").agg(F.sum("lang_n").alias("lang_all"), F.count("*").alias("kept"))
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    members = counted.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["all", "kept", "lang_all"])
    language = W.partitionBy("lang")
    members = cut(members.select("*", (F.row_number().over(language.orderBy("source")) - 1).alias("g"), F.count("*").over(language).alias("members")), "members")

    found = _pairs(own, members).unionAll(_terms(own, members, shown))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= shown))


def _price(count: str, everything: str) -> Column:
    wide = f"CAST({BILLIONTHS} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTHING} AS DECIMAL(19, 0))"
    return F.expr(f"1 + ({wide}) div CAST({everything} + {SMOOTHING} * kept AS DECIMAL(19, 0))")


def _terms(own: DataFrame, members: DataFrame, shown: int) -> DataFrame:
    priced = own.join(members, ["lang", "source"]).withColumn("value", _price("n", "`all`") - _price("lang_n", "lang_all")).where("value > 0")
    top = priced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= shown)
    return top.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")


def _pairs(own: DataFrame, members: DataFrame) -> DataFrame:
    chunk = F.expr(f"id div {CHUNK}")
    arrays = own.groupBy("lang", "source", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    arrays = arrays.select("lang", "source", "chunk", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    # Every member takes part in every chunk of its language, with an empty array if need be.
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest((kept - 1) div {CHUNK}, 0L)")))
    whole = members.select("*", chunks.alias("chunk")).join(arrays, ["lang", "source", "chunk"], "left")
    none = F.array().cast("array<long>")
    tile = F.expr(f"g div {TILE}")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(members - 1) div {TILE}")))
    dealt = whole.select("lang", "chunk", tile.alias("tile"), tiles.alias("other"), "g", "source", (F.col("all") + SMOOTHING * F.col("kept")).alias("all"), "kept", F.coalesce("ids", none).alias("ids"), F.coalesce("counts", none).alias("counts"))
    dealt = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
    task = ["lang", "chunk", "low", "high"]
    met = dealt.repartition(*task).sortWithinPartitions(*task, "g").select(*task, "tile", "source", "all", "kept", "ids", "counts")
    summed = met.mapInArrow(_differences, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by member and term; a row without a term for each member."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def gathered() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, size), pa.repeat(source, size), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        found.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            words: set[bytes] = set()
            for some in terms(text.as_py()):
                n.update(some)
                words.update(some)
            docs.update(words)
            held += len(n)
            if held >= GATHERED:
                yield from gathered()
                held = 0
    yield from gathered()


def prices(counts: np.ndarray, everything: int) -> np.ndarray:
    """1 + floor(billionths * (count + smoothing) / everything), three decimal digits at a time, within 64 bits."""
    rest = counts + SMOOTHING
    whole, rest = np.divmod(rest, everything)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, everything)
        whole = whole * 1000 + more
    return whole + 1


def met(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ids in two sorted arrays of distinct ids.

    The longer one is galloped through: steps double until they pass the next
    ids of the shorter, which are then probed between the last two steps.
    """
    if len(short) > len(long):
        return met(long, short)[::-1]
    at, left, right = 0, [], []
    for begin in range(0, len(short), STRIDE):
        part = short[begin : begin + STRIDE]
        step = end = 0
        while at + end < len(long) and (not end or long[at + end - 1] < part[-1]):
            step = 2 * step or STRIDE
            end += step
        near = long[at : at + end]
        place = np.searchsorted(near, part)
        hit = np.flatnonzero(place < len(near))
        hit = hit[near[place[hit]] == part[hit]]
        left.append(begin + hit)
        right.append(at + place[hit])
        at += int(place[-1])
        if at >= len(long):
            break
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class Member:
    """A member's prices within a chunk, and its price of a term it does not have."""

    def __init__(self, source: str, everything: int, ids: np.ndarray, counts: np.ndarray) -> None:
        self.source, self.ids = source, ids
        self.prices = prices(counts, everything) if len(ids) else np.empty(0, np.int64)
        self.absent = int(prices(np.zeros(1, np.int64), everything)[0]) if everything else 0

    def difference(self, other: Member, chunk_terms: int) -> int:
        """Sum of price differences over the chunk's terms."""
        mine, its = met(self.ids, other.ids)
        p, q = self.prices[mine], other.prices[its]
        both = np.abs(p - q).sum()
        one = np.abs(self.prices - other.absent).sum() - np.abs(p - other.absent).sum()
        one += np.abs(other.prices - self.absent).sum() - np.abs(q - self.absent).sum()
        neither = chunk_terms - len(self.ids) - len(other.ids) + len(mine)
        return int(both + one) + neither * abs(self.absent - other.absent)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (tuple(c[i] for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    plain = ((*(x.as_py() for x in row[:8]), *(x.values.to_numpy(zero_copy_only=False) for x in row[8:])) for row in rows)
    for (lang, chunk, low, high), task in groupby(plain, itemgetter(0, 1, 2, 3)):
        tiles: dict[int, list[Member]] = {low: [], high: []}
        for *_, tile, source, everything, kept, ids, counts in task:
            tiles[tile].append(Member(source, everything, ids, counts))
        size = max(0, min(CHUNK, kept - chunk * CHUNK))
        pairs = [(a, b) for i, a in enumerate(tiles[low]) for b in (tiles[high] if low < high else tiles[low][i + 1 :])]
        if pairs:
            values = [a.difference(b, size) for a, b in pairs]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(pairs), "a": [a.source for a, _ in pairs], "b": [b.source for _, b in pairs], "value": pa.array(values, pa.int64())})
