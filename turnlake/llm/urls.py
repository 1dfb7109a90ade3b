"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, of accepted and of rejected URLs, back off by
Witten-Bell smoothing: the longer a context was seen, and the fewer symbols
followed it, the more its own counts weigh.  Whole URLs are read, and each
context has counts of its own, so the models grow with the URLs.  All URLs that
a rule judges are counted, in Spark, with partial sums before the shuffle; one
in five of them is kept out to calibrate the threshold.  Models of at most
``MOST_KEYS`` counts are broadcast; larger ones stay in Spark, where the distinct
strings of a context and its symbol are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import cut

#: Longest context in bytes, and contexts of that length.
ORDER = 4
SLOTS = 1 << 8 * ORDER
#: Counts that are broadcast, of 16 bytes each and as much again for totals.
MOST_KEYS = 1 << 22
#: Bins of the calibration, over score differences per character from -8 to 8.
BINS, REACH = 320, 8.0


def host_of(url: str) -> Column:
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``STRUCT<rule, verdict>`` of the longest rule that fits, NULL without one.

    A rule ``host/path`` fits its host and all subdomains if the path starts
    with its own.  Rules are few and come as literals, longest first.
    """
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts per order as numbers (row 0: none), symbols, and the text of each symbol.

    A text is read as UTF-8 bytes between a start mark per context place and an end mark.
    """
    data = [bytes(ORDER) + t.encode() + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(d) for d in data], np.int64)
    owner = np.repeat(np.arange(len(data)), lengths)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(inside >= ORDER)
    slots = np.zeros((ORDER + 1, len(at)), np.int64)
    for k in range(1, ORDER + 1):
        slots[k] = slots[k - 1] + (flat[at - k].astype(np.int64) << 8 * (k - 1))
    return slots, flat[at].astype(np.int64), owner[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (class, order, slot, symbol) packed into one key, summed per batch."""
    for batch in batches:
        slots, symbols, owner = _grams(batch.column(0).to_pylist())
        side = np.array(batch.column(1).to_pylist(), np.int64)[owner] if len(owner) else owner
        keys = [((side * (ORDER + 1) + k) * SLOTS + slots[k]) * 256 + symbols for k in range(ORDER + 1)]
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": key, "n": n.astype(np.int64)})


class Models:
    """Both models as sorted keys with counts, and totals and kinds per context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)
        self.contexts, place = np.unique(self.keys // 256, return_inverse=True)
        self.total = np.bincount(place, self.counts, len(self.contexts))
        self.kinds = np.bincount(place, minlength=len(self.contexts)).astype(np.float64)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood under the accepted model less that under the rejected one, per symbol."""
        slots, symbols, owner = _grams(texts)
        diff = np.zeros(len(symbols))
        for side, sign in ((1, 1.0), (0, -1.0)):
            p = np.full(len(symbols), 1 / 256)
            for k in range(ORDER + 1):
                context = (side * (ORDER + 1) + k) * SLOTS + slots[k]
                key = context * 256 + symbols
                at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                seen = np.where(self.keys[at] == key, self.counts[at], 0.0) if len(self.keys) else np.zeros(len(key))
                where = np.minimum(np.searchsorted(self.contexts, context), max(0, len(self.contexts) - 1))
                known = self.contexts[where] == context if len(self.contexts) else np.zeros(len(key), bool)
                total, kinds = (np.where(known, x[where], 0.0) if len(x) else np.zeros(len(key)) for x in (self.total, self.kinds))
                p = np.where(total > 0, (seen + kinds * p) / np.maximum(total + kinds, 1), p)
            diff += sign * np.log(p)
        return np.bincount(owner, diff, len(texts)) / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def counted(judged: DataFrame) -> DataFrame:
    """``key, n`` of ``judged (text, side)``, side 1 accepted and 0 rejected."""
    return cut(judged.select("text", "side").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "url-counts")


def fit(table: DataFrame) -> Models:
    """Models from ``key, n``.  No rows give models that score 0."""
    table = table.toArrow()
    return Models(table.column("key").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64))


def broadcast_scores(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``text, score`` of ``texts``, by models that every worker holds."""
    models = texts.sparkSession.sparkContext.broadcast(fit(table))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("score", pa.array(models.value.score(batch.column(0).to_pylist())))

    return texts.select("text").mapInArrow(score, "text string, score double")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each string of a context and its symbol, as a number, occurs in each text."""
    for batch in batches:
        slots, symbols, owner = _grams(batch.column(0).to_pylist())
        string = slots[ORDER] * 256 + symbols
        order = np.lexsort((string, owner))
        owner, string = owner[order], string[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (string[1:] != string[:-1]))[: len(owner)])
        times = np.diff(np.append(first, len(owner)))
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owner[first])), pa.array(string[first]), pa.array(times)], ["id", "string", "times"])


def joined_scores(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``text, score`` of the distinct ``texts``, by joins with models of any size."""
    named = texts.select("text", F.xxhash64("text").alias("id")).distinct()
    found = cut(named.mapInArrow(_strings, "id long, string long, times long"), "url-strings")
    known = found.select("string").distinct().withColumn("p0", F.lit(1 / 256)).withColumn("p1", F.lit(1 / 256))
    context = F.shiftright("key", 8)
    for k in range(ORDER + 1):
        # The last k bytes of the context, and the symbol.
        own = F.col("string").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        for side in (0, 1):
            base = (side * (ORDER + 1) + k) * SLOTS
            level = table.where((context >= F.lit(base)) & (context < F.lit(base + SLOTS)))
            seen = level.select((F.col("key") - F.lit(base * 256)).alias("own"), F.col("n").alias("seen"))
            totals = level.groupBy((context - F.lit(base)).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            p = F.col(f"p{side}")
            new = F.when(F.col("total") > 0, (F.coalesce("seen", F.lit(0)) + F.col("kinds") * p) / (F.col("total") + F.col("kinds"))).otherwise(p)
            known = known.withColumn("own", own).join(seen, "own", "left").withColumn("context", F.shiftright("own", 8)).join(totals, "context", "left")
            known = known.withColumn(f"p{side}", new).select("string", "p0", "p1")
    each = cut(known.select("string", (F.log("p1") - F.log("p0")).alias("diff")), "url-strings")
    scores = found.join(each, "string").groupBy("id").agg((F.sum(F.col("diff") * F.col("times")) / F.sum("times")).alias("score"))
    return named.join(scores, "id").select("text", "score")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``id_column, host, path, rule, verdict, score`` per row of ``pages``.

    Rules decide where one fits (longest wins); elsewhere the URL is allowed
    if its score is at least the threshold that best tells held-out accepted
    from rejected URLs.  NULL or malformed URLs have an empty host and path;
    the whole URL is scored, its host in lower case, NULL as an empty text; without URLs of both sides all scores
    are compared with 0.  Rows are kept as they are, repeated ones too.
    """
    host, path = host_of(url_column), path_of(url_column)
    head = F.regexp_extract(F.col(url_column), r"(?s)^.*?://[^/?#]*", 0)
    whole = F.concat(F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(F.col(url_column), F.length(head) + 1, F.length(url_column)))
    text = F.coalesce(whole, F.lit(""))
    rows = pages.select(F.col(id_column).alias("_id"), host.alias("_host"), path.alias("_path"), text.alias("text"))
    rows = rows.withColumn("_found", longest_rule(F.col("_host"), F.col("_path"), rules))
    judged = rows.where(F.col("_found").isNotNull()).select("text", (F.col("_found.verdict") == "allow").cast("long").alias("side"))
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    table = counted(judged.where(~held))
    scores_of = broadcast_scores if table.count() <= MOST_KEYS else joined_scores
    scores = cut(scores_of(rows.select("text").distinct(), table), "url-scores")

    cell = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / (2 * REACH))), F.lit(0)), F.lit(BINS)).cast("int")
    bins = judged.where(held).join(scores, "text").groupBy(cell.alias("cell"), "side").count().collect()  # at most 2 * (BINS + 1) rows
    bar = threshold([(r["cell"], r["side"], r["count"]) for r in bins])
    scored = rows.join(scores, "text")
    verdict = F.coalesce("_found.verdict", F.when(F.col("score") >= bar, "allow").otherwise("block"))
    return scored.select(F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_found.rule").alias("rule"), verdict.alias("verdict"), "score")


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The lower edge of a bin with the best mean of both sides' accuracies; the one nearest 0 among equals."""
    sides = np.zeros((2, BINS + 1))
    for cell, side, n in bins:
        sides[side, cell] += n
    if not sides.sum(1).all():
        return 0.0
    share = sides / sides.sum(1, keepdims=True)
    edges = np.arange(BINS + 1) * (2 * REACH / BINS) - REACH
    good = (share[1].sum() - np.concatenate([[0], np.cumsum(share[1])[:-1]])) + np.concatenate([[0], np.cumsum(share[0])[:-1]])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])
