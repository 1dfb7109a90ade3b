"""Benchmark decontamination over item-sized windows of words.

A document is contaminated by an item of ``n`` words when a window of ``n``
consecutive words of it is within an edit distance of ``n // 5`` words.  Words
are compared in lower case without marks.

1. A window within that distance keeps a certain number of the item's word
   runs (the q-gram lemma), so windows with fewer are passed over unseen.
2. The others are embedded by CGK random walks, which turn edit distance into
   Hamming distance, and meet the items in buckets of sampled coordinates.  The
   number of repetitions comes from the recall aimed at and the collision
   rate of pairs at the full distance.
3. Meetings are verified by the exact edit distance.

Items are the query set: they go to all tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Cache, text_of

#: Words that may differ: one in five of the item's.
SLACK = 5
#: Words of a run at most; characters of a block of items; windows embedded at a time.
RUN, BLOCK_CHARS, WINDOWS = 3, 8_000_000, 100_000
#: Bits of a run's fingerprint in the table of those seen in items.
_SEEN = 20
#: Sampled coordinates of a bucket, and the recall aimed at for a window at the full distance.
SAMPLED, RECALL = 2, 0.999
#: Steps per word of an item that coordinates are drawn from; a walk has left the item's words after about two a word.
REACH = 1.0


def meets(n: int) -> float:
    """Share of pairs of ``n`` words at the full distance that meet in one repetition, low: edits put walks out of step, more with more words.

    A curve below what ``collision_rate`` measures from 5 to 1000 words.
    """
    return min(0.45, 0.45 * (15 / n) ** 0.65)


def repeats(n: int) -> int:
    """Repetitions after which ``RECALL`` of such pairs have met."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - meets(n)))


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MARKS = re.compile(r"[\W_]+")


def _word_hash(piece: str) -> int:
    """Fingerprint of a piece in lower case without marks; 0 if nothing is left."""
    word = _MARKS.sub("", piece.lower())
    return (xxhash.xxh3_64_intdigest(word) | 1) if word else 0


_HASHES: Cache[int] = Cache(_word_hash, limit=300_000)


def words_of(text: str) -> np.ndarray:
    pieces = text.split()
    return np.fromiter(map(_HASHES.__getitem__, pieces), np.uint64, len(pieces))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words that :func:`words_of` keeps."""
    return [m.span() for m in re.finditer(r"\S+", text) if _HASHES[m[0]]]


def allowed(n: int) -> int:
    return n // SLACK


def run_words(n: int) -> int:
    """Words of a run that every window within the distance keeps at least once."""
    k = allowed(n)
    return min(RUN, -(-(n - k) // (k + 1)))


def runs_kept(n: int) -> int:
    q = run_words(n)
    return max(1, n - q + 1 - allowed(n) * q)


def runs(h: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - q + 1), np.uint64)
    for i in range(q):
        out = out * _MIX[2] + h[i : len(h) - q + 1 + i] * _MIX[i % 3]
    return out


def embed(h: np.ndarray, begin: np.ndarray, length: np.ndarray, n: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each window ``h[begin : begin + length]`` for items of ``n`` words, in one repetition, and whether it has one.

    At each step the walk writes the word it stands on, and a random bit of
    step and word decides whether it moves on.  A bucket is the words at the
    sampled steps, with ``n``.  A walk moves at every second step on average,
    so steps are drawn where it still has words ahead; one that has left the
    window there says nothing, and gets no bucket.
    """
    rng = np.random.default_rng(repeat)
    sampled = rng.random(SAMPLED)
    steps = np.floor(sampled[:, None] * (REACH * n)).astype(np.int64)
    place, bucket = np.zeros(len(begin), np.int64), n.astype(np.uint64) * _MIX[0]
    stood = np.ones(len(begin), bool)
    for step in range(int(steps.max(initial=-1)) + 1):
        salt = np.uint64(int(rng.integers(1 << 63)) * 2 + 1)
        word = h[np.minimum(begin + place, len(h) - 1)]
        for s in steps:
            here = s == step
            bucket = np.where(here, (bucket ^ word) * _MIX[1], bucket)
            stood &= ~here | (place < length)
        place += (((word ^ salt) * _MIX[2]) >> np.uint64(63)).astype(np.int64)
    return bucket ^ np.uint64(repeat * int(_MIX[2]) % (1 << 64)), stood


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of word sequences, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i if i <= most else far
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        if min(new) > most:
            return far
        row = new
    return row[-1]


@dataclass
class Items:
    """A block of items: runs by length with their items, and buckets of all repetitions."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        keep = [k for k, w in enumerate(self.words) if len(w)]
        self.ids, self.words = [self.ids[k] for k in keep], [self.words[k] for k in keep]
        self.lists = [w.tolist() for w in self.words]
        self.bags = [frozenset(w) for w in self.lists]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([runs_kept(int(n)) for n in self.n], np.int64)
        self.q = np.array([run_words(int(n)) for n in self.n], np.int64)
        self.by_run = {}
        for q in sorted(set(self.q.tolist())):
            own = np.flatnonzero(self.q == q)
            found = [np.unique(runs(self.words[k], q)) for k in own]
            key, item = np.concatenate(found), np.repeat(own, [len(x) for x in found])
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _SEEN, bool)  # tells most other runs at once
            seen[key >> np.uint64(64 - _SEEN)] = True
            self.by_run[q] = (key[order], item[order], seen)
        if self.words:
            flat, begin = np.concatenate(self.words), np.cumsum(self.n) - self.n
            rounds, keys, met = np.array([repeats(int(n)) for n in self.n]), [], []
            for r in range(int(rounds.max())):
                own = np.flatnonzero(rounds > r)
                key, stood = embed(flat, begin[own], self.n[own], self.n[own], r)
                keys.append(key[stood])
                met.append(own[stood])
            order = np.argsort(np.concatenate(keys), kind="stable")
            self.buckets, self.in_bucket = np.concatenate(keys)[order], np.concatenate(met)[order]

    def windows(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and item sizes of windows that keep enough runs of an item.

        ``first`` and ``last`` bound the document of each word of ``h``.
        """
        found = set()
        for q, (keys, items, seen) in self.by_run.items():
            here = runs(h, q)
            inside = np.flatnonzero(seen[here >> np.uint64(64 - _SEEN)])
            inside = inside[first[inside] == first[inside + q - 1]]
            left, right = np.searchsorted(keys, here[inside], "left"), np.searchsorted(keys, here[inside], "right")
            hit = np.flatnonzero(right > left)
            if not len(hit):
                continue
            many = (right - left)[hit]
            place = np.repeat(inside[hit], many)
            item = items[np.repeat(left[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            order = np.lexsort((place, item))
            place, item = place[order], item[order]
            end = np.arange(len(place)) + self.need[item] - 1
            ok = end < len(place)
            end = np.minimum(end, len(place) - 1)
            ok &= (item[end] == item) & (first[place[end]] == first[place]) & (place[end] - place <= self.n[item] - q)
            at, until, n = place[ok], place[end[ok]], self.n[item[ok]]
            low = np.maximum(first[at], until + q - n)
            spans = np.unique(np.column_stack([low, at, n]), axis=0)
            for a, b, size in spans.tolist():
                found.update((s, size) for s in range(a, b + 1))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        start, n = np.array(sorted(found), np.int64).T
        length = np.minimum(n, last[start] - start)
        keep = length >= n - n // SLACK
        return start[keep], length[keep], n[keep]

    def search(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best ``(distance, start, length)`` by first word of the document and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.words or not len(h):
            return best
        starts, lengths, sizes = self.windows(h, first, last)
        for i in range(0, len(starts), WINDOWS):
            start, length, n = starts[i : i + WINDOWS], lengths[i : i + WINDOWS], sizes[i : i + WINDOWS]
            met, sizes_here, which = set(), *np.unique(n, return_inverse=True)
            rounds = np.array([repeats(int(x)) for x in sizes_here])[which]
            for r in range(int(rounds.max())):
                own = np.flatnonzero(rounds > r)
                key, stood = embed(h, start[own], length[own], n[own], r)
                left, right = np.searchsorted(self.buckets, key, "left"), np.searchsorted(self.buckets, key, "right")
                for w in np.flatnonzero((right > left) & stood):
                    met.update((int(own[w]), int(k)) for k in self.in_bucket[left[w] : right[w]])
            met = sorted((w, k) for w, k in met if self.n[k] == n[w])
            for w, k in met:  # whole copies first: nothing else of the document can be closer
                where = (int(first[start[w]]), k)
                if length[w] == n[w] and where not in best and (h[start[w] : start[w] + n[w]] == self.words[k]).all():
                    best[where] = (0, int(start[w]), int(n[w]))
            for w, k in met:
                s, size = int(start[w]), int(length[w])
                where = (int(first[s]), k)
                most = min(allowed(int(self.n[k])), best[where][0] - 1 if where in best else 1 << 30)
                if most < 0:
                    continue
                window = h[s : s + size].tolist()
                # Each word that the item lacks is an edit of its own.
                if size - sum(map(self.bags[k].__contains__, window)) <= most and (d := edit_distance(self.lists[k], window, most)) <= most:
                    best[where] = (d, s, size)
        return best


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str) -> list[Items]:
    """All items in blocks of about ``BLOCK_CHARS`` characters each; NULL or blank items match nothing."""
    rows = benchmark.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    out = []
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # about BLOCK_CHARS
        hashed = [words_of(r["text"]) for r in own]
        out.append(Items([r["id"] for r in own], [h[h != 0] for h in hashed]))
    return out


def _searched(items: Items, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """``(item, distance, first word, words)`` per text."""
    words = [words_of(t) for t in texts]
    words = [h[h != 0] for h in words]
    sizes = np.array([len(h) for h in words], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not ends.size or not ends[-1]:
        return found
    best = items.search(np.concatenate(words), np.repeat(begins, sizes), np.repeat(ends, sizes))
    for (begin, k), (d, s, size) in best.items():
        # Of the texts that begin here, only the last one has words.
        found[int(np.searchsorted(begins, begin, "right")) - 1].append((k, d, s - begin, size))
    return found


def _portions(texts: list[str], chars: int = 16_000_000) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Each document with an item found in it: ``id_column, item_column, distance, begin, end``.

    ``begin`` and ``end`` are the characters of the closest window, the first
    of equals.  NULL and empty texts hold nothing; a document of fewer words than an item is
    one window.  Texts of any length are searched whole.  Repeated documents or
    items give repeated rows; an empty table of either gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_column), text_of(text_column).alias("_text"))
    kinds = f"`{id_column}` {rows.schema[0].dataType.simpleString()}, `{item_column}` {benchmark.schema[item_column].dataType.simpleString()}, distance int, begin long, end long"
    names = [id_column, item_column, "distance", "begin", "end"]
    parts = []
    for items in item_blocks(benchmark, item_column, item_text_column):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in _portions(texts):
                    out, rows_found = [], []
                    for i, found in enumerate(_searched(shared.value, texts[a:b]), a):
                        spans = word_spans(texts[i]) if found else []
                        for k, d, s, size in sorted(found):
                            rows_found.append(i)
                            out.append((shared.value.ids[k], d, spans[s][0], spans[s + size - 1][1]))
                    if out:
                        item, distance, begin, end = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_found)), pa.array(item), pa.array(distance, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names)

        parts.append(rows.mapInArrow(run, kinds))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were.

    Rows of a NULL or empty text stay, repeated rows go or stay alike; without
    items all rows stay.
    """
    for items in item_blocks(benchmark, item_column, item_text_column):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()]
                clean = [not found for a, b in _portions(texts) for found in _searched(shared.value, texts[a:b])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def collision_rate(n: int, trials: int = 2000, seed: int = 0) -> float:
    """Share of random pairs of ``n`` words at the full distance that meet in one repetition."""
    rng = np.random.default_rng(seed)
    meets = 0
    for t in range(trials):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a.tolist()
        for _ in range(allowed(n)):
            at, what = int(rng.integers(len(b))), int(rng.integers(3))
            if what == 0:
                b[at] = int(rng.integers(1, 1 << 62))
            elif what == 1:
                b.insert(at, int(rng.integers(1, 1 << 62)))
            else:
                b.pop(at)
        other = np.array(b[:n], np.uint64)
        both = np.concatenate([a, other])
        keys, stood = embed(both, np.array([0, n]), np.array([n, len(other)]), np.array([n, n]), t)
        meets += keys[0] == keys[1] and stood.all()
    return meets / trials
