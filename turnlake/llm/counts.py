"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

Each block of documents becomes an inverted list: one row per distinct
pre-token with the places and frequencies of the documents that hold it.  Rows
meet by pre-token, sorted, so a pre-token is given to the tokenizer once and
its count is multiplied into all lists that follow; ids are never kept.  A
frequent pre-token has one row per block, not per document, so no key is hot.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import text_of

#: A pre-token with the white space before it.  Texts are cut only before a
#: blank or line feed that follows a visible character: every byte-level
#: pattern of this kind ends a token there, so counts of the parts add up.
PRE_TOKEN = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
#: A block ends at so many characters or documents (places are 16 bits).
BLOCK_CHARS, BLOCK_DOCS = 24_000_000, 60_000

#: Sums held before they are handed on.
HELD_SUMS = 4_000_000

_OWN = np.dtype([("id", "<i8"), ("known", "<i8"), ("bytes", "<i8")])
_SUM = np.dtype([("place", "<u2"), ("tokens", "<u8")])
#: Kinds of a list: every frequency is 1 and only places are written; places,
#: then frequencies of 8 bits; and the block's own row of ids and sizes.
ONES, TIMES, OWN = 0, 1, 2


@lru_cache(maxsize=4)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def _lists(block: int, ids: list[int | None], sizes: list[int], found: list[np.ndarray], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The inverted lists of a block, and its own row under a NULL pre-token."""
    keys = [np.unique(x, return_counts=True) for x in found]
    word = np.concatenate([k for k, _ in keys])
    times = np.concatenate([t for _, t in keys])
    place = np.repeat(np.arange(len(keys)), [len(k) for k, _ in keys])
    while (many := times > 255).any():  # a frequency beyond 8 bits is written in parts
        word, place = np.append(word, word[many]), np.append(place, place[many])
        times = np.append(np.where(many, 255, times), times[many] - 255)
    order = np.argsort(word, kind="stable")
    word, place, times = word[order], place[order].astype("<u2"), times[order].astype("u1")
    size = np.bincount(word, minlength=len(words))
    often = np.zeros(len(words), bool)
    often[word[times > 1]] = True
    strings = pa.array([*words], pa.string())
    for kind, width in ((ONES, 2), (TIMES, 3)):
        own = np.flatnonzero(often == (kind == TIMES))
        if not len(own):
            continue
        mine = np.isin(word, own, kind="table") if len(word) else np.empty(0, bool)
        data = np.empty((mine.sum(), width), "u1")
        data[:, :2] = place[mine].view("u1").reshape(-1, 2)
        if kind == TIMES:
            data[:, 2] = times[mine]
        offsets = np.concatenate([[0], np.cumsum(size[own]) * width]).astype("<i4")
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([strings.take(pa.array(own)), pa.array(np.full(len(own), block * 4 + kind)), lists], ["word", "block", "lists"])
    rows = np.empty(len(ids), _OWN)
    rows["id"], rows["known"], rows["bytes"] = [x or 0 for x in ids], [x is not None for x in ids], sizes
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block * 4 + OWN]), pa.array([rows.tobytes()], pa.binary())], ["word", "block", "lists"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), count()

    def fresh() -> tuple[list, list, list, defaultdict]:
        return [], [], [], defaultdict(count().__next__)

    ids, sizes, found, words = fresh()
    chars = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(key)
            sizes.append(len(text.encode()))
            found.append(np.fromiter(map(words.__getitem__, PRE_TOKEN.findall(text)), np.int64))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                yield from _lists(task << 32 | next(number), ids, sizes, found, words)
                ids, sizes, found, words = fresh()
                chars = 0
    if ids:
        yield from _lists(task << 32 | next(number), ids, sizes, found, words)


def token_counts(docs: DataFrame, file: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_tokens`` and ``over_limit`` per row of ``docs``.

    Counts are those of the whole text under a byte-level tokenizer file,
    without added special tokens; special strings inside a text count as the
    library counts them.  NULL texts are empty: 0 bytes, 0 tokens.  Repeated
    rows and repeated or NULL ids give one result per row.  Ids are long.
    Other columns are not read.  Needs special strings without white space.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, size = _tokenizer(file).encode_batch_fast, None, 0
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            words, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            # A row of ids passes through; lists are multiplied out below.
            yield batch.filter(pa.array(blocks % 4 == OWN)).select(["block", "lists"])
            new = [w for i, w in enumerate(words) if w is not None and w != last and (i == 0 or w != words[i - 1])]
            sizes = dict(zip(new, map(len, encode(new, add_special_tokens=False)), strict=True))
            if last is not None:
                sizes[last] = size
            each = np.array([sizes.get(w, 0) for w in words], np.int64)
            last, size = next(((w, sizes[w]) for w in reversed(words) if w is not None), (last, size))
            ends = np.frombuffer(batch.column(2).buffers()[1], "<i4")[batch.column(2).offset :][: len(words) + 1].astype(np.int64)
            data = np.frombuffer(batch.column(2).buffers()[2] or b"", "u1")
            for kind, width in ((ONES, 2), (TIMES, 3)):
                own = np.flatnonzero(blocks % 4 == kind)
                lengths = (ends[own + 1] - ends[own]) // width
                at = np.repeat(ends[own] - (np.cumsum(lengths) - lengths) * width, lengths) + np.arange(lengths.sum()) * width
                place = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
                tokens = np.repeat(each[own], lengths) * (data[at + 2] if kind == TIMES else 1)
                block = np.repeat(blocks[own] >> 2, lengths)
                order = np.argsort(block, kind="stable")
                block, place, tokens = block[order], place[order], tokens[order]
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)]):
                    sums = np.bincount(place[a:b], tokens[a:b]).astype(np.int64)
                    key = int(block[a])
                    old = held.get(key)
                    if old is None or len(old) < len(sums):
                        held[key] = sums if old is None else sums + np.pad(old, (0, len(sums) - len(old)))
                    else:
                        old[: len(sums)] += sums
            if sum(map(len, held.values())) > HELD_SUMS:
                yield _packed(held)
                held.clear()
        yield _packed(held)

    def finish(table: pa.Table) -> pa.Table:
        """Sum a block's counts by place, and name the documents."""
        parts = list(zip(table.column("block").to_pylist(), table.column("lists").to_pylist(), strict=True))
        rows = np.concatenate([np.frombuffer(x, _OWN) for b, x in parts if b % 4 == OWN])
        total = np.zeros(len(rows), np.int64)
        for b, x in parts:
            if b % 4 != OWN:
                sums = np.frombuffer(x, _SUM)
                total[sums["place"]] += sums["tokens"].astype(np.int64)
        return pa.table({"id": pa.array(rows["id"].copy(), mask=rows["known"] == 0), "n_bytes": pa.array(rows["bytes"].copy()), "n_tokens": pa.array(total)})

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    lists = rows.mapInArrow(_invert, "word string, block long, lists binary")
    # Rows of ids have no word; they spread by their block.
    met = lists.repartition(F.coalesce(F.xxhash64("word"), F.lit(0)) + F.when(F.col("word").isNull(), F.xxhash64("block")).otherwise(0)).sortWithinPartitions("word")
    parts = met.mapInArrow(pieces, "block long, lists binary")
    counted = parts.groupBy(F.shiftright("block", 2)).applyInArrow(finish, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """One row of places and sums per block."""
    rows = []
    for sums in held.values():
        place = np.flatnonzero(sums)
        packed = np.empty(len(place), _SUM)
        packed["place"], packed["tokens"] = place, sums[place]
        rows.append(packed.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([b << 2 for b in held], pa.int64()), pa.array(rows, pa.binary())], ["block", "lists"])
