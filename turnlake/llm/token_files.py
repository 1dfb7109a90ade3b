"""Token ids in seekable zstandard files.

A shard holds the ids of a range of documents in ascending order, little-endian
unsigned 32 bits each, every document closed by an end id.  Its bytes are cut
into frames that decompress independently.  Layout:

* zstandard frames of at most ``FRAME_BYTES`` (a longer document spans several),
* a skippable frame with the document index: how many ids are NULL, then the
  doc ids and the end of each document in bytes of raw data (64 bits each), compressed,
* a skippable frame with the seek table of the public seekable format: compressed
  size, raw size and checksum (low 32 bits of XXH64 of the raw bytes) per frame,
  then the number of frames, a descriptor and the magic number.

Shards are written by the tasks of a range-partitioned, sorted shuffle to files
named by attempt, so a repeated task never touches the file of another one; the
manifest lists those that count.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnlake.llm.bpe import byte_alphabet, is_word, simpler_pieces, takes_short_ways
from turnlake.llm.common import Cache, cut, scratch_path, text_of

FRAME_BYTES = 1 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_FRAME = 0x184D2A50
#: Shards to a group when their totals are summed up.
GROUP = 1000


@lru_cache(maxsize=4)
def encoder(file: str) -> Cache[bytes]:
    """Ids by piece without blanks, of a file that :func:`takes_short_ways`; else by whole text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(file)
    encode, tokenize = library.encode, library.model.tokenize
    short = takes_short_ways(file)

    def ids(piece: str) -> bytes:
        if not short:
            found = encode(piece, add_special_tokens=False).ids
        elif (simpler := simpler_pieces(piece)) is not None:
            return b"".join([pieces[x] for x in simpler])
        elif is_word(piece):  # needs no normalizer and is one pre-token: the library's model takes it as it is
            found = [t.id for t in tokenize(byte_alphabet(piece))]
        else:
            found = encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    pieces: Cache[bytes] = Cache(ids, limit=500_000)
    return pieces


class ShardWriter:
    """Cuts raw bytes into frames and keeps the index; memory holds a frame and the index."""

    def __init__(self, out, level: int = 3) -> None:
        import zstandard

        self.out, self.compress = out, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.waiting, self.frames, self.raw = bytearray(), [], 0
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.nulls = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        if self.waiting and len(self.waiting) + len(data) > FRAME_BYTES:
            self._frame(len(self.waiting))
        self.waiting += data
        while len(self.waiting) > FRAME_BYTES:
            self._frame(FRAME_BYTES)
        self.raw += len(data)
        self.nulls += doc_id is None
        self.ids.append(doc_id or 0)
        self.ends.append(self.raw)

    def _frame(self, n: int) -> None:
        import xxhash

        part = bytes(self.waiting[:n])
        del self.waiting[:n]
        packed = self.compress(part)
        self.out.write(packed)
        self.frames.append((len(packed), n, xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(len(self.waiting))
        index = self.compress(struct.pack("<q", self.nulls) + np.array([self.ids, self.ends], "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class ShardReader:
    """Reads the documents asked for and decompresses only their frames."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.expand = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(head + 8, 12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.raw = np.concatenate([[0], np.cumsum(self.frames[:, 1], dtype=np.int64)])
        kind, length = struct.unpack("<II", self._at(int(self.at[-1]), 8))
        if kind != INDEX_FRAME:
            raise ValueError("no document index before the seek table")
        index = self.expand(self._at(int(self.at[-1]) + 8, length))
        self.nulls = struct.unpack("<q", index[:8])[0]
        self.ids, self.ends = np.frombuffer(index[8:], "<i8").reshape(2, -1)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        import xxhash

        if self.last[0] != i:
            data = self.expand(self._at(int(self.at[i]), int(self.frames[i, 0])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[i, 2]:
                raise ValueError(f"checksum of frame {i} differs")
            self.last = (i, data)
        return self.last[1]

    def document(self, k: int) -> bytes:
        """Raw ids of the ``k``-th document of the shard."""
        begin, end = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        first = int(np.searchsorted(self.raw, begin, "right")) - 1
        parts = []
        while first < len(self.frames) and self.raw[first] < end:
            at = int(self.raw[first])
            parts.append(self.frame(first)[max(0, begin - at) : end - at])
            first += 1
        return b"".join(parts)


def open_fs(path: str):
    """File system and path of a folder that Spark names by URI."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, file: str, end_id: int, out: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write shards and return their manifest ``(shard, path, n_docs, n_ids, first_id)``.

    Encodes each whole text of ``docs`` without special tokens, closed by
    ``end_id``.  Documents ascend by id (NULL ids first, rows of one id by
    text) within and across shards; ``first_id`` counts the ids before the
    shard.  NULL or empty texts hold the end id alone.  An empty table gives
    no shards.  Other columns are not read.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end, short = encoder(file), struct.pack("<I", end_id), takes_short_ways(file)
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    system, folder = open_fs(out)
                    system.create_dir(folder, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                    stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = ShardWriter(stream)
                text = text.as_py()
                writer.add(key, b"".join(map(pieces.__getitem__, text.replace("\n", " ").split(" ") if short else [text])) + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out}/{name}"], "n_docs": [len(writer.ids)], "n_ids": [writer.raw // 4]})

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ties of an id meet in one shard, and the text orders them.
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    manifest = cut(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")
    grouped = manifest.withColumn("g", F.floor(F.col("shard") / GROUP))
    groups = grouped.groupBy("g").agg(F.sum("n_ids").alias("n"))
    # One row per thousand shards reaches the unpartitioned window.
    ahead = groups.select(F.col("g"), F.coalesce(F.sum("n").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("g").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("within", within).join(ahead, "g").select("shard", "path", "n_docs", "n_ids", (F.col("ahead") + F.col("within")).alias("first_id"))


def read_token_files(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id_column, start, n_tokens, ids)`` of every document in the manifest's shards, one task per shard at best.

    ``start`` counts all ids before the document, ``ids`` are its raw bytes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = open_fs(path)
                with system.open_input_file(where) as source:
                    reader = ShardReader(source)
                    begin, size, found = 0, 0, []
                    for k in range(len(reader.ids)):
                        found.append(reader.document(k))
                        size += len(found[-1])
                        if size >= 8 * FRAME_BYTES or k + 1 == len(reader.ids):
                            ends = reader.ends[begin : k + 1]
                            lengths = np.array([len(x) for x in found], np.int64)
                            ids = pa.array(reader.ids[begin : k + 1].copy(), mask=np.arange(begin, k + 1) < reader.nulls)
                            yield pa.RecordBatch.from_arrays(
                                [ids, pa.array((ends - lengths) // 4 + first), pa.array(lengths // 4), pa.array(found, pa.binary())],
                                [id_column, "start", "n_tokens", "ids"],
                            )
                            begin, size, found = k + 1, 0, []

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not left to AQE, which sees few bytes here
    spread = manifest.select("path", "first_id", "shard").repartition(tasks, "shard").select("path", "first_id")
    return spread.mapInArrow(read, f"`{id_column}` long, start long, n_tokens long, ids binary")
