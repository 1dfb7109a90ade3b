"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the ranks of adjacent pairs; its root is the
leftmost pair of lowest rank.  A merge changes at most three leaves, so it costs
a logarithm of the word's length, until no pair is left that can be merged.
Every white-space delimited piece is encoded once per worker while it stays
in a bounded cache; texts are cut at blanks only, which no token spans.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Cache, text_of

#: Stands for "no pair to merge"; larger than any rank shifted by a position.
NONE = 1 << 62
_SHIFT = 32
#: Letters below this one have the same case and class in every Unicode
#: version at hand; other pieces go through the library's own normalizer.
_SAFE = "\u0250"
_BYTES = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else None for b in range(256)}
for _b in [b for b, c in _BYTES.items() if c is None]:
    _BYTES[_b] = chr(256 + sum(c is None or ord(c) > 255 for x, c in _BYTES.items() if x < _b))
#: Rows go back in batches of about this many characters.
BATCH_CHARS = 2_000_000


_all_safe = re.compile(f"[\0-{chr(ord(_SAFE) - 1)}]*").fullmatch


def is_word(piece: str) -> bool:
    """Only lower-case letters that need no normalizer: one pre-token as it stands."""
    return piece.isalpha() and (piece.isascii() or _all_safe(piece) is not None) and piece == piece.lower()


def byte_alphabet(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


def simpler_pieces(piece: str) -> tuple[str, ...] | None:
    """Pieces with the same ids together: a mark after a letter stands alone, case is dropped.

    Not after a letter whose lower case ends in something else: of "İ" a
    combining mark is left, which forms one run with the mark behind it.
    """
    if piece[-1:] in (".", ","):
        letter = piece[-2:-1].lower()
        if len(letter) == 1 and letter.isalpha() and piece[-2] < _SAFE and letter < _SAFE:
            return piece[:-1], piece[-1]
    lower = piece.lower()
    if lower != piece and lower.isalpha() and (piece.isascii() or (_all_safe(piece) and _all_safe(lower))):
        return (lower,)
    return None


#: What a file must state for texts to be cut at blanks and pieces to be simplified.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def takes_short_ways(file: str) -> bool:
    """Whether the file lower-cases, drops white space and splits letters from marks, so that pieces can be coded apart.

    Any other file is coded text by text, as it states.
    """
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    normal, steps = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split = steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    marked = any(x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"] or not x["content"].isascii() or " " in x["content"] for x in spec["added_tokens"])
    return normal.get("normalizers") == _NORMAL and split and level and not marked


class PairTree:
    """Minimum of ``rank << 32 | position`` over adjacent pairs."""

    def __init__(self, leaves: list[int]) -> None:
        width = 1 << (len(leaves) - 1).bit_length()
        self.width = width
        self.tree = tree = [NONE] * width + leaves + [NONE] * (width - len(leaves))
        for i in range(width - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right

    def set(self, position: int, value: int) -> None:
        tree, i = self.tree, position + self.width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if tree[i] == value:
                return
            tree[i] = value


def merge(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge ``ids`` until no pair has a rank; ``ranks`` maps ``left << 32 | right`` to it."""
    n, get = len(ids), ranks.get
    if n < 2:
        return ids
    leaves, some = [NONE] * (n - 1), False
    for i in range(n - 1):
        rank = get(ids[i] << _SHIFT | ids[i + 1])
        if rank is not None:
            leaves[i], some = rank << _SHIFT | i, True
    if not some:
        return ids
    pairs = PairTree(leaves)
    tree, put = pairs.tree, pairs.set
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) < NONE:
        i, rank = least & 0xFFFFFFFF, least >> _SHIFT
        gone = after[i]
        following = after[gone]
        own = ids[i] = made[rank]
        ids[gone], after[i] = -1, following
        value = NONE
        if following < n:
            before[following] = i
            put(gone, NONE)
            rank = get(own << _SHIFT | ids[following])
            if rank is not None:
                value = rank << _SHIFT | i
        put(i, value)
        ahead = before[i]
        if ahead >= 0:
            rank = get(ids[ahead] << _SHIFT | own)
            put(ahead, NONE if rank is None else rank << _SHIFT | ahead)
    return [x for x in ids if x >= 0]


class WordBpe:
    """A word BPE vocabulary file: normalizer and pre-tokenizer as the file states them, merges by the tree."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(file)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocabulary
        self.ranks = {v[a] << _SHIFT | v[b]: i for i, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [v[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of_id = {i: s for s, i in [*v.items(), *self.special.items()]}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.short = takes_short_ways(file)
        self.pieces: Cache[tuple[bytes, str]] = Cache(self.piece, limit=300_000)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, already in the byte alphabet."""
        v = self.vocabulary
        return merge([v[c] for c in word[:-1]] + [v[word[-1] + self.end]], self.ranks, self.made)

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids (little-endian, 4 bytes each) and decoded text of a piece without blanks."""
        if self.short and (simpler := simpler_pieces(piece)) is not None:
            found = [self.pieces[x] for x in simpler]
            return found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), " ".join([x[1] for x in found]))
        ids: list[int] = []
        if self.short and is_word(piece):
            ids = self.word(byte_alphabet(piece))
        else:
            for part in self.parts.split(piece) if self.special else (piece,):
                if part in self.special:
                    ids.append(self.special[part])
                elif part:
                    for word, _ in self.split(self.normalize(part)):
                        ids += self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.text_of_id.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        if not self.short:
            return self.piece(text)
        found = [*map(self.pieces.__getitem__, text.replace("\n", " ").split(" "))]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])


@lru_cache(maxsize=4)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)


def bpe_encode_decode(docs: DataFrame, file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``ids`` (binary, little-endian unsigned 32 bits each) and ``decoded`` per row of ``docs``.

    ``file`` is a tokenizer file with a byte-level pre-tokenizer and without a
    decoder, so tokens decode joined by blanks.  One that lower-cases, drops
    white space and splits letters from marks is coded piece by piece
    (:func:`takes_short_ways`), any other text by text.  A NULL or empty text
    gives no ids and an empty string; very long texts are coded whole; repeated
    rows give repeated results; an empty table gives no rows; other columns,
    also of clashing names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(file)
        for batch in batches:
            keys, texts, begin, ids, decoded, size = batch.column(0), batch.column(1), 0, [], [], 0
            for i in range(len(texts)):
                text = texts[i].as_py()
                a, b = coder.encode(text)
                ids.append(a)
                decoded.append(b)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield _rows(keys.slice(begin, len(ids)), ids, decoded, names)
                    begin, ids, decoded, size = i + 1, [], [], 0
            if ids:
                yield _rows(keys.slice(begin, len(ids)), ids, decoded, names)

    rows = docs.select(F.col(id_column), text_of(text_column).alias("_text"))
    names = [id_column, "ids", "decoded"]
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids binary, decoded string")


def _rows(keys: pa.Array, ids: list[bytes], decoded: list[str], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names)
