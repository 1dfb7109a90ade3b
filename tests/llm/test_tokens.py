"""Encoding, counting and token files against the tokenizers library itself."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ODD, SF
from tokenizers import Tokenizer

from turnlake.llm import bpe, counts, queries, token_files

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return {f: Tokenizer.from_file(f) for f in (WORD, BYTE)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in ODD], "doc_id long, text string, n_tokens int, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_segment_tree_equals_repeated_scans():
    rng = random.Random(5)
    for _ in range(400):
        ranks, made = {}, []
        for i in range(rng.randrange(1, 12)):
            pair = (rng.randrange(4 + i), rng.randrange(4 + i))
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(4 + len(made))
        ids = [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        want = list(ids)
        while True:
            found = [(ranks[p], k) for k, p in enumerate(zip(want, want[1:])) if p in ranks]
            if not found:
                break
            rank, k = min(found)
            want[k : k + 2] = [made[rank]]
        assert bpe.merge(ids, {a << 32 | b: r for (a, b), r in ranks.items()}, made) == want


def test_bpe_equals_the_library(odd, library):
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.bpe_encode_decode(odd, WORD).collect())
    want = Counter()
    for i, text in ODD:
        ids = library[WORD].encode(text or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library[WORD].decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_query(spark, library, documents):
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = library[WORD].encode(documents[r["doc_id"]], add_special_tokens=False).ids
        decoded = library[WORD].decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()))


def test_counts_equal_the_library(odd, library):
    got = Counter(tuple(r) for r in counts.token_counts(odd, BYTE, limit=100).collect())
    want = Counter()
    for i, text in ODD:
        n = len(library[BYTE].encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 100] += 1
    assert got == want


def test_counts_in_many_blocks(odd, library, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK_DOCS", 2)
    test_counts_equal_the_library(odd, library)


def test_counts_query(spark, library, documents):
    rows = queries.op4_token_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n = len(library[BYTE].encode(documents[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), n, n > 1024)


def test_token_files_query(spark, library, documents):
    rows = {r["doc_id"]: r for r in queries.op9_token_files(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    start = 0
    for i in sorted(documents):
        ids = [*library[WORD].encode(documents[i], add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(odd, library, monkeypatch):
    manifest = token_files.write_token_files(odd, WORD, 2)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_token_files(manifest).collect()))
    start, want = 0, []
    for i, text in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*library[WORD].encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, i, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    data = [bytes([i]) * n for i, n in enumerate((4, 60, 300, 0, 8, 64))]
    path = str(tmp_path / "shard.zst")
    with fs.LocalFileSystem().open_output_stream(path, compression=None) as out:
        writer = token_files.ShardWriter(out)
        for i, d in enumerate(data):
            writer.add(i, d)
        writer.close()
    with fs.LocalFileSystem().open_input_file(path) as source:
        reader = token_files.ShardReader(source)
        assert [reader.document(k) for k in (5, 2, 0, 1, 3, 4)] == [data[k] for k in (5, 2, 0, 1, 3, 4)]
        assert len(reader.frames) > 5
        reader.last, asked = (-1, b""), []
        frame = reader.frame
        monkeypatch.setattr(reader, "frame", lambda i: asked.append(i) or frame(i))
        reader.document(4)
        assert len(asked) == 1
    # A plain reader of zstandard skips index and seek table.
    import zstandard

    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(data)
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 1
    open(path, "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(path) as source, pytest.raises(Exception):  # noqa: B017, PT011  damaged data or checksum
        token_files.ShardReader(source).document(0)


def test_empty_tables(empty):
    assert bpe.bpe_encode_decode(empty, WORD).count() == 0
    assert counts.token_counts(empty, BYTE).count() == 0
    manifest = token_files.write_token_files(empty, WORD, 2)
    assert manifest.count() == 0
    assert token_files.read_token_files(manifest).count() == 0


def both_ways(texts):
    """Ids by the tree's encoder and by that of the token files."""
    coder, pieces = bpe.word_bpe(WORD), token_files.encoder(WORD)
    for text in texts:
        yield text, coder.encode(text)[0], b"".join(pieces[x] for x in text.replace("\n", " ").split(" "))


def test_every_letter_with_marks(library):
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    texts = [t.format(x) for x in letters for t in ("{}.", "{},", "a{}.", "{0}{0},", "{}a.", "A.{}.", "{}.,", "{}'s.", "{}\u0301.")]
    texts += ["A.İ.", "İSTANBUL, İ,", "i̇. İ.İ, \u0130. DİYARBAKIR\u0130."]
    for text, tree, files in both_ways(texts):
        want = np.array(library[WORD].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tree == files == want, text


def test_random_texts_of_odd_characters(library):
    rng = random.Random(11)
    odd = [*"abzAZİıßéÉ.,'!?-_0 9\n\t", "e\u0301", "\u0307", "\u00a0", "ǅ", "ŉ", "ﬁ", "日", "😀", "<|endoftext|>", "<|", "'s", "'LL", "\u2003"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(1, 12))) for _ in range(100_000)]
    wanted = library[WORD].encode_batch(texts, add_special_tokens=False)
    for (text, tree, files), want in zip(both_ways(texts), wanted, strict=True):
        assert tree == files == np.array(want.ids, "<u4").tobytes(), text


def test_files_that_keep_case_or_blanks_are_coded_as_they_state(spark, tmp_path):
    import json

    spec = json.loads(open(WORD).read())
    spec["normalizer"]["normalizers"].pop()  # keeps case
    path = str(tmp_path / "cased.json")
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    library = Tokenizer.from_file(path)
    assert bpe.takes_short_ways(WORD) and not bpe.takes_short_ways(path)
    texts = ["Hello, World. İ.", "a  b\nC", "", "x<|endoftext|>Y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.ids) for r in bpe.bpe_encode_decode(docs, path).collect()} == want
    read = token_files.read_token_files(token_files.write_token_files(docs, path, end_id=2)).collect()
    assert {r.doc_id: bytes(r.ids)[:-4] for r in read} == want
