"""Operator 12 against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from teachspark.llm import duckbpe
from teachspark.llm.bytebpe import splitter, unassigned_letters

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return duckbpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def worker(ranks):
    return duckbpe.Contractor(duckbpe.Ranks(ranks))


def encoded(worker, text):
    words = [w for piece in splitter({}, unassigned_letters())(text) for w in piece]
    return [int(i) for a in worker.encode([w.encode() for w in words]) for i in a[1].split()]


def test_texts_equal_the_library(worker, library):
    random.seed(12)
    letters = [chr(c) for c in [*range(0x250), 0x300, 0x3B1, 0x4E2D, 0x5D0, 0x661, 0x2160, 0x2009, 0x3000, 0xFEFF, 0x1F600, 0x10FFFF, 0x1C89, 0x3FF00]]
    texts = ["", " ", "\n\n  x  ", "a<|endoftext|> b", "don't we'll I'M", "a" * 999, " " * 77 + "x", "½²³ 12٣", "xxxx xxxxx"]
    texts += ["".join(random.choice(letters) for _ in range(60)) for _ in range(200)]
    texts += ["".join(random.choice("abcdeinorst  '.ABC12\n") for _ in range(90)) for _ in range(200)]
    texts.append("".join(f"a{c}1{c} {c}'s{c}'ll " for c in map(chr, range(0x3FF00, 0x40000))))
    for text in texts:
        assert encoded(worker, text) == library.encode_ordinary(text), text


def test_long_words_by_stretches_equal_the_library(worker, library):
    random.seed(13)
    words = [b"x" * n for n in (127, 128, 129, 130, 1000, 5001)] + ["the" * 500, "yxxxxxxxxx" * 90, "日本" * 300, "-=" * 900, "y" + "x" * 400 + "zx"]
    words += ["".join(random.choice(some) for _ in range(random.randint(129, 1500))) for some in ("ab", "etaoinshrdlu", "xyxxx") for _ in range(12)]
    words = [w if isinstance(w, bytes) else w.encode() for w in words]
    for w, (n, ids, text) in zip(words, worker.encode(words), strict=True):
        assert [int(i) for i in ids.split()] == library._encode_single_piece(w) and text == w and n == len(ids.split())


def test_a_token_that_no_merge_makes_stays_whole(tmp_path):
    """The library takes a word that is a token as it is, even where merges lead elsewhere."""
    table = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"xyz": 261}
    library = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})
    worker = duckbpe.Contractor(duckbpe.Ranks(table))
    words = ["xyz", "xyzx", "abcd", "abc", "abcabcd", "bcd", "dcba", "cdcdab"]
    assert [[int(i) for i in a[1].split()] for a in worker.encode([w.encode() for w in words])] == [library.encode_ordinary(w) for w in words]


def test_ids_are_decoded(spark, worker, library, ranks):
    texts = ["some words, and more", "é日本 \U0001f600", ""]
    rows = [(i, library.encode_ordinary(t)) for i, t in enumerate(texts)] + [(3, None), (4, [5, None]), (5, [10**9])]
    out = {r["i"]: r["decoded"] for r in duckbpe.decode_ranks(spark, spark.createDataFrame(rows, "i int, ids array<long>"), PATH).collect()}
    assert [bytes(out[i]).decode() for i in range(3)] == texts and out[3] is out[4] is out[5] is None


def test_operator(spark, library, edge_docs, no_docs):
    out = duckbpe.encode_ranks(spark, edge_docs, PATH)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    for r in out.collect():
        ids = library.encode_ordinary(r["text"] or "")
        assert r["bpe"]["n_tokens"] == len(ids) and r["bpe"]["ids"] == ids
        assert r["bpe"]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["bpe"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert duckbpe.encode_ranks(spark, no_docs, PATH).count() == 0


def test_slices_and_memory_change_nothing(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: library.encode_ordinary(r["text"] or "") for r in docs.collect()}
    got = {r["doc_id"]: r["bpe"]["ids_sha256"] for r in duckbpe.encode_ranks(spark, docs, PATH, keep_ids=False).collect()}
    assert got == {k: hashlib.sha256(" ".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
    memory = duckbpe.Memory()
    monkeypatch.setattr(duckbpe, "REMEMBERED", 3)
    calls = []
    work = lambda words: calls.extend(words) or [len(w) for w in words]
    for words in ({"a", "b"}, {"c", "d"}, {"a"}, {"e", "f", "g" * 99}):
        assert memory.look_up(words, work) == {w: len(w) for w in words}
    assert calls.count(b"a") == 1
