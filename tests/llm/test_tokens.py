"""Operators 4 and 5 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from teachspark.llm import bytebpe
from teachspark.llm.bytebpe import Automaton, Tables, count_symbols, count_tokens, encode_texts, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return Tables(PATH)


@pytest.fixture(scope="module")
def automaton(tables):
    return Automaton(tables)


def texts():
    random.seed(4)
    letters = [chr(c) for c in [*range(0x250), 0x300, 0x3B1, 0x4E2D, 0x5D0, 0x661, 0x2160, 0x2009, 0x3000, 0xFEFF, 0x1F600, 0x10FFFF, 0x1C89, 0x1246F]]
    yield from ["", " ", "a", "\n\n  x  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "don't we'll I'M", "a" * 999, "ab" * 700, " " * 77 + "x", "½²³ 12٣"]
    for _ in range(300):
        yield "".join(random.choice(letters) for _ in range(random.randint(1, 50)))
    for _ in range(300):
        yield "".join(random.choice("abcdeinorst  '.ABC12\n") for _ in range(random.randint(1, 90)))


def test_ids_counts_and_text_equal_the_library(library, tables, automaton):
    split = splitter(tables.specials, tables.newer)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        pieces = list(split(text))
        words = sorted({w for p in pieces if isinstance(p, list) for w in p})
        data = [w.encode() for w in words]
        ids = dict(zip(words, automaton.encode(data), strict=True))
        counts = dict(zip(words, count_symbols(tables, data).tolist() if data else [], strict=True))
        got = b"".join(b"".join(ids[w] for w in p) if isinstance(p, list) else p.to_bytes(4, "little") for p in pieces)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert sum(sum(counts[w] for w in p) if isinstance(p, list) else 1 for p in pieces) == len(want)
        assert automaton.decode(got) == library.decode(want, skip_special_tokens=False)


def test_gadgets_by_brute_force(tmp_path):
    """Every word over three letters, with merges that overlap and repeat a symbol."""
    import itertools
    import json

    letters = {b: c for c, b in bytebpe.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ab"), ("c", "aa"), ("aa", "aa"), ("b", "c"), ("ab", "c")]
    for i, (x, y) in enumerate(merges):
        vocab[x + y] = 256 + i
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [f"{x} {y}" for x, y in merges]}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    library, tables = Tokenizer.from_file(str(path)), Tables(str(path))
    words = ["".join(w) for n in range(1, 9) for w in itertools.product("abc", repeat=n)]
    data = [w.encode() for w in words]
    want = [library.encode(w).ids for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in Automaton(tables).encode(data)] == want
    assert count_symbols(tables, data).tolist() == [len(x) for x in want]


def test_long_texts_are_cut_where_a_token_ends(library, tables, monkeypatch):
    monkeypatch.setattr(bytebpe, "SLICE", 7)
    split = splitter(tables.specials, tables.newer)
    for text in ["one two  three\n\n four <|endoftext|> five " * 5, "x" * 60, " a" * 40, "  \n  \n" * 20]:
        words = [w for p in split(text) if isinstance(p, list) for w in p]
        want = [text[a:b] for part in [text] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(part)] if "<|" not in text else None
        assert want is None or words == want
        assert "".join(words) == text.replace("<|endoftext|>", "")


def test_small_memory_gives_the_same(spark, monkeypatch, library):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    rows = [(i, t) for i, t in enumerate(["one two three four five six", "two three", "seven eight nine ten"])]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {i: len(library.encode(t).ids) for i, t in rows}


def test_edges(spark, edge_docs, no_docs, library):
    want = sorted((r.doc_id or 0, len(ids := library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.collect())
    counted = count_tokens(spark, edge_docs, PATH)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted.collect()) == [x[:2] for x in want]
    encoded = encode_texts(spark, edge_docs, PATH)
    assert sorted((r.doc_id or 0, r.bpe.n_tokens, r.bpe.ids_sha256, r.bpe.decoded_sha256) for r in encoded.collect()) == want
    assert all(len(r.bpe.ids) == 4 * r.bpe.n_tokens for r in encoded.collect())
    assert count_tokens(spark, no_docs, PATH).count() == 0 and encode_texts(spark, no_docs, PATH).count() == 0
