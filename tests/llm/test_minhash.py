"""Operator 2 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from teachspark.llm import minhash
from teachspark.llm.minhash import Shingler, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else least[find(i)]
        out.append((d, len(sets[i]), c, d is None or c == d))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    common = " ".join(rng.choices(words, k=30))
    texts = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(20, 160))
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
            if rng.random() < 0.2:
                texts.append(f"{texts[-1].upper()}  ")
    texts += [f"{common} {' '.join(rng.choices(words, k=rng.randint(1, 12)))}" for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    rng.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)) == brute(rows, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_large_lists_around_hubs(spark, monkeypatch, n, percent):
    """Lists of any size are finished by differences from hubs, with families whose original is missing."""
    monkeypatch.setattr(minhash, "PAIRED_LIST", 0)
    rows = corpus(7, families=4, size=60)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent)) == brute(rows, n, percent)


def test_hubs_alone_would_not_do(spark):
    """A chain of texts, each linked to the next only, needs the exact last step."""
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(24)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == brute(rows, 3, 85)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(near_duplicates(edge_docs)) == brute(rows, 5, 80)
    assert near_duplicates(no_docs).count() == 0
    twice = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f g h i j k"), (2, "A  b C\td e f"), (5, "q"), (5, "q"), (4, "r"), (9, "")]
    assert result(near_duplicates(spark.createDataFrame(twice, "doc_id long, text string"))) == brute(twice, 5, 80)


def test_pieces_change_no_set(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "bb", "cc\t", "é", "\n", "Zed"], k=rng.randint(0, 4000))) for _ in range(6)]
    whole = [s.copy() for s in Shingler(3).sets(texts)]
    monkeypatch.setattr(minhash, "CHUNK", 1500)
    assert all(np.array_equal(a, b) for a, b in zip(whole, Shingler(3).sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts]


def test_words_across_the_borders_of_pieces(monkeypatch):
    """Texts over CHUNK with runs without white space: no word is cut, wherever the borders lie."""
    run = "aZ09+/" * (minhash.CHUNK // 4)
    texts = [run, f"one two {run} three four", f"{run} {run}x {run} end", f"{'w ' * (minhash.CHUNK // 2)}last {run}\n"]
    assert all(len(t) > minhash.CHUNK for t in texts)
    sets = [s.copy() for s in Shingler(3).sets(texts)]
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "Bc", "é", " ", "x" * 40, "y" * 9], k=rng.randint(0, 300))) for _ in range(40)]
    whole = [s.copy() for s in Shingler(3).sets(texts)]
    monkeypatch.setattr(minhash, "CHUNK", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, Shingler(3).sets(texts), strict=True))
