"""Operator 13 against a plain trie in Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from teachspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = [f.split()[0] for f in pt.OUT.split(", ")]


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            tie = hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).digest()[:16]
            convs.setdefault(c, []).append(((turn is not None, turn or 0, key[0], tie), key))
    convs = {c: [k for _, k in sorted(v)] for c, v in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    import re

    out = set()
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = {p for p in under if len(p) == len(path) + 1}
        leaves = sum(1 for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under))
        saved = sum((len(members[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c, end in sorted(own) if end)
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        out.add((min(c for c, _ in own), len(path), parent, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in pt.prefix_trie(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    random.seed(13)
    out = []
    for c in range(-30, 130):
        if c % 20 == 0 and c in (60, 100):
            continue  # an absent base
        for turn in range(random.choice([0, 1, 2, 4, 6])):
            out.append((c, turn, random.choice(["user", "assistant"]), random.choice(["a b", "c", "", "d\te f"])))
    for c in range(8200, 8300):  # a third are copies of one conversation, over two runs of ids
        out += [(c, t, "user", f"hello there {t}") for t in range(4)]
    out += [(500, None, None, None), (500, 3, "x", None), (500, None, "x", "null turn first"), (501, 1, "x", "y"), (501, 1, "x", "y"), (501, 1, "w", "y"), (None, 1, "user", "of no conversation")]
    return out


def test_equals_plain_trie(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_top_nodes_and_many_runs_change_nothing(spark, rows, monkeypatch):
    for name, value in (("LEAST", 3), ("PIECES", 10**9), ("RUN", 7), ("BATCH", 5)):
        monkeypatch.setattr(pt, name, value)
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
        table = pt.Slots(keys)
        assert sorted(table.find(keys).tolist()) == list(range(n))
        assert (table.find(rng.integers(0, 2**63, (500, 2)).astype(np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        pt.Slots(np.zeros((2, 2), np.uint64))


def test_edges(spark):
    from pyspark.sql import functions as F

    assert got(spark.createDataFrame([], SCHEMA)) == set()
    one = [(21, 0, "user", "w " * 100_000)]
    df = spark.createDataFrame(one, SCHEMA)
    for c in ("node", "parent", "words", "depth", "root", "base", "n", "ends"):
        df = df.withColumn(c, F.lit("own"))
    assert got(df) == plain(one)
