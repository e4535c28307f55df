"""Operator 11 against a plain Lloyd in Python integers."""

import math

import numpy as np
import pytest

from teachspark.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """vec_id, label -> codes and errors by full rescans; rows of one length."""
    kept = sorted((i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    at = lloyd.borders(len(kept[0][1]), parts)
    cuts = [[v[at[p] : at[p + 1]] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cuts[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (d(c[p], books[p][e]), e)) for p in range(parts)] for c in cuts]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if mine := [c[p] for c, code in zip(cuts, codes, strict=True) if code[p] == e]:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    errors = [sum(d(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cuts, codes, strict=True)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    mark = lloyd.digest([np.array(b).reshape(len(b), -1) for b in books])
    return sorted((i, "".join(f"{c:02x}" for c in code), e, by_label[label], mark) for (i, _, label), code, e in zip(kept, codes, errors, strict=True))


def got(df, **kw):
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in lloyd.compress(df, **kw).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(9, 10))
    out = [(int(i), [float(np.float32(x)) for x in centres[i % 9] + rng.normal(scale=0.02 if i % 3 else 0.4, size=10)], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    out += [(9000 + i, [0.5] * 10, 1) for i in range(200)]  # a third are one vector
    return out


def test_equals_plain_lloyd(spark, rows):
    bad = [(5000, None, 1), (5001, [1.0, None] * 5, 1), (5002, [math.nan] + [0.0] * 9, 2), (5003, [math.inf] * 10, 2)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    assert got(df, entries=16) == plain(rows, entries=16)
    assert got(df) == plain(rows)


def test_active_entries_give_what_rescans_give():
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 6, (500, 3))  # many ties
    book = x[:20].copy()
    code, dist = lloyd.assign(x, book, np.ones(20, bool), None, None)
    for _ in range(6):
        new = book.copy()
        some = rng.random(20) < 0.3
        new[some] += rng.integers(-2, 3, (int(some.sum()), 3))
        moved = (new != book).any(1)
        code, dist = lloyd.assign(x, new, moved, code, dist)
        full = lloyd.assign(x, new, np.ones(20, bool), None, None)
        assert (code == full[0]).all() and (dist == full[1]).all()
        book = new


def test_distances_are_exact_for_large_integers():
    x = lloyd.integers(np.array([1e30, -1e30, 3.0e5, 0.1]), 4)
    d = lloyd.distances(x[None], -x[None])[0, 0]
    assert d == sum((2 * int(v)) ** 2 for v in x) and 0 < d < 2**63


def test_edges(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [0.0, -0.1, 3e38, 4.0, 5.0], None), (None, [9.0, 2.0, 3.0, 4.0, 5.0], None)]
    out = lloyd.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 4 and all(r["error"] == 0 for r in out)  # each is its own entry
    codes = {r["vec_id"]: r["code"] for r in out}
    assert codes[1] == "00000000" and codes[2] == "02020000"
    mixed = [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [], 1), (4, [2.0] * 4, 1)]
    out = {r["vec_id"]: r for r in lloyd.compress(spark.createDataFrame(mixed, SCHEMA)).collect()}
    assert out[4]["code"] == "01010101" and out[2]["code"] == out[3]["code"] == "00000000"
    assert out[1]["codebooks_sha256"] == out[4]["codebooks_sha256"] != out[2]["codebooks_sha256"]


def test_other_columns_pass(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [1.0] * 4, 1), (2, [3.0] * 4, 1)], SCHEMA)
    for c in ("code", "dist", "x", "part", "error", "length", "sums"):
        df = df.withColumn(c, F.lit("own"))
    assert len(got(df)) == 2
