"""Operator 3: recall against brute force, exact scores, equal vectors, edges."""

import numpy as np

from teachspark.llm import ann
from teachspark.llm.ann import nearest


def brute(ids, x, q, k):
    score = x @ x[q]
    keep = [i for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(((-score[i], ids[i]) for i in keep))[:k]


def test_recall_with_rounds(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "BEAM", 96)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((8, 24)), 150, axis=0) + rng.standard_normal((1200, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(rows, rows.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 1200, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v in brute(range(1200), x, q, 10)})
    assert hits / (10 * len(got)) >= 0.9


def test_equal_vectors_ties_and_edges(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.6, 0.8]
    rows = [(i, a) for i in range(10, 40)] + [(1, b), (2, c), (2, c), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, a), (8, [float("inf"), 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'own' as score", "'own' as node")
    got = {}
    for r in nearest(df, df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert set(got) == {1, 2, *range(10, 40)}
    assert got[10] == [(11, 1.0), (12, 1.0), (13, 1.0), (14, 1.0)] and got[12] == [(10, 1.0), (11, 1.0), (13, 1.0), (14, 1.0)]
    assert got[1] == [(2, 0.8), (10, 0.0), (11, 0.0), (12, 0.0)] and got[2] == [(1, 0.8), (10, 0.6), (11, 0.6), (12, 0.6)]
    few = df.where("vec_id in (1, 2)")
    assert [(r.query_id, r.vec_id) for r in nearest(few, few, 20).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert nearest(df.limit(0), df.limit(0), 5).count() == 0
    assert nearest(df, df.limit(0), 5).count() == 0


def test_recall_beside_an_outlier(spark, monkeypatch):
    """One row a hundred million times the others leaves their neighbours as they were."""
    monkeypatch.setattr(ann, "BLOCK", 256)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((8, 24)), 100, axis=0) + rng.standard_normal((800, 24))
    x[0] *= 1e8 / np.abs(x[0]).max()
    x[1, 0] = 1e-6
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(rows, rows.where("vec_id % 20 = 0 or vec_id = 1"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found & {v for _, v in brute(range(800), x, q, 10)}) for q, found in got.items())
    assert set(got) == {1, *range(0, 800, 20)} and hits / (10 * len(got)) >= 0.9


def test_small_tables_descend_until_lists_are_still(spark, monkeypatch):
    """Rounds go on while many entries change, however many that takes, and small tables have them too."""
    changes = []
    descend = ann.descend
    monkeypatch.setattr(ann, "PASSES", 2)
    monkeypatch.setattr(ann, "ONE", 16)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "descend", lambda *a: changes.append(a[-1]) or descend(*a))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 12))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graph = ann.build_graph(ann.nodes_of(rows, "embedding", "vec_id", 1), degree=8, sample=8)
    changed = sum(sum(r.new) for r in graph.collect())
    assert (changed <= ann.STILL * 8 * 600, len(changes) > 4) == (True, True), (changed, changes)


def test_all_dealings_are_one_plan(spark):
    """However many dealings: one grouped map, whose rows hold each dealing's neighbours."""
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 12)))], "vec_id long, embedding array<double>")
    nodes = ann.nodes_of(rows, "embedding", "vec_id", 1)
    pairs = ann.block_pairs(nodes, 600, 3, 4, 128)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    found = {}
    for r in pairs.collect():
        found.setdefault(r.node, []).append(r.near)
    assert len(found) == 600 and all(i not in near for i, near in found.items())
    assert sum(map(len, found.values())) > 0.9 * 600 * 3 * 4 and sum(len(set(near)) for near in found.values()) > 600 * 6
