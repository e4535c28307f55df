"""Operator 3: nearest neighbours by inner product, over a neighbour graph that NN-descent builds.

Vectors are the nodes. The graph begins with the nearest neighbours inside random blocks (rows that
fall on the same side of random hyperplanes, cut to a bounded size), several times over. Each round
of NN-descent then joins, for every node, its sampled neighbours and reverse neighbours with one
another, since neighbours of neighbours are likely neighbours: vectors come to a node by a Spark
join on the neighbour's id, the node's task scores all pairs of its members at once and gives each
member its best, and a merge by id keeps the ``degree`` best. Rounds end when few lists still change.

Queries walk the graph greedily, all of them at once: each keeps the best nodes found so far (its
beam) and in every round opens those not yet opened. What opens a node is again a join, of the
queries' vectors with the node's row, which holds the vectors of its neighbours, so that one row
moves for ``degree`` scores. A query that is itself a node starts at its own place, any other at
entry nodes. It ends when its beam holds nothing new.

Equal vectors are one node: a vector that a third of all rows share is a node like any other, and
answers list the smallest ids of its rows. Vectors travel as bytes: each is scaled by its own largest
component, kept in single precision, and carries that factor along. The scores returned are computed
on the original vectors in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Neighbours a node keeps, and members (neighbours and reverse neighbours) that a round joins at a node.
DEGREE, SAMPLE = 24, 16
#: Random blocks: how often, rows in one at most, and rows below which a table isn't dealt over several.
PASSES, BLOCK, ONE = 8, 8192, 256
#: Rounds of NN-descent end when no more than this share of list entries changes.
STILL = 0.02
#: Nodes that a query's beam keeps, and nodes it opens in a round; rounds go on until every beam is opened.
BEAM, OPEN = 192, 96
#: Entry nodes for queries that are not nodes.
ENTRIES = 64


def _matrix(cells) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that travel as bytes: rows of a float32 matrix, their largest components 1, and the factors that they were divided by."""
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
    return np.ascontiguousarray(raw[:, 8:]).view(np.float32), np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0]


def _packed(x: np.ndarray, top: float) -> bytes:
    """The factor (the vector's largest component over ``top``, the table's) and the vector without it."""
    largest = float(np.abs(x).max())
    return np.float64(largest / top).tobytes() + (x / largest).astype(np.float32).tobytes()


def usable(rows: DataFrame, vec: str, id_: str) -> DataFrame:
    """``id, v`` of the rows that take part.

    Null and zero vectors, vectors that hold a null, NaN or infinity, and rows with a null id take no part.
    """
    good = rows.where(F.col(id_).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return good.where(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"))


def nodes_of(rows: DataFrame, vec: str, id_: str, keep: int, top: float = 1.0) -> DataFrame:
    """One row for each different usable vector: node (its least id), ``vec`` (its bytes, see :func:`_packed`), exact, ``ids`` (the ``keep`` least ids)."""
    good = usable(rows, vec, id_)
    # The least ids of a hot vector: first those of each hash part, then of all, so no task holds a third of the rows.
    part = good.distinct().groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    whole = part.groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = [np.asarray(x, np.float64) for x in batch["v"]]
            yield pd.DataFrame({"node": [x[0] for x in batch["ids"]], "vec": [_packed(x, top) for x in v], "exact": [x.tobytes() for x in v], "ids": batch["ids"]})

    return whole.mapInPandas(pack, "node long, vec binary, exact binary, ids array<long>")


def best_of(found: DataFrame, k: int, parts: int) -> DataFrame:
    """From pairs ``(node, near, score, new)``, repeated ones too: each node's ``k`` best neighbours as a row ``node, near, scores, new``.

    ``new`` is 1 for entries that no pair with 0 (an entry of the last round's list) repeats.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            # The last node may go on in the next batch.
            last = batch["node"].iloc[-1]
            cut_at = int(np.searchsorted(batch["node"].to_numpy(), last))
            held, batch = batch.iloc[cut_at:], batch.iloc[:cut_at]
            if len(batch):
                yield kept(batch)
        if held is not None and len(held):
            yield kept(held)

    def kept(batch: pd.DataFrame) -> pd.DataFrame:
        node, near, score, new = (batch[c].to_numpy() for c in ("node", "near", "score", "new"))
        order = np.lexsort((new, near, node))
        node, near, score, new = node[order], near[order], score[order], new[order]
        first = np.concatenate(([True], (node[1:] != node[:-1]) | (near[1:] != near[:-1])))
        node, near, score, new = node[first], near[first], score[first], new[first]
        order = np.lexsort((near, -score, node))
        node, near, score, new = node[order], near[order], score[order], new[order]
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        keep = rank < k
        node, near, score, new = node[keep], near[keep], score[keep], new[keep]
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        ends = np.append(starts[1:], len(node))
        pairs = list(zip(starts.tolist(), ends.tolist(), strict=True))
        return pd.DataFrame({"node": node[starts], "near": [near[a:b] for a, b in pairs], "scores": [score[a:b] for a, b in pairs], "new": [new[a:b] for a, b in pairs]})

    sorted_ = found.select("node", "near", "score", "new").repartition(parts, "node").sortWithinPartitions("node")
    return sorted_.mapInPandas(merge, "node long, near array<long>, scores array<double>, new array<int>")


def _pairs(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode(F.arrays_zip("near", "scores", "new")).alias("x")).select("node", F.col("x.near").alias("near"), F.col("x.scores").alias("score"), F.lit(0).alias("new"))


def block_pairs(nodes: DataFrame, n: int, numbers: int, k: int, block: int) -> DataFrame:
    """Each node's nearest in ``numbers`` random blocks: blocks are what hyperplanes leave together, cut by a hash to a bounded size.

    All dealings go through one plan, told apart by their number: the driver plans, broadcasts and tracks one job whatever their count.
    """
    planes = int(np.ceil(np.log2(n / (block / 2)))) if n > block else 0

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, _ = _matrix(batch["vec"].tolist())
            for number in range(numbers):
                normal = np.random.default_rng(7000 + number).standard_normal((x.shape[1], max(planes, 1))).astype(np.float32)
                code = ((x @ normal > 0)[:, :planes] @ (1 << np.arange(planes, dtype=np.int64))) if planes else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"number": np.full(len(x), number, np.int32), "side": code, "node": batch["node"], "vec": batch["vec"]})

    coded = nodes.select("node", "vec").mapInPandas(sides, "number int, side long, node long, vec binary")
    sizes = coded.groupBy("number", "side").agg(F.ceil(F.count("*") / block).alias("pieces"))  # at most n / (block / 2) rows a number
    coded = coded.join(sizes, ["number", "side"]).withColumn("piece", F.pmod(F.xxhash64("node", "number"), "pieces"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        (x, factor), ids = _matrix(pdf["vec"].tolist()), pdf["node"].to_numpy()
        out = []
        m = min(k, len(ids) - 1)
        if m <= 0:
            return pd.DataFrame({"node": [], "near": [], "score": [], "new": []})
        for a in range(0, len(ids), 512):
            score = (x[a : a + 512] @ x.T) * factor  # without the node's own factor, which orders nothing
            rows = np.arange(len(score))
            score[rows, a + rows] = -np.inf
            top = np.argpartition(-score, m - 1, axis=1)[:, :m]
            out.append((np.repeat(ids[a : a + 512], m), ids[top].ravel(), np.take_along_axis(score, top, 1).ravel()))
        node, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"node": node, "near": near, "score": score, "new": np.ones(len(node), np.int32)})

    return coded.groupBy("number", "side", "piece").applyInPandas(nearest, "node long, near long, score double, new int")


def descend(nodes: DataFrame, graph: DataFrame, degree: int, sample: int, number: int) -> DataFrame:
    """Candidates ``(node, near, score, new)`` of one round: every node's sampled members, scored against one another."""
    edges = graph.select("node", F.explode(F.arrays_zip("near", "new")).alias("x")).select("node", F.col("x.near").alias("near"), F.col("x.new").alias("new"))
    both = edges.unionByName(edges.select(F.col("near").alias("node"), F.col("node").alias("near"), "new"))
    # New entries first, then by a hash: what a node of a great many reverse neighbours leaves out comes up in other rounds.
    order = F.struct((1 - F.col("new")).alias("old"), F.xxhash64("node", "near", F.lit(number)).alias("h"), "near")
    part = F.pmod(F.xxhash64("near", F.lit(number)), F.lit(8))
    some = both.groupBy("node", part.alias("part")).agg(F.slice(F.sort_array(F.collect_set(order)), 1, sample).alias("m"))
    members = some.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("m"))), 1, sample).alias("m"))
    members = members.select("node", F.explode("m").alias("m")).select("node", F.col("m.near").alias("near"), (1 - F.col("m.old")).alias("new"))
    met = members.join(nodes.select(F.col("node").alias("near"), "vec"), "near")
    rows = met.groupBy("node").agg(F.collect_list(F.struct("near", "new", "vec")).alias("m"))  # at most ``sample`` members
    rows = rows.select("m.near", "m.new", "m.vec")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for near, new, vec in zip(batch["near"], batch["new"], batch["vec"], strict=True):
                near, new = np.asarray(near), np.asarray(new, bool)
                if len(near) < 2 or not new.any():
                    continue
                x, factor = _matrix(list(vec))
                score = (x @ x.T) * factor
                np.fill_diagonal(score, -np.inf)
                score[np.ix_(~new, ~new)] = -np.inf  # two old members have met before
                one, other = np.nonzero(np.isfinite(score))
                out.append((near[one], near[other], score[one, other]))
            if out:
                node, near, value = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"node": node, "near": near, "score": value, "new": np.ones(len(node), np.int32)})

    return rows.mapInPandas(join, "node long, near long, score double, new int")


def build_graph(nodes: DataFrame, degree: int = DEGREE, sample: int = SAMPLE) -> DataFrame:
    """The neighbour graph: ``node, near, scores, new``, neighbours from the nearest on. Each round is a written table."""
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000 + 1)
    # Small tables are dealt over some four blocks too.
    block = min(BLOCK, max(ONE, -(-n // 4)))
    found = block_pairs(nodes, n, PASSES if n > block else 1, degree, block)
    graph = cut(best_of(found, degree, parts), "ann-graph")
    for number in itertools.count():
        more = descend(nodes, graph, degree, sample, number).unionByName(_pairs(graph))
        new = cut(best_of(more, degree, parts), "ann-graph")
        forget(graph)
        graph = new
        changed = graph.agg(F.sum(F.aggregate("new", F.lit(0), lambda a, x: a + x)).alias("c")).first()["c"] or 0
        if changed <= STILL * degree * n:
            break
    return graph


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, opened: int = OPEN) -> DataFrame:
    """Greedy search for all queries ``(query, vec, start)``: ``query, node, score`` of the beam each ends with.

    ``start`` is the node a query begins at, or null for the entry nodes (the ``ENTRIES`` nodes of least hash).
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = graph.select("node", F.explode("near").alias("near")).join(nodes.select(F.col("node").alias("near"), "vec"), "near")
    around = cut(edges.groupBy("node").agg(F.collect_list("near").alias("near"), F.collect_list("vec").alias("vecs")).repartition(parts, "node"), "ann-around")  # ``degree`` neighbours
    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    entries = entries.agg(F.collect_list("node").alias("nodes"))
    begin = queries.where("start is not null").select("query", "vec", F.array("start").alias("nodes"))
    begin = begin.unionByName(queries.where("start is null").select("query", "vec").join(F.broadcast(entries)).select("query", "vec", "nodes"))
    # A query's state: its vector, and its beam with the marks of what it opened.
    state = begin.select("query", "vec", "nodes", F.expr("transform(nodes, x -> double(0))").alias("scores"), F.expr("transform(nodes, x -> 0)").alias("done"), F.col("nodes").alias("open"))
    state = cut(state, "ann-state")
    while True:
        front = state.where(F.size("open") > 0).select("query", "vec", F.explode("open").alias("node"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out_n, out_s = [], []
                for vec, near, vecs in zip(batch["vec"], batch["near"], batch["vecs"], strict=True):
                    (x, factor), (q, _) = _matrix(list(vecs)), _matrix([vec])
                    value = (x @ q[0]) * factor
                    out_n.append(np.asarray(near))
                    out_s.append(value)
                yield pd.DataFrame({"query": batch["query"], "near": out_n, "value": out_s})

        got = front.join(around, "node").mapInPandas(score, "query long, near array<long>, value array<double>")
        got = got.groupBy("query").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("value")).alias("value"))  # opened * degree values

        def absorb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cols = {c: [] for c in ("nodes", "scores", "done", "open")}
                for nodes_, scores, done, open_, near, value in zip(*(batch[c] for c in ("nodes", "scores", "done", "open", "near", "value")), strict=True):
                    nodes_, scores, done = np.asarray(nodes_, np.int64), np.asarray(scores, np.float64), np.asarray(done, np.int64)
                    done = done | np.isin(nodes_, np.asarray(open_, np.int64))
                    if near is not None and len(near):
                        near, at = np.unique(np.asarray(near, np.int64), return_index=True)
                        value = np.asarray(value, np.float64)[at]
                        fresh = ~np.isin(near, nodes_)
                        # A node of the beam may get its score here (a starting node has none before).
                        where = np.searchsorted(near, nodes_).clip(0, len(near) - 1)
                        scores = np.where(near[where] == nodes_, value[where], scores)
                        nodes_, scores = np.concatenate((nodes_, near[fresh])), np.concatenate((scores, value[fresh]))
                        done = np.concatenate((done, np.zeros(int(fresh.sum()), np.int64)))
                    order = np.lexsort((nodes_, -scores))[:beam]
                    nodes_, scores, done = nodes_[order], scores[order], done[order]
                    cols["nodes"].append(nodes_)
                    cols["scores"].append(scores)
                    cols["done"].append(done.astype(np.int32))
                    cols["open"].append(nodes_[done == 0][:opened])
                yield pd.DataFrame({"query": batch["query"], "vec": batch["vec"]} | cols)

        new = state.join(got, "query", "left").mapInPandas(absorb, "query long, vec binary, nodes array<long>, scores array<double>, done array<int>, open array<long>")
        new = cut(new, "ann-state")
        forget(state)
        state = new
        if state.where(F.size("open") > 0).isEmpty():
            break
    return state.select("query", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("query", F.col("x.nodes").alias("node"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """The ``k`` rows of largest inner product found for each query row, itself left out: query_id, rank, vec_id, score.

    ``queries`` is a selection of ``rows``. Ties go to the smaller id. Rows that take no part (see
    :func:`nodes_of`, and those whose length isn't the most frequent) neither ask nor answer; with fewer candidates than ``k`` all that are found
    are returned. Rows repeated with an equal id and vector count once.
    """
    sizes = rows.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    same = F.size(vec) == (sizes["dim"] if sizes else 0)
    rows, queries = rows.where(same), queries.where(same)
    # All factors within 1.
    top = usable(rows, vec, id_).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 1.0
    nodes = cut(nodes_of(rows, vec, id_, k + 1, top), "ann-nodes")
    graph = build_graph(nodes)
    ask = nodes_of(queries, vec, id_, 1, top).select("vec", "exact").join(nodes.select(F.col("node"), F.col("exact").alias("e")), F.col("exact") == F.col("e"))
    ask = cut(ask.select(F.col("node").alias("query"), "vec", F.col("node").alias("start"), "exact"), "ann-queries")
    found = search_graph(nodes, graph, ask.select("query", "vec", "start"))
    found = found.unionByName(ask.select("query", F.col("query").alias("node"))).distinct()
    # Exact scores on the original vectors, then the smallest ids of each node.
    both = found.join(nodes.select("node", F.col("exact").alias("there"), "ids"), "node").join(ask.select("query", F.col("exact").alias("here")), "query")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = [float(np.dot(np.frombuffer(a), np.frombuffer(b))) for a, b in zip(batch["here"], batch["there"], strict=True)]
            yield pd.DataFrame({"query": batch["query"], "score": score, "ids": batch["ids"]})

    scored = both.select("query", "here", "there", "ids").mapInPandas(exact, "query long, score double, ids array<long>")
    lists = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    order = F.struct((-F.col("score")).alias("s"), "vec_id")
    lists = lists.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k + 1).alias("best"))  # a beam's nodes, k + 1 ids each at most
    # Every query row with the node's vector gets its list, without itself.
    good = _exact_rows(queries, vec, id_).join(ask.select("query", "exact"), "exact")
    out = good.join(lists, "query").select(F.col("id").alias("query_id"), F.expr(f"slice(filter(best, x -> x.vec_id <> id), 1, {k})").alias("best"))
    return out.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def _exact_rows(rows: DataFrame, vec: str, id_: str) -> DataFrame:
    good = usable(rows, vec, id_).distinct()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "exact": [np.asarray(x, np.float64).tobytes() for x in batch["v"]]})

    return good.mapInPandas(pack, "id long, exact binary")
