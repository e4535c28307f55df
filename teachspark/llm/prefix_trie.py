"""Operator 13: the trie of conversation prefixes, as node tables behind minimal perfect hashes.

A rebuilt conversation takes the first h turns of its base (the conversation with id ``c - c % FAMILY``), then
its own turns after its first h; h is the CRC-32 of the decimal id modulo ``HEADS``. Each distinct prefix of
rebuilt turns (role and text) is a node.

1. Turns become narrow rows (a digest of role and text, a word count), written to the shared folder;
   texts are read once. Sorted by base and conversation, a task streams them and emits one row per conversation
   and prefix: the chained 128-bit digest, its parent's, and how many turns follow.
2. Rows are counted by digest (a hot prefix is combined before the shuffle). ``below``, the turns that follow summed over
   a node's members, bounds the nodes under it. Nodes with more than ``limit`` of them are the *top*; there are at most
   rows / limit of those at each depth. All others hang below the topmost ancestor that is no top node, the *root of their subtree*,
   and subtrees are dealt to shards by that root.
3. A shard's distinct digests get the slots of a minimal perfect hash: levels of bits, a digest taking
   its bit if it is the only one to hash there, otherwise going on to the next level; a slot is the number of bits before it.
   Slots are verified against the digests kept in them. Counts are scattered into flat arrays by slot, parents are
   looked up as slots, and children, leaves and tokens accumulate through the parent slots, deepest nodes first.
4. The subtrees' sums are added by parent and run through the same arrays of the top nodes.

``ends_sha256`` hashes ids in their order: ids are joined to strings by (node, id // ``RUN``), at most RUN a string as
ids are unique, and the strings of a node are streamed in order.

Null roles and texts count as empty. Turns are ordered by turn (null first); equal turns by role, then by the
digest of the text, so repeated rows are turns one after the other. Rows without a conv_id belong to no conversation.
Without conversations there are no nodes. Very long texts are hashed
and counted where they lie. One conversation's turns are streamed by one task, not held. Other columns play no part.
A digest that stands for two different prefixes (of 128 bits, so not by chance) raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget

#: Conversations that share a base, and the modulus of the number of turns taken from it.
FAMILY, HEADS = 20, 4
#: Nodes below which a subtree is left whole at least, and how many parts of all rows the limit is otherwise.
LEAST, PIECES = 512, 20_000
#: Width of the id runs whose members are joined to one string.
RUN = 4096
#: Rows of one Arrow batch that a task sends back.
BATCH = 8192
#: Bits per digest and level of the minimal perfect hash.
GAMMA = 2.0
#: Fixed value: what a word is.
WORDS = r"[^\\x20\\x09-\\x0D]+"

ROOT = hashlib.sha256(b"").digest()[:16]


def turns_of(conversations: DataFrame) -> DataFrame:
    """Narrow rows: base, conv_id, turn, role, digest (16 bytes, of role and text), words, and ``n``, the conversation's turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).cast("long").alias("base"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.substring(F.unhex(F.sha2(spelled, 256)), 1, 16).alias("digest"),
        F.expr(f"regexp_count(coalesce(text, ''), '{WORDS}')").cast("long").alias("words"),
        (F.crc32(F.col("conv_id").cast("long").cast("string")) % HEADS).cast("int").alias("heads"),
    )
    return cut(rows, "trie-turns")


PATHS = "node binary, parent binary, depth long, conv_id long, words long, below long, root binary"


class _Path:
    """The prefixes of one conversation after the other, as rows."""

    def __init__(self, tops: frozenset[bytes]) -> None:
        self.tops, self.rows = tops, []

    def begin(self, conv: int, left: int) -> None:
        self.conv, self.depth, self.left, self.node, self.root = conv, 0, left, ROOT, None
        self._row(None, 0)

    def step(self, digest: bytes, words: int) -> None:
        parent, self.node = self.node, hashlib.sha256(self.node + digest).digest()[:16]
        self.depth, self.left = self.depth + 1, self.left - 1
        self._row(parent, words)

    def _row(self, parent: bytes | None, words: int) -> None:
        if self.root is None and self.node not in self.tops:
            self.root = self.node
        self.rows.append((self.node, parent, self.depth, self.conv, words, self.left, self.root))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PATHS.split(", ")])
        self.rows = []
        return out


def paths(turns: DataFrame, top: list[bytes] | None = None) -> DataFrame:
    """One row per conversation and prefix (depth 0 included). ``root``: the first prefix on the way that isn't in ``top``."""
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(top or ()))
    # clustering by base also clusters by (base, conv_id): one shuffle serves the count and the walk
    dealt = turns.repartition("base").withColumn("n", F.count("*").over(Window.partitionBy("base", "conv_id")))
    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = dealt.sortWithinPartitions(*order).select("base", "conv_id", "digest", "words", "heads", "n")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _Path(shared.value)
        base, head, conv, at = None, [], None, 0  # head: the base's first turns, which its family takes
        for rows in batches:
            for b, c, digest, words, heads, n in zip(*(rows.column(k).to_pylist() for k in range(6)), strict=True):
                if b != base:
                    base, head, conv = b, [], None
                if c != conv:
                    conv, at = c, 0
                    taken = [] if c == b else head[:heads]
                    path.begin(c, n if c == b else len(taken) + max(0, n - heads))
                    for turn in taken:
                        path.step(*turn)
                if c == b and at < HEADS - 1:
                    head.append((digest, words))
                if c == b or at >= heads:  # the base takes its first turns from itself
                    path.step(digest, words)
                at += 1
                if len(path.rows) >= BATCH:
                    yield path.batch()
        if path.rows:
            yield path.batch()

    return dealt.mapInArrow(walk, PATHS)


class Slots:
    """A minimal perfect hash over distinct 16-byte digests, with the digests kept to verify it."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys``: n rows of two unsigned 64-bit integers."""
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rest, taken = np.arange(len(keys)), 0
        slots = np.zeros(len(keys), np.int64)
        while len(rest):
            size = max(64, int(GAMMA * len(rest)))
            at = self._hash(keys[rest], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append(bits)
            self.before.append(taken + np.cumsum(bits) - bits)
            alone = bits[at]
            slots[rest[alone]] = self.before[-1][at[alone]]
            taken, rest = taken + int(bits.sum()), rest[~alone]
            if len(self.levels) > 200:
                raise ValueError("equal digests can't have slots of their own")
        self.keys = np.zeros_like(keys)
        self.keys[slots] = keys
        self.assigned = slots
        if not (self.find(keys) == slots).all() or taken != len(keys):
            raise ValueError("slots are not minimal and perfect")

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[:, 0] ^ (keys[:, 1] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 where the digest kept in the slot is another one."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = self._hash(keys[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = before[at[hit]]
            rest = rest[~hit]
        some = np.flatnonzero(out >= 0)
        out[some[(self.keys[out[some]] != keys[some]).any(1)]] = -1
        return out


def _keys(column: pd.Series) -> np.ndarray:
    """Digests as two unsigned 64-bit integers each; nulls become zeros."""
    return np.frombuffer(b"".join(x if isinstance(x, (bytes, bytearray)) else bytes(16) for x in column), np.uint64).reshape(-1, 2)


def accumulate(nodes: pd.DataFrame, extra: pd.DataFrame | None = None) -> pd.DataFrame:
    """Adds n_children, n_leaves, saved and parent_conv_id to nodes (node, parent, depth, conv_id, n_convs, words).

    ``extra``: what subtrees outside of these nodes add to a parent (parent, children, leaves, saved).
    A parent that isn't among the nodes leaves parent_conv_id null.
    """
    nodes = nodes.reset_index(drop=True)
    keys = _keys(nodes["node"])
    table = Slots(keys)
    slot, n = table.assigned, len(nodes)

    def scattered(column: pd.Series) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slot] = column.to_numpy(np.int64)
        return out

    depth, conv, convs, words = (scattered(nodes[c]) for c in ("depth", "conv_id", "n_convs", "words"))
    parent = np.full(n, -1, np.int64)
    parent[slot] = np.where(nodes["parent"].isna(), -1, table.find(_keys(nodes["parent"])))
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), (convs - 1) * words
    if extra is not None and len(extra):
        at = table.find(_keys(extra["parent"]))
        if (at < 0).any():
            raise ValueError("a subtree's parent is missing")
        for into, name in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
            np.add.at(into, at, extra[name].to_numpy(np.int64))
    order = np.argsort(depth, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(depth[order]) != 0))) if n else np.zeros(0, np.int64)
    for low, high in zip(starts[::-1].tolist(), np.append(starts[1:], n)[::-1].tolist(), strict=True):
        some = order[low:high]
        leaves[some[children[some] == 0]] = 1
        up = some[parent[some] >= 0]
        np.add.at(children, parent[up], 1)
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    nodes["n_children"], nodes["n_leaves"], nodes["saved"] = children[slot], leaves[slot], saved[slot]
    above = pd.array(conv[np.maximum(parent, 0)][slot], dtype="Int64") if n else pd.array([], dtype="Int64")
    above[parent[slot] < 0] = pd.NA
    nodes["parent_conv_id"] = above
    return nodes


FULL = "node binary, parent binary, depth long, conv_id long, n_convs long, words long, root binary, ends long, n_children long, n_leaves long, saved long, parent_conv_id long"
_ORDER = [f.split()[0] for f in FULL.split(", ")]


def _ends(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of its ids in order; ``ends``: distinct (node, conv_id)."""
    runs = (
        ends.groupBy("node", F.expr(f"floor(conv_id / cast({RUN} as decimal(20,0)))").cast("long").alias("run"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
        .repartition("node")
        .sortWithinPartitions("node", "run")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, hashlib.sha256(), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])
        for rows in batches:
            for x, ids in zip(rows.column("node").to_pylist(), rows.column("ids").to_pylist(), strict=True):
                if x != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= BATCH:
                yield batch()
                out = []
        if node is not None:
            out.append((node, state.hexdigest()))
        if out:
            yield batch()

    return runs.select("node", "run", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark: SparkSession = conversations.sparkSession
    turns = turns_of(conversations)
    weigh = paths(turns).groupBy("node").agg(F.sum(F.col("below").cast("decimal(20,0)")).alias("below"), F.count("*").alias("n"))
    weights = cut(weigh, "trie-weights")
    total = weights.agg(F.sum("n")).first()[0] or 0
    if not total:
        forget(turns)
        forget(weights)
        return spark.createDataFrame([], OUT)
    limit = max(LEAST, total // PIECES)
    heavy = [bytes(r["node"]) for r in weights.where(F.col("below") > F.lit(Decimal(limit))).select("node").collect()]
    shards = max(256, total // limit, int(spark.conf.get("spark.sql.shuffle.partitions")))
    walked = cut(paths(turns, heavy), "trie-paths")
    same = F.struct("parent", "depth", "words", "root")
    nodes = walked.groupBy("node").agg(
        F.min(same).alias("low"), F.max(same).alias("high"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("below") == 0).cast("long")).alias("ends")
    )
    sound = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low.depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = cut(nodes.select("node", "low.parent", sound.alias("depth"), "conv_id", "n_convs", "low.words", "low.root", "ends"), "trie-nodes")

    below = nodes.where("root is not null").groupBy(F.pmod(F.xxhash64("root"), F.lit(shards)).alias("shard"))
    light = cut(below.applyInPandas(lambda rows: accumulate(rows)[_ORDER], FULL), "trie-shards")
    into = light.where("node = root and parent is not null").groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # at most rows / limit top nodes a depth: the driver holds these arrays
    top = nodes.where("root is null").toPandas()
    done = accumulate(top, into.toPandas()) if len(top) else None
    names = {bytes(n): int(c) for n, c in zip(top["node"], top["conv_id"], strict=True)}
    out = light
    if done is not None:
        rows = [tuple(None if pd.isna(v) else (bytes(v) if isinstance(v, (bytes, bytearray)) else int(v)) for v in r) for r in done[_ORDER].itertuples(index=False)]
        out = light.unionByName(spark.createDataFrame(rows, FULL))
        above = spark.createDataFrame([(k, v) for k, v in names.items()], "parent binary, above long")
        out = out.join(F.broadcast(above), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    ends = _ends(walked.where("below = 0").select("node", "conv_id"))
    # nodes where nobody ends need no partner
    some = out.where("ends > 0").join(ends, "node").unionByName(out.where("ends = 0").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return some.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def crc32_sql(value: str) -> str:
    """CRC-32 of a short ASCII string in DuckDB SQL: a fold over the bytes and their eight bits, from the polynomial."""
    shift = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: xor(a >> 1, (a & 1) * 3988292384), {})"
    folded = f"list_reduce(list_transform(string_split({value}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {shift.format('xor(c, b)')}, 4294967295::BIGINT)"
    return f"xor({folded}, 4294967295)"


def oracle_sql() -> str:
    """The same in DuckDB: prefixes as lists of turn digests, sums over every ancestor of every node."""
    return f"""
WITH RECURSIVE
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text)) AS pos FROM t),
c AS (SELECT DISTINCT conv_id, {crc32_sql('conv_id::VARCHAR')} % {HEADS} AS h FROM t),
own AS (SELECT c.conv_id, 2 AS source, o.pos, o.role, o.text FROM c JOIN o USING (conv_id) WHERE o.pos > c.h),
heads AS (SELECT c.conv_id, 1 AS source, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY} WHERE o.pos <= c.h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY source, pos) AS depth FROM (FROM own UNION ALL FROM heads)),
k AS (SELECT conv_id, depth, list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path,
             len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, depth, path, words FROM k UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM c),
l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
nodes AS (SELECT path, min(p.conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = l.n), '')) AS ends_sha256
          FROM p JOIN l USING (conv_id) GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
up AS (SELECT path[:d] AS path, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM full_, range(depth + 1) x(d)),
sums AS (SELECT path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (path) LEFT JOIN nodes q ON f.depth > 0 AND q.path = f.path[:-2]
"""
