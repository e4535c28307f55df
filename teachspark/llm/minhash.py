"""Operator 2: near duplicates by bottom-k sketches of word shingles.

A document's set is its distinct word shingles, hashed by one function; its sketch is the ``k``
least hashes. Documents with equal sets are one class, so copies cost one row each. Links between
classes come from inverted lists of retained values:

1. A value that only one class retains links nothing. Two sets with Jaccard similarity ``J`` share
   about ``J * k`` retained values, at least ``c`` of them but for a chance below one in a million;
   so each class enters only the lists of its ``k - c + 1`` rarest values, and two similar classes
   meet in at least one. Values that very many documents share (stop words, boilerplate) are thus
   used only by classes that hardly have others.
2. In each list, hubs (the members that share most values) are compared with the members of similar
   size, not all members with each other: the union sketch estimates the similarity, and where that
   comes near the threshold the whole sets decide.
3. Lists whose members are still in several components are finished exactly: with the whole sets of
   their members, by prefix filtering over shingles from rare to frequent, leaving out pairs inside
   a list's largest component and pairs that share too few non-unique shingles to pass. Large lists
   (families of edited copies) are finished by how members differ from their hub.

No list is cut off and no pair is dropped unseen. Sketches and lists are rows of bounded size, hot
values are met by joins that adaptive execution splits, and each stage is a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut

#: Values that a sketch retains.
K = 64
#: Standard deviations that an estimate may be off before a pair is lost or passed on in vain.
SIGMAS = 5.0
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
#: Base of the polynomial that hashes a word.
BASE = 0x9E3779B97F4A7C15 | 1


def _power_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(CHUNK, BASE, np.uint64))
        down = np.cumprod(np.full(CHUNK, inverse, np.uint64))
    return rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1), up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes (63 bits) of texts: words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.letter, self.up, self.down = _power_tables()
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        rng = np.random.default_rng(21)
        self.place = rng.integers(1, 2**63, max(2, words)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def _polynomials(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Polynomial, first byte and end of each word of at most CHUNK bytes; prefix sums give any word's."""
        code = np.frombuffer(data, np.uint8)
        gap = np.concatenate(([True], self.space[code], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.concatenate(([np.uint64(0)], np.cumsum(self.letter[code] * self.up[: len(code)])))
        return (total[stop] - total[start]) * self.down[start], start, stop

    def _hash_words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word of at most CHUNK bytes."""
        value, start, _ = self._polynomials(data)
        return mix(value), start

    def _hash_long(self, data: bytes) -> np.ndarray:
        """Hash of each word of a text of any length, in pieces of CHUNK bytes; a word's polynomial goes on over their borders."""
        out, held, length = [], np.zeros(0, np.uint64), 0
        for at in range(0, len(data), CHUNK):
            piece = data[at : at + CHUNK]
            value, start, stop = self._polynomials(piece)
            size = stop - start
            if length and len(value) and start[0] == 0:
                value[0] = held[0] + np.uint64(pow(BASE, length, 1 << 64)) * value[0]
                size[0] += length
            else:
                out.append(held)
            held, length = np.zeros(0, np.uint64), 0
            if len(value) and stop[-1] == len(piece):
                held, length, value = value[-1:], int(size[-1]), value[:-1]
            out.append(value)
        return mix(np.concatenate([*out, held]))

    def _set(self, words: np.ndarray) -> np.ndarray:
        n = self.words
        if not len(words):
            return np.zeros(0, np.int64)
        if len(words) < n:
            whole = np.uint64(len(words))
            for i, w in enumerate(words):
                whole = whole + self.place[i] * w
            return (mix(np.array([whole])) >> np.uint64(1)).astype(np.int64)
        sums = sum(self.place[i] * words[i : len(words) - n + 1 + i] for i in range(n))
        return np.unique((mix(sums) >> np.uint64(1)).astype(np.int64))

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
            at = 0
            while at < len(data):
                end, size = at, 0
                while end < len(data) and (end == at or size + len(data[end]) + 1 <= CHUNK):
                    size += len(data[end]) + 1
                    end += 1
                if size > CHUNK:
                    yield self._set(self._hash_long(data[at]))
                else:
                    words, start = self._hash_words(b" ".join(data[at:end]))
                    limits = np.searchsorted(start, np.cumsum([len(d) + 1 for d in data[at:end]]))
                    for a, b in zip([0, *limits[:-1].tolist()], limits.tolist(), strict=True):
                        yield self._set(words[a:b])
                at = end


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """Per row: doc_id, ``tid`` (a hash of the text), n (shingles), ``key`` (a hash of the whole set; 0 for the empty set) and the sorted sketch."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            n, keys, least = [], [], []
            for s in shingler.sets(list(batch["text"])):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    h = mix(s.astype(np.uint64) + np.uint64(0x1234567))
                    keys.append(int(mix(np.array([h.sum(dtype=np.uint64) ^ (np.uint64(len(s)) << np.uint64(40))]))[0] >> np.uint64(1)) if len(s) else 0)
                least.append(s[:k].copy())  # a view would keep the whole set
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tid": batch["tid"], "n": n, "key": keys, "sketch": least})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("tid")).mapInPandas(sketch, "doc_id string, tid long, n long, key long, sketch array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _least_shared(size: Column, threshold: float, k: int) -> Column:
    """How many retained values a class surely shares with a similar one: exact for sets that sketches hold whole."""
    exact = F.ceil(size * threshold - 1e-9)
    spread = SIGMAS * F.sqrt(size * (threshold * (1 - threshold)))
    return F.when(size <= math.floor(threshold * k), exact).otherwise(F.greatest(F.lit(1), F.floor(size * threshold - spread)))


def _band(n: Column, threshold: float) -> Column:
    """Sets of similar sizes are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def retained_lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """``(value, band, key, n, shared)``: each class in the lists of the rarest values that it must share with a similar one."""
    threshold = percent / 100
    postings = classes.select("key", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = postings.join(frequent, "value")
    mine = met.groupBy("key", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"))  # at most k values a class
    free = F.col("size") - F.size("met")
    take = F.greatest(F.lit(0), F.col("size") - _least_shared(F.col("size"), threshold, k) + 1 - free).cast("int")
    mine = mine.withColumn("take", F.least(take, F.size("met"))).where("take > 0")
    return mine.select(F.explode(F.slice("met", 1, F.col("take"))).alias("x"), "key", "n", F.size("met").alias("shared")).select(
        "x.value", _band(F.col("n"), threshold).alias("band"), "key", "n", "shared"
    )


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` of list members of similar size, one of them a hub of the list (or of a neighbouring band's)."""
    rank = [F.struct("shared", F.xxhash64("key"), "key", "n"), F.struct("shared", F.xxhash64("key", F.col("value") % 4), "key", "n")]
    hubs = lists.groupBy("value", "band").agg(*[F.max(r).alias(f"h{i}") for i, r in enumerate(rank)])
    different = F.array_distinct(F.array(*[F.struct(f"h{i}.key", f"h{i}.n") for i in range(len(rank))]))
    hubs = hubs.select("value", "band", F.explode(different).alias("hub"))
    hubs = hubs.select("value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "hub")
    met = lists.join(hubs, ["value", "band"]).where((F.col("key") != F.col("hub.key")) & _similar_size(F.col("n"), F.col("hub.n"), percent))
    return met.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose union sketch (the k least values of both) leaves it possible that they are similar."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.select("a", "b", union.alias("union"), F.array_intersect("sa", "sb").alias("common"))
    share = F.size(F.array_intersect("union", "common")) / F.size("union")
    margin = SIGMAS * F.sqrt(F.lit(percent * (100 - percent) / 1e4) / F.size("union"))
    return both.where(share >= percent / 100 - margin).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar: ``percent * union <= 100 * intersection``."""
    side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held = Shingler(words), {}
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(batch[c] for c in ("a", "b", "ta", "tb")), strict=True):
                sets = []
                for key, text in ((a, ta), (b, tb)):
                    if key not in held:
                        if len(held) > 64:
                            held.pop(next(iter(held)))
                        held[key] = next(shingler.sets([text]))
                    sets.append(held[key])
                common = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(check, "a long, b long")


#: Pairs that a list may hold for its members to be paired at once; larger lists are finished around their hubs.
PAIRED_LIST = 20_000


def finishing_pairs(lists: DataFrame, component: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidate pairs of different components that lists hold, for the members of lists with several components.

    The whole sets are used: first by prefix filtering over shingles from rare to frequent, without
    pairs inside a list's largest component and pairs that share too few non-unique shingles. Lists
    that would still hold many pairs go to :func:`around_hubs`.
    """
    threshold = percent / 100
    placed = lists.join(component.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("value")
    members = cut(placed.join(mixed, "value", "left_semi").select("key", "n", "component").distinct(), "minhash-mixed")

    def whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = list(shingler.sets(list(batch["text"])))
            yield pd.DataFrame({"key": batch["key"], "n": batch["n"], "component": batch["component"], "values": sets})

    sets = members.join(texts, "key").select("key", "n", "component", "text").mapInPandas(whole_sets, "key long, n long, component long, values array<long>")
    sets = cut(sets, "minhash-sets")
    whole = sets.select("key", "n", "component", F.explode("values").alias("value"))
    # A shingle that one member has, or only members of one component, can't link components.
    seen = whole.groupBy("value").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = cut(whole.join(seen.where("df > 1"), "value"), "minhash-met")
    shared = met.groupBy("key", "n").agg(F.count("*").alias("shared"))
    # Of its non-unique shingles a class needs the rarest n - ceil(threshold * n) + 1, less the unique ones, which come first.
    slots = shared.withColumn("slots", F.col("shared") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("slots > 0").select("key", "shared", "slots")
    # The rank among a class's own shingles (at most its set size) by (df, value): a window over one class.
    own = F.row_number().over(W.partitionBy("key").orderBy("df", "value"))
    ranked = met.join(slots, "key").withColumn("rank", own).where("rank <= slots and low <> high")
    prefix = cut(ranked.select("value", "key", "n", "component", "shared", _band(F.col("n"), threshold).alias("band")), "minhash-prefix")
    # In each list the largest component's members are met only by the others.
    sizes = prefix.groupBy("value", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("value").agg(F.max(F.struct("m", "component")).alias("x"), F.sum("m").alias("members"))
    largest = largest.select("value", F.col("x.component").alias("largest"), ((F.col("members") - F.col("x.m")) * F.col("members") > PAIRED_LIST).alias("large"))
    prefix = cut(prefix.join(largest, "value"), "minhash-sized")

    left = prefix.where("component <> largest and not large")
    left = left.select("value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("component").alias("c2"), F.col("shared").alias("m2"))
    enough = F.least("shared", "m2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    both = left.join(prefix.where("not large"), ["value", "band"]).where((F.col("component") != F.col("c2")) & _similar_size(F.col("n"), F.col("n2"), percent) & enough)
    pairs = both.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b"))
    return pairs.unionByName(around_hubs(prefix.where("large"), sets, percent)).distinct()


def around_hubs(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of large lists, by how their members differ from the list's hub.

    Let ``D`` be the symmetric difference of a set and the hub's, ``d`` its size. Two sets differ in
    ``d1 + d2 - 2 * |D1 & D2|`` shingles, and are similar if that is at most ``c * (n1 + n2)`` with
    ``c = (1 - t) / (1 + t)``. Where one of them isn't similar to the hub, ``d1 > c * (n1 + n hub)``,
    they must share more than ``(d2 + c * (n hub - n2)) / 2`` elements of ``D``; where both are, they
    are linked through the hub. So members that aren't similar to the hub are joined with the others
    on the rarest elements of ``D`` that such an overlap can't avoid. Copies of one original with
    edits of their own hardly share any, however many there are.
    """
    threshold = percent / 100
    c = (1 - threshold) / (1 + threshold)
    hubs = prefix.groupBy("value", "band").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), F.xxhash64("key"), "key")).alias("x"))
    hubs = hubs.select("value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("x.key").alias("hub"))
    pairs = cut(prefix.join(hubs, ["value", "band"]).select("hub", "key").distinct(), "minhash-around")
    both = pairs.join(sets, "key").join(sets.select(F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("values").alias("hub_values")), "hub")

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(batch["values"], batch["hub_values"], strict=True)]
            yield pd.DataFrame({x: batch[x] for x in ("hub", "hub_n", "key", "n", "component")} | {"d": [len(x) for x in found], "element": found})

    apart = both.mapInPandas(differences, "hub long, hub_n long, key long, n long, component long, d long, element array<long>")
    apart = cut(apart, "minhash-apart")
    similar = F.col("d") <= (F.col("n") + F.col("hub_n")) * c + 1e-9
    links = apart.where(similar & (F.col("d") > 0)).select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
    rows = apart.withColumn("alone", ~similar).select("hub", "hub_n", "key", "n", "component", "d", "alone", F.explode("element").alias("element"))
    df = rows.groupBy("hub", "element").agg(F.count("*").alias("df"), F.max("alone").alias("wanted"))
    rows = rows.join(df, ["hub", "element"])
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("hub", "key").orderBy("df", "element")))
    rows = cut(rows.where("df > 1 and wanted").drop("wanted"), "minhash-elements")
    n, d = F.col("n"), F.col("d")
    need_left = F.greatest(F.lit(1), F.ceil((d - c * (n + n / threshold)) / 2 - 1e-6))
    need_right = F.greatest(F.lit(1), F.ceil((d + c * (F.col("hub_n") - n)) / 2 - 1e-6))
    left = rows.where(F.col("alone") & (F.col("rank") <= d - need_left + 1)).select("hub", "element", F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("component").alias("c2"))
    right = rows.where(F.col("rank") <= d - need_right + 1).select("hub", "element", "key", "n", "component")
    met = left.join(right, ["hub", "element"]).where((F.col("component") != F.col("c2")) & _similar_size(F.col("n"), F.col("n2"), percent))
    return links.unionByName(met.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b")))


def _placed(docs: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """Per row of ``docs``: doc_id, ``tid`` (a hash of the text), n (shingles) and ``place``, equal for linked rows and null for empty sets."""
    bounded_batches(docs.sparkSession)
    rows = cut(sketches(docs, words, k), "minhash-sketches")
    # One row a class; its least doc_id names the row whose text stands for it.
    classes = rows.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid", "n", "sketch")).alias("x"))
    classes = cut(classes.select("key", "x.doc_id", "x.tid", "x.n", "x.sketch"), "minhash-classes")
    lists = cut(retained_lists(classes, percent, k), "minhash-lists")
    # The texts of classes in any list, each taken from one row, which its id and its text's hash name.
    named = classes.join(lists.select("key").distinct(), "key", "left_semi").select("key", F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid"))
    whole = docs.select("doc_id", "text", F.xxhash64("text").alias("tid")).where("text is not null")
    whole = whole.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("tid") == F.col("__tid")))
    texts = cut(whole.select("key", "text").dropDuplicates(["key"]), "minhash-texts")

    found = estimated(hub_pairs(lists, percent), classes, percent, k)
    links = cut(verified(found, texts, words, percent), "minhash-links")
    component = cut(components(links, name="minhash-star"), "minhash-components")
    # These pairs come from whole sets already, so an estimate would add nothing.
    more = finishing_pairs(lists, component, texts, words, percent)
    links = links.unionByName(cut(verified(more, texts, words, percent), "minhash-more"))
    component = cut(components(links, name="minhash-star"), "minhash-components")

    placed = rows.select("doc_id", "tid", "n", "key").join(component.select(F.col("node").alias("key"), "component"), "key", "left")
    place = F.when(F.col("n") == 0, F.lit(None)).otherwise(F.coalesce("component", "key"))
    return placed.select("doc_id", "tid", "n", place.alias("place"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``words``-word
    shingles (with fewer words, the whole sequence is one; without any, the set is empty and links
    nothing). ``component_id`` is the smallest doc_id reachable, ``kept`` marks the documents that
    have it. A null doc_id has a null component and is kept; it still links others. Repeated rows
    get equal results. An empty table gives an empty result.
    """
    placed = _placed(docs, words, percent, k).drop("tid")
    least = placed.where("place is not null").groupBy("place").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1").select("place", "least")
    out = placed.join(least, "place", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``docs`` without near duplicates: of linked rows those stay that have the smallest id and, under it, one text.

    Each row is judged by its own text, so texts that share an id are dropped or kept apart. Of repeated
    rows (one id and text) one stays. Rows with a null id come after all others; where only
    such rows are linked, one row stays. Texts without a word stay.
    """
    placed = cut(_placed(docs, words, percent, k).where("place is not null"), "minhash-placed")
    mine = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")
    first = placed.groupBy("place").agg(F.min(mine).alias("first"), F.count("*").alias("members")).where("members > 1").select("place", "first")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid")))
    gone = cut(placed.join(first, "place").where(other).select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__gone")).distinct(), "minhash-gone")

    rows = docs.withColumn("__tid", F.xxhash64("text"))
    twice = placed.where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc"), F.col("tid").alias("__twice")).count().where("count > 1").drop("count")
    named = rows.where("doc_id is not null").join(gone.where("__doc is not null"), (F.col("doc_id") == F.col("__doc")) & (F.col("__tid") == F.col("__gone")), "left_anti")
    again = (F.col("doc_id") == F.col("__doc")) & (F.col("__tid") == F.col("__twice"))
    named = named.join(twice, again, "left_anti").unionByName(named.join(twice, again, "left_semi").dropDuplicates(["doc_id", "__tid"]))
    unnamed = rows.where("doc_id is null")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = unnamed.where(worded).dropDuplicates(["__tid"]).join(gone.where("__doc is null"), F.col("__tid") == F.col("__gone"), "left_anti")
    return named.unionByName(one).unionByName(unnamed.where(~worded)).select(*docs.columns)
