"""Operator 9: benchmark items in documents, within an edit distance.

The CGK embedding walks through a string: at each step it emits the character it stands on and,
by a random bit drawn for (step, character), stays or goes one on. Two walks with the same bits
over strings of small edit distance soon meet again after each edit, so their outputs have a small
Hamming distance; a hash of sampled output positions then collides with good probability (bit
sampling). Each repetition hashes the items from another of their words on (``ANCHORS``), by one of
``WALKS`` walks; windows of the documents begin at every word. At a collision, ``PIECE`` characters
of the item from its anchor on are aligned there; where they are near enough, the item-sized window
around it is verified by exact edit distance. With edits in a tenth of an item's characters, the
tests find every planted copy.

Items shorter than ``PIECE`` have few words to hash from, so they have an exact way besides: with at
most ``k`` edits, two of ``k + 2`` consecutive pieces of an item stay as they are and lie at most ``k``
apart on the diagonal; wherever that happens, the whole item is aligned. Items shorter than ``FUZZY``
must occur word for word, since a fifth of their characters makes other words of them.

Many items may share a stem. Anchors are preferred where at most ``SHARED`` items read alike, equal
items are searched for once, and a collision is verified only if the least edits of all its item's
pieces, aligned for many collisions at once, don't add up to more than the item's edits.

Documents are one map: the hashed items and the items themselves are broadcast in blocks of
``BLOCK`` items (a proven bound), whatever the number of documents, and only matches leave the map.
Text is compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A window matches an item if their edit distance is at most this share of the item's length.
MAX_EDITS = 0.2
#: Walks with their own random bits, words of an item that hashing begins from, steps of a walk and sampled outputs.
WALKS, ANCHORS, STEPS, SAMPLED = 3, 16, 30, 14
#: Characters that a walk rarely reads more than: it is begun no nearer to an item's end.
REACHED = 20
#: Characters aligned at a collision, and the share of them that may differ for it to be verified.
PIECE, PIECE_EDITS = 64, 0.4
#: Items that are hashed, broadcast and searched for at a time, and characters of text that are walked at a time.
BLOCK, CHUNK = 20_000, 1 << 20
#: Characters that the pieces of a long text overlap by: a collision near a border is whole, with what is aligned, in one of them.
OVERLAP = 2 * (PIECE + STEPS)
#: Bits of the first test of a hash.
SIEVE = 22
#: Items of fewer characters must occur word for word.
FUZZY = 16
#: Anchors that more items than this share are taken only where an item has too few others.
SHARED = 8
#: Characters of a short item's piece at most, and spots of pieces that are held at a time.
GRAM, SPOTS = 8, 1 << 21
#: Collisions from which on it pays to bound the edits of all of them at once before any is verified.
MANY = 256

SPACES = re.compile(r"\s+")


def normal(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return SPACES.sub(" ", text).strip().lower()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words_at(code: np.ndarray) -> np.ndarray:
    """Where windows begin: after each space, and at each character of scripts written without spaces."""
    if not len(code):
        return np.zeros(0, np.int64)
    begins = np.concatenate(([True], code[:-1] == 32)) & (code != 32)
    return np.flatnonzero(begins | (code >= 0x2E80))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_keys(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` characters from each place on."""
    n = max(0, len(code) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
    return mix(out)


def sieve_of(keys: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[(keys >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
    return sieve


def looked_up(h: np.ndarray, sieve: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which hashes are among the sorted keys: their numbers, the first of their keys and how many."""
    some = np.flatnonzero(sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)])
    first = np.searchsorted(keys, h[some])
    times = np.searchsorted(keys, h[some], side="right") - first
    hit = times > 0
    return some[hit], first[hit], times[hit]


def runs(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...``, ``times`` of each, one after the other."""
    return np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


@dataclass
class Grams:
    """Pieces of short items with ``size`` characters each: sorted keys, and which item at which offset each belongs to."""

    size: int
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def build(code: list[np.ndarray], max_edits: float) -> list[Grams]:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, c in enumerate(code):
            if FUZZY <= len(c) < PIECE:
                pieces = int(max_edits * len(c)) + 2
                size = max(1, min(GRAM, len(c) // pieces))
                keys = gram_keys(c, size)
                by.setdefault(size, []).extend((int(keys[at]), i, at) for at in (j * len(c) // pieces for j in range(pieces)) if at < len(keys))
        out = []
        for size, rows in sorted(by.items()):
            keys = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            items, offsets = (np.array([r[c] for r in rows], np.int64)[order] for c in (1, 2))
            out.append(Grams(size, keys[order], items, offsets, sieve_of(keys)))
        return out


class Walk:
    """One CGK walk and the outputs that its repetitions sample. Characters count by their code modulo 256."""

    def __init__(self, number: int) -> None:
        rng = np.random.default_rng(1000 + number)
        self.advance = rng.integers(0, 2, (STEPS, 256)).astype(np.int32)
        self.sampled = np.zeros(STEPS, bool)
        self.sampled[np.sort(rng.choice(STEPS, SAMPLED, replace=False))] = True
        self.factor = rng.integers(1, 2**62, STEPS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        last = int(np.flatnonzero(self.sampled)[-1])
        self.steps = last + 1

    def hashes(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
        """Hash of the sampled outputs of the walk from each start; past its stop (else the text's end) a walk emits 0."""
        padded = np.concatenate((code, np.zeros(STEPS + 1, code.dtype)))
        low = (padded & 0xFF).astype(np.uint8)
        at = starts.astype(np.int32)
        out = np.zeros(len(at), np.uint64)
        for step in range(self.steps):
            c = low[at]
            if stops is not None:
                c = np.where(at < stops, c, 0)
            if self.sampled[step]:
                out += self.factor[step] * c
            at += self.advance[step][c]
        return mix(out)


def piece_edits(code: np.ndarray, at: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, margin: int = 12) -> np.ndarray:
    """Least edit distance of each piece (of at most 64 characters) to a part of the text near its place; bit-parallel, all at once."""
    padded = np.concatenate((np.zeros(margin, code.dtype), code, np.zeros(PIECE + 2 * margin, code.dtype)))
    up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
    one, top = np.uint64(1), np.uint64(1) << (sizes - 1).astype(np.uint64)
    score = sizes.astype(np.int64)
    best = score.copy()
    for step in range(PIECE + 2 * margin):
        c = padded[at + step]
        eq = np.packbits(pieces == c[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
        ph, mh = ph << one, mh << one
        up, down = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


@dataclass
class Index:
    """The hashed anchors of a block of items: sorted keys a walk, and which item at which offset each belongs to."""

    ids: list
    texts: list[str]
    keys: list[np.ndarray]
    items: list[np.ndarray]
    offsets: list[np.ndarray]
    short: list[int]

    @staticmethod
    def build(ids: list, texts: list[str]) -> Index:
        keys, items, offsets = [], [], []
        short = [i for i, t in enumerate(texts) if 0 < len(t) < FUZZY]
        code, lengths = codes("".join(texts)), np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        at, it = Index._anchors(code, begins, lengths)
        for number in range(WALKS):
            k, off = Walk(number).hashes(code, at, begins[it] + lengths[it]), at - begins[it]
            order = np.argsort(k, kind="stable")
            keys.append(k[order].astype(np.uint64))
            items.append(it[order])
            offsets.append(off[order])
        return Index(ids, texts, keys, items, offsets, short)

    @staticmethod
    def _anchors(code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where items are hashed from, and which items: up to ``ANCHORS`` of an item's words, spread, at first of those that few items share."""
        # Words begin where items do too; from too near its end a walk would leave the item.
        words = np.union1d(words_at(code), begins[lengths > 0])
        item = np.searchsorted(begins, words, side="right") - 1
        inside = words <= (begins + lengths)[item] - REACHED
        words, item = words[inside], item[inside]
        keys = Walk(0).hashes(code, words, (begins + lengths)[item])
        pairs = np.unique(np.column_stack((keys, item.astype(np.uint64))), axis=0)
        each, count = np.unique(pairs[:, 0], return_counts=True)
        rare = count[np.searchsorted(each, keys)] <= SHARED if len(keys) else np.zeros(0, bool)
        spread = lambda x, n: x[np.unique(np.linspace(0, len(x) - 1, n).round().astype(int))]
        edges = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True]))) if len(item) else np.zeros(1, np.int64)
        out = [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            starts = words[a:b]
            if b - a > ANCHORS:
                own, shared = starts[rare[a:b]], starts[~rare[a:b]]
                starts = spread(own, ANCHORS) if len(own) >= ANCHORS else np.concatenate((own, spread(shared, ANCHORS - len(own))))
            out.append(starts)
        at = np.sort(np.concatenate(out))
        return at, np.searchsorted(begins, at, side="right") - 1


def best_window(item: str, text: str, limit: int) -> tuple[int, int, int]:
    """``(edits, start, end)`` of the part of ``text`` nearest to ``item`` in edit distance (the first, then the shortest), if within ``limit``."""
    if (at := text.find(item)) >= 0:
        return 0, at, at + len(item)

    def scan(pattern: str, within: str, free: bool) -> tuple[int, int]:
        # Bit-parallel columns of the edit-distance table; ``free`` lets a match begin anywhere.
        m, at = len(pattern), {}
        for i, c in enumerate(pattern):
            at[c] = at.get(c, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(within, 1):
            eq = at.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up) & full, up & xh
            score += bool(ph & top) - bool(mh & top)
            ph = ph << 1 & full | (not free)
            mh = mh << 1 & full
            up, down = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best, end = score, j
        return best, end

    edits, end = scan(item, text, True)
    if not end or edits > limit:
        return edits, 0, end
    # Backwards from the end, the least distance again; its place is where the window begins.
    _, back = scan(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], False)
    return edits, end - back, end


class Searcher:
    """Finds the items of an index in texts."""

    def __init__(self, index: Index, max_edits: float) -> None:
        self.index, self.max_edits = index, max_edits
        self.walks = [Walk(n) for n in range(WALKS)]
        self.text = codes("".join(index.texts))
        self.lengths = np.array([len(t) for t in index.texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.limits = (max_edits * self.lengths).astype(np.int64)
        self.sieves = [sieve_of(keys) for keys in index.keys]
        self.grams = Grams.build([codes(t) for t in index.texts], max_edits)

    def candidates(self, code: np.ndarray) -> set[tuple[int, int, int]]:
        """``(position, item, offset in the item)`` of every place to verify: collisions near enough, and short items by their pieces."""
        place, number, offset = self._collisions(code)
        # Collisions on one diagonal are one.
        _, one = np.unique(np.column_stack((place - offset, number)), axis=0, return_index=True)
        place, number, offset = place[one], number[one], offset[one]
        if len(place) > MANY:
            keep = self._bounded(code, place - offset, number)
            place, number, offset = place[keep], number[keep], offset[keep]
        return set(zip(place.tolist(), number.tolist(), offset.tolist(), strict=True)) | self._short(code)

    def _pieces(self, number: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ``sizes`` characters of the items from the offsets on, as rows of ``PIECE``."""
        begin = self.begins[number] + offset
        inside = np.arange(PIECE) < sizes[:, None]
        return np.where(inside, self.text[np.minimum(begin[:, None] + np.arange(PIECE), len(self.text) - 1)], 0xFFFFFFFF)

    def _bounded(self, code: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Numbers of the candidates whose items' consecutive pieces have least edits that add up to no more than the item's.

        A piece is looked for as far from its place as the item's edits may move it, so none within its edits is lost.
        """
        order = np.argsort(self.limits[number], kind="stable")
        kept = []
        for a in range(0, len(order), 1 << 13):
            alive = order[a : a + (1 << 13)]
            margin = int(self.limits[number[alive]].max())
            spent, done = np.zeros(len(alive), np.int64), []
            # The last pieces first: what items share is mostly their beginning.
            for back in range(-(-int(self.lengths[number[alive]].max()) // PIECE)):
                offset = (-(-self.lengths[number[alive]] // PIECE) - 1 - back) * PIECE
                done.append(alive[offset < 0])
                alive, spent, offset = alive[offset >= 0], spent[offset >= 0], offset[offset >= 0]
                if not len(alive):
                    break
                sizes = np.minimum(self.lengths[number[alive]] - offset, PIECE)
                begin = np.clip(at[alive] + offset, 0, len(code))
                spent += piece_edits(code, begin, self._pieces(number[alive], offset, sizes), sizes, margin)
                near = spent <= self.limits[number[alive]]
                alive, spent = alive[near], spent[near]
            kept += [*done, alive]
        return np.concatenate(kept)

    def _short(self, code: np.ndarray) -> set[tuple[int, int, int]]:
        """Where items shorter than ``PIECE`` are within their edits: position, item and offset of a piece that stayed whole; none is missing."""
        found: set[tuple[int, int, int]] = set()
        for grams in self.grams:
            margin = max(12, int(self.limits[grams.items].max()))
            reach = PIECE + 2 * margin
            some, first, times = looked_up(gram_keys(code, grams.size), grams.sieve, grams.keys)
            total = np.cumsum(times)
            a = 0
            while a < len(some):
                # As many places as SPOTS allows, but more than an item reaches; the next ones begin an item's reach earlier.
                b = int(np.searchsorted(total, total[a] - times[a] + SPOTS, side="right"))
                b = max(b, int(np.searchsorted(some, some[a] + 2 * reach)))
                hit = runs(first[a:b], times[a:b])
                item, offset = grams.items[hit], grams.offsets[hit]
                diagonal = np.repeat(some[a:b], times[a:b]) - offset
                order = np.lexsort((offset, diagonal, item))
                item, offset, diagonal = item[order], offset[order], diagonal[order]
                two = (item[1:] == item[:-1]) & (offset[1:] != offset[:-1]) & (diagonal[1:] - diagonal[:-1] <= self.limits[item[1:]])
                item, offset, diagonal = item[:-1][two], offset[:-1][two], diagonal[:-1][two]
                for c in range(0, len(item), 1 << 14):
                    number, off, at = (x[c : c + (1 << 14)] for x in (item, offset, diagonal))
                    place, at = at + off, np.maximum(at, 0)
                    sizes = self.lengths[number]
                    near = piece_edits(code, at, self._pieces(number, np.zeros_like(number), sizes), sizes, margin) <= self.limits[number]
                    found.update(zip(place[near].tolist(), number[near].tolist(), off[near].tolist(), strict=True))
                if b >= len(some):
                    break
                a = int(np.searchsorted(some, some[b] - reach))
        return found

    def _collisions(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and offset in the item of every collision whose piece of the item is near."""
        at, item = [], []
        starts = words_at(code)
        for walk, sieve, keys, items, offsets in zip(self.walks, self.sieves, self.index.keys, self.index.items, self.index.offsets, strict=True):
            if not len(keys):
                continue
            h = walk.hashes(code, starts)
            some, first, times = looked_up(h, sieve, keys)
            hit = runs(first, times)
            at.append(np.repeat(starts[some], times))
            item.append(np.stack([items[hit], offsets[hit]], 1))
        if not at:
            return (np.zeros(0, np.int64),) * 3
        spots = np.unique(np.column_stack([np.concatenate(at), np.concatenate(item)]), axis=0)
        found = [spots[:0]]
        for a in range(0, len(spots), 1 << 14):
            place, number, offset = spots[a : a + (1 << 14)].T
            # Near the item's end the piece begins earlier, so that it is whole.
            sizes = np.minimum(self.lengths[number], PIECE)
            shift = np.maximum(0, offset + sizes - self.lengths[number])
            edits = piece_edits(code, np.maximum(place - shift, 0), self._pieces(number, offset - shift, sizes), sizes)
            found.append(spots[a : a + (1 << 14)][edits <= PIECE_EDITS * sizes])
        return tuple(np.concatenate(found).T)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches ``(item, start, end, edits)``: the best window of each item, offsets in the normal form."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        norm = [normal(t) for t in texts]
        # Walk many texts as one, spaces between them, and long ones in pieces that overlap.
        group, size = [], 0
        for i, t in enumerate(norm):
            for a in range(0, len(t), CHUNK):
                piece = t[a : a + CHUNK + OVERLAP]
                group.append((i, a, piece))
                size += len(piece)
                if size >= CHUNK:
                    self._collide(group, norm, out)
                    group, size = [], 0
        if group:
            self._collide(group, norm, out)
        for item in self.index.short:
            for i, t in enumerate(norm):
                if (m := re.search(rf"(?<!\w){re.escape(self.index.texts[item])}(?!\w)", t)) and (item not in out[i] or out[i][item][0]):
                    out[i][item] = (0, m.start(), m.end())
        return [[(item, a, b, e) for item, (e, a, b) in sorted(found.items())] for found in out]

    def _collide(self, group: list[tuple[int, int, str]], norm: list[str], out: list[dict]) -> None:
        begins = np.cumsum([0] + [len(p) + STEPS + 1 for _, _, p in group])
        code = codes("".join(p + " " * (STEPS + 1) for _, _, p in group))
        spots: dict[tuple[int, int], list[int]] = {}
        for place, item, offset in self.candidates(code):
            # The collision lies in the piece it came from; the item may begin before that piece, or before its text.
            g = int(np.searchsorted(begins, place, side="right")) - 1
            i, a, _ = group[g]
            spots.setdefault((i, item), []).append(max(0, a + place - int(begins[g]) - offset))
        for (i, item), places in spots.items():
            pattern = self.index.texts[item]
            limit = int(self.max_edits * len(pattern))
            # What spots near each other may reach is scanned as one part of the text.
            parts: list[list[int]] = []
            for at in sorted(places):
                low, high = max(0, at - limit), at + len(pattern) + 2 * limit
                if parts and low <= parts[-1][1]:
                    parts[-1][1] = high
                else:
                    parts.append([low, high])
            for low, high in parts:
                if item in out[i] and not out[i][item][0]:
                    break
                edits, a, b = best_window(pattern, norm[i][low:high], limit)
                if edits <= limit and (item not in out[i] or edits < out[i][item][0]):
                    out[i][item] = (edits, low + a, low + b)


RESULT = "item_id long, start long, stop long, edits int, item_chars int"


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block: int = BLOCK) -> DataFrame:
    """One row for each document and benchmark item found in it: ``doc_id`` and ``RESULT``.

    Offsets are in characters of the text's normal form (lower case, single spaces). Null and empty
    texts hold nothing, and null or empty items are in nothing. Repeated rows are searched like any
    others; equal items are reported under each id. Items shorter than ``FUZZY`` characters must occur
    word for word, those shorter than ``PIECE`` are found by an exact way, longer ones with the chance of
    their walks. Very long texts are walked in pieces. Columns but doc_id, item_id and text are not read,
    whatever their names. The items are numbered and searched for in blocks of ``block``, each broadcast;
    texts are read once a block.
    """
    out = None
    for index in _indexes(benchmark, block):
        part = _searched(docs, index, max_edits)
        out = part if out is None else out.unionAll(part)
    return out


def _indexes(benchmark: DataFrame, block: int) -> Iterator:
    """The broadcast index of each block of items; one without items if there are none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = items.count()
    blocks = max(1, -(-n // block))
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).distinct().collect() if n else []
        rows = sorted(((r["item_id"], normal(r["text"])) for r in mine), key=lambda x: (x[0] is None, x[0], x[1]))
        # Items that read alike are searched for once, and found under each of their ids.
        equal: dict[str, list] = {}
        for i, t in rows:
            if t and i not in equal.setdefault(t, []):
                equal[t].append(i)
        yield benchmark.sparkSession.sparkContext.broadcast(Index.build(list(equal.values()), list(equal)))


def _searched(docs: DataFrame, index, max_edits: float) -> DataFrame:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(index.value, max_edits)
        ids, texts = searcher.index.ids, searcher.index.texts
        for batch in batches:
            rows = []
            found = searcher.search([t if isinstance(t, str) else "" for t in batch["text"]])
            for doc, matches in zip(batch["doc_id"], found, strict=True):
                rows += [(doc, one, a, b, e, len(texts[item])) for item, a, b, e in matches for one in ids[item]]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "stop", "edits", "item_chars"]).astype({"item_id": "Int64"})

    # Ids travel as text: pandas would make doubles of a column of ids with nulls.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(search, "doc_id string, " + RESULT)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark item, whatever their ids: null and repeated ids decide nothing."""
    for index in _indexes(benchmark, block):
        docs = docs.where(~_holds(index, max_edits)("text"))
    return docs


def _holds(index, max_edits: float):
    """A column function: whether a text holds an item of the index."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(index.value, max_edits)
        for batch in batches:
            yield pd.Series([bool(m) for m in searcher.search([t if isinstance(t, str) else "" for t in batch])], dtype=bool)

    return holds
