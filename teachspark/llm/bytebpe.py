"""Operators 4 and 5: token counts by rank-synchronous merging, and a BPE automaton to encode and decode.

Both read a ``tokenizers`` file (byte-level BPE) on the driver, compile it into numpy tables of a
size the vocabulary bounds, and broadcast those. A worker cuts each text into pre-tokens, works on
the pre-tokens it has not met yet, all at once, and remembers them in a dictionary of bounded size.
A text is worked on in slices, cut where a pre-token must end, so a very long text needs no more
memory than its tokens.

* Counting (operator 4) holds the batch's pre-tokens as one ragged array of symbols. Each round
  looks up the ranks of all neighbouring pairs, takes each sequence's lowest, merges all its
  occurrences from left to right, and drops sequences in which no pair has a rank. The symbols
  that survive are counted. A pair with the symbol a merge has made ranks after that merge, so
  merging all occurrences at once gives what merging them one by one gives.
* Encoding (operator 5) builds a deterministic automaton whose arcs carry tokens. It starts as one
  state that each single byte leads back to. For each merge (a, b) in order, a gadget forbids b
  after a: the state that a leads to is split off, loses its arc b, and wherever a could be
  followed by b an arc ``ab`` is added that leads where b led. In the end the only path that spells
  a pre-token is its encoding. Paths are found byte by byte, for the whole batch at once: each
  prefix has one encoding, so its last token (hence the automaton's state) is all to remember.
  Decoding walks the ids and emits the bytes on their arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, worker_cache

#: Characters after which a slice of a text is cut at the next place where a pre-token must end.
SLICE = 1 << 18
#: Pre-tokens that a worker remembers, and the longest that it remembers (characters).
REMEMBERED, LONGEST = 400_000, 64

#: Fixed value: the pre-token pattern of byte-level BPE (its letter branch moved to the front, where it is met most).
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over the characters of LATIN only, for a faster matcher.
LATIN = r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*"
LATIN_PATTERN = r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t\n\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: Code points that Unicode 17 added as letters or numbers (hexadecimal). The tokenizer library
#: follows Unicode 16, to which they are unassigned, so symbols; the ``regex`` module may know them already.
UNICODE_17 = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def unassigned_letters() -> str:
    """A character class of the code points above."""
    ends = [[chr(int(x, 16)) for x in run.split("-")] for run in UNICODE_17.split()]
    return "[" + "".join(f"{run[0]}-{run[-1]}" for run in ends) + "]"


class Tables:
    """What a vocabulary file compiles to: bytes of each id, merges as sorted keys, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("only byte-level BPE without a normalizer or dropout is supported")
        if spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("prefix spaces, ignored merges, and subword marks are not supported")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.newer = unassigned_letters()
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens must match literally")
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.specials.values()], default=-1) + 1
        self.spelling: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.spelling[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.spelling[i] = token.encode()
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab.get(c, -1)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[p[0] + p[1]] for p in pairs], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("two merges make the same token")
        self.merges = np.stack([left, right, made], 1) if len(pairs) else np.zeros((0, 3), np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where it has none."""
        if not len(self.keys):
            return np.zeros(len(a), np.int64)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


def count_symbols(tables: Tables, words: list[bytes]) -> np.ndarray:
    """Tokens of each word, by merging all sequences in step."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = lengths.copy()
    symbols = tables.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    none = len(tables.keys)
    while len(symbols):
        rank = np.full(len(symbols), none, np.int64)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = tables.rank(symbols[inside], symbols[inside + 1])
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.append(starts, len(symbols)))
        lowest = np.minimum.reduceat(rank, starts)
        out[owner[starts]] = sizes
        alive = np.repeat(lowest < none, sizes)
        merge = (rank == np.repeat(lowest, sizes)) & alive
        # In a run of the same symbol pairs overlap: every other one merges, from the left.
        at = np.arange(len(symbols))
        first = merge & ~np.concatenate(([False], merge[:-1]))
        merge &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
        symbols = np.where(merge, tables.merges[np.where(merge, rank, 0), 2] if none else symbols, symbols)
        keep = alive & ~np.concatenate(([False], merge[:-1]))
        symbols, owner = symbols[keep], owner[keep]
    return out


class Automaton:
    """The tokens' automaton and the trie of their spellings, as sorted tables."""

    def __init__(self, tables: Tables) -> None:
        self.size, self.byte_id, self.specials, self.spelling, self.newer = tables.size, tables.byte_id, tables.specials, tables.spelling, tables.newer
        merges, never = tables.merges, len(tables.merges) + 1
        # States: what a state lost itself (arc -> time), what it was split from, and when.
        lost: list[dict[int, int]] = [{}]
        parent, since = [-1], [0]
        target = [0] * tables.size  # the state each token's arcs lead to
        users = [0] * 1  # arcs' tokens that lead to a state; state 0 is where words begin
        users[0] = 257
        made_at = [never] * tables.size
        left = [-1] * tables.size
        for i in tables.byte_id.tolist():
            made_at[i] = -1

        def lost_at(state: int, token: int, by: int) -> bool:
            """Whether the arc's own removal from the state, or from those it was split from, came no later than ``by``."""
            limit = by
            while state >= 0:
                if lost[state].get(token, never) <= limit:
                    return True
                limit, state = min(limit, since[state] - 1), parent[state]
            return False

        def has(state: int, token: int, now: int) -> bool:
            """Whether the state has the arc: an arc ``ab`` was added where ``a`` was then, and may have been lost later."""
            limit = now
            while True:
                if made_at[token] > limit or lost_at(state, token, limit):
                    return False
                if left[token] < 0:
                    return True
                limit, token = made_at[token], left[token]

        for now, (a, b, ab) in enumerate(merges.tolist()):
            if made_at[a] >= now or made_at[b] >= now or not has(target[a], b, now - 1):
                continue  # a is never followed by b here: the gadget changes nothing
            left[ab], made_at[ab], target[ab] = a, now, target[b]
            users[target[ab]] += 1
            old = target[a]
            if old == 0 or users[old] > 1:
                users[old] -= 1
                target[a] = len(lost)
                lost.append({})
                parent.append(old)
                since.append(now)
                users.append(1)
            lost[target[a]][b] = now
        self.target, self.left = np.array(target, np.int64), np.array(left, np.int64)
        self.made_at = np.array(made_at, np.int64)
        # Every state's own and inherited losses, as one sorted table (state, token) -> time.
        full: list[dict[int, int]] = []
        for s, own in enumerate(lost):
            held = {t: at for t, at in full[parent[s]].items() if at < since[s]} if parent[s] >= 0 else {}
            for t, at in own.items():
                held[t] = min(at, held.get(t, never))
            full.append(held)
        sizes = [len(x) for x in full]
        keys = np.repeat(np.arange(len(full), dtype=np.int64), sizes) * self.size + np.fromiter(chain.from_iterable(full), np.int64, sum(sizes))
        times = np.fromiter(chain.from_iterable(x.values() for x in full), np.int64, sum(sizes))
        order = np.argsort(keys)
        self.lost_keys, self.lost_times = np.append(keys[order], np.int64(2**62)), np.append(times[order], never).astype(np.int32)
        # The trie: (node, byte) -> node, and the token each node spells.
        nodes: dict[tuple[int, int], int] = {}
        spelled = [-1]
        for i in sorted(range(self.size), key=lambda i: tables.spelling[i]):
            if made_at[i] == never:
                continue
            node = 0
            for byte in tables.spelling[i]:
                if (step := nodes.get((node, byte))) is None:
                    step = nodes[node, byte] = len(spelled)
                    spelled.append(-1)
                node = step
            spelled[node] = i
        keys = np.array([n * 256 + b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self.step_keys, self.step_to = np.append(keys[order], np.int64(2**62)), np.append(np.array(list(nodes.values()), np.int64)[order], 0)
        self.spelled = np.array(spelled, np.int64)

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has the arc: no removal in time of the token, nor of what its left spine was when added."""
        ok = np.ones(len(state), bool)
        limit = np.full(len(state), 2**31 - 1, np.int64)
        todo = np.arange(len(state))
        state, token = state.copy(), token.copy()
        while len(todo):
            key = state * self.size + token
            at = np.searchsorted(self.lost_keys, key)
            bad = (self.lost_keys[at] == key) & (self.lost_times[at] <= limit)
            ok[todo[bad]] = False
            on = ~bad & (self.left[token] >= 0)
            limit, state, todo, token = self.made_at[token[on]], state[on], todo[on], self.left[token[on]]
        return ok

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        # last[p] is the last token of the encoding of the word's bytes up to p, back[p] where it begins.
        last = np.full(len(data), -1, np.int64)
        back = np.zeros(len(data), np.int64)
        start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        node = np.zeros(0, np.int64)
        begin = np.zeros(0, np.int64)
        word = np.zeros(0, np.int64)
        live = np.arange(len(words))
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            node = np.concatenate((node, np.zeros(len(live), np.int64)))
            begin = np.concatenate((begin, start[live] + step))
            word = np.concatenate((word, live))
            here = start[word] + step
            inside = step < lengths[word]
            node, begin, word, here = node[inside], begin[inside], word[inside], here[inside]
            key = node * 256 + data[here]
            at = np.searchsorted(self.step_keys, key)
            found = self.step_keys[at] == key
            node, begin, word, here = self.step_to[at[found]], begin[found], word[found], here[found]
            token = self.spelled[node]
            some = np.flatnonzero(token >= 0)
            token, b, h = token[some], begin[some], here[some]
            first = b == start[word[some]]
            state = np.where(first, 0, self.target[last[b - 1]])
            ok = self.allows(state, token)
            last[h[ok]], back[h[ok]] = token[ok], b[ok]
        # Walk back from every word's end, all at once; then turn the tokens round.
        at, out, owner = start + lengths - 1, [], []
        who = np.flatnonzero(lengths > 0)
        at = at[who]
        while len(at):
            out.append(last[at])
            owner.append(who)
            at = back[at] - 1
            more = at >= start[who]
            at, who = at[more], who[more]
        if not out:
            return [b""] * len(words)
        ids, owner = np.concatenate(out)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        begins = np.concatenate(([0], ends[:-1]))
        return [flat[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text that the ids' arcs spell; bytes that aren't UTF-8 become U+FFFD."""
        spelling = self.spelling
        return b"".join([spelling[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def splitter(specials: dict[str, int], newer: str = ""):
    """A function that yields, for a text, lists of pre-tokens and the ids of special strings, slice by slice."""
    import regex

    full, latin, plain = regex.compile(PATTERN), re.compile(LATIN_PATTERN), re.compile(LATIN)
    odd = regex.compile(newer) if newer else None
    older = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{newer}]").replace(r" ?\p{L}", rf" ?[\p{{L}}--{newer}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{newer}]")

    def pattern(piece: str):
        if plain.fullmatch(piece):
            return latin
        return regex.compile("(?V1)" + older) if odd and odd.search(piece) else full

    # A space between non-spaces begins a pre-token, whatever stands around it.
    safe = regex.compile(r"(?<=\S) (?=\S)")
    special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def words(text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (cut := safe.search(text, at + SLICE)):
                end = cut.start()
            piece = text[at:end] if at or end < len(text) else text
            yield pattern(piece).findall(piece)
            at = end

    def split(text: str) -> Iterator[list[str] | int]:
        at = 0
        for m in special.finditer(text) if special else ():
            yield from words(text[at : m.start()])
            yield specials[m.group()]
            at = m.end()
        yield from words(text[at:] if at else text)

    return split


def _known(memory: dict, work, pieces: list[list[str]]) -> None:
    """Let ``work`` answer for the words not in memory; start the memory anew when it is full."""
    new = {w for words in pieces for w in words if w not in memory}
    if not new:
        return
    if len(memory) > REMEMBERED:
        memory.clear()
        new = {w for words in pieces for w in words}
    listed = list(new)
    memory.update(zip(listed, work([w.encode("utf-8", "surrogatepass") for w in listed]), strict=True))


def _forget_long(memory: dict, pieces: list[list[str]]) -> None:
    for words in pieces:
        for w in words:
            if len(w) > LONGEST:
                memory.pop(w, None)


def token_counter(spark: SparkSession, path: str):
    """A column function: tokens of a text under the vocabulary file at ``path`` (null and empty texts: 0)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Tables(path))
    job = uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = shared.value
        memory = worker_cache(job)
        split = splitter(tables.specials, tables.newer)
        work = lambda words: count_symbols(tables, words).tolist()
        for texts in batches:
            out = []
            for group in _groups(texts):
                pieces = [[x for x in split(t)] for t in group]
                lists = [x for p in pieces for x in p if isinstance(x, list)]
                _known(memory, work, lists)
                get = memory.__getitem__
                out += [sum(sum(map(get, x)) if isinstance(x, list) else 1 for x in p) for p in pieces]
                _forget_long(memory, [[w for w in x if len(w) > LONGEST] for x in lists])
            yield pd.Series(out, dtype="int64")

    return count


def _groups(texts: pd.Series, most: int = 1 << 21) -> Iterator[list[str]]:
    """The batch's texts (null: empty) in runs of a few million characters."""
    run, size = [], 0
    for t in texts:
        run.append(t if isinstance(t, str) else "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, text: str | Column = "text") -> DataFrame:
    """Adds ``n_tokens`` to every row (a column of that name is replaced); null and empty texts have none."""
    return docs.withColumn("n_tokens", token_counter(spark, path)(F.col(text) if isinstance(text, str) else text))


def encode_texts(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds a struct ``bpe`` to every row: n_tokens, ids_sha256, decoded_sha256 and, on request, ids (little-endian u32).

    The decoded text is made from the ids alone. Null and empty texts have no ids.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(Tables(path)))
    job = uuid.uuid4().hex
    kind = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string" + (",ids:binary>" if keep_ids else ">")

    @F.pandas_udf(kind)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        memory = worker_cache(job)
        split = splitter(automaton.specials, automaton.newer)
        for texts in batches:
            rows = []
            for group in _groups(texts):
                pieces = [[x for x in split(t)] for t in group]
                lists = [x for p in pieces for x in p if isinstance(x, list)]
                _known(memory, automaton.encode, lists)
                get = memory.__getitem__
                for p in pieces:
                    ids = b"".join([b"".join(map(get, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in p])
                    decoded = automaton.decode(ids).encode()
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *([ids] if keep_ids else [])))
                _forget_long(memory, [[w for w in x if len(w) > LONGEST] for x in lists])
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return docs.withColumn("bpe", encode(F.col(text)))
