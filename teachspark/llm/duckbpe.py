"""Operator 12: byte-level BPE by DuckDB's recursive queries, one database in memory a Python worker.

A rank file (``token in base64, rank`` a line) becomes two DuckDB tables: ``merges`` (a pair of ids and
the id of their concatenation, for every cut of every token whose halves are tokens) and ``vocab``
(id and spelling). A worker cuts its texts into pre-tokens and sends those it has not met to DuckDB:

* Short words: a recursive query holds a row per token position. Each step joins every token with its
  right neighbour and the merge table, takes each word's pair of the lowest rank (the leftmost of
  those), lets the pair's first row become the merged token and drops the second. A word leaves the
  recursion when no pair of it is in the merge table: its last rows are its encoding.
* Words over ``LONG`` bytes would need as many steps as they have merges, each over the whole word.
  There a step contracts the lowest pair of every stretch: a pair whose rank no pair within the length of
  the longest token (of the word's bytes) undercuts. No token reaches further, and a merged token's pairs rank after the
  merge that made it (as in every vocabulary that merges made), so nothing else could have come
  first. In a run of pairs of one rank every other pair contracts, from the left. Each query takes
  ``STEPS`` steps, until no word changes.
* An ordered aggregation turns a word's rows into its ids, and another one spells the tokens by ``vocab``.

A text's words are strung together slice by slice, and digests are fed slice by slice, so a very
long text needs no more memory than a slice and its longest pre-token. Words and encodings are
remembered in a dictionary of bounded size that the job's end releases.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import splitter, unassigned_letters
from .common import bounded_batches, worker_cache

#: Words a generation of a worker's memory holds (there are two), and the longest word that it keeps (characters).
REMEMBERED, LONGEST = 250_000, 64
#: Bytes above which a word is contracted by stretches, and the steps of one query over such words.
LONG, STEPS = 128, 4
#: Rows that the steps of one recursive query may hold; and characters of texts worked on together.
ROWS, GROUP = 4_000_000, 1 << 21
#: Bits of a byte's place in a query; the merged token's rank stands above them.
PLACE = 40

_CONTRACT_WORDS = f"""
WITH RECURSIVE state(round, word, pos, stop, id) AS (
  SELECT 0, word, pos, pos + 1, id FROM letters
  UNION ALL
  (WITH best AS (
     SELECT a.word, min((m.made << {PLACE}) + a.pos) AS best,
            arg_min(b.pos, (m.made << {PLACE}) + a.pos) AS gone, arg_min(b.stop, (m.made << {PLACE}) + a.pos) AS stop
     FROM state a JOIN state b ON b.pos = a.stop JOIN merges m ON m.pair = (a.id << 32) + b.id
     GROUP BY a.word)
   SELECT s.round + 1, s.word, s.pos,
          CASE WHEN s.pos = h.best & {(1 << PLACE) - 1} THEN h.stop ELSE s.stop END,
          CASE WHEN s.pos = h.best & {(1 << PLACE) - 1} THEN h.best >> {PLACE} ELSE s.id END
   FROM state s JOIN best h ON s.word = h.word
   WHERE s.pos <> h.gone)),
last AS (SELECT word, max(round) AS round FROM state GROUP BY word),
tokens AS (SELECT s.word, s.pos, s.id FROM state s JOIN last l ON l.word = s.word AND l.round = s.round)
"""

_CONTRACT_STRETCHES = f"""
WITH RECURSIVE state(round, word, pos, stop, id) AS (
  SELECT 0, word, pos, stop, id FROM letters
  UNION ALL
  (WITH pairs AS (
     SELECT a.word, a.pos, b.pos AS gone, b.stop, m.made
     FROM state a JOIN state b ON b.pos = a.stop LEFT JOIN merges m ON m.pair = (a.id << 32) + b.id
     WHERE a.round < {STEPS}),
   low AS (
     SELECT *, made IS NOT NULL AND made = min(made) OVER near AS lowest, lag(made) OVER w = made AS like_last
     FROM pairs
     WINDOW w AS (PARTITION BY word ORDER BY pos), near AS (PARTITION BY word ORDER BY pos RANGE BETWEEN $reach PRECEDING AND $reach FOLLOWING)),
   run AS (
     SELECT *, sum(CASE WHEN lowest AND like_last AND last_lowest THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
     FROM (SELECT *, lag(lowest) OVER (PARTITION BY word ORDER BY pos) AS last_lowest FROM low)),
   hit AS (
     SELECT pos, gone, stop, made
     FROM (SELECT *, row_number() OVER r AS place, first_value(lowest AND like_last IS NOT TRUE) OVER r AS sound FROM run WINDOW r AS (PARTITION BY word, run ORDER BY pos))
     WHERE sound AND place % 2 = 1),
   busy AS (SELECT DISTINCT s.word FROM state s JOIN hit h ON s.pos = h.pos)
   SELECT s.round + 1, s.word, s.pos, coalesce(h.stop, s.stop), coalesce(h.made, s.id)
   FROM state s JOIN busy ON busy.word = s.word LEFT JOIN hit h ON h.pos = s.pos ANTI JOIN hit g ON g.gone = s.pos)),
last AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT s.word, s.pos, s.stop, s.id, s.round FROM state s JOIN last l ON l.word = s.word AND l.round = s.round
"""

_AGGREGATE = """
SELECT t.word, count(*) AS n, string_agg(t.id::VARCHAR, ' ' ORDER BY t.pos) AS ids, unhex(string_agg(v.spelling, '' ORDER BY t.pos)) AS text
FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.word
"""

_DECODE = """
SELECT t.row, unhex(string_agg(v.spelling, '' ORDER BY t.place)) AS text, count(v.id) = count(*) AS known
FROM ids t LEFT JOIN vocab v ON v.id = t.id GROUP BY t.row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens; on the driver (the vocabulary's size bounds it)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Ranks:
    """A vocabulary as the columns of the two DuckDB tables."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        cuts = [(a, b, made) for token, made in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, made = (np.array([c[k] for c in cuts], np.int64) for k in range(3))
        self.merges = pa.table({"pair": (left << 32) + right, "made": made})
        self.vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "spelling": [t.hex() for t in ranks]})
        self.whole = {t: i for t, i in ranks.items()}
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Tokens' lengths and the bytes they hold, longest first; one entry for each different pair.
        self.spans = sorted({(len(t), frozenset(t)) for t in ranks}, key=lambda x: -x[0])

    def reach(self, word: bytes) -> int:
        """No token of the word is longer: the longest token whose every byte the word has."""
        held = set(word)
        return next(n for n, used in self.spans if used <= held)


class Contractor:
    """A worker's DuckDB database in memory: one thread, no files, extensions or settings of its own."""

    def __init__(self, ranks: Ranks) -> None:
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoload_known_extensions": False, "autoinstall_known_extensions": False})
        for name in ("merges", "vocab"):
            self.db.register("given", getattr(ranks, name))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _letters(self, words: list[bytes]) -> pa.Table:
        """A row per byte; words stand a place apart, so that no pair crosses a border."""
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(word)) + word
        return pa.table({"word": word, "pos": pos, "stop": pos + 1, "id": self.ranks.letter[np.frombuffer(b"".join(words), np.uint8)]})

    def _answers(self, words: list[bytes], query: str) -> Iterator[tuple[int, str, bytes]]:
        found = {w: (n, ids, text) for w, n, ids, text in self.db.execute(query).fetchall()}
        return (found[i] for i in range(len(words)))

    def _short(self, words: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        self.db.register("letters", self._letters(words))
        return self._answers(words, _CONTRACT_WORDS + _AGGREGATE)

    def _long(self, words: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        """By stretches; words that no longer change are set aside between queries."""
        rows, done = self._letters(words), []
        query = _CONTRACT_STRETCHES.replace("$reach", str(max(map(self.ranks.reach, words))))
        while rows.num_rows:
            self.db.register("letters", rows)
            rows = self.db.sql(query).to_arrow_table()
            open_ = pa.compute.equal(rows["round"], STEPS)
            done.append(rows.filter(pa.compute.invert(open_)).select(["word", "pos", "id"]))
            rows = rows.filter(open_).select(["word", "pos", "stop", "id"])
        self.db.register("tokens", pa.concat_tables(done))
        return self._answers(words, _AGGREGATE)

    def encode(self, words: list[bytes]) -> list[tuple[int, str, bytes]]:
        """Per word: how many tokens, their ids (decimal, a space between them), and the bytes that these ids spell."""
        out: list[tuple[int, str, bytes]] = [(0, "", b"")] * len(words)
        whole = [i for i, w in enumerate(words) if w in self.ranks.whole]
        if whole:  # a word that is a token stays whole
            self.db.register("tokens", pa.table({"word": whole, "pos": whole, "id": [self.ranks.whole[words[i]] for i in whole]}))
            for i, n, ids, text in self.db.execute(_AGGREGATE).fetchall():
                out[i] = (n, ids, text)
        rest = [i for i, w in enumerate(words) if w and w not in self.ranks.whole]
        over = sorted((i for i in rest if len(words[i]) > LONG), key=lambda i: self.ranks.reach(words[i]))
        for work, which in ((self._short, [i for i in rest if len(words[i]) <= LONG]), (self._long, over)):
            some, rows = [], 0
            for k, i in enumerate(which):
                some.append(i)
                rows += len(words[i]) * (len(words[i]) if work == self._short else STEPS)
                if rows >= ROWS or k == len(which) - 1:
                    for j, answer in zip(some, work([words[j] for j in some]), strict=True):
                        out[j] = answer
                    some, rows = [], 0
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes | None]:
        """The bytes each list of ids spells; None where an id is not in the vocabulary."""
        sizes = np.array([len(x) for x in ids], np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        self.db.register("ids", pa.table({"row": row, "place": np.arange(len(row)), "id": np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)}))
        out: list[bytes | None] = [b""] * len(ids)
        for i, text, known in self.db.execute(_DECODE).fetchall():
            out[i] = text if known else None
        return out


class Memory:
    """Two generations of answers: when the younger is full it becomes the elder, and words met again move on."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, words: set[str], work) -> dict:
        """Answers of all the words; new ones come from ``work``."""
        out, new = {}, []
        for w in words:
            answer = self.young.get(w)
            if answer is None and (answer := self.old.get(w)) is not None:
                self.young[w] = answer
            if answer is None:
                new.append(w)
            else:
                out[w] = answer
        for w, answer in zip(new, work([w.encode("utf-8", "surrogatepass") for w in new]) if new else (), strict=True):
            out[w] = answer
            if len(w) <= LONGEST:
                self.young[w] = answer
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return out


def _slices(texts: pd.Series, split) -> Iterator[list[tuple[int, list[str]]]]:
    """Groups of (row, words of a slice of its text) with about GROUP characters each; null is empty."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for words in split(text if isinstance(text, str) else ""):
            group.append((row, words))
            size += sum(map(len, words))
            if size >= GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode_ranks(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds a struct ``bpe`` to every row: n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array of long).

    ``path`` names a rank file, on the driver. ids_sha256 is of the decimal ids joined by a space,
    decoded_sha256 of the bytes that the ids spell. Null and empty texts have no ids. Repeated rows
    are each encoded; other columns pass through, a column ``bpe`` is replaced; an empty table stays empty.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Ranks(read_ranks(path)))
    job = uuid.uuid4().hex
    kind = "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string" + (",ids:array<long>>" if keep_ids else ">")

    @F.pandas_udf(kind)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = worker_cache(job)
        if not held:
            held.update(db=Contractor(shared.value), memory=Memory())
        db, memory = held["db"], held["memory"]
        split = splitter({}, unassigned_letters())
        for texts in batches:
            n = np.zeros(len(texts), np.int64)
            ids = [hashlib.sha256() for _ in range(len(texts))]
            spelled = [hashlib.sha256() for _ in range(len(texts))]
            kept: list[list[int]] = [[] for _ in range(len(texts))]
            for group in _slices(texts, split):
                known = memory.look_up({w for _, words in group for w in words}, db.encode)
                for row, words in group:
                    answers = [known[w] for w in words]
                    string = " ".join([a[1] for a in answers])
                    ids[row].update((" " + string if n[row] else string).encode())
                    spelled[row].update(b"".join([a[2] for a in answers]))
                    n[row] += sum([a[0] for a in answers])
                    if keep_ids:
                        kept[row] += map(int, string.split())
            out = {"n_tokens": n, "ids_sha256": [x.hexdigest() for x in ids], "decoded_sha256": [x.hexdigest() for x in spelled]}
            yield pd.DataFrame(out | ({"ids": kept} if keep_ids else {}))

    return docs.withColumn("bpe", encode(F.col(text)))


def decode_ranks(spark: SparkSession, rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that a row's ids spell, by an ordered aggregation of DuckDB.

    Null where ids are null, hold a null, or an id that the vocabulary lacks; no ids spell no bytes.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Ranks(read_ranks(path)))
    job = uuid.uuid4().hex

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = worker_cache(job)
        if not held:
            held["db"] = Contractor(shared.value)
        for lists in batches:
            out: list[bytes | None] = []
            for at in range(0, len(lists), 256):
                out += held["db"].decode([np.asarray(x, np.int64) for x in lists.iloc[at : at + 256]])
            yield pd.Series(out, dtype=object)

    sound = F.col(ids).isNotNull() & ~F.exists(ids, lambda x: x.isNull())
    return rows.withColumn("decoded", F.when(sound, decode(F.when(sound, F.col(ids)).otherwise(F.array().cast("array<long>")))))
