"""Operator 11: vector codes by a product of codebooks, fitted by Lloyd's rounds over active entries.

Components become integers (``floor(SCALE * x)``), so every distance is exact. A vector is cut into
consecutive parts; each part position has a codebook that starts as that part of the vectors with the
smallest ids. A round is one pass over the table, in numpy blocks, without a shuffle of the vectors:

* A part whose entry stayed where it was keeps its stored distance; of the other entries only those
  that moved can have come nearer, so it compares those alone (equal distances: the lower index).
* A part whose entry moved compares the whole codebook.

Each pass writes a table in the shared folder: the vectors with their entries and distances, the next
pass's input, and after them per task one row for each entry in use (component sums and a count). Those rows are summed
by Spark; their size is bounded by the codebooks, so the sums go to the driver, which floors the means and
broadcasts the codebooks with the entries that moved.

Rows whose vector is null, or holds a null or non-finite component, are dropped. Vectors of different
lengths can't be compared: each length has codebooks of its own; a length that the number of parts
doesn't divide makes the first parts one component longer. Integers beyond ``2**30 / sqrt(length)``
(131,072 times SCALE at 64 components) are held there, so that no distance overflows. Null ids stand behind all others; equal
ids are told apart by their vectors, equal rows are each coded. With fewer vectors than entries the
codebook is that much smaller; an empty table has no codes. Other columns pass through ``keep``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget

#: Components are multiplied by this before they are floored.
SCALE = 1024
#: Vectors compared at once: bounds a task's distance matrix.
BLOCK = 4096
#: Labels whose error sums are broadcast; more of them are joined by a shuffle.
BROADCAST_LABELS = 100_000


def borders(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and the last one ends."""
    return [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]


def integers(values: np.ndarray, length: int) -> np.ndarray:
    """``floor(SCALE * x)`` as integers, held within the bound under which a vector's squared distance fits 63 bits."""
    most = math.isqrt((1 << 60) // max(1, length))
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances; by floating point where every step of it is exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[None, :, k]) ** 2
    return out


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, dist: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each part; ``code`` and ``dist`` are those before entries moved (None: none yet)."""
    code = np.zeros(len(x), np.int64) if code is None else code.astype(np.int64)
    dist = np.full(len(x), -1, np.int64) if dist is None else dist.astype(np.int64)
    stale = (dist < 0) | moved[code]
    active = np.flatnonzero(moved)
    for rows, entries in ((np.flatnonzero(stale), np.arange(len(book))), (np.flatnonzero(~stale), active)):
        if not len(entries):
            continue
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            d = distances(x[some], book[entries])
            best = d.argmin(1)  # the lowest index of the nearest
            near, which = d[np.arange(len(some)), best].astype(np.int64), entries[best]
            better = (dist[some] < 0) | stale[some] | (near < dist[some]) | ((near == dist[some]) & (which < code[some]))
            code[some] = np.where(better, which, code[some])
            dist[some] = np.where(better, near, dist[some])
    return code, dist


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and each row's length of an Arrow list column without nulls."""
    return array.flatten().to_numpy(zero_copy_only=False), array.value_lengths().to_numpy(zero_copy_only=False)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _pass(state: DataFrame, books: dict, parts: int, name: str) -> DataFrame:
    """Assign every vector under the codebooks; ``books``: length -> per part (entries, which of them moved)."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(books)
    fields = [*state.schema["__row"].dataType.fields]
    schema = T.StructType([T.StructField("__row", T.StructType(fields)), *T._parse_datatype_string("x array<long>, code array<int>, dist array<long>, length int, part int, entry int, sums array<long>, n long").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = shared.value, None
        total = {(length, p): (np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)) for length, pairs in held.items() for p, (book, _) in enumerate(pairs)}
        row_type = None
        for batch in batches:
            row_type = batch.schema.field("__row").type
            flat, lengths = _lists(batch.column("x"))
            starts = np.cumsum(lengths) - lengths
            first = batch.column("code").null_count == batch.num_rows
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                x = flat[starts[rows, None] + np.arange(length)[None]]
                old = None if first else [_lists(batch.column(c).take(pa.array(rows)))[0].reshape(-1, parts) for c in ("code", "dist")]
                code, dist = np.zeros((len(rows), parts), np.int32), np.zeros((len(rows), parts), np.int64)
                at = borders(length, parts)
                for p, (book, moved) in enumerate(held[length]):
                    part = x[:, at[p] : at[p + 1]]
                    code[:, p], dist[:, p] = assign(part, book, moved, *((None, None) if old is None else (old[0][:, p], old[1][:, p])))
                    np.add.at(total[length, p][0], code[:, p], part)
                    total[length, p][1][:] += np.bincount(code[:, p], minlength=len(book))
                out = pa.table({
                    "__row": batch.column("__row").take(pa.array(rows)), "x": _fixed(x), "code": _fixed(code), "dist": _fixed(dist),
                    "length": pa.nulls(len(rows), pa.int32()), "part": pa.nulls(len(rows), pa.int32()), "entry": pa.nulls(len(rows), pa.int32()),
                    "sums": pa.nulls(len(rows), pa.list_(pa.int64())), "n": pa.nulls(len(rows), pa.int64()),
                })
                yield from out.to_batches()
        if row_type is None:
            return
        used = [(length, p, e, sums[e].tolist(), int(n[e])) for (length, p), (sums, n) in total.items() for e in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), row_type), pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.list_(pa.int32())), pa.nulls(len(used), pa.list_(pa.int64()))]
            + [pa.array([u[k] for u in used], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()))],
            names=["__row", "x", "code", "dist", "length", "part", "entry", "sums", "n"],
        )

    return cut(state.mapInArrow(work, schema), name)


def _updated(done: DataFrame, books: dict, parts: int) -> dict:
    """Codebooks after a pass: floored means of the parts assigned, entries without parts unchanged."""
    rows = (
        done.where("part is not null")
        .select("length", "part", "entry", F.posexplode_outer("sums").alias("place", "value"), "n")
        .groupBy("length", "part", "entry", "place")
        .agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"), F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        .collect()
    )
    new = {length: [(book.copy(), None) for book, _ in pairs] for length, pairs in books.items()}
    for r in rows:
        if r["place"] is not None:
            new[r["length"]][r["part"]][0][r["entry"], r["place"]] = int(r["value"]) // int(r["n"])
    return {length: [(b, (b != old).any(1)) for (b, _), (old, _) in zip(pairs, books[length], strict=True)] for length, pairs in new.items()}


def fit_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes of every kept row, and the codebooks by vector length.

    The rows have ``vec_id`` and the columns of ``keep``, then ``code`` and ``dist`` (arrays over the parts: entry,
    squared distance) and ``length``. At most 256 entries a codebook. See the module's text for edge cases.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("between 1 and 256 entries, at least one part")
    spark: SparkSession = vectors.sparkSession
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    row = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys((vec_id, *keep))])
    raw = vectors.where(sound).select(row.alias("__row"), F.col(vector).cast("array<double>").alias("__v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _lists(batch.column("__v"))
            x = np.concatenate([np.zeros(0, np.int64), *(integers(flat[i : i + n], n) for i, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True))])
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=["__row", "x", "code", "dist"]
            )

    schema = T.StructType([T.StructField("__row", raw.schema["__row"].dataType), *T._parse_datatype_string("x array<long>, code array<int>, dist array<long>").fields])
    state = cut(raw.mapInArrow(whole, schema), "lloyd-integers")
    books: dict[int, list] = {}
    for (length,) in state.select(F.size("x")).distinct().collect():
        first = state.where(F.size("x") == length).orderBy(F.col(f"__row.`{vec_id}`").asc_nulls_last(), "x").limit(entries).select("x").collect()
        at, start = borders(length, parts), np.array([r["x"] for r in first], np.int64).reshape(len(first), length)
        books[length] = [(start[:, at[p] : at[p + 1]], np.ones(len(first), bool)) for p in range(parts)]
    for k in range(rounds + 1):
        done = _pass(state, books, parts, f"lloyd-{k}")
        forget(state)
        if k < rounds:
            books = _updated(done, books, parts)
        state = done.where("part is null").select("__row", "x", "code", "dist")
    return state.select("__row.*", "code", "dist", F.size("x").alias("length")), {length: [b for b, _ in pairs] for length, pairs in books.items()}


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all entries' integers in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Per kept row: vec_id, code (two hex digits a part), error, label_error (error over equal labels), codebooks_sha256."""
    codes, books = fit_codes(vectors, vec_id, vector, (label,), parts, entries, rounds)
    spark = vectors.sparkSession
    rows = codes.select(
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("__label"),
        F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"),
        "length",
    )
    sums = cut(rows.groupBy("__label").agg(F.sum("error").alias("label_error")), "lloyd-labels")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    marks = spark.createDataFrame([(n, digest(b)) for n, b in books.items()], "length int, codebooks_sha256 string")
    out = rows.alias("r").join(side.alias("s"), F.col("r.__label").eqNullSafe(F.col("s.__label"))).join(F.broadcast(marks), "length")
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same as DuckDB SQL by plain rescans, for vectors of one length that the number of parts divides."""
    ctes = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)",
        "numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row FROM kept)",
        f"cuts AS (SELECT row, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM numbered, range({parts}) t(p))",
        f"book0 AS (SELECT p, row - 1 AS e, v FROM cuts WHERE row <= {entries})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"near{k} AS (SELECT c.row, c.p, any_value(c.v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS best "
            f"FROM cuts c JOIN book{k} b USING (p) GROUP BY c.row, c.p)"
        )
        if k < rounds:
            ctes += [
                f"means{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m "
                f"FROM (SELECT p, best.e AS e, unnest(v)::HUGEINT AS y, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e)",
                f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v)::BIGINT[] AS v FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)",
            ]
    return (
        "WITH " + ", ".join(ctes) + ", "
        f"coded AS (SELECT row, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row), "
        f"mark AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}) "
        "SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM numbered JOIN coded USING (row), mark"
    )
