"""Operator 8: shards as runs of a Hilbert curve over several metadata dimensions.

Each dimension is cut at its own quantiles into ``2**bits`` ranges, the ranges are the coordinates
of a point on a Hilbert curve, rows are ordered by their place on the curve and the order is cut
into equal runs. Rows near each other in all dimensions land in the same run, so the minimum and
maximum that a Parquet file keeps of each dimension skip most files for a filter on any of them.

Native: DataFrame functions only. No sort of the whole table is needed: the place of a row is the
count of rows in curve cells before its own, plus the count in hash buckets of its cell before its
own, plus its place in its bucket. A cell that holds a third of all rows has as many more buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Bits of a dimension: 2**BITS quantile ranges each, and 2**(BITS * dimensions) cells at most.
BITS = 4
#: Rows that a bucket holds on average; buckets are what one window sorts.
ROWS_PER_BUCKET = 2000


def _hex(col: Column) -> Column:
    """The UTF-8 bytes in hexadecimal, which sorts as the string does (null as empty)."""
    return F.hex(F.encode(F.coalesce(col, F.lit("")), "UTF-8"))


def _number(digits: Column) -> Column:
    """Up to twelve hexadecimal digits as a number that sorts as they do."""
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("bigint")


def string_cuts(df: DataFrame, col: str, at: list[float], accuracy: int = 10_000) -> list[str]:
    """Quantiles of a column of hexadecimal strings, over all rows: prefixes of values, as long as it takes to tell them apart.

    Six bytes are a number, so a round takes quantiles of numbers. Where several quantiles fall on the
    same six bytes and some value goes on behind them, another round looks at the next six bytes of
    those rows. There are at most ``len(at)`` open prefixes, and no more rounds than the longest value has steps of six bytes.
    """
    total = df.count()
    if not total:
        return []
    found: dict[int, str] = {}
    open_ = {"": list(range(len(at)))}  # prefix -> numbers of the quantiles that lie on it
    while open_:
        prefixes = sorted(open_)
        step = len(prefixes[0])
        on = [F.substring(col, 1, step) == p for p in prefixes]
        sums = [F.sum((F.substring(col, 1, step) < p).cast("long")).alias(f"below{i}") for i, p in enumerate(prefixes)]
        sums += [F.sum(m.cast("long")).alias(f"on{i}") for i, m in enumerate(on)]
        row = df.agg(*sums).first()
        asked = []
        for i, p in enumerate(prefixes):
            share = [min(1.0, max(0.0, (at[q] * total - row[f"below{i}"]) / max(1, row[f"on{i}"]))) for q in open_[p]]
            asked.append(F.percentile_approx(F.when(on[i], _number(F.substring(col, step + 1, 12))), share, accuracy).alias(f"q{i}"))
        row = df.agg(*asked).first()
        next_: dict[str, list[int]] = {}
        for i, p in enumerate(prefixes):
            for q, value in zip(open_[p], row[f"q{i}"], strict=True):
                next_.setdefault(p + f"{value:012X}", []).append(q)
        found |= {q: p for p, qs in next_.items() for q in qs}
        several = sorted(p for p, qs in next_.items() if len(qs) > 1)
        if not several:
            break
        longer = df.agg(*[F.max(F.when(F.substring(col, 1, len(p)) == p, F.length(col))).alias(f"n{i}") for i, p in enumerate(several)]).first()
        open_ = {p: next_[p] for i, p in enumerate(several) if (longer[f"n{i}"] or 0) > len(p)}
    return [found[q] for q in range(len(at))]


def _string_range(col: Column, cuts: list[str]) -> Column:
    """The number of cuts that lie below the value's beginning of the same length."""
    total = F.lit(0)
    for c in cuts:
        total = total + (F.substring(col, 1, len(c)) > c).cast("int")
    return total


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve of ``dims`` dimensions as an automaton.

    A state is an entry corner and a direction; from ``state * 2**dims + orthant`` the lists give
    the orthant's place on the curve and the state inside it. Built by the rules of Gray codes:
    rotate and reflect the orthant into the state's frame, and its place is the inverse Gray code.
    """
    n, side = dims, 1 << dims
    turn_left = lambda x, k: ((x << k % n) | (x >> (n - k % n) % n)) & (side - 1) if k % n else x
    turn_right = lambda x, k: turn_left(x, n - k % n)
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    step = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n
    place, state = [0] * (side * n * side), [0] * (side * n * side)
    for corner in range(side):
        for direction in range(n):
            s = corner * n + direction
            for orthant in range(side):
                w = t = turn_right(orthant ^ corner, direction + 1)
                while t := t >> 1:
                    w ^= t
                place[s * side + orthant] = w
                state[s * side + orthant] = (corner ^ turn_left(entry(w), direction + 1)) * n + (direction + step(w) + 1) % n
    return place, state


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point with ``bits``-bit coordinates, walked bit by bit through the table."""
    n, side = len(coords), 1 << len(coords)
    place, state = (F.array(*map(F.lit, t)) for t in curve_table(n))
    point = F.array(*[c.cast("int") for c in coords])
    orthants = F.transform(
        F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)),
        lambda b: F.aggregate(point, F.lit(0), lambda acc, x: acc * 2 + F.pmod(F.floor(x / F.pow(F.lit(2.0), b)).cast("int"), F.lit(2))),
    )
    walk = F.aggregate(
        orthants,
        F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("s"), place.alias("p"), state.alias("t")),
        lambda acc, o: F.struct(
            (acc["h"] * side + F.get(acc["p"], acc["s"] * side + o)).alias("h"),
            F.get(acc["t"], acc["s"] * side + o).alias("s"),
            acc["p"].alias("p"),
            acc["t"].alias("t"),
        ),
    )
    return walk["h"]


def _range_of(key: Column, cuts: list[int]) -> Column:
    """In which range between the cuts the key lies: the number of cuts below it."""
    return F.size(F.filter(F.array(*[F.lit(int(x)).cast("bigint") for x in cuts]), lambda x: x < key))


def hilbert_shards(
    df: DataFrame, dims: dict[str, Column], shards: int, tie: str, bits: int = BITS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Adds ``hilbert`` (place on the curve), ``shard`` and ``slot`` to every row of ``df``.

    ``dims`` gives a key for each dimension, a number or a string (null counts as the least value, or
    the empty string). Shards hold row counts at most one apart; ``slot`` runs without gaps from 0 in
    each. Ties on the curve are ordered by a hash of the row, then by ``tie`` and the other columns;
    rows equal in all columns are interchangeable. An empty table gives an empty table. Existing
    columns named like the added ones are replaced, and ``__``-prefixed helper columns are dropped
    from the result. ``df`` is read several times, so give it narrow (texts replaced by their
    measures; strings of any length may stay) and written.
    """
    df = df.drop("hilbert", "shard", "slot")
    columns = [tie, *[c for c in df.columns if c != tie]]
    names = {f"__d{i}": k for i, k in enumerate(dims.values())}
    text = {k for k, t in df.select(*[c.alias(k) for k, c in names.items()]).dtypes if t == "string"}
    keys = {k: _hex(c) if k in text else F.coalesce(c.cast("bigint"), F.lit(-(2**62))) for k, c in names.items()}
    keyed = df.withColumns(keys)
    at = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [F.percentile_approx(k, at, 10_000).alias(k) for k in keys if k not in text]
    row = keyed.agg(F.count("*").alias("n"), *numbers).first()
    n = row["n"]
    if not n:
        return df.withColumns({"hilbert": F.lit(None).cast("bigint"), "shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("bigint")})
    coords = [_string_range(F.col(k), string_cuts(keyed.select(k), k, at)) if k in text else _range_of(F.col(k), row[k]) for k in keys]
    # A cell's number holds its coordinates, so a row carries one integer and the curve is walked once a cell.
    cell = F.lit(0).cast("bigint")
    for c in coords:
        cell = cell * 2**bits + c
    celled = cut(keyed.withColumn("__cell", cell).select(*df.columns, "__cell"), "shard-cells")

    # At most 2**(bits * dimensions) rows, so broadcasting them and one task's window over them are bounded.
    cells = celled.groupBy("__cell").agg(F.count("*").alias("__rows"))
    apart = [F.pmod(F.shiftright("__cell", bits * (len(coords) - 1 - i)), F.lit(2**bits)) for i in range(len(coords))]
    cells = cells.withColumn("hilbert", hilbert_index(apart, bits))
    cells = cells.withColumn("__before", F.sum("__rows").over(W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)))
    cells = cells.select("__cell", "hilbert", F.coalesce("__before", F.lit(0)).alias("__before"), F.ceil(F.col("__rows") / rows_per_bucket).alias("__buckets"))
    cells = cut(cells, "shard-curve")
    df = celled.join(F.broadcast(cells), "__cell")
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*columns), F.col("__buckets"))).drop("__cell", "__buckets")

    buckets = df.groupBy("hilbert", "__bucket").agg(F.count("*").alias("__rows"))
    earlier = W.partitionBy("hilbert").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select("hilbert", "__bucket", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__inside"))
    df = df.join(buckets, ["hilbert", "__bucket"])
    inside = F.row_number().over(W.partitionBy("hilbert", "__bucket").orderBy(*columns))
    df = df.withColumn("__place", F.col("__before") + F.col("__inside") + inside - 1)
    df = df.withColumn("shard", F.floor(F.col("__place") * shards / F.lit(n)).cast("int") if n * shards < 2**52 else F.expr(f"__place * {shards} div {n}").cast("int"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    df = df.withColumn("slot", F.col("__place") - first)
    return df.select(*[c for c in columns], "hilbert", "shard", "slot")


def _measures() -> dict[str, Column]:
    return {
        "doc_id": F.col("doc_id"),
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1,
        "text_crc32": F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint"),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }


def document_measures(docs: DataFrame) -> DataFrame:
    """What sharding needs of documents: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, lang and source."""
    return docs.select(*[c.alias(name) for name, c in _measures().items()])


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All documents in ``shards`` runs of a Hilbert curve over language, source and size (law ``rows``).

    Null texts count as empty (size 1, crc 0); null languages and sources sort first; a null doc_id
    is a value like any other, and rows repeated under one id are placed each. A very long text is
    one row like any other (the law counts rows). Other columns are not read, whatever their names.
    The texts are read once: the rest works on a written table of measures.
    """
    rows = cut(document_measures(docs), "shard-measures")
    return hilbert_shards(rows, {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")}, shards, "doc_id")


#: Rows of a file that :func:`write_shards` makes, unless told otherwise.
ROWS_PER_FILE = 50_000


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``docs`` as one folder a shard, rows in slot order, so that file statistics prune by every dimension.

    A shard is cut into runs of ``rows_per_file`` slots, each one file, and the runs are dealt over
    the shuffle's tasks: a shard is as many tasks' work as it has runs.

    ``sharded`` is what :func:`shard_documents` gives for these rows. Ids may be null or repeated: rows
    are matched by all that was measured, and rows equal in that by their number among them, so each
    is written once.
    """
    keys = ["doc_id", "size", "text_crc32", *[c for c in ("lang", "source") if c in docs.columns]]
    number = lambda by, *order: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    measures = _measures()
    mine = [f"__m{i}" for i in range(len(keys))]
    rows = docs.withColumns({m: measures[k] for m, k in zip(mine, keys, strict=True)}).withColumn("__number", number(mine, F.xxhash64(*docs.columns)))
    there = [f"__s{i}" for i in range(len(keys))]
    slots = sharded.select(*[F.col(k).alias(t) for k, t in zip(keys, there, strict=True)], F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    slots = slots.withColumn("__nth", number(there, "__shard", "__slot"))
    match = F.col("__number") == F.col("__nth")
    for m, t in zip(mine, there, strict=True):
        match &= F.col(m).eqNullSafe(F.col(t))
    joined = rows.join(slots, match).select(*[c for c in docs.columns if c not in ("shard", "slot")], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    run = F.floor(F.col("slot") / rows_per_file)
    # In a task the runs of a shard follow each other whole (only a shard's last is shorter), so files end where runs do.
    tasks = joined.repartition("shard", run).sortWithinPartitions("shard", "slot")
    tasks.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
