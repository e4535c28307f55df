"""Operator 8: the curve, the law and the edges."""

import itertools
import random
from zlib import crc32

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from teachspark.llm.sharding import curve_table, hilbert_index, hilbert_shards, shard_documents, string_cuts, write_shards


def test_curve_visits_every_cell_in_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = list(itertools.product(range(2**bits), repeat=dims))
        df = spark.createDataFrame(points, ", ".join(f"d{i} int" for i in range(dims)))
        order = [tuple(r)[:dims] for r in df.withColumn("h", hilbert_index([F.col(f"d{i}") for i in range(dims)], bits)).orderBy("h").collect()]
        assert sorted(order) == sorted(points)
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(order))
    place, state = curve_table(3)
    assert len(place) == len(state) == 8 * 3 * 8


def law_holds(rows, shards):
    n = len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_rows_are_even_with_a_hot_cell(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("a"), (F.col("id") % 7).alias("b"))
    for shards in (1, 7, 16):
        rows = hilbert_shards(df, {"a": F.col("a"), "b": F.col("b")}, shards, "doc_id", rows_per_bucket=50).collect()
        law_holds(rows, shards)
        # Shards are runs of the curve.
        ends = sorted((r.shard, r.hilbert) for r in rows)
        assert all(a[1] <= b[1] for a, b in itertools.pairwise(ends) if a[0] != b[0])


def test_edges(spark, edge_docs, no_docs, tmp_path):
    rows = shard_documents(edge_docs).collect()
    law_holds(rows, 16)
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == crc32(texts[r.doc_id].encode()) for r in rows)
    assert shard_documents(no_docs).count() == 0
    named = edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    write_shards(named.select("doc_id", "text"), shard_documents(named), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == named.count()


def test_files_hold_rows_with_null_and_repeated_ids_once(spark, tmp_path):
    rows = [(None, f"text {i}", "en", "a") for i in range(6)] + [(None, "copy", "en", None)] * 3 + [(1, f"t{i}", None, "b") for i in range(4)] + [(2, "same", "en", "b")] * 3
    rows += [(3, "same", lang, "b") for lang in ("en", "de", None)] + [(None, None, None, None), (None, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for number, df in enumerate((docs, docs.select("doc_id", "text"))):
        path = str(tmp_path / str(number))
        write_shards(df, shard_documents(docs, 4), path)
        out = spark.read.parquet(path)
        assert sorted((tuple(r) for r in out.select(*df.columns).collect()), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
        law_holds(out.collect(), 4)


def test_string_cuts_see_past_common_prefixes(spark):
    rng = random.Random(4)
    shared = "https://example.org/collections/"
    values = [shared + f"{rng.randrange(900):03}" for _ in range(4000)] + [shared + "heavy"] * 2000 + ["", "a", "zz"] * 50 + ["äö"] * 40
    df = spark.createDataFrame([(v.encode().hex().upper(),) for v in values], "h string")
    at = [i / 16 for i in range(1, 16)]
    cuts = string_cuts(df, "h", at)
    assert cuts == sorted(cuts)
    ordered = sorted(v.encode().hex().upper() for v in values)
    # The range of each row by brute force; away from the heavy value the ranges are near equal.
    ranges = [sum(h[: len(c)] > c for c in cuts) for h in ordered]
    assert ranges == sorted(ranges)
    sizes = [ranges.count(r) for r in set(ranges)]
    assert len(sizes) >= 10 and sorted(sizes)[-2] <= 2 * len(values) / 16
    assert string_cuts(df.limit(0), "h", at) == []


def plain_place(rows, dims, shards, bits):
    """Cell ranges and curve order by brute force: rows in order of the curve, cut at i * shards // n."""
    place, state = curve_table(len(dims))
    side = 1 << len(dims)

    def walk(point):
        h, s = 0, 0
        for b in range(bits - 1, -1, -1):
            o = 0
            for x in point:
                o = o * 2 + (x >> b & 1)
            h, s = h * side + place[s * side + o], state[s * side + o]
        return h

    points = {i: [] for i in range(len(rows))}
    for d in dims:
        values = sorted(r[d] for r in rows)
        cuts = [values[max(0, -(-len(values) * q // 2**bits) - 1)] for q in range(1, 2**bits)]
        for i, r in enumerate(rows):
            points[i].append(sum(c < r[d] for c in cuts))
    curve = {i: walk(p) for i, p in points.items()}
    order = sorted(curve.values())
    return curve, [h for h in order]


def test_placement_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [{"doc_id": i, "a": rng.choice(["", "de", "en", "shared/prefix/x", "shared/prefix/y"]), "b": rng.randrange(400), "c": rng.choice([1, 1, 1, 50, rng.randrange(99)])} for i in range(1500)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, a string, b long, c long")
    curve, order = plain_place(rows, ["a", "b", "c"], 16, 3)
    got = hilbert_shards(df, {k: F.col(k) for k in "abc"}, 16, "doc_id", bits=3, rows_per_bucket=40).collect()
    law_holds(got, 16)
    assert {r.doc_id: r.hilbert for r in got} == curve
    first = [-(-s * len(rows) // 16) for s in range(16)]
    assert all(order[first[r.shard] + r.slot] == r.hilbert for r in got)


def test_null_and_repeated_ids_fill_many_buckets(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("doc_id"), F.col("id").alias("size"), F.lit(5).alias("a"))
    rows = hilbert_shards(df, {"a": F.col("a")}, 4, "doc_id", rows_per_bucket=50)
    law_holds(rows.collect(), 4)
    again = hilbert_shards(df.repartition(5), {"a": F.col("a")}, 4, "doc_id", rows_per_bucket=50)
    assert rows.exceptAll(again).isEmpty() and again.exceptAll(rows).isEmpty()


def test_files_are_skipped_by_every_dimension(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "w" * rng.randrange(1, 300), rng.choice("abcdefgh"), "http://host/" + str(rng.randrange(100, 180))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.octet_length("text"))
    path = tmp_path / "shards"
    write_shards(docs, shard_documents(docs, 16), str(path), rows_per_file=60)
    files = [pq.ParquetFile(f) for f in path.rglob("*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 6000 and all(f.metadata.num_rows <= 60 for f in files) and 96 <= len(files) <= 112

    def may_hold(f, column, low, high):
        group = f.metadata.row_group(0)
        (s,) = [group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == column]
        return s.min <= high and s.max >= low

    for column, low, high in (("lang", "c", "c"), ("source", "http://host/120", "http://host/124"), ("size", 40, 50)):
        assert sum(may_hold(f, column, low, high) for f in files) <= 0.5 * len(files), column
