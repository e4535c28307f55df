"""The pipeline's stages: columns, decisions, edges, and the whole run."""

import random
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "bpe_encoding"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A small corpus with toxic documents, copies, near copies, leaks and personal data, beside clean ones."""
    rng = random.Random(9)
    words = [a + b + c for a in "ta re lo mi su".split() for b in "na ke po ri".split() for c in "st l m nd".split()]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(i, prose(30)) for i in range(8)]
    rows, kind = [], {}

    def add(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, rng.choice(["en", None]), rng.choice(["a", "b"]), len(text) if text is not None else None))

    for i in range(300):
        add(f"{prose(40)}. {prose(30)}{' vilek gromp skaz' if i % 8 == 0 else ''}. {prose(9)}", "toxic" if i % 8 == 0 else "clean")
    for i in range(12):
        base = [d for d in range(300) if kind[d] == "clean"][i]
        add(rows[base][1], "copy")
        add(rows[base][1] + " extra", "copy")
        add(f"{prose(30)} {bench[i % 8][1].upper()} {prose(30)}", "leak")
        add(f"{prose(40)} write to a{i}@mail.example.com or +1 (212) 555-{i:04d} {prose(5)}", "pii")
    for text in (None, "", " "):
        add(text, "clean")
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(d, int(rng.random() < 0.5), int(w == "toxic")) for d, w in kind.items() if d < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}, kind


def test_whole_run_on_planted_cases(spark, planted):
    folder, rows, kind = planted
    out = {r.doc_id: r for r in P.run(spark, folder).collect()}
    assert set(out) == {d for d, w in kind.items() if w in ("clean", "pii")}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in out.items():
        text = rows[d][1] or ""
        if kind[d] == "pii":
            text = re.sub(r"\+1 \(212\) 555-\d{4}", "[PHONE]", re.sub(r"a\d+@mail\.example\.com", "[EMAIL]", text))
            assert "[EMAIL] or [PHONE]" in text
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert r.n_chars == (None if rows[d][1] is None else len(text))


def test_each_stage_keeps_columns_and_takes_edges(spark, planted, edge_docs):
    folder = planted[0]
    docs = edge_docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        # of the row that is there twice near-dedup leaves one
        assert out.count() == docs.count() - (name == "minhash_near_dedup")
        assert stage(spark, docs.limit(0), folder).count() == 0
    last = P.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and "ids" in last.columns


def test_whole_run_on_given_tables(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
    assert "corpus_pipeline" in sys.modules


def test_null_and_repeated_ids_are_judged_by_their_text(spark, planted):
    """Null and repeated ids beside leaks and copies: each row goes or stays by its own text."""
    folder = planted[0]
    rng = random.Random(4)
    words = [a + b for a in "qua zor fli gre pon".split() for b in "dak mel tis rup von".split()]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    clean = {name: prose(40) for name in ("null 1", "null 2", "seven", "eight", "nulls", "copies", "family")}
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(stage, rows):
        docs = spark.createDataFrame([(d, t, "en", "a", None) for d, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, folder).collect()), key=str)

    leak = f"{prose(20)} {item} {prose(20)}"
    stay = [(None, clean["null 1"]), (None, clean["null 2"]), (7, clean["seven"]), (None, None), (None, "")]
    assert run(P.drop_leaks, [*stay, (None, leak), (7, leak), (9, leak)]) == sorted(stay, key=str)

    # Id 8 is a copy of 3 once, and once a text of its own; copies without an id leave one, or none beside a named one.
    near = clean["family"] + " more"
    rows = [(3, clean["copies"]), (8, clean["copies"]), (8, clean["eight"]), (None, clean["copies"]), (None, None), (None, ""), (None, ""), (None, clean["null 1"])]
    rows += [(None, clean["nulls"])] * 3 + [(None, clean["nulls"].upper()), (5, clean["family"]), (5, near), (6, near)]
    out = run(P.drop_near_duplicates, rows)
    kept = [(d, t) for d, t in out if d == 5 or (t or "").lower() == clean["nulls"]]
    assert len([x for x in kept if x[0] == 5]) == 1 and len([x for x in kept if x[0] is None]) == 1
    rest = [(3, clean["copies"]), (8, clean["eight"]), (None, clean["null 1"]), (None, None), (None, ""), (None, "")]
    assert sorted((x for x in out if x not in kept), key=str) == sorted(rest, key=str)
