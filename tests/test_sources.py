"""S1 adapter edge rows, rejects, and plug-in tokenizer parity."""

import pytest

from teachspark.operators.tokenize import PluginTokenizer, Vocabulary, tokenize, tokenize_with
from teachspark.session import ensure_checkpoint_dir, input_signature
from teachspark.sources.instructions import instructions_from_conversations, read_instructions, row_id, split_rejects, with_row_ids


def test_adapter_pairs_turns(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"),
        (1, 3, "user", "Bye"), (1, 4, "assistant", "Ciao"),
        (2, 0, "user", "Q1"), (2, 1, "assistant", "A1"), (2, 2, "user", "dangling"),
        (3, 0, "assistant", "odd start"), (3, 1, "user", "Q"), (3, 2, "assistant", "A"),
    ]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["id"]: (r["instruction"], r["input"], r["output"]) for r in instructions_from_conversations(conv).collect()}
    assert got == {
        4: ("Be brief.", "Hi", "Hello"),
        13: ("Bye", "", "Ciao"),
        3: ("Q1", "", "A1"),
        11: ("Q", "", "A"),
    }


def test_ids_never_collide(spark):
    rows = [(c, t) for c in range(40) for t in range(0, 3000, 37)] + [(10**9, 1000), (10**9 + 1, 0)]
    df = spark.createDataFrame(rows, "conv_id long, u_turn long").select(row_id("conv_id", "u_turn").alias("id"))
    assert df.distinct().count() == len(rows) and df.filter("id < 0").count() == 0


def test_rewritten_input_changes_the_signature(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    before = input_signature(spark, path)
    assert before == input_signature(spark, "file://" + path) and len(before) > 1
    spark.range(4).write.mode("overwrite").parquet(path)
    assert input_signature(spark, path) != before


def test_cluster_without_shared_folder_is_refused():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_rejects(spark):
    df = spark.createDataFrame(
        [(1, "i", "", "o"), (2, None, "", "o"), (3, "i", None, None)], "id long, instruction string, input string, output string"
    )
    good, bad = split_rejects(df)
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_plugin_tokenizer_matches_builtin(spark):
    class _Words(PluginTokenizer):  # local class: shipped to workers by value
        def __init__(self):
            self.v = Vocabulary(("a", "b"))

        def encode_batch(self, texts):
            return [self.v.encode(t) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "b, a!", "", "a " * 10])], "id int, text string")
    native = {r["id"]: list(r["ids"]) for r in tokenize(df, "text", Vocabulary(("a", "b")), "ids", max_length=5).collect()}
    plug = {r["id"]: list(r["ids"]) for r in tokenize_with(df, "text", _Words, "ids", max_length=5).collect()}
    assert native == plug and native[3] == [4] * 5


def test_hashed_lookup_large_vocabulary(spark):
    import random

    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzàéü"
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(6000)})[:5000]
    vocab = Vocabulary(tuple(words))
    assert vocab.n_buckets > 1000
    texts = [" ".join(rnd.choice(words + ["zzzzzzz", "42", "?"]) for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: list(r["ids"]) for r in tokenize(df, "text", vocab, "ids", max_length=None).collect()}
    assert all(got[i] == vocab.encode(t) for i, t in enumerate(texts))


def test_read_scores_prunes_columns(spark, tmp_path):
    from teachspark.sources.store import read_scores

    path = str(tmp_path / "scores")
    spark.createDataFrame(
        [(1, 0, [0.1, 0.2], "x" * 100)], "id long, pos int, logits array<float>, extra string"
    ).write.parquet(path)
    df = read_scores(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,pos:int,logits:array<float>>" in plan
    assert df.first()["pos"] == 0


def test_raw_tables_without_id(spark, tmp_path):
    rows = [(f"q{i}", None if i % 3 else "", f"a{i % 7}") for i in range(40)] + [("copy", "", "same")] * 30
    rows += [("ab", "", "c"), ("a", "b", "c"), (None, "x", "y"), ("", "", ""), (None, None, None)]
    raw = spark.createDataFrame(rows, "instruction string, input string, output string")
    raw.write.parquet(f"{tmp_path}/p")
    raw.repartition(5).write.json(f"{tmp_path}/j")
    content = lambda df: [tuple(r)[1:] for r in df.orderBy("id").collect()]
    whole = read_instructions(spark, f"{tmp_path}/p")
    assert whole.columns == ["id", "instruction", "input", "output"]
    assert sorted(r["id"] for r in whole.collect()) == list(range(len(rows)))
    assert sorted(content(whole), key=str) == sorted(rows, key=str)
    # The same ids from other files, and over several range partitions.
    assert content(read_instructions(spark, f"{tmp_path}/j", "json")) == content(whole)
    assert content(with_row_ids(raw.repartition(3), n_buckets=6)) == content(whole)
    assert read_instructions(spark, f"{tmp_path}/j", "json", has_id=False).count() == len(rows)
    whole.write.json(f"{tmp_path}/k")
    assert content(read_instructions(spark, f"{tmp_path}/k", "json")) == content(whole)
    assert with_row_ids(raw.limit(0)).count() == 0
