"""P1-P9, F1, F2 on hand-made rows (FIXTURES section 4)."""

from pyspark.sql import functions as F

from teachspark.config import EOS_ID, IGNORE_INDEX, UNK_ID, ChatTemplate
from teachspark.functions.arrays import attention_mask, mask_source, token_count, truncate_ids
from teachspark.functions.text import render_chat, user_content
from teachspark.operators import filters as FL
from teachspark.operators.tokenize import Vocabulary, fit_vocabulary, tokenize


def test_user_content_truthiness(spark):
    df = spark.createDataFrame(
        [(1, "Do", None), (2, "Do", ""), (3, "Do", " "), (4, "Do", "x")], "id int, instruction string, input string"
    )
    got = dict(df.select("id", user_content("instruction", "input").alias("c")).collect())
    assert got == {1: "Do", 2: "Do", 3: "Do\n ", 4: "Do\nx"}


def test_render_chat_template(spark):
    df = spark.createDataFrame([("hi",)], "c string")
    t = ChatTemplate("<u>", "</u>", "<a>")
    assert df.select(render_chat("c", t)).first()[0] == "<u>hi</u><a>"


def test_tokenizer_parity_and_unknown(spark):
    vocab = Vocabulary(("the", "cat", "1"))
    texts = ["the cat sat 1", "Ünï the-cat\t1\n", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: list(r["ids"]) for r in tokenize(df, "text", vocab, "ids").collect()}
    for i, t in enumerate(texts):
        assert got[i] == vocab.encode(t)
    assert got[0] == [4, 5, UNK_ID, 6]


def test_fit_vocabulary_order(spark):
    df = spark.createDataFrame([("b a b c c c",), ("a",)], "text string")
    v = fit_vocabulary(df, "text", 2)
    assert v.words == ("c", "a")  # c:3, then a:2 and b:2 tie -> word asc


def test_tokenize_truncates_but_counts_whole(spark):
    vocab = Vocabulary(("w",))
    df = spark.createDataFrame([(" ".join(["w"] * 5000),)], "text string")
    r = tokenize(df, "text", vocab, "ids", max_length=2048, count_col="n").first()
    assert r["n"] == 5000 and len(r["ids"]) == 2048


def test_prompt_filter_is_strict(spark):
    df = spark.createDataFrame([(63,), (64,), (65,)], "n_tokens int")
    assert [r[0] for r in FL.filter_prompt_length(df, 64).collect()] == [63]


def test_example_filter_uses_truncated_length(spark):
    df = spark.createDataFrame([(2047,), (2048,), (5000,)], "n_tokens int")
    assert sorted(r[0] for r in FL.filter_example_length(df, 2048).collect()) == [2047]
    assert sorted(r[0] for r in FL.filter_example_length(df, 4096).collect()) == [2047, 2048, 5000]


def test_border_token_is_masked_with_source(spark):
    vocab = Vocabulary(("ab", "a", "b"))
    # source "a" + output "b" tokenises jointly as "ab": one token straddles the border
    df = spark.createDataFrame([("a", "ab")], "source string, example string")
    t = tokenize(tokenize(df, "source", vocab, "src"), "example", vocab, "ids")
    t = t.withColumn("n", token_count("src", EOS_ID)).withColumn("labels", mask_source("ids", "n"))
    r = t.first()
    assert list(r["ids"]) == [4] and list(r["labels"]) == [IGNORE_INDEX]


def test_pad_in_middle_counts_and_mask(spark):
    df = spark.createDataFrame([([5, EOS_ID, 6, EOS_ID],)], "ids array<int>")
    r = df.select(
        token_count("ids", EOS_ID).alias("n"), attention_mask("ids", EOS_ID).alias("m"), truncate_ids("ids", 3).alias("t")
    ).first()
    assert r["n"] == 2 and list(r["m"]) == [True, False, True, False] and list(r["t"]) == [5, EOS_ID, 6]


def test_mask_source_train_on_inputs(spark):
    df = spark.createDataFrame([([7, 8, 9],)], "ids array<int>")
    r = df.select(mask_source("ids", 2).alias("a"), mask_source("ids", 2, True).alias("b")).first()
    assert list(r["a"]) == [IGNORE_INDEX, IGNORE_INDEX, 9] and list(r["b"]) == [7, 8, 9]
    assert F is not None


def test_a_vocabulary_of_128k_words_is_one_literal(spark):
    import time

    from teachspark.operators.tokenize import Vocabulary, tokenize

    vocab = Vocabulary(tuple(f"w{i:x}" for i in range(128_000)), pattern=r"\S+")
    df = spark.createDataFrame([("w0 w1f3ff nothing w1 \"quoted\" w12",), ("",)], "text string")
    vocab._bucket_of  # a job of its own
    began = time.time()
    out = tokenize(df, "text", vocab)
    assert time.time() - began < 2
    assert [r["input_ids"] for r in out.collect()] == [vocab.encode("w0 w1f3ff nothing w1 \"quoted\" w12"), []]
