"""Driver contract, plan shape and fixture counts."""

import __spark_entry__ as E
from tests.conftest import SF001, SF01
from teachspark.operators import batching as B
from teachspark.plans.queries import QUERIES as PLAN_QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 3 and set(df.columns) == {"split", "metric", "value", "n_batches"}
    q, o, own = E.queries(), E.oracle_sql(), set(PLAN_QUERIES)
    assert own <= set(q) and set(o) <= set(q) and own - set(o) == {"distill_loss_curve"}


def test_fixture_counts(spark):
    q = E.queries()
    assert q["instructions"](spark, SF01).count() == 233
    assert q["filter_prompt_length"](spark, SF01).count() == 174


def test_no_single_partition_exchange_on_data(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id")
    for df in (B.shuffle_index(docs, "doc_id"), B.split_train_test(docs, "doc_id")):
        plan = _plan(df)
        # the only un-partitioned window is over the bucket-count table
        assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_native_operators_have_no_python(spark):
    q = E.queries()
    for key in ("tokenize", "filter_prompt_length", "kl_teacher_student", "table_lm", "offline_batch_divergence"):
        plan = _plan(q[key](spark, SF001))
        assert "Python" not in plan and "ArrowEval" not in plan, key


def test_filters_reach_the_scan(spark):
    from teachspark.sources.tables import table
    from pyspark.sql import functions as F

    df = table(spark, SF001, "documents").filter(F.col("lang") == "en").select("text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<text:string,lang:string>" in plan


def test_models_read_written_counts(spark, tmp_path):
    """The fit reads its counts three times; the texts are split once."""
    from teachspark.config import PINS
    from teachspark.plans import stages as PL

    docs = [("the cat sat", "en"), ("the dog", "en"), ("der Hund", "de"), (None, "en")]
    spark.createDataFrame(docs, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i, t) for i, t in enumerate(["a cat", "the cat sat", None, ""])]
    spark.createDataFrame(turns, "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for fit in (PL._teacher_lm, PL._student_lm):
        model = fit(spark, str(tmp_path), PINS)
        plan = _plan(model)
        assert "regexp_extract_all" not in plan and "conversations.parquet" not in plan
        assert model.count() == PINS.vocab_size**2
