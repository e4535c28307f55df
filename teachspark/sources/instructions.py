"""Raw instruction rows (id, instruction, input, output).

``read_instructions`` reads a stored instruction table with a fixed schema;
``instructions_from_conversations`` derives one from chat turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batching import ordered_index

INSTRUCTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("instruction", T.StringType(), True),
        T.StructField("input", T.StringType(), True),
        T.StructField("output", T.StringType(), True),
    ]
)


def read_instructions(spark: SparkSession, path: str, fmt: str = "parquet", has_id: bool | None = None) -> DataFrame:
    """Read with an explicit schema (no inference); extra columns are ignored.

    Tables without ``id`` get :func:`with_row_ids`. Unless ``has_id`` says which it is, a Parquet table's
    schema tells, of a JSON table whether any row has an id; a CSV table is read by position and has one.
    """
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        fields = [f for f in INSTRUCTION_SCHEMA.fields if has_id is not False or f.name != "id"]
        reader = reader.schema(T.StructType(fields))
    df = reader.load(path)
    if has_id is None:
        has_id = fmt == "csv" or "id" in df.columns
        if fmt == "json":
            has_id = not df.filter(F.col("id").isNotNull()).isEmpty()
    texts = df.select(*[F.col(f.name).cast(f.dataType) for f in INSTRUCTION_SCHEMA.fields if f.name != "id"])
    if not has_id:
        return with_row_ids(texts)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in INSTRUCTION_SCHEMA.fields])


def content_key(*cols: str) -> Column:
    """Hex md5 of the columns' texts, each preceded by its length, so that neither borders nor nulls are confused."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in cols]))


def with_row_ids(texts: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Dense ids from 0 in the order of the rows' content keys: the same rows get the same ids however they are stored.

    Equal rows stay, with consecutive ids; which of them gets which makes no difference. A running
    number tells them apart while rows are dealt to range partitions, so many copies of one row fill several.
    """
    cols = [f.name for f in INSTRUCTION_SCHEMA.fields if f.name != "id"]
    keyed = texts.select(*cols, content_key(*cols).alias("__key"), F.monotonically_increasing_id().alias("__copy"))
    return ordered_index(keyed, "__key", "id", n_buckets=n_buckets).select("id", *cols)


def row_id(conv_id: str, turn: str) -> Column:
    """Collision-free id of ``(conversation, turn)``: Cantor's pairing of two non-negative numbers.

    It fits a bigint while their sum stays below about 4e9; beyond, ANSI mode raises instead of wrapping.
    """
    s = f"(cast({conv_id} as bigint) + {turn})"
    return F.expr(f"{s} * ({s} + 1) div 2 + {turn}")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a null instruction or output cannot form an example: send them aside."""
    bad = F.col("instruction").isNull() | F.col("output").isNull()
    return df.filter(~bad), df.filter(bad)


def instructions_from_conversations(conversations: DataFrame) -> DataFrame:
    """Pair each user turn with the assistant turn right after it.

    ``instruction`` is the text of a system turn right before the user turn,
    else the user text; ``input`` is then the user text, else ''. Turns are
    consecutive integers inside a conversation, so neighbours are found by
    equi-joins on (conv_id, turn +- 1). The join key is unique, so a single
    huge conversation spreads over all tasks instead of one window partition.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    user = c.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("u_text")
    )
    asst = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("text").alias("a_text")
    )
    system = c.filter(F.col("role") == "system").select(
        "conv_id", (F.col("turn") + 1).alias("u_turn"), F.col("text").alias("s_text"),
        F.lit(True).alias("has_sys"),
    )
    pairs = user.join(asst, ["conv_id", "u_turn"], "inner").join(system, ["conv_id", "u_turn"], "left")
    has_sys = F.coalesce(F.col("has_sys"), F.lit(False))
    return pairs.select(
        row_id("conv_id", "u_turn").cast("long").alias("id"),
        F.when(has_sys, F.col("s_text")).otherwise(F.col("u_text")).alias("instruction"),
        F.when(has_sys, F.col("u_text")).otherwise(F.lit("")).alias("input"),
        F.col("a_text").alias("output"),
    )
