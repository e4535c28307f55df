"""P1-P8, F1 and the hash split (B1) on a stream of instruction rows.

Every operator here is row-local (no state, no shuffle), so the same code
serves batch and stream. The sink is parquet with a checkpoint location
under the shared checkpoint folder, so a restarted query resumes exactly
once; ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EOS_ID, PINS, Pins
from ..functions.arrays import attention_mask, token_count
from ..functions.text import render_chat, user_content
from ..operators.batching import split_train_test
from ..operators.tokenize import Vocabulary, tokenize
from ..sources.instructions import INSTRUCTION_SCHEMA


def prepare_prompts(df: DataFrame, vocab: Vocabulary, pins: Pins = PINS) -> DataFrame:
    """Instruction rows -> ``(id, split, text, input_ids, n_tokens, n_real, attention_mask)`` kept by F1.

    Works unchanged on a batch or a streaming DataFrame; ``n_real`` (P6) and
    ``attention_mask`` (P8) use the pad id (= EOS).
    """
    p = split_train_test(df, "id", seed=pins.seed)
    p = p.select("id", "split", render_chat(user_content("instruction", "input"), pins.template).alias("text"))
    p = tokenize(p, "text", vocab, "input_ids", max_length=None, add_bos=pins.add_bos, count_col="n_tokens")
    p = p.withColumn("n_real", token_count("input_ids", EOS_ID)).withColumn(
        "attention_mask", attention_mask("input_ids", EOS_ID)
    )
    return p.filter(F.col("n_tokens") < pins.prompt_limit)


def read_instruction_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming parquet source with the fixed instruction schema (no inference)."""
    return spark.readStream.schema(INSTRUCTION_SCHEMA).parquet(path)


def run_available_now(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Drain the source into a parquet sink and stop (exactly-once via the checkpoint)."""
    q = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(sink)
    )
    q.awaitTermination()
