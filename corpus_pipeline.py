"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read as the next one's ``docs``. All but the last return the columns of
``documents``. Rows whose text is null or empty pass every filter. Each row is judged by its own
text, whatever other rows have its id, or none. Of repeated rows, and of copies with null ids only,
near-dedup leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teachspark.llm import minhash
from teachspark.llm.bytebpe import encode_texts
from teachspark.llm.common import cut
from teachspark.llm.decontam import drop_contaminated
from teachspark.llm.pii import redact
from teachspark.llm.queries import vocabulary
from teachspark.llm.toxicity import score_documents, train
from teachspark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("text", F.struct("*").alias("__row")), model)
    return scored.where("toxicity.predicted = 0").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents linked by five-word shingles at similarity 0.8 or more, the one with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data is replaced by its kind; ``n_chars`` follows the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids (little-endian unsigned 32-bit integers), their count and digests."""
    out = encode_texts(spark, docs.select(*COLUMNS), vocabulary())
    return out.select("doc_id", "lang", "source", "n_chars", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256", "bpe.ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_pii),
    ("bpe_encoding", encode),
]

#: The fitted toxicity model, edit distances and tokens can't be expressed in SQL; tests/llm checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
