"""Registered queries of the corpus operators: ``(spark, sf_dir) -> DataFrame``, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .ann import nearest
from .bytebpe import count_tokens, encode_texts
from .decontam import contaminated
from . import licenses, lloyd, prefix_trie
from .duckbpe import encode_ranks
from .minhash import near_duplicates
from .pii import KINDS, find_pii, spans_string
from .sharding import shard_documents
from .toxicity import held_out, score_documents, train
from .warc import archive_pages

#: The vocabulary file that the token queries use; operators take any path.
VOCABULARY = "byte_bpe_50k.json"
#: The rank file of the same vocabulary.
RANKS = "byte_bpe_50k.tiktoken"
#: Tokens above which ``over_limit`` holds.
TOKEN_LIMIT = 1024


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(spark, docs, vocabulary())
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_texts(spark, docs, vocabulary(), keep_ids=False)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    sentences = F.transform("toxicity.offending", lambda s: F.concat_ws(":", s["start"], s["stop"]))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "toxicity.score", "toxicity.predicted", F.array_join(sentences, ",").alias("sentences"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents")).withColumn("every", F.concat("base", "added"))
    counts = [F.expr(f"cast(size(filter(base, o -> o.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_string("base"), 256).alias("base_sha256"), spans_string("every").alias("spans"), F.size("added").cast("long").alias("n_added"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


def op11_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compress(table(spark, sf_dir, "embeddings"))


def op12_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_ranks(spark, docs, vocabulary(RANKS), keep_ids=False)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_licenses": op1_licenses,
    "op2_bottom_k": op2_bottom_k,
    "op3_nn_descent": op3_nn_descent,
    "op4_token_counts": op4_token_counts,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_lloyd_codes": op11_lloyd_codes,
    "op12_duckdb_bpe": op12_duckdb_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle_sql(),
    "op11_lloyd_codes": lloyd.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
