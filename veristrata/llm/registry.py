"""Queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import balltree, cotrain, exthash, histogram, hmm, itq, linedup, linefirst, merkle, minhash, mixing, packing, warc
from veristrata.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"))


def op3_itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op7_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exthash.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = linedup.line_dedup(_table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"))


def op9_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.context_table(histogram.length_histogram(_table(spark, sf_dir, "documents")))


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.embeddings_negatives(_table(spark, sf_dir, "embeddings"))


def op12_fractal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def op13_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = linefirst.measured(_table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_co_training, op2_bbit_minhash, op3_itq_near_vectors, op4_vector_best_fit, op5_warc_segments, op6_hidden_markov, op7_extendible_hash, op8_deletion_neighbourhood, op9_weighted_mix, op10_length_histogram, op11_ball_tree_negatives, op12_fractal_manifest, op13_line_first, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
