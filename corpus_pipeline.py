"""A corpus from documents: quality, exact and near copies, mixing, packing.

Each stage gets the documents its predecessor kept, read again from Parquet. Every stage gives
each row a key of its own, in the order of doc_id (null last), and picks rows by it: rows without a
doc_id and rows that repeat one are judged, kept and repeated each on its own, and come out with
the doc_id they had. All stages but the last return the columns of documents, extra ones
included. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import cotrain, exthash, minhash, mixing, packing
from veristrata.llm.common import row_keys, shared_dir, stage

#: DuckDB SQL for run()'s rows: none, as SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def _scored(spark: SparkSession, keyed: DataFrame, sf_dir: str) -> DataFrame:
    """_key, score, kept of each row by the classifier, fitted on the labelled ones of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    labels = labels.join(keyed.select("doc_id", "_key"), "doc_id").select(F.col("_key").alias("doc_id"), "quality")
    return cotrain.classify(keyed, labels, id_col="_key").select(F.col("doc_id").alias("_key"), "score", "kept")


def _only(keyed: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.join(keys.select(F.col("doc_id").alias("_key")), "_key", "left_semi").select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained classifier rejects.

    A null text counts as the empty one; ties and repeated rows get equal scores, so they stay or go alike.
    """
    keyed = row_keys(docs)
    bad = _scored(spark, keyed, sf_dir).filter("NOT kept").select("_key")
    return keyed.join(bad, "_key", "left_anti").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal but for blanks, repeated rows included.

    The longest original text stays, then the smallest doc_id (null last). All null and blank texts are one group.
    """
    keyed = row_keys(docs)
    return _only(keyed, exthash.exact_dedup(keyed, id_col="_key").filter("kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id (null last) of each group of near copies; null and blank texts link with nothing and stay."""
    keyed = row_keys(docs)
    return _only(keyed, minhash.near_dedup(keyed, id_col="_key").filter("kept"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops rows so that the sources come near their targets; what is selected in part favours what the classifier scores high.

    Texts without words have no size: they are repeated with their source's complete epochs. A null source is a source.
    """
    keyed = row_keys(docs)
    scores = stage(_scored(spark, keyed, sf_dir).select("_key", F.col("score").alias("_score")), "scores")
    copies = mixing.mix(keyed.join(scores, "_key"), id_col="_key", weight=F.col("_score")).filter("copies > 0").select(F.col("doc_id").alias("_key"), F.col("copies").alias("_copies"))
    return keyed.join(copies, "_key").select(*docs.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents, repeats included, into sequences; one row per piece. A null text is the end token alone."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mixture), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for k, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
