"""Codes of a column by a vocabulary, the similar spellings that no alias settles included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions import normalize
from veristrata.functions.names import ratio


def code_table(values: DataFrame, column: str, words: dict[str, str], least: float = 0.88) -> DataFrame:
    """(value, code, problem) of the distinct non-null values of a column.

    words: simplified alias -> code. Values that are no alias and hold none take the code of the most similar
    alias of at least `least`, the earliest of the vocabulary among equals. Only those reach Python.
    """
    code, problem = normalize.code(F.col("value"), words)
    known = values.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct().select("value", code.alias("code"), problem.alias("problem"))
    if not words:
        return known
    aliases = F.array(*(F.named_struct(F.lit("i"), F.lit(i), F.lit("alias"), F.lit(a), F.lit("code"), F.lit(c)) for i, (a, c) in enumerate(words.items())))
    tried = known.filter("problem IS NOT NULL").select("value", "problem", F.explode(aliases).alias("x"))
    tried = tried.select("value", "problem", "x.code", (-F.col("x.i")).alias("order"), ratio(normalize.simplify(F.col("value")), F.col("x.alias")).alias("score"))
    best = tried.groupBy("value").agg(F.first("problem").alias("problem"), F.max(F.struct("score", "order", "code")).alias("b"))
    near = F.col("b.score") >= least
    rest = best.select("value", F.when(near, F.col("b.code")).alias("code"), F.when(~near, F.col("problem")).alias("problem"))
    return known.filter("problem IS NULL").unionByName(rest)


def with_codes(df: DataFrame, column: str, words: dict[str, str], least: float = 0.88) -> DataFrame:
    """df with code and code_problem; values are settled once and joined back."""
    t = code_table(df, column, words, least).select(F.col("value").alias("_v"), F.col("code"), F.col("problem").alias("code_problem"))
    return df.join(t, F.col(column).cast("string") == F.col("_v"), "left").drop("_v")


def similar_codes(rows: DataFrame, vocabularies: dict[str, dict[str, str]], least: float = 0.88) -> DataFrame:
    """(field, value, code) of the distinct values, in any of the given columns (column -> words), that only their spelling's likeness settles."""
    cells = [F.when(normalize.code(F.col(f), w)[1].isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, w in vocabularies.items()]
    known = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*").distinct()
    aliases = F.coalesce(*(F.when(F.col("field") == f, F.array(*(F.named_struct(F.lit("i"), F.lit(-i), F.lit("alias"), F.lit(a), F.lit("code"), F.lit(c)) for i, (a, c) in enumerate(w.items())))) for f, w in vocabularies.items()))
    tried = known.select("field", "value", F.explode(aliases).alias("x"))
    tried = tried.withColumn("score", ratio(normalize.simplify(F.col("value")), F.col("x.alias")))
    best = tried.groupBy("field", "value").agg(F.max(F.struct("score", "x.i", "x.code")).alias("b"))
    return best.filter(F.col("b.score") >= least).select("field", "value", F.col("b.code").alias("code"))
