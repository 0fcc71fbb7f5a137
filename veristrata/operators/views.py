"""Business views, profiles and catalog views."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[a-z][a-z0-9_]{0,62}$")


def create_view(df: DataFrame, name: str) -> str:
    """Temp view under a safe identifier, ValueError otherwise."""
    if not _NAME.match(name):
        raise ValueError(f"not a safe identifier: {name!r}")
    df.createOrReplaceTempView(name)
    return name


def first_status(*cases: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds; null conditions don't."""
    return F.coalesce(*(F.when(c, F.lit(s)) for c, s in cases), F.lit(default))


def flagged_rollup(df: DataFrame, by: list[str], amount: str, flagged: Column) -> DataFrame:
    """Rows, amount and flagged amount per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), F.sum(F.when(flagged, F.col(amount)).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("flagged"))


def coverage(facts: DataFrame, group: str, day: str, band: Column, bands: list[str], clean: Column) -> DataFrame:
    """The whole group x day x band grid with ok, at_risk or gap."""
    seen = facts.groupBy(group, day, band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(clean).alias("n_clean"))
    grid = facts.select(group).distinct().join(facts.select(day).distinct()).select(group, day, F.explode(F.array(*map(F.lit, bands))).alias("band"))
    status = F.when(F.col("n").isNull(), "gap").when(F.col("n_clean") > 0, "ok").otherwise("at_risk")
    return grid.join(seen, [group, day, "band"], "left").select(group, day, "band", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: n (not null), n_distinct, n_null, low and high as text; one pass and one row a column.

    A column's distinct values are counted with Spark's own multi-distinct aggregation.
    """
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns))).alias("x")).select("x.*")
    return rows.groupBy("column").agg(F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"), F.count_if(F.col("v").isNull()).alias("n_null"), F.min("v").alias("low"), F.max("v").alias("high"))


def overlap(a: DataFrame, b: DataFrame, value_a: str, value_b: str) -> DataFrame:
    """n_a, n_b, n_both distinct values and the share of b's that occur in a."""
    x = a.select(F.col(value_a).alias("v")).dropna().distinct().select("v", F.lit(1).alias("a"))
    y = b.select(F.col(value_b).alias("v")).dropna().distinct().select("v", F.lit(1).alias("b"))
    j = x.join(y, "v", "full").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.expr("a = 1 AND b = 1")).alias("n_both"))
    return j.withColumn("share", F.try_divide(F.col("n_both").cast("double"), F.col("n_b").cast("double")))


def pivot_attributes(attributes: DataFrame, names: list[str]) -> DataFrame:
    """(entity_key, attribute, value) -> one column an attribute; names are known, so there is no extra pass."""
    return attributes.groupBy("entity_key").agg(*(F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(n) for n in names))


def timeline(*parts: DataFrame) -> DataFrame:
    """Union of event frames by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
