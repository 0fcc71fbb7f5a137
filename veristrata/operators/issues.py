"""Issues: one schema, fingerprints, severities, lifecycle across rebuilds, decisions and learned rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("fingerprint", "rule", "severity", "category", "entity_key", "title")
# Severities from the most to the least urgent.
SEVERITIES = ("critical", "warning", "info")


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by |, null as the empty text."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16)


def rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(len(SEVERITIES)))


def issue(df: DataFrame, rule: str, severity: Column | str, category: str, key: Column, title: Column, *parts: Column) -> DataFrame:
    """Rows of df as issues; the fingerprint is made of the rule's name and parts."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(fingerprint(F.lit(rule), *parts).alias("fingerprint"), F.lit(rule).alias("rule"), level.alias("severity"), F.lit(category).alias("category"), key.cast("string").alias("entity_key"), title.alias("title"))


def union(*found: DataFrame) -> DataFrame:
    """All issues; of a repeated fingerprint the one of the earliest argument stays."""
    every = reduce(DataFrame.unionByName, (f.select(*COLUMNS, F.lit(i).alias("_o")) for i, f in enumerate(found)))
    return every.groupBy("fingerprint").agg(*(F.min_by(c, F.struct("_o", "title")).alias(c) for c in COLUMNS[1:])).select(*COLUMNS)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(rank(F.col("severity")), "category", "fingerprint")


def lifecycle(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (fingerprint, active) and new (fingerprint) -> fingerprint, active, event.

    new only: detected; both, inactive before: reopened; old only, active before: cleared.
    """
    o, n = old.select("fingerprint", F.col("active").alias("was")), new.select("fingerprint", F.lit(True).alias("now")).distinct()
    both = o.join(n, "fingerprint", "full")
    event = F.when(F.col("was").isNull(), "issue_detected").when(F.col("now") & ~F.col("was"), "issue_reopened").when(F.col("now").isNull() & F.col("was"), "issue_cleared")
    return both.select("fingerprint", F.coalesce("now", F.lit(False)).alias("active"), event.alias("event"))


def latest(decisions: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return decisions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def auto_rules(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues (pattern, severity, decided) with the first learned rule (rule_id, pattern, action) that applies; critical and decided ones get none."""
    first = rules.groupBy("pattern").agg(F.min_by("action", "rule_id").alias("action"), F.min("rule_id").alias("rule_id"))
    free = (F.col("severity") != "critical") & ~F.col("decided")
    j = issues.join(first, "pattern", "left")
    return j.withColumns({"action": F.when(free, F.col("action")), "rule_id": F.when(free, F.col("rule_id"))})
