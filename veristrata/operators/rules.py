"""Declarative checks: each rule is a function of frames and settings that gives a frame of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.normalize import simplify
from veristrata.functions.settle import settle
from veristrata.operators.intervals import covered_periods, period_coverage, sums_of_both

REGISTRY: dict[str, callable] = {}


def rule(f):
    REGISTRY[f.__name__] = f
    return f


@rule
def presence(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Entities without a record of a source."""
    return entities.join(records.select("entity_key"), "entity_key", "left_anti")


@rule
def required_attribute(attributes: DataFrame, when: Column) -> DataFrame:
    return attributes.filter(F.coalesce(when, F.lit(False)) & (F.col("status") == "MISSING"))


@rule
def expiration(df: DataFrame, day: Column, as_of: str, warn_days: int = 60, critical_days: int = 0) -> DataFrame:
    """days to a date; expired is critical, within warn_days a warning, others aren't findings."""
    days = F.datediff(day, F.lit(as_of).cast("date")).cast("long")
    found = df.withColumn("days", days).withColumn("severity", F.when(F.col("days") < critical_days, "critical").when(F.col("days") <= warn_days, "warning"))
    return found.filter("severity IS NOT NULL")


@rule
def staleness(df: DataFrame, day: Column, as_of: str, max_age_days: int) -> DataFrame:
    return df.withColumn("age", F.datediff(F.lit(as_of).cast("date"), day).cast("long")).filter(F.col("age") > max_age_days)


def after_expiry(expiries: DataFrame, activity: DataFrame) -> DataFrame:
    """The activity after its entity's expiry; a record whose measure (worked) is blank or zero isn't worked."""
    return activity.filter("worked <> 0").join(expiries, "entity_key").filter("day > expiry")


@rule
def activity_after_expiry(expiries: DataFrame, activity: DataFrame) -> DataFrame:
    """expiries (entity_key, expiry), activity (entity_key, day, worked) -> hits and first day per entity."""
    return after_expiry(expiries, activity).groupBy("entity_key", "expiry").agg(F.count(F.lit(1)).alias("hits"), F.min("day").alias("first_day"))


@rule
def date_order(df: DataFrame, start: Column, end: Column, expected_days: int | None = None) -> DataFrame:
    """End before start; else an inclusive length other than expected (info)."""
    days = (F.datediff(end, start) + 1).cast("long")
    odd = F.lit(None) if expected_days is None else F.when(days != expected_days, "info")
    return df.withColumns({"days": days, "severity": F.when(end < start, "warning").otherwise(odd)}).filter("severity IS NOT NULL")


@rule
def unusual_value(df: DataFrame, value: Column, expected: list[str], critical_pattern: str | None = None, severity: str = "warning") -> DataFrame:
    """Values outside the expected ones, spelling simplified on both sides; critical where the pattern occurs, cases aside."""
    level = F.when(value.rlike(f"(?i){critical_pattern}"), "critical").otherwise(severity) if critical_pattern else F.lit(severity)
    usual = F.array(*(simplify(F.lit(e)) for e in expected))
    return df.filter(value.isNotNull() & ~F.array_contains(usual, simplify(value))).withColumn("severity", level)


@rule
def duplicate_entity(entities: DataFrame, key: str, match_on: list[str | tuple[str, ...]], pairs_up_to: int | None = 100) -> DataFrame:
    """Pairs k1 < k2 that share a value of any match_on attribute: k1, k2, reasons (attribute, value), hot.

    A tuple of columns is one attribute, shared if all its columns are; nulls and empty texts never match.
    reasons holds all that the two share. A value of more than pairs_up_to entities is hot: it isn't
    spelt out in pairs but as its class, one row (smallest key, member) each with hot = true. Null: no value is hot.
    """

    def attribute(m):
        cols = [m] if isinstance(m, str) else list(m)
        known = F.array(*(F.col(c).cast("string") for c in cols))
        value = F.col(m).cast("string") if isinstance(m, str) else F.to_json(F.struct(*cols))
        return F.when(F.forall(known, lambda v: F.coalesce(v != "", F.lit(False))), F.struct(F.lit("+".join(cols)).alias("attribute"), value.alias("value")))

    has = entities.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(F.array_compact(F.array(*map(attribute, match_on)))).alias("v")).distinct()
    sizes = has.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("head")).filter("n > 1")
    over = F.lit(False) if pairs_up_to is None else F.col("n") > pairs_up_to
    member = has.join(sizes.select("v", "head", over.alias("hot")), "v")
    few = member.filter("NOT hot")
    pairs = few.select(F.col("k").alias("k1"), "v").join(few.select(F.col("k").alias("k2"), "v"), "v").filter("k1 < k2").select("k1", "k2", "v", F.lit(False).alias("hot"))
    if pairs_up_to is not None:
        many = member.filter("hot").select("k", "v", "head")
        pairs = pairs.unionByName(many.filter("k <> head").select(F.col("head").alias("k1"), F.col("k").alias("k2"), "v", F.lit(True).alias("hot")))
        # hot values that pairs of other values share besides
        classes = many.groupBy("k").agg(F.collect_list("v").alias("vs"))
        found = pairs.groupBy("k1", "k2").agg(F.collect_set("v").alias("vs"), F.bool_or("hot").alias("hot"))
        j = found.join(classes.select(F.col("k").alias("k1"), F.col("vs").alias("x")), "k1", "left").join(classes.select(F.col("k").alias("k2"), F.col("vs").alias("y")), "k2", "left")
        both = F.coalesce(F.array_intersect("x", "y"), F.array().cast("array<struct<attribute:string,value:string>>"))
        return j.select("k1", "k2", F.array_sort(F.array_union("vs", both)).alias("reasons"), "hot")
    return pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("v")).alias("reasons"), F.bool_or("hot").alias("hot"))


@rule
def aggregate_compare(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """a, b (entity_key, period, amount) -> totals per key and period that differ by more than the tolerance, either side alone included.

    For sums of one period each; aggregate_compare_periods compares periods with daily rows, and groups.
    """
    sums = [x.groupBy("entity_key", "period").agg(F.sum("amount").alias(n)) for x, n in ((a, "a"), (b, "b"))]
    j = sums[0].join(sums[1], ["entity_key", "period"], "full")
    zero = F.lit(0).cast("decimal(18,2)")
    diff = F.coalesce("a", zero) - F.coalesce("b", zero)
    kind = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").otherwise("both")
    return j.select("entity_key", "period", "a", "b", diff.alias("diff"), kind.alias("kind")).filter(F.abs("diff") > tolerance)


rule(period_coverage)


@rule
def aggregate_compare_periods(a: DataFrame, b: DataFrame, tolerance: float, every_day: bool = True, slack_days: int = 0, covered: DataFrame | None = None) -> DataFrame:
    """a (entity_key, start, end, grp, amount) against b (entity_key, day, grp, amount) -> entity_key, start, end, a, b, diff, kind, groups_a, groups_b.

    Compared are the periods of a that b covers: b has each of their days, or (every_day false) they lie
    within b's days give or take slack_days. Kinds: both, only a, only b (totals beyond the tolerance),
    group (totals agree, the groups with an amount don't), no overlap (one row if no period is covered).
    Days of b without an amount cover but don't count. covered: the periods (start, end), where they are known.
    """
    dates = b.filter("day IS NOT NULL")
    if covered is None:
        covered = settle(covered_periods(a.filter("end >= start"), dates.select("day"), every_day, slack_days), "covered")
    by = ["entity_key", "start", "end"]
    per = sums_of_both(a.filter("entity_key IS NOT NULL"), dates.filter("amount <> 0 AND entity_key IS NOT NULL"), covered)
    # groups with an amount: counted for the kind, and listed (a struct holds the null group, too)
    some = {n: F.coalesce(F.col(n) != 0, F.lit(False)) for n in "ab"}
    counts = [F.count_if(some[n]).alias(f"n_{n}") for n in "ab"] + [F.count_if(some["a"] != some["b"]).alias("n_apart")]
    lists = [F.array_sort(F.collect_set(F.when(some[n], F.struct("grp")))).alias(f"groups_{n}") for n in "ab"]
    j = per.groupBy(*by).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *counts, *lists)
    diff = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    beyond = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").otherwise("both")
    kind = F.when(F.abs(diff) > tolerance, beyond).when((F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("n_apart") > 0), "group")
    groups = [F.when(F.col(n).isNotNull(), F.col(f"groups_{n}.grp")).alias(f"groups_{n}") for n in "ab"]
    found = j.select(*by, "a", "b", diff.alias("diff"), kind.alias("kind"), *groups).filter("kind IS NOT NULL")
    n = [x.agg(F.count(F.lit(1)).alias(c)) for x, c in ((a, "n_a"), (dates, "n_b"), (covered, "n_c"))]
    none = n[0].crossJoin(n[1]).crossJoin(n[2]).filter("n_a > 0 AND n_b > 0 AND n_c = 0").select(F.lit("no overlap").alias("kind"))
    return found.unionByName(none, allowMissingColumns=True)
