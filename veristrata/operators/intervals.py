"""Sums over periods of daily rows, without a row for each day of a period.

Days are the leaves of a binary tree: a node of level k stands for 2**k days. Daily rows are summed
up the tree, key by key, which at most doubles them; a period of n days is the union of at most 2 log2(n) nodes, two
a level. Rows and periods meet by an equi-join of nodes. Periods may overlap, repeat, and be as long as they like.

In sums_of_both() the leaves are segments, the stretches between two neighbouring bounds of periods: only nodes
that some period is made of are kept, and an entity's rows stay in one task from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions.settle import settle

#: Sums by entity, group and period that one task holds, about.
HELD = 500_000


def _number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def _levels(periods: DataFrame) -> int:
    longest = periods.agg(F.max(F.datediff("end", "start") + 1)).first()[0] or 1
    return max(1, int(longest).bit_length())


def period_nodes(periods: DataFrame, levels: int) -> DataFrame:
    """(start, end, level, node) of the nodes that make up each distinct period."""
    own = periods.select("start", "end").filter("end >= start").distinct()
    return _nodes(own, _number("start"), _number("end") + 1, levels)


def _nodes(own: DataFrame, low: Column, high: Column, levels: int) -> DataFrame:
    """(start, end, level, node): the leaves from low on, high not included, as nodes."""
    nodes = []
    for k in range(levels):
        a, b = F.shiftright(low + (2**k - 1), k), F.shiftright(high, k)  # first node from the start on, first one beyond the end
        nodes.append(F.when((a < b) & (a.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), a.alias("node"))))
        nodes.append(F.when((a < b) & (b.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("node"))))
    return own.select("start", "end", F.explode(F.array_compact(F.array(*nodes))).alias("n")).select("start", "end", "n.level", "n.node")


def period_sums(periods: DataFrame, daily: DataFrame, by: list[str], *measures: str) -> DataFrame:
    """periods (start, end), daily (by..., day, measures...) -> by..., start, end and the measures' sums.

    One row for each key and distinct period in which the key has a daily row; rows without a day are in no period, and
    a period that ends before it starts has none.
    """
    levels = _levels(periods)
    total = [F.sum(m).alias(m) for m in measures]
    per = daily.filter("day IS NOT NULL").groupBy(*by, _number("day").alias("node")).agg(*total)
    tree = per.select(*by, *measures, F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("node", k).alias("node")) for k in range(levels)))).alias("_at"))
    tree = tree.groupBy(*by, "_at.level", "_at.node").agg(*total)
    met = tree.join(period_nodes(periods, levels), ["level", "node"])
    return met.groupBy(*by, "start", "end").agg(*total)


def period_coverage(periods: DataFrame, days: DataFrame) -> DataFrame:
    """periods (start, end), days (day) -> start, end, n_days, n_seen, covered: whether every day occurs."""
    own = periods.select("start", "end").filter("end >= start").distinct()
    seen = period_sums(own, days.select("day").distinct().withColumn("n", F.lit(1)), [], "n")
    out = own.join(seen, ["start", "end"], "left").select("start", "end", (F.datediff("end", "start") + 1).cast("long").alias("n_days"), F.coalesce("n", F.lit(0)).cast("long").alias("n_seen"))
    return out.withColumn("covered", F.col("n_days") == F.col("n_seen"))


def covered_periods(periods: DataFrame, dates: DataFrame, every_day: bool = True, slack_days: int = 0) -> DataFrame:
    """The periods (start, end) that the dates (day) cover, all days or from first to last give or take slack_days."""
    if every_day:
        return period_coverage(periods, dates).filter("covered").select("start", "end")
    span = dates.agg(F.date_sub(F.min("day"), slack_days).alias("low"), F.date_add(F.max("day"), slack_days).alias("high"))  # one row
    return periods.select("start", "end").filter("end >= start").distinct().crossJoin(F.broadcast(span)).filter("low <= start AND end <= high").select("start", "end")


def sums_of_both(a: DataFrame, b: DataFrame, periods: DataFrame) -> DataFrame:
    """a (entity_key, start, end, grp, amount), b (entity_key, day, grp, amount), the periods to sum over -> entity_key, grp, start, end, a, b; null where a side has no rows.

    Rows meet their periods by broadcast. The calendar has a row for each day from the first period's start to the last one's end, so periods
    should lie within the days of b, as covered ones do. Where a day has many periods, the rows are first summed by segment, then
    dealt by entity to so many tasks that each makes about HELD sums; later groupings by entity and more need no exchange.
    """
    own = settle(periods.select("start", "end").filter("end >= start").distinct(), "periods")
    cuts = own.select(F.explode(F.array(_number("start"), _number("end") + 1)).alias("at")).distinct().withColumn("cut", F.lit(1))
    span = own.agg(F.min(_number("start")).alias("low"), F.max(_number("end")).alias("high")).filter("low IS NOT NULL")
    days = span.select(F.explode(F.sequence("low", "high")).alias("at")).join(F.broadcast(cuts), "at", "left")
    calendar = settle(days.select("at", F.count("cut").over(Window.orderBy("at")).cast("int").alias("seg")), "calendar")  # a row a day
    first, last = (calendar.select(F.col("at").alias(f"{c}_at"), F.col("seg").alias(c)) for c in ("low", "high"))
    ranged = own.join(first, _number("start") == F.col("low_at")).join(last, _number("end") == F.col("high_at"))
    longest, every, segments = ranged.agg(F.max(F.col("high") - F.col("low") + 1), F.sum(F.col("high") - F.col("low") + 1), F.max("high")).first()
    levels = max(1, int(longest or 1).bit_length())
    nodes = _nodes(ranged, F.col("low"), F.col("high") + 1, levels)
    no = lambda c, kind: F.lit(None).cast(kind).alias(c)
    of_a = a.join(F.broadcast(own), ["start", "end"]).select("entity_key", "grp", "start", "end", F.coalesce("amount", F.lit(0)).alias("a"))
    of_b = b.filter("day IS NOT NULL").join(F.broadcast(calendar), _number("day") == F.col("at")).select("entity_key", "grp", "seg", F.col("amount").alias("b"))
    by = ["entity_key", "grp", "start", "end"]
    total = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    if levels == 1:  # no day has two periods
        met = of_b.join(F.broadcast(nodes.select(F.col("node").alias("seg"), "start", "end")), "seg").select(*by, "b")
        return of_a.unionByName(met, allowMissingColumns=True).groupBy(*by).agg(*total)
    x = of_a.groupBy(*by).agg(F.sum("a").alias("a")).withColumn("seg", F.lit(None).cast("int"))
    y = of_b.groupBy("entity_key", "grp", "seg").agg(F.sum("b").alias("b"))
    rows = settle(x.unionByName(y, allowMissingColumns=True), "sums")
    n, n_seg = rows.agg(F.count(F.lit(1)), F.count("seg")).first()
    tasks = max(1, round((n + n_seg * every / segments) / HELD)) if segments else 1
    own_level, none = F.struct(F.lit(-1).alias("level"), F.lit(-1).alias("node")), F.lit(None).cast("date")  # rows of a have their period already
    up = F.when(F.col("seg").isNull(), F.array(own_level)).otherwise(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("seg", k).alias("node")) for k in range(levels))))
    nodes = nodes.unionByName(own.sparkSession.range(1).select(none.alias("start"), none.alias("end"), F.lit(-1).alias("level"), F.lit(-1).alias("node")))
    up_the_tree = rows.repartition(tasks, "entity_key").select(*by, "a", "b", F.explode(up).alias("_at")).select(*by, "a", "b", "_at.level", "_at.node")
    up_the_tree = up_the_tree.join(F.broadcast(nodes.select("level", "node").distinct()), ["level", "node"]).groupBy(*by, "level", "node").agg(*total)
    of = nodes.select("level", "node", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = up_the_tree.join(F.broadcast(of), ["level", "node"]).select("entity_key", "grp", F.coalesce("start", "_s").alias("start"), F.coalesce("end", "_e").alias("end"), "a", "b")
    return met.groupBy(*by).agg(*total)
