"""Views of a rebuild for the business: shift coverage, totals side by side, staffing, summaries, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.normalize import simplify
from veristrata.functions.settle import settle
from veristrata.operators import issues as iss
from veristrata.operators.intervals import covered_periods, period_sums, sums_of_both

# The bands of a day, in hours since its midnight.
BANDS = {"Day": (7, 15), "Evening": (15, 23), "Night": (23, 31)}


def shift_coverage(shifts: DataFrame, days: DataFrame, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """shifts (grp, day, start, hours, needed, clean), days (day) -> grp, day, band, n, status.

    A shift counts in a band that it overlaps by four hours or by half of itself, the day before's
    and the day after's hours of the band included. ok: someone needed and clean is there;
    at_risk: someone needed, but not clean; gap: others only; empty: nobody. Groups without
    any shift in a band have no rows. Each group's grid is made from the days, which are broadcast
    (a calendar), not from its shifts.
    """

    def meets(low, high):
        over = [F.least(F.col("start") + F.col("hours"), F.lit(float(high + k))) - F.greatest(F.col("start"), F.lit(float(low + k))) for k in (-24, 0, 24)]
        most = F.greatest(*over)
        return (most >= 4) | ((most > 0) & (most >= F.col("hours") * 0.5))

    own = shifts.filter("hours > 0 AND start IS NOT NULL AND day IS NOT NULL").withColumn("grp", F.coalesce("grp", F.lit("UNKNOWN")))
    hit = own.select("grp", "day", "needed", "clean", F.explode(F.array_compact(F.array(*(F.when(meets(*b), F.lit(n)) for n, b in bands.items())))).alias("band"))
    seen = hit.groupBy("grp", "day", "band").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("needed"), F.lit(False)).alias("any"), F.coalesce(F.bool_or(F.col("needed") & F.col("clean")), F.lit(False)).alias("ok"))
    calendar = days.select("day").filter("day IS NOT NULL").distinct().agg(F.array_sort(F.collect_set("day")).alias("days"))
    cells = seen.select("grp").distinct().crossJoin(F.broadcast(calendar)).select("grp", F.explode("days").alias("day")).select("grp", "day", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    status = F.when(F.col("n").isNull(), "empty").when(F.col("ok"), "ok").when(F.col("any"), "at_risk").otherwise("gap")
    return cells.join(seen, ["grp", "day", "band"], "left").select("grp", "day", "band", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def totals(a: DataFrame, b: DataFrame, tolerance: float, every_day: bool = True, slack_days: int = 0) -> DataFrame:
    """a (entity_key, start, end, amount), b (entity_key, day, amount) -> entity_key, start, end, a, b, diff, ok of covered periods, alike ones included."""
    dated = b.filter("day IS NOT NULL")
    covered = settle(covered_periods(a, dated.select("day"), every_day, slack_days), "covered")
    by = ["entity_key", "start", "end"]
    whole = F.lit(None).cast("string").alias("grp")
    j = sums_of_both(a.filter("entity_key IS NOT NULL").withColumn("grp", whole), dated.filter("entity_key IS NOT NULL").withColumn("grp", whole), covered)
    x, y = (F.coalesce(c, F.lit(0)) for c in "ab")
    return j.select(*by, x.alias("a"), y.alias("b"), (x - y).alias("diff"), (F.abs(x - y) <= tolerance).alias("ok"))


def staffing(paid: DataFrame, reasons: DataFrame, scheduled: DataFrame | None = None) -> DataFrame:
    """paid (rec_id, entity_key, start, end, place, role, amount, provisional), reasons (rec_id or entity_key, reason), scheduled (place, role, day, amount)
    -> start, end, place, role, paid, staff, flagged, reasons (six at most), confidence, scheduled.

    An amount is flagged if its record or entity is cited with a reason, or its link is provisional. What is
    scheduled is told for periods whose every day has a schedule.
    """
    cited = reasons.filter("rec_id IS NOT NULL").select("rec_id", "reason").union(reasons.filter("rec_id IS NULL").join(paid.select("entity_key", F.col("rec_id").alias("_r")), "entity_key").select("_r", "reason")).distinct()
    per = cited.groupBy("rec_id").agg(F.slice(F.array_sort(F.collect_set("reason")), 1, 6).alias("why"))
    rows = paid.withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in ("place", "role")}).join(per, "rec_id", "left")
    bad = F.col("why").isNotNull() | F.col("provisional")
    by = ["start", "end", "place", "role"]
    out = rows.groupBy(*by).agg(F.sum("amount").alias("paid"), F.count_distinct("entity_key").alias("staff"), F.sum(F.when(bad, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("flagged"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))), 1, 6).alias("reasons"))
    out = out.withColumn("confidence", F.bround(F.try_divide(100 * (F.col("paid") - F.col("flagged")), F.col("paid")), 0).cast("int"))
    if scheduled is None:
        return out
    covered = settle(covered_periods(paid, scheduled.select("day")), "covered")
    plan = period_sums(covered, scheduled.withColumns({c: F.coalesce(c, F.lit("UNKNOWN")) for c in ("place", "role")}), ["place", "role"], "amount").withColumnRenamed("amount", "scheduled")
    return out.join(plan, by, "full")


# --- summaries and lists ---------------------------------------------------------------------

def summary(records: DataFrame, attributes: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """(metric, value): records, linked %, attributes that agree %, entities without a critical open issue %, open issues by severity."""
    share = lambda a, b: F.bround(F.try_divide(F.lit(100.0) * a, b), 0)
    n = F.count(F.lit(1))
    own = found.filter("status = 'open'")
    critical = own.filter("severity = 'critical' AND entity_key IS NOT NULL").select("entity_key").distinct()
    parts = [
        records.agg(F.map_from_arrays(F.array(F.lit("records"), F.lit("linked_pct")), F.array(n.cast("double"), share(F.count("entity_key"), n))).alias("m")),
        attributes.agg(F.map_from_arrays(F.array(F.lit("agreeing_pct")), F.array(share(F.count_if(F.col("status").isin("CONFIRMED", "SINGLE_SOURCE", "RESOLVED")), F.count_if(F.col("status") != "MISSING")))).alias("m")),
        entities.join(critical.withColumn("c", F.lit(True)), "entity_key", "left").agg(F.map_from_arrays(F.array(F.lit("entities"), F.lit("clean_pct")), F.array(n.cast("double"), share(n - F.count("c"), n))).alias("m")),
        own.agg(F.map_from_arrays(F.array(*(F.lit(f"open_{s}") for s in iss.SEVERITIES)), F.array(*(F.count_if(F.col("severity") == s).cast("double") for s in iss.SEVERITIES))).alias("m")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.explode("m").alias("metric", "value"))


def issue_list(found: DataFrame, entities: DataFrame, status: str | None = None, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Issues that meet all given conditions, with the entity's name, most urgent first."""
    for c, v in (("status", status), ("severity", severity), ("category", category)):
        found = found if v is None else found.filter(F.col(c) == v)
    return iss.ordered(found.join(entities.select("entity_key", F.col("name").alias("entity_name")), "entity_key", "left"))


def entity_list(entities: DataFrame, records: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with records by source, open issues (info aside) and their worst severity; unverified first, then by key."""
    own = records.filter("entity_key IS NOT NULL").groupBy("entity_key", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("entity_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    worst = found.filter("status = 'open'").groupBy("entity_key").agg(F.count_if(F.col("severity") != "info").alias("open_issues"), F.min_by("severity", iss.rank(F.col("severity"))).alias("worst"))
    return entities.join(own, "entity_key", "left").join(worst, "entity_key", "left").withColumn("open_issues", F.coalesce("open_issues", F.lit(0))).orderBy(F.desc("status"), "entity_key")


def entity_detail(key: str, records: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An entity's records (internal fields, which begin with _, left out) and the issues that are of it or name it."""
    own = records.filter(F.col("entity_key") == key).withColumn("v", F.map_filter("v", lambda k, _: ~F.startswith(k, F.lit("_"))))
    return own, found.filter((F.col("entity_key") == key) | F.coalesce(F.array_contains("related", key), F.lit(False)))


# A period in brackets, as titles end in it, and a number with its marks.
PERIOD, AMOUNT = r"\(\d{1,2}/\d{1,2}[–-]\d{1,2}/\d{1,2}\)", r"\d[\d,.]*"


def generic_title(title: Column) -> Column:
    """A title for all issues of its kind: without a period in brackets, numbers as #, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, PERIOD, ""), AMOUNT, "#"), r"\s+", " "))


def similar_options(found: DataFrame, attributes: DataFrame, fingerprint: str, skip: tuple[str, ...] = ("name",)) -> DataFrame:
    """(attribute, value, n): the ways to widen a decision on an issue, with the other open issues that each would settle.

    First all issues of its rule and attribute (attribute and value null), then those whose entity shares
    a value of an attribute with 2 to 12 values, fewer than max(3, 60 %) of its entities; dates and names (skip) aside.
    """
    it = found.filter(F.col("fingerprint") == fingerprint).select("rule", F.coalesce("attribute", F.lit("")).alias("a"), F.col("entity_key").alias("k"))
    kind = found.filter((F.col("status") == "open") & (F.col("fingerprint") != fingerprint)).withColumn("a", F.coalesce("attribute", F.lit(""))).join(F.broadcast(it.select("rule", "a")), ["rule", "a"], "left_semi")
    every = kind.agg(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n"))
    known = attributes.filter(F.col("value").isNotNull() & ~F.col("attribute").isin(*skip))
    few = known.groupBy("attribute").agg(F.count_distinct("value").alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").try_cast("date").isNotNull()).alias("dates"))
    few = few.filter("d BETWEEN 2 AND 12 AND d < greatest(3, 0.6 * n) AND dates = 0").select("attribute")
    mine = known.join(F.broadcast(few), "attribute", "left_semi").join(F.broadcast(it.select(F.col("k").alias("entity_key"))), "entity_key", "left_semi").select("attribute", simplify(F.col("value")).alias("s"), "value")
    others = kind.select("entity_key").join(known.select("entity_key", "attribute", simplify(F.col("value")).alias("s")), "entity_key").join(F.broadcast(mine), ["attribute", "s"], "right")
    return every.unionByName(others.groupBy("attribute", "value").agg(F.count("entity_key").alias("n")))
