"""Sums over periods: the same as row by row, in tasks of bounded size, without moving what the periods multiply."""

import datetime as dt
import random
import re
from collections import defaultdict

from veristrata.operators import business, intervals, rules

DAY = dt.date(2024, 1, 1)


def _tables(spark):
    rnd = random.Random(7)
    day = lambda n: DAY + dt.timedelta(n)
    spans = [(0, 29), (30, 59), (0, 89), (10, 69), (30, 30), (60, 119)]
    a = [(rnd.choice("ABC"), *map(day, rnd.choice(spans)), rnd.choice(["x", "y", None]), float(rnd.randint(0, 50))) for _ in range(60)]
    a += [("A", *map(day, s), "x", 1.0) for s in spans]
    b = [(rnd.choice("ABD"), day(n % 120), rnd.choice(["x", "y", None]), float(rnd.choice([0, 5, 9]))) for n in range(240)]
    kinds = "entity_key string, start date, end date, grp string, amount double", "entity_key string, day date, grp string, amount double"
    return a, b, *(spark.createDataFrame(x, k) for x, k in zip((a, b), kinds))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlapping_periods_by_hand(spark, monkeypatch):
    a, b, fa, fb = _tables(spark)
    monkeypatch.setattr(intervals, "HELD", 10)
    want = defaultdict(lambda: [None, None, set(), set()])
    for k, s, e, g, v in a:
        w = want[k, s, e]
        w[0] = (w[0] or 0) + v
    for s, e in {x[1:3] for x in a}:
        for k, d, g, v in b:
            if s <= d <= e and v:
                w = want[k, s, e]
                w[1] = (w[1] or 0) + v
                w[3].add(g)
        for k in {x[0] for x in a}:
            sums = defaultdict(float)
            for x in a:
                if x[:3] == (k, s, e):
                    sums[x[3]] += x[4]
            want[k, s, e][2] = {g for g, v in sums.items() if v}
    kinds = {}
    for key, (x, y, ga, gb) in want.items():
        if x is None and y is None:
            continue
        if abs((x or 0) - (y or 0)) > 20:
            kinds[key] = (x, y, "only a" if y is None else "only b" if x is None else "both")
        elif ga and gb and ga != gb:
            kinds[key] = (x, y, "group")
    found = rules.aggregate_compare_periods(fa, fb, 20)
    assert {(r["entity_key"], r["start"], r["end"]): (r["a"], r["b"], r["kind"]) for r in found.collect()} == kinds
    assert len({k for _, _, k in kinds.values()}) >= 3


def test_sums_stay_where_their_entity_is(spark, monkeypatch):
    """As many tasks as HELD asks for, and no exchange by period once rows have met their periods."""
    _, _, fa, fb = _tables(spark)
    monkeypatch.setattr(intervals, "HELD", 10)
    plan = _plan(rules.aggregate_compare_periods(fa, fb, 20).select("entity_key", "start", "end", "a", "b", "kind"))
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(entity_key#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and dealt[0] > 20
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "hashpartitioning(entity_key" not in above[: above.rindex("Exchange")] and "collect_set" not in above


def test_totals_move_rows_once(spark):
    _, _, fa, fb = _tables(spark)
    months = fa.filter("start = '2024-01-01' AND end = '2024-01-30' OR start = '2024-01-31' AND end = '2024-02-29'")
    plan = _plan(business.totals(months, fb, 20))
    assert len(re.findall(r"Exchange hashpartitioning\(entity_key", plan)) == 1
