"""Queries of the engine and the business views on the driver's tables; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.engine.process import Engine
from veristrata.engine.records import normalize_records
from veristrata.functions import normalize
from veristrata.operators import business, rules
from veristrata.plans.queries import money, query, table


@query(r"""SELECT c_custkey AS rec_id, regexp_replace(upper(replace(replace(c_name, '#', ''), ' ', '')), '^([A-Z]+)(\d+)$', '\1-\2') AS license,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS segment,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS n_problems,
  CASE WHEN c_custkey % 3 = 0 THEN 'nick is blank' END AS blank FROM customer""")
def record_normalise(spark, d):
    spec = {"fields": {"license": {"type": "license", "required": True}, "segment": {"type": "code", "ref": "seg"}, "nick": {"required": True}, "balance": {"type": "number", "min": 0}, "gone": {"required": True}}, "record_key": "license"}
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_name").alias("license"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 3 == 0, " n/a ").otherwise("x").alias("nick"), F.format_number("c_acctbal", 2).alias("balance"))
    r = normalize_records(rows, "customer", spec, {"seg": {"B": ["building"], "M": ["machinery"]}})
    nick = F.filter("problems", lambda p: p["field"] == "nick")
    return r.select("rec_id", F.col("v")["license"].alias("license"), F.col("v")["segment"].alias("segment"), F.size("problems").alias("n_problems"), F.try_element_at(nick, F.lit(1))["message"].alias("blank"))


_TWO = {
    "entity": {"anchor_source": "orders", "key_field": "id"},
    "sources": {"orders": {"fields": {"id": {}, "status": {}}}, "lines": {"fields": {"status": {}, "flag": {}}}},
    "attributes": {"status": {"from": {"orders": "status", "lines": "status"}, "authority": ["orders"]}, "flag": {"from": {"lines": "flag"}}},
}


@query("""WITH e AS (SELECT o_orderkey AS k, 'status' AS a, 'orders' AS s, o_orderstatus AS v, 0 AS p FROM orders
  UNION ALL SELECT l_orderkey, 'status', 'lines', l_linestatus, 1 FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT l_orderkey, 'flag', 'lines', l_returnflag, 1 FROM lineitem WHERE l_quantity > 10),
v AS (SELECT k, a, v, count(*) AS n, min(p) AS p FROM e GROUP BY ALL),
c AS (SELECT k, a, count(*) AS n_values, (list(v ORDER BY n DESC, v))[1] AS value FROM v GROUP BY k, a),
s AS (SELECT k, a, count(DISTINCT s) AS n_sources FROM e GROUP BY k, a)
SELECT o_orderkey::VARCHAR AS entity_key, x.a AS attribute, CASE WHEN x.a = 'status' THEN o_orderstatus ELSE c.value END AS value, CASE WHEN n_values IS NULL THEN 'MISSING' WHEN n_values > 1 THEN 'CONFLICT' WHEN n_sources > 1 THEN 'CONFIRMED' ELSE 'SINGLE_SOURCE' END AS status,
  coalesce(n_sources, 0)::BIGINT AS n_sources, coalesce(n_values, 0)::BIGINT AS n_values
FROM orders CROSS JOIN (VALUES ('status'), ('flag')) x(a) LEFT JOIN c ON c.k = o_orderkey AND c.a = x.a LEFT JOIN s ON s.k = o_orderkey AND s.a = x.a""")
def reconcile_full(spark, d):
    """Records that wait for review (quantity up to 10) don't count; without an authority the commonest value, then the lowest."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rec = lambda df, s, key, review, **v: df.select(F.monotonically_increasing_id().alias("rec_id"), F.lit(s).alias("source"), F.col(key).cast("string").alias("entity_key"), F.when(review, "review").otherwise("auto").alias("match_status"), F.lit(None).cast("struct<first:string,middle:string,last:string,display:string,org:boolean>").alias("name"), F.create_map(*(x for k, c in v.items() for x in (F.lit(k), F.col(c)))).alias("v"))
    records = rec(o, "orders", "o_orderkey", F.lit(False), status="o_orderstatus").unionByName(rec(li, "lines", "l_orderkey", F.col("l_quantity") <= 10, status="l_linestatus", flag="l_returnflag")).withColumn("raw", F.col("v"))
    engine = Engine(_TWO, "1998-12-01")
    attributes, _ = engine.reconcile(engine.evidence(records), o.select(F.col("o_orderkey").cast("string").alias("entity_key")), None)
    return attributes.select("entity_key", "attribute", "value", "status", "n_sources", "n_values")


@query("""SELECT entity_key, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'U-p' || p_partkey ELSE 'U-' || string_split(p_name, ' ')[-1] || '-' || string_split(p_name, ' ')[1] END AS entity_key FROM part WHERE p_partkey % 10 <> 5 AND p_partkey % 7 <> 0) GROUP BY 1""")
def orphan_clusters(spark, d):
    """By name, without one by identifier; without both (every tenth) not at all; linked records (every seventh) aren't orphans."""
    config = {"entity": {"anchor_source": "x", "key_field": "id"}, "attributes": {}, "sources": {"part": {"fields": {"id": {"type": "id"}, "name": {"type": "person_name"}}, "name": {"full": "name"}}}}
    k = F.col("p_partkey") % 10
    part = table(spark, d, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file is one task, its names are work
    rows = part.select(F.col("p_partkey").alias("rec_id"), F.when(k == 0, F.concat(F.lit("P "), F.col("p_partkey").cast("string"))).alias("id"), F.when(~k.isin(0, 5), F.col("p_name")).alias("name"))
    linked = normalize_records(rows, "part", config["sources"]["part"]).withColumn("entity_key", F.when(F.col("rec_id") % 7 == 0, "E"))
    return Engine(config, "1998-12-01").orphans(linked).groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"))


_SHIFTS = "SELECT event_type AS grp, ts::DATE AS day, hour(ts)::DOUBLE AS start, (4 + user_id % 9)::DOUBLE AS hours, value > 20 AS needed, value > 50 AS clean FROM events WHERE hour(ts) % 3 = 0"


@query(f"""WITH s AS ({_SHIFTS}), b(band, low, high) AS (VALUES ('Day', 7, 15), ('Evening', 15, 23), ('Night', 23, 31)),
h AS (SELECT DISTINCT s.*, band, row_number() OVER () AS r FROM (SELECT *, row_number() OVER () AS i FROM s) s JOIN b ON greatest(least(start + hours, high - 24) - greatest(start, low - 24), least(start + hours, high) - greatest(start, low), least(start + hours, high + 24) - greatest(start, low + 24)) >= 4
  OR greatest(least(start + hours, high - 24) - greatest(start, low - 24), least(start + hours, high) - greatest(start, low), least(start + hours, high + 24) - greatest(start, low + 24)) >= greatest(hours * 0.5, 0.0001)),
g AS (SELECT grp, day, band, count(*) AS n, bool_or(needed) AS needed, bool_or(needed AND clean) AS ok FROM h GROUP BY ALL)
SELECT x.grp, y.day, b.band, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'empty' WHEN ok THEN 'ok' WHEN needed THEN 'at_risk' ELSE 'gap' END AS status
FROM (SELECT DISTINCT grp FROM g) x CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM events) y CROSS JOIN b LEFT JOIN g ON g.grp = x.grp AND g.day = y.day AND g.band = b.band""")
def shift_coverage(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    s = e.filter(F.hour("ts") % 3 == 0).select(F.col("event_type").alias("grp"), "day", F.hour("ts").cast("double").alias("start"), (4 + F.col("user_id") % 9).cast("double").alias("hours"), (F.col("value") > 20).alias("needed"), (F.col("value") > 50).alias("clean"))
    return business.shift_coverage(s, e.select("day"))


@query("""WITH o AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS s, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS t, o_totalprice::DECIMAL(18,2) AS v FROM orders),
b AS (SELECT o_custkey AS k, l_shipdate::DATE AS day, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT DISTINCT s, t FROM o), c AS (SELECT s, t FROM p WHERE (SELECT count(DISTINCT day) FROM b WHERE day BETWEEN s AND t) = t - s + 1),
x AS (SELECT k, s, t, sum(v) AS a FROM o JOIN c USING (s, t) GROUP BY ALL), y AS (SELECT k, s, t, sum(v) AS b FROM b JOIN c ON day BETWEEN s AND t GROUP BY ALL)
SELECT k AS entity_key, s AS start, t AS "end", coalesce(a, 0)::DECIMAL(28,2) AS a, coalesce(b, 0)::DECIMAL(28,2) AS b, (coalesce(a, 0) - coalesce(b, 0))::DECIMAL(28,2) AS diff, abs(coalesce(a, 0) - coalesce(b, 0)) <= 1000 AS ok FROM x FULL JOIN y USING (k, s, t)""")
def totals_view(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.select(F.col("o_custkey").alias("entity_key"), F.trunc("o_orderdate", "month").alias("start"), F.last_day("o_orderdate").alias("end"), money("o_totalprice").alias("amount"))
    b = li.join(o, F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("entity_key"), F.col("l_shipdate").cast("date").alias("day"), money("l_extendedprice").alias("amount"))
    t = business.totals(a, b, 1000)
    return t.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("a", "b", "diff")})


_ROLLING = """WITH o AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS s, (date_trunc('month', o_orderdate) + (CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 1 END) * INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS t, o_orderpriority AS g, o_totalprice::DECIMAL(18,2) AS v FROM orders),
b AS (SELECT o_custkey AS k, l_shipdate::DATE AS day, o_orderpriority AS g, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END::DECIMAL(18,2) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT DISTINCT s, t FROM o), c AS (SELECT s, t FROM p WHERE (SELECT count(DISTINCT day) FROM b WHERE day BETWEEN s AND t) = t - s + 1),
x AS (SELECT k, s, t, sum(v) AS a, list_sort(list(DISTINCT g)) AS ga FROM (SELECT k, s, t, g, sum(v) AS v FROM o JOIN c USING (s, t) GROUP BY ALL) GROUP BY ALL),
y AS (SELECT k, s, t, sum(v) AS b, list_sort(list(DISTINCT g)) AS gb FROM (SELECT k, s, t, g, sum(v) AS v FROM b JOIN c ON day BETWEEN s AND t WHERE v <> 0 GROUP BY ALL) GROUP BY ALL),
j AS (SELECT k, s, t, a, b, ga, gb, coalesce(a, 0) - coalesce(b, 0) AS diff FROM x FULL JOIN y USING (k, s, t))
SELECT k AS entity_key, s AS start, t AS "end", a::DECIMAL(28,2) AS a, b::DECIMAL(28,2) AS b, diff::DECIMAL(28,2) AS diff, kind FROM (
  SELECT *, CASE WHEN abs(diff) > 50000 THEN CASE WHEN b IS NULL THEN 'only a' WHEN a IS NULL THEN 'only b' ELSE 'both' END WHEN len(ga) > 0 AND len(gb) > 0 AND ga <> gb THEN 'group' END AS kind FROM j) WHERE kind IS NOT NULL"""


@query(_ROLLING)
def aggregate_compare_periods(spark, d):
    """Months and years that begin with each month: periods overlap; rows of line 7 cover their day but don't count."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    month = F.trunc("o_orderdate", "month")
    end = F.date_sub(F.add_months(month, F.when(F.col("o_orderkey") % 2 == 0, 12).otherwise(1)), 1)
    a = o.select(F.col("o_custkey").alias("entity_key"), month.alias("start"), end.alias("end"), F.col("o_orderpriority").alias("grp"), money("o_totalprice").alias("amount"))
    amount = F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)")
    b = li.join(o, F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("entity_key"), F.col("l_shipdate").cast("date").alias("day"), F.col("o_orderpriority").alias("grp"), amount.alias("amount"))
    found = rules.aggregate_compare_periods(a, b, 50_000)
    return found.select("entity_key", "start", "end", *(F.col(c).cast("decimal(28,2)").alias(c) for c in ("a", "b", "diff")), "kind")


@query("""WITH p AS (SELECT o_orderkey AS r, o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS s, o_orderstatus AS place, o_orderpriority AS role, o_totalprice::DECIMAL(18,2) AS v,
  o_orderkey % 50 = 0 OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) OR o_orderkey % 11 = 0 AS bad FROM orders)
SELECT s AS start, (s + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS "end", place, role, sum(v)::DECIMAL(28,2) AS paid, count(DISTINCT k) AS staff, sum(CASE WHEN bad THEN v ELSE 0 END)::DECIMAL(28,2) AS flagged FROM p GROUP BY ALL""")
def staffing_view(spark, d):
    o = table(spark, d, "orders")
    paid = o.select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("entity_key"), F.trunc("o_orderdate", "month").alias("start"), F.last_day("o_orderdate").alias("end"), F.col("o_orderstatus").alias("place"), F.col("o_orderpriority").alias("role"), money("o_totalprice").alias("amount"), (F.col("o_orderkey") % 11 == 0).alias("provisional"))
    none = F.lit(None).cast("long")
    reasons = o.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("rec_id"), none.alias("entity_key"), F.lit("cited").alias("reason")).unionByName(table(spark, d, "customer").filter("c_acctbal < 0").select(none.alias("rec_id"), F.col("c_custkey").alias("entity_key"), F.lit("in debt").alias("reason")))
    return business.staffing(paid, reasons).select("start", "end", "place", "role", F.col("paid").cast("decimal(28,2)").alias("paid"), "staff", F.col("flagged").cast("decimal(28,2)").alias("flagged"))


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 AS ok FROM supplier""")
def email_endings(spark, d):
    """Endings have two letters or more."""
    end = F.when(F.col("s_suppkey") % 3 == 0, ".museum").when(F.col("s_suppkey") % 3 == 1, ".c").otherwise(".12")
    return table(spark, d, "supplier").select("s_suppkey", normalize.email(F.concat(F.lit(" X.y@z-"), F.col("s_suppkey").cast("string"), end))[1].isNull().alias("ok"))


@query(r"""SELECT DISTINCT c_name AS title, trim(regexp_replace(regexp_replace(regexp_replace(c_name || ' owes  ' || c_acctbal || '. (' || (1 + c_nationkey % 12) || '/' || (1 + c_custkey % 28) || '–12/31)', '\(\d{1,2}/\d{1,2}[–-]\d{1,2}/\d{1,2}\)', '', 'g'), '\d[\d,.]*', '#', 'g'), '\s+', ' ', 'g')) AS generic FROM customer""")
def issue_generic_title(spark, d):
    c = table(spark, d, "customer")
    period = F.concat(F.lit(". ("), (1 + F.col("c_nationkey") % 12).cast("string"), F.lit("/"), (1 + F.col("c_custkey") % 28).cast("string"), F.lit("–12/31)"))
    return c.select(F.col("c_name").alias("title"), business.generic_title(F.concat("c_name", F.lit(" owes  "), F.col("c_acctbal").cast("string"), period)).alias("generic")).distinct()


@query("""SELECT o_orderkey AS fingerprint, o_custkey AS entity_key, c_name AS entity_name, CASE o_orderstatus WHEN 'P' THEN 'critical' ELSE 'warning' END AS severity FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'""")
def issue_filter(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fingerprint"), F.col("o_custkey").alias("entity_key"), F.when(F.col("o_orderstatus") == "P", "critical").otherwise("warning").alias("severity"), F.col("o_orderpriority").alias("category"), F.lit("open").alias("status"))
    e = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("name"))
    return business.issue_list(o, e, severity="critical", category="2-HIGH").select("fingerprint", "entity_key", "entity_name", "severity")


@query("""WITH i AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'P' THEN 'critical' WHEN 'F' THEN 'warning' ELSE 'info' END AS severity, o_orderkey % 2 = 0 AS open FROM orders),
n AS (SELECT k, count(*) FILTER (severity <> 'info') AS open_issues, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS worst FROM i WHERE open GROUP BY 1)
SELECT c_custkey AS entity_key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)::BIGINT AS n_a, coalesce(open_issues, 0)::BIGINT AS open_issues, worst FROM customer LEFT JOIN n ON k = c_custkey""")
def entity_rollup(spark, d):
    o = table(spark, d, "orders")
    level = F.when(F.col("o_orderstatus") == "P", "critical").when(F.col("o_orderstatus") == "F", "warning").otherwise("info")
    found = o.select(F.col("o_custkey").alias("entity_key"), level.alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise("resolved").alias("status"))
    records = o.select(F.col("o_custkey").alias("entity_key"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("source"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_key"), F.lit("verified").alias("status"))
    return business.entity_list(e, records, found).select("entity_key", F.coalesce(F.try_element_at("sources", F.lit("a")), F.lit(0)).alias("n_a"), "open_issues", "worst")


@query("""SELECT 'records' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'linked_pct', round_even(100.0::DOUBLE * count(*) FILTER (o_custkey % 4 <> 0) / count(*), 0) FROM orders
UNION ALL SELECT 'agreeing_pct', round_even(100.0::DOUBLE * count(*) FILTER (l_linestatus = 'F') / count(*), 0) FROM lineitem
UNION ALL SELECT 'entities', count(*)::DOUBLE FROM customer UNION ALL SELECT 'clean_pct', round_even(100.0::DOUBLE * count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderkey % 2 = 0)) / count(*), 0) FROM customer
UNION ALL SELECT 'open_critical', count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0 UNION ALL SELECT 'open_warning', count(*)::DOUBLE FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0 UNION ALL SELECT 'open_info', 0.0""")
def summary_metrics(spark, d):
    o = table(spark, d, "orders")
    records = o.select(F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("entity_key"))
    attributes = table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("CONFLICT").alias("status"))
    found = o.select(F.col("o_custkey").alias("entity_key"), F.when(F.col("o_orderstatus") == "P", "critical").otherwise("warning").alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise("resolved").alias("status"))
    return business.summary(records, attributes, found, table(spark, d, "customer").select(F.col("c_custkey").alias("entity_key")))


@query("""SELECT o_orderkey AS entity_key, o_orderdate::DATE + 60 AS expiry, count(*) AS hits, min(l_shipdate)::DATE AS first_day
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity <> 7 AND l_quantity % 5 <> 0 AND l_shipdate::DATE > o_orderdate::DATE + 60 GROUP BY 1, 2""")
def activity_without_measure(spark, d):
    """A record whose measure is blank (every multiple of 5) or zero (7) isn't worked."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_key"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("expiry"))
    q = F.col("l_quantity")
    return rules.activity_after_expiry(e, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.col("l_shipdate").cast("date").alias("day"), F.when(q == 7, 0.0).when(q % 5 != 0, q).alias("worked")))
