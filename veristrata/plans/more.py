"""Queries of names, schedules, setup and human decisions on the driver's tables; importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import names, normalize, schedule
from veristrata.functions.settle import shared_folder
from veristrata.operators import codes, infer, issues, resolve, state, views
from veristrata.plans.queries import _last_order, query, table
from veristrata.streaming import timers


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, array_to_string(string_split(p_name, ' ')[2:-2], ' ') AS middle, string_split(p_name, ' ')[-1] AS last FROM part")
def person_parse(spark, d):
    n = names.parse_person(F.regexp_replace("p_name", r"^(.*) (\S+)$", "$2, $1"))
    return table(spark, d, "part").select("p_partkey", n.alias("n")).select("p_partkey", "n.first", "n.middle", "n.last")


@query(r"SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS last, 'The ' || s_name || ', Inc.' AS display FROM supplier")
def org_parse(spark, d):
    n = names.parse_org(F.concat(F.lit("The "), "s_name", F.lit(",  Inc.")))
    return table(spark, d, "supplier").select("s_suppkey", n["last"].alias("last"), n["display"].alias("display"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'doe|#0' WHEN 1 THEN 'doe|#0' ELSE 'doe|zed' END AS name_key FROM customer")
def nickname_key(spark, d):
    first = F.when(F.col("c_custkey") % 3 == 0, "Bob").when(F.col("c_custkey") % 3 == 1, "Robert").otherwise("Zed")
    key = names.name_key(names.person(first, F.lit("Doe Jr")), names.nickname_groups(["robert rob bob"]))
    return table(spark, d, "customer").select("c_custkey", key.alias("name_key"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 8.0 WHEN 2 THEN 8.5 WHEN 3 THEN 12.0 END::DOUBLE AS hours, CASE o_orderkey % 5 WHEN 1 THEN 7.0 WHEN 2 THEN 15.0 WHEN 3 THEN 19.0 END::DOUBLE AS start, o_orderkey % 5 = 0 AS leave, o_orderkey % 5 IN (2, 3, 4) AS problem FROM orders""")
def shift_parse(spark, d):
    k = F.col("o_orderkey") % 5
    code = F.when(k == 0, "PTO").when(k == 1, "7a - 3p").when(k == 2, "3pm to 11:30pm").when(k == 3, "19:00-07:00").otherwise("??")
    s = schedule.shift(code, schedule.legend(F.lit("7a-3p and 3p-11p are 8 hours")))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.hours", "s.start", "s.leave", F.col("s.problem").isNotNull().alias("problem"))


@query("""SELECT o_orderkey, try_cast(CASE WHEN try_cast('1998-' || strftime(o_orderdate, '%m-%d') AS DATE) - DATE '1998-03-01' > 183 THEN '1997-' ELSE '1998-' END || strftime(o_orderdate, '%m-%d') AS DATE) AS day FROM orders""")
def day_headings(spark, d):
    return table(spark, d, "orders").select("o_orderkey", schedule.heading_day(F.date_format("o_orderdate", "EEE M/d"), "1998-03-01").alias("day"))


@query("""SELECT 'c_custkey' AS "column", 'id' AS type UNION ALL SELECT 'c_name', 'text' UNION ALL SELECT 'c_acctbal', 'number' UNION ALL SELECT 'c_mktsegment', 'code'""")
def column_types(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    stats = {r["column"]: r.asDict() for r in infer.column_statistics(t).collect()}  # one row a column
    heads = {"c_custkey": "cust id", "c_name": "title", "c_acctbal": "balance", "c_mktsegment": "segment"}
    return spark.createDataFrame([(c, infer.column_type(h, stats[c])) for c, h in heads.items()], "column string, type string")


@query("""SELECT 'c_custkey' AS column_a, 'o_custkey' AS column_b, count(DISTINCT c_custkey) AS n_both, count(DISTINCT o_custkey) AS n_b, count(DISTINCT c_custkey)::DOUBLE / count(DISTINCT o_custkey) AS share FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def column_links(spark, d):
    return infer.overlaps(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey"), {"c_custkey": "id"}, {"o_custkey": "id"})


@query("""SELECT o_orderkey AS rec_id, CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 'E1' ELSE o_custkey::VARCHAR END AS entity_key, CASE WHEN o_custkey % 10 = 0 THEN 'rejected' WHEN o_custkey % 10 = 1 THEN 'confirmed' ELSE 'review' END AS decision
FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def override_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    over = c.filter("c_custkey % 10 < 2").select(F.lit("orders").alias("source"), F.col("c_custkey").cast("string").alias("name_key"), F.when(F.col("c_custkey") % 10 == 0, state.NO_ENTITY).otherwise("E1").alias("entity_key"))
    key = F.col("o_custkey").cast("string")
    links = o.join(c, F.expr("o_custkey = c_custkey"), "left_semi").select(F.col("o_orderkey").alias("rec_id"), F.lit("orders").alias("source"), key.alias("name_key"), key.alias("entity_key"), F.lit(0.8).alias("score"), F.lit("review").alias("decision"))
    return state.apply_overrides(links, over).select("rec_id", "entity_key", "decision")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'acknowledged' ELSE 'open' END AS status FROM nation")
def decision_status(spark, d):
    k = F.col("n_nationkey") % 4
    return table(spark, d, "nation").select("n_nationkey", state.status(F.when(k == 0, "confirm").when(k == 1, "dismiss").when(k == 2, "acknowledge")).alias("status"))


@query("""SELECT o_custkey AS entity_key, count(*) FILTER (o_orderstatus <> 'O') AS open_issues, min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) AS worst FROM orders GROUP BY 1""")
def issue_rollup(spark, d):
    level = F.when(F.col("o_orderstatus") == "P", "critical").when(F.col("o_orderstatus") == "F", "warning").otherwise("info")
    return table(spark, d, "orders").withColumn("severity", level).groupBy(F.col("o_custkey").alias("entity_key")).agg(F.count_if(F.col("severity") != "info").alias("open_issues"), F.min(issues.rank(F.col("severity"))).alias("worst"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN day < DATE '1998-03-01' THEN 'expired' WHEN day - DATE '1998-03-01' <= 60 THEN 'soon' ELSE 'ok' END AS status FROM (SELECT max(o_orderdate)::DATE AS day FROM orders GROUP BY o_custkey)) GROUP BY 1""")
def expiring_counts(spark, d):
    days = F.datediff("day", F.lit("1998-03-01").cast("date"))
    return _last_order(spark, d).groupBy(views.first_status((days < 0, "expired"), (days <= 60, "soon"), default="ok").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_linestatus AS name_key, l_returnflag AS candidate, count(*) AS n, (list_sort(list(l_orderkey * 10 + l_linenumber)))[1:6]::VARCHAR AS evidence FROM lineitem GROUP BY 1, 2")
def review_groups(spark, d):
    """Records of a name and candidate as one group with its six first records; no more than six are ever held."""
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("name_key"), F.col("l_returnflag").alias("candidate"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"))
    return resolve.review_groups(li, "name_key", "candidate", "r").select("name_key", "candidate", "n", F.concat(F.lit("["), F.array_join(F.col("evidence").cast("array<string>"), ", "), F.lit("]")).alias("evidence"))


@query("SELECT event_id, c AS code, c IS NULL AS problem FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END AS c FROM events)")
def code_events(spark, d):
    value, problem = normalize.code(F.col("event_type"), normalize.vocabulary({"C": ["click"], "V": ["view"]}))
    return table(spark, d, "events").select("event_id", value.alias("code"), problem.isNotNull().alias("problem"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'F' END AS code, o_orderkey % 3 = 2 AS problem FROM orders")
def code_similar(spark, d):
    k = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "Facilty").when(k == 1, "the facility").otherwise("zebra").alias("v"))
    return codes.with_codes(o, "v", normalize.vocabulary({"F": ["facility"], "W": ["warehouse"]})).select("o_orderkey", "code", F.col("code_problem").isNotNull().alias("problem"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS d FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL), n AS (SELECT k, d, lead(d) OVER (PARTITION BY k ORDER BY d) AS nx FROM d),
o AS (SELECT k, d + 366 AS day, nx FROM n WHERE d + 366 <= coalesce(nx, (SELECT max(d) FROM d)))
SELECT k::VARCHAR AS entity_key, CASE row_number() OVER (PARTITION BY k ORDER BY day) WHEN 1 THEN 'issue_detected' ELSE 'issue_reopened' END AS event, day FROM o
UNION ALL SELECT k::VARCHAR, 'issue_cleared', nx FROM o WHERE nx IS NOT NULL""")
def quiet_customers(spark, d):
    """Customers without an order for over a year, opened by timers and cleared by orders, as orders stream in."""
    path, folder = f"{d}/orders.parquet", shared_folder(spark)
    orders = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/orders.parque[t]")  # a pattern, as a stream takes no single file
    day = F.col("o_orderdate").cast("date")
    records = orders.select(F.col("o_custkey").cast("string").alias("entity_key"), F.lit("last_order").alias("attribute"), day.alias("day"), F.timestamp_millis(F.unix_date(day).cast("long") * timers.DAY_MS).alias("at"))
    before = spark.conf.get(timers.PROVIDER)
    timers.use_rocksdb(spark)
    try:
        found = timers.watch(records, {"last_order": timers.Stale(365)}).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state")
        found.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(timers.PROVIDER, before)
    return spark.read.parquet(f"{folder}/events").select("entity_key", "event", "day")
