"""The library's queries on the driver's tables, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import names, normalize
from veristrata.functions.settle import settle
from veristrata.operators import issues, resolve, rules, views

AS_OF = "1998-12-01"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# --- normalisation -------------------------------------------------------------------------

@query(r"SELECT c_custkey, regexp_replace(regexp_replace(upper(c_name), '[\s#._/-]', '', 'g'), '^([A-Z]+)(\d+)$', '\1-\2') AS license FROM customer")
def license_normalise(spark, d):
    return table(spark, d, "customer").select("c_custkey", normalize.license_number(F.col("c_name")).alias("license"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type).replace('&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS simple FROM part")
def simplify_text(spark, d):
    return table(spark, d, "part").select("p_partkey", normalize.simplify(F.concat("p_name", F.lit(" & "), "p_type")).alias("simple"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day, FALSE AS problem FROM orders")
def date_formats(spark, d):
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(day, "M/d/yyyy")).when(k == 1, F.date_format(day, "MMM d, yyyy")).when(k == 2, F.date_format(day, "M/d/yy")).when(k == 3, F.date_format(day, "yyyyMMdd")).otherwise(F.datediff(day.cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
    value, problem = normalize.date(text)
    return o.select("o_orderkey", value.alias("day"), problem.isNotNull().alias("problem"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, CASE WHEN l_quantity < 5 THEN 'below the expected minimum 5' WHEN l_quantity > 45 THEN 'above the expected maximum 45' END AS problem FROM lineitem")
def number_range(spark, d):
    value, problem = normalize.number(F.concat(F.lit("qty "), F.format_number("l_quantity", 2)), 5, 45)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), problem.alias("problem"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substr(t, 1, 3) || '-' || substr(t, 4, 3) || '-' || substr(t, 7, 4) ELSE u END AS phone, c_custkey % 3 <> 0 AS problem
FROM (SELECT c_custkey, (2000000000 + c_custkey)::VARCHAR AS t, (200000 + c_custkey)::VARCHAR AS u FROM customer)""")
def phone_normalise(spark, d):
    k = F.col("c_custkey")
    ten = (F.lit(2000000000) + k).cast("string")
    raw = F.when(k % 3 == 0, F.concat(F.lit("+1 ("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 7))).otherwise((F.lit(200000) + k).cast("string"))
    value, problem = normalize.phone(raw)
    return table(spark, d, "customer").select("c_custkey", value.alias("phone"), problem.isNotNull().alias("problem"))


@query("SELECT s_suppkey, upper(replace(s_name, ' ', '')) AS id, lower(s_name) || CASE WHEN s_suppkey % 2 = 0 THEN '@mail.example' ELSE '' END AS email, s_suppkey % 2 = 1 OR position(' ' IN s_name) > 0 AS problem FROM supplier")
def id_and_email(spark, d):
    value, problem = normalize.email(F.concat(F.lit(" "), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "@Mail.example").otherwise("")))
    return table(spark, d, "supplier").select("s_suppkey", normalize.identifier(F.col("s_name")).alias("id"), value.alias("email"), problem.isNotNull().alias("problem"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'U' WHEN o_orderpriority LIKE '%HIGH%' THEN 'H' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'M' WHEN o_orderpriority LIKE '%LOW%' THEN 'L' END AS code,
  NOT (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%MEDIUM%' OR o_orderpriority LIKE '%LOW%') AS problem FROM orders""")
def code_priority(spark, d):
    value, problem = normalize.code(F.col("o_orderpriority"), normalize.vocabulary({"U": ["urgent"], "H": ["high"], "M": ["medium"], "L": ["low"]}))
    return table(spark, d, "orders").select("o_orderkey", value.alias("code"), problem.isNotNull().alias("problem"))


# --- resolution ----------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def record_key_dups(spark, d):
    return resolve.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT md5(text) AS signature, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def signature_dups(spark, d):
    return resolve.duplicate_keys(table(spark, d, "documents").select(F.md5("text").alias("signature")), "signature")


@query("SELECT o_custkey AS entity_key, min_by(o_orderpriority, o_orderkey) AS name, count(*) AS n_records FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def anchor_build(spark, d):
    return resolve.anchors(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT o_orderkey AS rec_id, coalesce(a.c_custkey, b.c_custkey) AS entity_key, CASE WHEN a.c_custkey IS NOT NULL THEN 'k1' ELSE 'k2' END AS method
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS k1, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS k2 FROM orders)
LEFT JOIN customer a ON a.c_custkey = k1 LEFT JOIN customer b ON b.c_name = k2 WHERE a.c_custkey IS NOT NULL OR b.c_custkey IS NOT NULL""")
def key_link(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).cast("string").alias("k1"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("k2"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_custkey").cast("string").alias("id"), "c_name")
    return resolve.link_by_keys(o, "o_orderkey", c, [("k1", "id"), ("k2", "c_name")])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_orders(spark, d):
    return resolve.orphans(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec_id")), "o_orderkey")


_TOP2 = """WITH w AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part),
c AS (SELECT a.p_name AS rec, b.p_name AS entity, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS score FROM w a JOIN w b ON a.p_name <> b.p_name AND len(list_intersect(a.t, b.t)) > 0),
r AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS second FROM c WINDOW o AS (PARTITION BY rec ORDER BY score DESC, entity))
SELECT rec, entity, score, CASE WHEN score >= 0.5 AND NOT (coalesce(second, 0) >= 0.5 AND score - second < 0.03) THEN 'auto' WHEN score >= 0.2 THEN 'review' ELSE 'none' END AS decision FROM r WHERE r = 1"""


@query(_TOP2)
def top2_decision(spark, d):
    w = table(spark, d, "part").select("p_name").distinct().select("p_name", F.array_distinct(F.split("p_name", " ")).alias("t"))
    w = w.select("p_name", "t", F.explode("t").alias("block"))  # only names that share a word can meet
    a, b = w.select(F.col("p_name").alias("rec"), F.col("t").alias("x"), "block"), w.select(F.col("p_name").alias("entity"), F.col("t").alias("y"), "block")
    pairs = a.join(b, "block").filter("rec <> entity").select("rec", "entity", "x", "y").distinct()
    score = F.size(F.array_intersect("x", "y")).cast("double") / F.size(F.array_union("x", "y"))
    return resolve.decide(pairs, "rec", score, "entity", auto=0.5, floor=0.2)


_LADDER = """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS d, string_split(p_name, ' ')[1] AS f, array_to_string(string_split(p_name, ' ')[2:], '') AS l FROM (SELECT DISTINCT p_name FROM part)),
p AS MATERIALIZED (SELECT a.d AS a, b.d AS b, a.f AS fa, a.l AS la, b.f AS fb, b.l AS lb FROM n a JOIN n b ON a.d < b.d),
t AS MATERIALIZED (SELECT DISTINCT fa AS x, fb AS y FROM p UNION SELECT DISTINCT la, lb FROM p),
-- longest common block, the first in x and then in y; then what is left of it and right of it
r(x, y, a0, a1, b0, b1, m) AS (
  SELECT x, y, 1, length(x) + 1, 1, length(y) + 1, 0 FROM t
  UNION ALL
  SELECT x, y, CASE WHEN s = 0 THEN a0 ELSE i + k END, CASE WHEN s = 0 THEN i ELSE a1 END, CASE WHEN s = 0 THEN b0 ELSE j + k END, CASE WHEN s = 0 THEN j ELSE b1 END, CASE WHEN s = 0 THEN k ELSE 0 END
  FROM (SELECT x, y, a0, a1, b0, b1, unnest([0, 1]) AS s, best[1] AS k, -best[2] AS i, -best[3] AS j FROM (
    SELECT x, y, a0, a1, b0, b1, max([k, -i, -j]) AS best
    FROM r, (SELECT unnest(range(1, 40)) AS i) u, (SELECT unnest(range(1, 40)) AS j) v, (SELECT unnest(range(1, 40)) AS k) w
    WHERE i >= a0 AND i + k <= a1 AND j >= b0 AND j + k <= b1 AND substr(x, i, k) = substr(y, j, k)
    GROUP BY ALL))),
q AS MATERIALIZED (SELECT x, y, 2.0::DOUBLE * sum(m) / (length(x) + length(y)) AS ratio FROM r GROUP BY x, y),
s AS (
  SELECT a, b, CASE WHEN la = lb AND (starts_with(fa, fb) OR starts_with(fb, fa)) AND least(length(fa), length(fb)) >= 3 AND fa <> fb THEN 0.9
      WHEN la = lb AND fa = fb THEN 1.0 WHEN fa = lb AND la = fb THEN 0.9
      ELSE round(0.6::DOUBLE * ql.ratio + 0.4::DOUBLE * CASE WHEN fa = fb THEN 1.0::DOUBLE ELSE qf.ratio END, 3) END::DOUBLE AS score,
    CASE WHEN la = lb AND fa = fb THEN 'exact' WHEN fa = lb AND la = fb THEN 'swapped' WHEN la = lb AND (starts_with(fa, fb) OR starts_with(fb, fa)) AND least(length(fa), length(fb)) >= 3 THEN 'shortened' ELSE 'fuzzy' END AS how
  FROM p JOIN q ql ON ql.x = la AND ql.y = lb JOIN q qf ON qf.x = fa AND qf.y = fb)
SELECT array_to_string(list_transform(string_split(a, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS a, array_to_string(list_transform(string_split(b, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS b, score, how FROM s WHERE score >= 0.65"""


@query(_LADDER)
def name_ladder(spark, d):
    distinct = settle(table(spark, d, "part").select("p_name").distinct(), "distinct")  # else conditions on parsed names go below, to every row
    p = settle(distinct.select(names.parse_person(F.col("p_name")).alias("name")).withColumn("id", F.col("name.display")), "parsed")
    return names.candidates(p, p, "id", "id").filter("rec < entity").select(F.col("rec").alias("a"), F.col("entity").alias("b"), "score", "how")


_RECONCILE = """WITH e AS (
  SELECT o_orderkey AS k, 'orders' AS source, 0::BIGINT AS ord, o_orderstatus AS value FROM orders
  UNION ALL SELECT DISTINCT l_orderkey, 'lineitem', 1, l_linestatus FROM lineitem),
s AS (SELECT k, count(DISTINCT value) AS n_values, count(DISTINCT source) AS n_sources, min_by(value, (CASE source WHEN 'orders' THEN 0 ELSE 1 END)::VARCHAR || value) AS value FROM e GROUP BY k)
SELECT o_orderkey AS entity_key, s.value, CASE WHEN n_values > 1 THEN 'CONFLICT' WHEN n_sources > 1 THEN 'CONFIRMED' ELSE 'SINGLE_SOURCE' END AS status, n_sources, n_values
FROM orders JOIN s ON k = o_orderkey"""


@query(_RECONCILE)
def reconcile_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_key"), F.lit("orders").alias("source"), F.lit(0).cast("long").alias("rec_ord"), F.col("o_orderstatus").alias("value"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.lit("lineitem").alias("source"), F.lit(1).cast("long").alias("rec_ord"), F.col("l_linestatus").alias("value"))
    return resolve.reconcile(o.unionByName(li), o.select("entity_key"), ["orders", "lineitem"])


# --- rules ---------------------------------------------------------------------------------

@query("SELECT c_custkey AS entity_key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1997-06-01')")
def presence_gap(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_key"))
    return rules.presence(c, table(spark, d, "orders").filter("o_orderdate >= '1997-06-01'").select(F.col("o_custkey").alias("entity_key")))


_LAST = "SELECT o_custkey AS entity_key, max(o_orderdate)::DATE AS day FROM orders GROUP BY 1"


def _last_order(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity_key")).agg(F.max("o_orderdate").cast("date").alias("day"))


@query(f"SELECT * FROM (SELECT entity_key, day, (day - DATE '1998-07-01')::BIGINT AS days, CASE WHEN day < DATE '1998-07-01' THEN 'critical' WHEN day - DATE '1998-07-01' <= 20 THEN 'warning' END AS severity FROM ({_LAST})) WHERE severity IS NOT NULL")
def expiry(spark, d):
    return rules.expiration(_last_order(spark, d), F.col("day"), "1998-07-01", 20)


@query(f"SELECT entity_key, day, (DATE '{AS_OF}' - day)::BIGINT AS age FROM ({_LAST}) WHERE DATE '{AS_OF}' - day > 180")
def staleness(spark, d):
    return rules.staleness(_last_order(spark, d), F.col("day"), AS_OF, 180)


@query("""SELECT o_orderkey AS entity_key, o_orderdate::DATE + 60 AS expiry, count(*) AS hits, min(l_shipdate)::DATE AS first_day
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity <> 0 AND l_shipdate::DATE > o_orderdate::DATE + 60 GROUP BY 1, 2""")
def activity_after_expiry(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_key"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("expiry"))
    return rules.activity_after_expiry(e, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("worked")))


@query("""SELECT * FROM (SELECT o_orderkey, (l_shipdate::DATE - o_orderdate::DATE + 1)::BIGINT AS days, CASE WHEN l_shipdate::DATE < o_orderdate::DATE THEN 'warning' WHEN l_shipdate::DATE - o_orderdate::DATE + 1 <> 7 THEN 'info' END AS severity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE severity IS NOT NULL""")
def date_order(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    return rules.date_order(j, F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"), 7).select("o_orderkey", "days", "severity")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN regexp_matches(o_orderstatus, '(?i)p') THEN 'critical' ELSE 'warning' END AS severity FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> 'O'")
def unusual_status(spark, d):
    return rules.unusual_value(table(spark, d, "orders"), F.col("o_orderstatus"), ["O"], "p").select("o_orderkey", "o_orderstatus", "severity")


@query("SELECT a.p_partkey AS k1, b.p_partkey AS k2, a.p_name, a.p_brand, a.p_size FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def duplicate_entity(spark, d):
    part, match_on = table(spark, d, "part"), ("p_name", "p_brand", "p_size")
    pairs = rules.duplicate_entity(part, "p_partkey", [match_on], pairs_up_to=None)
    return pairs.join(part, F.expr("k1 = p_partkey")).select("k1", "k2", *match_on)


@query("""WITH v AS (SELECT p_partkey AS k, 'p_brand' AS a, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part),
m AS (SELECT *, count(*) OVER (PARTITION BY a, v) AS n, min(k) OVER (PARTITION BY a, v) AS head FROM v),
p AS (SELECT x.k AS k1, y.k AS k2, bool_or(x.n > 5) AS hot FROM m x JOIN m y ON x.a = y.a AND x.v = y.v AND x.k < y.k AND (x.n <= 5 OR x.k = x.head) GROUP BY 1, 2)
SELECT k1, k2, string_agg(x.a || ' ' || x.v, ', ' ORDER BY x.a) AS reasons, hot FROM p JOIN v x ON x.k = k1 JOIN v y ON y.k = k2 AND y.a = x.a AND y.v = x.v GROUP BY k1, k2, hot""")
def duplicate_entity_any(spark, d):
    pairs = rules.duplicate_entity(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_size"], pairs_up_to=5)
    return pairs.select("k1", "k2", F.array_join(F.transform("reasons", lambda r: F.concat(r["attribute"], F.lit(" "), r["value"])), ", ").alias("reasons"), "hot")


@query("""WITH a AS (SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS p, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS a FROM orders GROUP BY ALL),
b AS (SELECT l_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS p, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT k AS entity_key, p AS period, a, b, (coalesce(a, 0) - coalesce(b, 0))::DECIMAL(29,2) AS diff, CASE WHEN b IS NULL THEN 'only a' WHEN a IS NULL THEN 'only b' ELSE 'both' END AS kind FROM a FULL JOIN b USING (k, p) WHERE abs(coalesce(a, 0) - coalesce(b, 0)) > 1000""")
def aggregate_compare(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    month = F.trunc("o_orderdate", "month")
    a = o.select(F.col("o_orderkey").alias("entity_key"), month.alias("period"), money("o_totalprice").alias("amount"))
    b = li.join(o, F.expr("l_orderkey = o_orderkey")).select(F.col("l_orderkey").alias("entity_key"), month.alias("period"), money("l_extendedprice").alias("amount"))
    return rules.aggregate_compare(a, b, 1000)


@query("""WITH p AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS s FROM orders), d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderpriority LIKE '1%')
SELECT s AS start, (s + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS "end", count(*) AS n_days, count(d.day) AS n_seen, count(*) = count(d.day) AS covered
FROM (SELECT s, unnest(generate_series(s, s + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM p) x LEFT JOIN d ON d.day = x.day GROUP BY s""")
def period_coverage(spark, d):
    o = table(spark, d, "orders")
    p = o.select(F.trunc("o_orderdate", "month").alias("start")).distinct().withColumn("end", F.last_day("start"))
    return rules.period_coverage(p, o.filter("o_orderpriority LIKE '1%'").select(F.col("o_orderdate").cast("date").alias("day")))


# --- issues --------------------------------------------------------------------------------

@query("SELECT substr(sha1('expiry|' || o_orderkey || '|' || o_orderstatus), 1, 16) AS fingerprint, o_orderkey FROM orders")
def issue_fingerprint(spark, d):
    return table(spark, d, "orders").select(issues.fingerprint(F.lit("expiry"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("fingerprint"), "o_orderkey")


@query("""WITH i AS (SELECT substr(sha1('status|' || o_orderkey), 1, 16) AS fingerprint, 'status' AS rule, 'critical' AS severity, 'Status' AS category, o_orderkey::VARCHAR AS entity_key, 'Status is ' || o_orderstatus AS title FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT substr(sha1('large|' || o_orderkey), 1, 16), 'large', 'warning', 'Amounts', o_orderkey::VARCHAR, 'Large order' FROM orders WHERE o_totalprice > 300000)
SELECT * FROM i ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, category, fingerprint""")
def severity_ranked_issues(spark, d):
    o = table(spark, d, "orders")
    a = issues.issue(o.filter("o_orderstatus = 'P'"), "status", "critical", "Status", F.col("o_orderkey"), F.concat(F.lit("Status is "), "o_orderstatus"), F.col("o_orderkey"))
    b = issues.issue(o.filter("o_totalprice > 300000"), "large", "warning", "Amounts", F.col("o_orderkey"), F.lit("Large order"), F.col("o_orderkey"))
    return issues.ordered(issues.union(a, b))


@query("""WITH o AS (SELECT DISTINCT o_custkey::VARCHAR AS f, o_custkey % 3 <> 0 AS was FROM orders WHERE o_orderdate < DATE '1995-01-01'), n AS (SELECT DISTINCT o_custkey::VARCHAR AS f FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT coalesce(o.f, n.f) AS fingerprint, n.f IS NOT NULL AS active, CASE WHEN o.f IS NULL THEN 'issue_detected' WHEN n.f IS NOT NULL AND NOT was THEN 'issue_reopened' WHEN n.f IS NULL AND was THEN 'issue_cleared' END AS event FROM o FULL JOIN n ON o.f = n.f""")
def issue_lifecycle(spark, d):
    o = table(spark, d, "orders").withColumn("fingerprint", F.col("o_custkey").cast("string"))
    old = o.filter("o_orderdate < '1995-01-01'").select("fingerprint", (F.col("o_custkey") % 3 != 0).alias("active")).distinct()
    return issues.lifecycle(old, o.filter("o_orderdate >= '1998-01-01'"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_decision(spark, d):
    return issues.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 THEN r.action END AS action, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 THEN r.rule_id END AS rule_id
FROM orders LEFT JOIN (SELECT left(n_name, 1) AS p, min_by(n_name, n_nationkey) AS action, min(n_nationkey) AS rule_id FROM nation GROUP BY 1) r ON r.p = o_orderstatus""")
def auto_rule_match(spark, d):
    i = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("pattern"), F.when(F.col("o_orderstatus") == "P", "critical").otherwise("warning").alias("severity"), (F.col("o_orderkey") % 4 == 0).alias("decided"))
    r = table(spark, d, "nation").select(F.col("n_nationkey").alias("rule_id"), F.substring("n_name", 1, 1).alias("pattern"), F.col("n_name").alias("action"))
    return issues.auto_rules(i, r).select("o_orderkey", "action", "rule_id")


# --- views ---------------------------------------------------------------------------------

@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events")
def json_view(spark, d):
    views.create_view(table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k")), "file_events")
    return spark.table("file_events")


@query("""WITH f AS (SELECT event_type, ts::DATE AS day, CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Day' ELSE 'Evening' END AS band, count(*) AS n, count(*) FILTER (value > 50) AS c FROM events GROUP BY ALL)
SELECT e.event_type, x.day, b.band, coalesce(f.n, 0)::BIGINT AS n, CASE WHEN f.n IS NULL THEN 'gap' WHEN f.c > 0 THEN 'ok' ELSE 'at_risk' END AS status
FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (SELECT DISTINCT ts::DATE AS day FROM events) x CROSS JOIN (VALUES ('Night'), ('Day'), ('Evening')) b(band) LEFT JOIN f ON f.event_type = e.event_type AND f.day = x.day AND f.band = b.band""")
def coverage_grid(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    band = F.when(F.hour("ts") < 8, "Night").when(F.hour("ts") < 16, "Day").otherwise("Evening")
    return views.coverage(e, "event_type", "day", band, ["Night", "Day", "Evening"], F.col("value") > 50)


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, c_mktsegment, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS amount, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DECIMAL(28,2) AS flagged
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def staffing_rollup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.trunc("o_orderdate", "month").alias("month"), "c_mktsegment", "o_orderpriority", "o_orderstatus", money("o_totalprice").alias("amount"))
    return views.flagged_rollup(j, ["month", "c_mktsegment", "o_orderpriority"], "amount", F.col("o_orderstatus") == "P")


@query("""SELECT c_custkey, CASE WHEN day IS NULL THEN 'missing' WHEN day < DATE '1998-01-01' THEN 'expired' WHEN c_acctbal < 0 THEN 'conflict' WHEN day < DATE '1998-06-01' THEN 'expiring' ELSE 'valid' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS day FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def status_precedence(spark, d):
    j = table(spark, d, "customer").join(_last_order(spark, d), F.expr("c_custkey = entity_key"), "left")
    return j.select("c_custkey", views.first_status((F.col("day").isNull(), "missing"), (F.expr("day < date'1998-01-01'"), "expired"), (F.col("c_acctbal") < 0, "conflict"), (F.expr("day < date'1998-06-01'"), "expiring"), default="valid").alias("status"))


@query("""SELECT 'o_orderkey' AS "column", count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS n_distinct, count(*) - count(o_orderkey) AS n_null, min(o_orderkey::VARCHAR) AS low, max(o_orderkey::VARCHAR) AS high FROM orders
UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(DISTINCT o_orderpriority), count(*) - count(o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders""")
def column_profile(spark, d):
    return views.profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (v)) AS n_both, (SELECT count(*) FROM a JOIN b USING (v))::DOUBLE / (SELECT count(*) FROM b) AS share""")
def value_overlap(spark, d):
    return views.overlap(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("""SELECT c_custkey AS entity_key, max(CASE WHEN a = 'segment' THEN v END) AS segment, max(CASE WHEN a = 'nation' THEN v END) AS nation
FROM (SELECT c_custkey, 'segment' AS a, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1""")
def entity_export(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_key"), "c_mktsegment", "c_nationkey")
    a = c.select("entity_key", F.lit("segment").alias("attribute"), F.col("c_mktsegment").alias("value"))
    b = c.join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).select("entity_key", F.lit("nation").alias("attribute"), F.col("n_name").alias("value"))
    return views.pivot_attributes(a.unionByName(b), ["segment", "nation"])


@query("""SELECT o_custkey AS entity_key, o_orderdate::DATE AS at, 'order' AS kind, NULL::DOUBLE AS quantity FROM orders
UNION ALL SELECT o_custkey, l_shipdate::DATE, 'shipment', l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def timeline_union(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.select(F.col("o_custkey").alias("entity_key"), F.col("o_orderdate").cast("date").alias("at"), F.lit("order").alias("kind"))
    b = li.join(o, F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("entity_key"), F.col("l_shipdate").cast("date").alias("at"), F.lit("shipment").alias("kind"), F.col("l_quantity").alias("quantity"))
    return views.timeline(a, b)
