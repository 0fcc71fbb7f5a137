"""Dates and names are parsed without failing tries and without working out one text many times over."""

from pyspark.sql import functions as F

from veristrata.functions import names, normalize


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_patterns_that_fit_are_tried(spark):
    rows = [("1998-2-3",), ("2/3/1998",), ("2/3/98",), ("19980203",), ("Feb 3, 1998",), ("february  3 1998",), ("3-FEB-1998",), ("1998-02-03t04:05:06",), ("35829",), ("2.3.1998",), ("31/31/1998",), ("n/a",), ("soon",)]
    df = spark.createDataFrame(rows, "t string").select("t", normalize.date(F.col("t"))[0].cast("string").alias("day"))
    day = {r["t"]: r["day"] for r in df.collect()}
    assert [t for t, v in day.items() if v is None] == ["31/31/1998", "n/a", "soon"] and set(day.values()) == {"1998-02-03", None}
    fits = lambda t: [p for p in normalize.DATE_PATTERNS if spark.range(1).select(F.lit(t).rlike(normalize._shape(p))).first()[0]]
    assert fits("2/3/98") == fits("19980203") == fits("soon") == [] and fits("2/3/1998") == ["M/d/yyyy"]


def test_text_is_worked_out_once(spark):
    raw = spark.createDataFrame([("Ann B. Doe",)], "t string").select(F.upper("t").alias("t"))
    assert _plan(raw.select(normalize.date(F.col("t"))[0].alias("d"))).count("upper(t#") == 1
    assert _plan(raw.select(names.parse_person(F.col("t")).alias("n"))).count("upper(t#") <= 3


def test_ladder_parses_distinct_names(spark, tmp_path, monkeypatch):
    """Conditions on parsed names aren't pushed to every row: they are parsed from a table of distinct ones."""
    from veristrata.plans import queries

    spark.createDataFrame([(f"{a} {b}",) for a in ("cold", "gold") for b in ("bolt", "gear")] * 50, "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    settled = {}
    monkeypatch.setattr(queries, "settle", lambda df, name: settled.setdefault(name, df.localCheckpoint()), raising=False)
    got = {(r["a"], r["b"]) for r in queries.name_ladder(spark, str(tmp_path)).collect()}
    assert settled["distinct"].count() == 4 and settled["parsed"].count() == 4 and ("Cold Bolt", "Gold Bolt") in got


def test_orphans_group_records_once(spark, monkeypatch):
    """Groups are read twice but made once."""
    from veristrata.engine import process

    settled = []
    monkeypatch.setattr(process, "settle", lambda df, name: settled.append(name) or df.localCheckpoint())
    config = {"entity": {"anchor_source": "x", "key_field": "id"}, "attributes": {}, "sources": {"part": {"fields": {"id": {"type": "id"}, "name": {"type": "person_name"}}, "name": {"full": "name"}}}}
    rows = spark.createDataFrame([(1, None, "Ann Doe"), (2, None, "ann doe"), (3, "p 7", None), (4, None, None)], "rec_id long, id string, name string")
    linked = process.normalize_records(rows, "part", config["sources"]["part"]).withColumn("entity_key", F.lit(None).cast("string"))
    got = {r["rec_id"]: r["entity_key"] for r in process.Engine(config, "1998-12-01").orphans(linked).collect()}
    assert got == {1: "U-doe-ann", 2: "U-doe-ann", 3: "U-p7"} and settled == ["orphan_groups"]


def test_reconcile_moves_evidence_twice(spark, monkeypatch):
    """Once to count what was seen, once to an entity's attribute; names are compared as before."""
    from veristrata.engine import process

    held = []
    monkeypatch.setattr(process, "settle", lambda df, name: held.append(df._jdf.queryExecution().executedPlan().toString()) or df.localCheckpoint())
    attributes = {"status": {"from": {"a": "status", "b": "status"}, "authority": ["b"]}, "boss": {"from": {"a": "boss", "b": "boss"}, "compare": "person_name"}}
    rows = [("E", "status", "a", 1, "x"), ("E", "status", "b", 2, "z"), ("E", "status", "a", 0, "y"), ("F", "status", "a", 5, "y"), ("F", "status", "a", 6, "x"), ("F", "status", "a", 7, "x"), ("E", "boss", "a", 1, "Ann Doe"), ("E", "boss", "b", 2, "ANN DOE"), ("F", "boss", "a", 3, "Ann Doe"), ("F", "boss", "b", 4, "Zed Roe")]
    e = spark.createDataFrame(rows, "entity_key string, attribute string, source string, rec_id long, value string").withColumns({"name": F.when(F.col("attribute") == "boss", names.parse_person(F.col("value"))), "match_status": F.lit("auto")})
    e = e.withColumn("name", F.col("name").cast(names.NAME))
    entities = spark.createDataFrame([("E",), ("F",), ("G",)], "entity_key string")

    def made(only):
        own = {k: attributes[k] for k in only}
        engine = process.Engine({"entity": {"anchor_source": "x", "key_field": "id"}, "attributes": own, "sources": {"a": {}, "b": {}}}, "1998-12-01")
        return {(r["entity_key"], r["attribute"]): r for r in engine.reconcile(e.filter(F.col("attribute").isin(list(own))), entities, None)[0].collect()}

    got = made(attributes)
    show = {k: (r["value"], r["status"], r["authority"], r["sources"], r["n_values"]) for k, r in got.items()}
    assert show["E", "status"] == ("z", "CONFLICT", "b", {"a": ["y", "x"], "b": ["z"]}, 3)
    assert show["F", "status"] == ("x", "CONFLICT", None, {"a": ["y", "x"]}, 2)
    assert show["E", "boss"][1] == "CONFIRMED" and show["F", "boss"][1] == "CONFLICT" and show["G", "boss"][1] == "MISSING"
    held.clear()
    assert made(["status"])["E", "status"]["value"] == "z" and held[0].count("Exchange hashpartitioning(entity_key") == 2
