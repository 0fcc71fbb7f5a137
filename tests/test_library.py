"""Queries against DuckDB at the smallest scale, and units of the functions below them."""

import random
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from veristrata.functions import names, normalize
from veristrata.operators import infer, issues, resolve, rules, setup, state
from veristrata.operators.views import create_view
from veristrata.plans import more  # noqa: F401
from veristrata.plans.queries import ORACLES, QUERIES
from veristrata.sources import grid, sheet, tabular

DATA = "/root/testdata/sf0.001"


def rows(table):
    cols = sorted(table.column_names)
    show = lambda v: str(v.normalize()) if isinstance(v, Decimal) else repr(v)
    return cols, sorted(tuple(map(show, r)) for r in zip(*(table.column(c).to_pylist() for c in cols)))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toArrow()
    if name in ORACLES:
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for p in Path(DATA).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        assert rows(got) == rows(con.sql(ORACLES[name]).to_arrow_table())


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, day",
    [("2021-04-03", "2021-04-03"), ("4/3/2021", "2021-04-03"), ("4/3/75", "1975-04-03"), ("4/3/21", "2021-04-03"), ("Apr 3, 2021", "2021-04-03"), ("44289", "2021-04-03"), ("2024-02-30", None), ("n/a", None), ("", None)],
)
def test_dates(spark, raw, day):
    got = one(spark, raw, lambda c: normalize.date(c)[0])
    assert (str(got) if got else None) == day


def test_scalars(spark):
    assert one(spark, " Tom & Jerry's  Café ", normalize.simplify) == "tom and jerrys cafe"
    assert one(spark, "rn # 12-34", normalize.license_number) == "RN-1234"
    assert one(spark, "1 (555) 123-4567", lambda c: normalize.phone(c)[0]) == "555-123-4567"
    assert one(spark, "(500)", lambda c: normalize.number(c)[0]) == 500.0
    assert one(spark, "N/A", normalize.text) is None
    words = normalize.vocabulary({"RN": ["registered nurse"], "LPN": ["practical nurse"]})
    assert one(spark, "Senior Registered Nurse II", lambda c: normalize.code(c, words)[0]) == "RN"
    assert one(spark, "WALSH jr, Ann Marie", lambda c: names.parse_person(c)["last"]) == "walsh"
    assert one(spark, "DE LA CRUZ, mary-ann", lambda c: F.to_json(names.parse_person(c))) == '{"first":"mary","middle":"ann","last":"delacruz","display":"Mary-Ann De La Cruz","org":false}'
    assert one(spark, "Ann O'connor RN md", lambda c: names.parse_person(c)["display"]) == "Ann O'Connor"
    assert one(spark, "Cher", lambda c: names.parse_person(c)["last"]) == "cher"
    assert one(spark, " ", lambda c: names.parse_person(c)) is None
    assert one(spark, "The Acme  Corp.", lambda c: names.parse_org(c)["last"]) == "acme"


def test_decisions_and_lifecycle(spark):
    c = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.98), (2, "a", 0.95), (3, "a", 0.8), (4, "a", 0.1)], "rec int, e string, s double")
    assert [tuple(r)[3] for r in resolve.decide(c, "rec", F.col("s"), "e").orderBy("rec").collect()] == ["review", "auto", "review", "none"]
    old = spark.createDataFrame([("x", True), ("y", False), ("z", True)], "fingerprint string, active boolean")
    new = spark.createDataFrame([("x",), ("y",), ("w",)], "fingerprint string")
    got = {r[0]: (r[1], r[2]) for r in issues.lifecycle(old, new).collect()}
    assert got == {"x": (True, None), "y": (True, "issue_reopened"), "z": (False, "issue_cleared"), "w": (True, "issue_detected")}
    with pytest.raises(ValueError):
        create_view(old, "bad name")


def test_tabular(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("title\n\nStaff Name;Hours Paid;Notes\nJosé;8;x\n;;\nAnn;4\n".encode("cp1252"))
    cells = tabular.read_cells(spark, f"file://{tmp_path}")
    head = [r[0] for r in cells.filter("row_num = 3").select("cells").collect()][0]
    bound, free, share = tabular.bind_headers(head, {"name": ["staff name"], "hours": ["hours paid"]})
    assert (bound, free, share) == ({"name": 0, "hours": 1}, ["Notes"], 1.0)
    got = tabular.records(cells, bound, 3).orderBy("row_num").select("locator", "name", "hours").collect()
    assert [tuple(r) for r in got] == [("row 4", "José", "8"), ("row 6", "Ann", "4")]


def test_candidates(spark):
    rows = [(1, "Bob Smith"), (2, "Smith Ann"), (3, "J. Doe"), (4, "Bob Smith"), (5, None)]
    r = spark.createDataFrame(rows, "id int, n string").select("id", names.parse_person(F.col("n")).alias("name"))
    e = spark.createDataFrame([("A", "Robert Smith"), ("B", "Ann Smith"), ("C", "John Doe")], "k string, n string").select("k", names.parse_person(F.col("n")).alias("name"))
    got = names.candidates(r, e, "id", "k", names.nickname_groups(["robert rob bob"]))
    best = {(x["rec"], x["entity"]): (x["score"], x["how"]) for x in got.collect()}
    assert best[1, "A"] == best[4, "A"] == (0.95, "nickname")
    assert best[2, "B"] == (0.9, "swapped")
    assert best[3, "C"] == (0.85, "initial")


def test_grid(spark):
    text = "Harborside East — Weekly Staff Schedule\n7a-3p, 3p-11p are 8 hours"
    table = [["Staff", "Role", "Mon 9/14", "Tue 9/15", "Wed 9/16"], ["Ann Lee", "RN", "7a-3p", "OFF", "3p-11:30p"], ["Bob Ray", "CNA", "PTO", "zzz", "7-3"], [""] * 5]
    plain = "East\nStaff Mon 9/14 Tue 9/15 Wed 9/16 Thu 9/17 Fri 9/18\nAnn Lee RN 7a-3p OFF 7a-3p 7a-3p PTO"
    pages = spark.createDataFrame([("f", 1, text, table), ("f", 2, plain, None), ("f", 3, None, None)], grid.PAGES)
    got = [(r["row_num"], r["staff_name"], r["role"], r["facility"], str(r["date"])[-2:], r["hours"], r["leave"], r["problem"] is not None) for r in grid.weekly_grid(pages, "2026-10-04").orderBy("row_num", "date").collect()]
    a, b = "Harborside East", "Bob Ray"
    assert got[:6] == [(1001, "Ann Lee", "RN", a, "14", 8.0, False, False), (1001, "Ann Lee", "RN", a, "15", 0.0, False, False), (1001, "Ann Lee", "RN", a, "16", 8.5, False, True), (1002, b, "CNA", a, "14", 0.0, True, False), (1002, b, "CNA", a, "15", None, False, True), (1002, b, "CNA", a, "16", 8.0, False, True)]
    assert [(r[0], r[3], r[5]) for r in got[6:]] == [(2002, "East", h) for h in (8.0, 0.0, 8.0, 8.0, 0.0)]


def test_sheet(spark, tmp_path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Name</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Day</t></is></c></row><row r="3"><c r="A3"><v>5</v></c><c r="C3" s="1"><v>44289</v></c></row></sheetData></worksheet>')
    got = [tuple(r["cells"]) for r in sheet.read_cells(spark, f"file://{tmp_path}").orderBy("row_num").collect()]
    assert got == [("Name", "", "Day"), ("", "", ""), ("5", "", "2021-04-03")]


def test_setup(spark):
    hr = spark.createDataFrame([(f"E-{i:04d}", f"Name{i}, Ann", f"2026-01-0{i % 9 + 1}") for i in range(40)], "`Employee ID` string, `Employee Name` string, `License Expires` string")
    pay = spark.createDataFrame([(f"e-{i:04d}", str(i), "2026-02-01") for i in range(30)], "`Emp ID` string, `Hours` string, `Pay Date` string")
    found = setup.analyse({"hr": hr, "pay": pay})
    assert found["master"] == "hr" and found["links"]["pay"] == [("Employee ID", "Emp ID", 1.0)]
    assert {"type": "expiration", "attribute": "license_expires"} in found["rules"]
    types = {c: p["type"] for f in found["profiles"].values() for c, p in f["columns"].items()}
    assert types == {"Employee ID": "codeid", "Employee Name": "person_name", "License Expires": "date", "Emp ID": "codeid", "Hours": "number", "Pay Date": "date"}
    assert setup.build_config(found)["entity"] == {"anchor_source": "hr", "key_field": "employee_id", "label": "Employee", "orphan_severity": {"pay": "critical"}}
    assert infer.header_row([["Title", ""], ["1", "2"], ["Name", "Hours"]]) == 2


def test_workspace(spark, tmp_path):
    w = state.Workspace(spark, f"file://{tmp_path}/ws")
    found = spark.createDataFrame([("f1", "status", "warning", "C", "1", "T"), ("f2", "large", "info", "C", "2", "T"), ("f3", "status", "critical", "C", "3", "T")], "fingerprint string, rule string, severity string, category string, entity_key string, title string")
    assert {r["status"] for r in w.rebuild(found).collect()} == {"open"}
    w.decide("f1", "dismiss")
    learned = w.learn("large", "acknowledge", "info")
    state_of = lambda df: {r["fingerprint"]: (r["active"], r["status"]) for r in df.collect()}
    assert state_of(w.rebuild(found.filter("fingerprint <> 'f3'"))) == {"f1": (True, "dismissed"), "f2": (True, "auto"), "f3": (False, "open")}
    w.reopen("f2")
    assert state_of(w.rebuild(found)) == {"f1": (True, "dismissed"), "f2": (True, "open"), "f3": (True, "open")}
    with pytest.raises(ValueError):
        w.decide("f1", "choose", "x", ["y"])
    w.set("as_of", "2026-01-01")
    w.set("as_of", "2026-01-02")
    assert w.get("as_of") == "2026-01-02" and w.get("other") is None
    w.receive("hr", "a.csv", found)
    w.receive("hr", "b.csv", found.limit(1))
    assert w.records("hr").count() == 1 and w.records("pay") is None
    assert "ws_issues" in w.catalog() and w.browse("ws_events", 2).count() == 2
    w.switch(learned, False)
    assert w.rules().count() == 0 and w.events(1).first()["kind"] == "rule off"
    w.switch(learned, True)
    assert w.rules().count() == 1
    assert w.info() == {"name": "ws", "records": 1, "open": 2, "urgent": 1}
    listed = w.files().collect()
    assert [(r["name"], r["active"]) for r in listed] == [("b.csv", True), ("a.csv", False)]
    w.deactivate(listed[1]["file_id"])
    assert w.records("hr").count() == 1
    w.deactivate(listed[0]["file_id"])
    assert w.records("hr") is None and w.files().filter("active").count() == 0
    w.rename("Client")
    w.reset()
    assert w.info() == {"name": "Client", "records": 0, "open": 0, "urgent": 0} and w.issues() is None and w.events().count() == 0
    assert state.workspaces(spark, f"file://{tmp_path}") == ["ws"] and state.workspaces(spark, f"file://{tmp_path}/none") == []
    state.remove_workspace(spark, f"file://{tmp_path}", "ws")
    assert state.workspaces(spark, f"file://{tmp_path}") == []


def test_source_detection():
    sources = {"hr": {"label": "HR roster", "fields": {"name": ["staff name"], "hired": ["hire date"]}, "required": ["name"]}, "payroll": {"fields": {"name": ["employee"], "hours": ["hours paid"]}, "required": ["name", "hours"]}}
    head = [["Report", ""], ["Employee", "Hours Paid", "Notes"], ["Ann", "8", ""]]
    assert tabular.detect_source(head, "march.csv", sources) == ("payroll", 1, {"name": 0, "hours": 1}, ["Notes"])
    assert tabular.detect_source([["Staff Name", "Hire Date"]], "march.csv", sources)[0] == "hr"
    with pytest.raises(ValueError):
        tabular.detect_source([["x", "y"]], "march.csv", {"hr": sources["hr"] | {"label": "HR"}})


def test_duplicate_entity_any(spark):
    rows = [(1, "a@x", "11", "p"), (2, "a@x", "22", "p"), (3, None, "22", "p"), (4, "", None, "p"), (5, "", None, None), (6, "b@x", "22", "q")]
    e = spark.createDataFrame(rows, "k int, email string, phone string, city string")
    show = lambda df: {(r["k1"], r["k2"]): ([tuple(x) for x in r["reasons"]], r["hot"]) for r in df.collect()}
    mail, phone, city = ("email", "a@x"), ("phone", "22"), ("city", "p")
    got = show(rules.duplicate_entity(e, "k", ["email", "phone", "city"]))
    assert got == {(1, 2): ([city, mail], False), (1, 3): ([city], False), (1, 4): ([city], False), (2, 3): ([city, phone], False), (2, 4): ([city], False), (3, 4): ([city], False), (2, 6): ([phone], False), (3, 6): ([phone], False)}
    got = show(rules.duplicate_entity(e, "k", ["email", "phone", "city"], pairs_up_to=3))
    assert got == {(1, 2): ([city, mail], True), (1, 3): ([city], True), (1, 4): ([city], True), (2, 3): ([city, phone], False), (2, 6): ([phone], False), (3, 6): ([phone], False)}
    assert show(rules.duplicate_entity(e, "k", [("phone", "city")])) == {(2, 3): ([("phone+city", '{"phone":"22","city":"p"}')], False)}


def test_shared_key(spark):
    e = spark.createDataFrame([("A", "x@m", "1", "Zoe Young"), ("B", "x@m", "1", "Ann Smith"), ("C", "x@m", "2", "Ann Smith"), ("D", "y@m", "3", None), ("E", "y@m", None, "Bob Roy")], "entity_key string, email string, phone string, n string")
    r = spark.createDataFrame([(1, "x@m", "3", "Ann Smyth"), (2, "x@m", None, "Zoe Young"), (3, "x@m", None, None), (4, "y@m", None, "Rob Roy"), (5, None, "1", "Smith Ann"), (6, None, "2", "Zoe Young"), (7, "z@m", "9", "Ann Smith"), (8, "y@m", None, "12")], "id int, email string, phone string, n string")
    e, r = (df.withColumn("name", names.parse_person(F.col("n"))) for df in (e, r))
    keys = [("email", "email"), ("phone", "phone")]
    link = lambda **o: {x["rec_id"]: (x["entity_key"], x["method"]) for x in resolve.link_by_keys(r, "id", e, keys, **o).collect()}
    assert link(names=("name", "name")) == {1: ("B", "email"), 2: ("A", "email"), 3: ("A", "email"), 4: ("E", "email"), 5: ("B", "phone"), 6: ("C", "phone"), 8: ("D", "email")}
    assert link()[1] == ("A", "email")


def test_candidates_are_whole(spark):
    people = ["Jon Smyth", "Jon Smith", "Smith Jon", "J Smith", "Bob Smith", "Rob Smits", "Robert Schmidt", "Ann Lee", "Anne Leigh", "Lee", "Anna-Maria Delacruz", "A Delacruzz", "Zed Quux", "Christopherjonathan Li", "C Li", "Katherine Oconnor", "Catherine Connor"]
    orgs = ["Acme Widgets", "Widgets Acme Inc", "Acme Widget Works", "Smith Jon LLC", "Zeta"]
    both = [(n, names.parse_person) for n in people] + [(n, names.parse_org) for n in orgs]
    of = lambda f: spark.createDataFrame([(n,) for n, g in both if g is f], "n string").select("n", f(F.col("n")).alias("name"))
    df = spark.createDataFrame(of(names.parse_person).unionByName(of(names.parse_org)).toArrow())
    nick = names.nickname_groups(["robert rob bob"])
    got = {(r["rec"], r["entity"]): (r["score"], r["how"]) for r in names.candidates(df, df, "n", "n", nick).collect()}
    pairs = df.select(F.col("n").alias("rec"), F.col("name").alias("a")).crossJoin(df.select(F.col("n").alias("entity"), F.col("name").alias("b")))
    want = {(r["rec"], r["entity"]): (r["score"], r["how"]) for r in names.score_pairs(pairs, nicknames=nick).filter("score >= 0.65").collect()}
    assert got == want
    assert got["Jon Smyth", "Jon Smith"][0] == 0.88 and got["Acme Widgets", "Widgets Acme Inc"][0] == 1.0


def test_names_meet_by_keys(spark):
    """Hundreds of alike names against exhaustive scoring, nicknames, organisations and one-letter names included; no plan has a cartesian product."""
    rng = random.Random(5)
    syllables = ["an", "na", "ro", "bert", "ma", "ri", "el", "jo", "sm", "ith", "ka", "le", "o", "x", "th", "son"]
    made = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    base = [(made(rng.randint(1, 4)), made(rng.randint(1, 5))) for _ in range(110)] + [("bob", "smithson"), ("robert", "smithsan"), ("rob", "smihson"), ("j", "smithson"), ("", "smithson"), ("jo", "")]
    people = [f"{f} {n}" for f, n in base] + [f"{n[1:]} {f}" for f, n in base[:40]] + [f"{f[:1]} {n}" for f, n in base[40:60]]
    orgs = [" ".join(made(2) for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["acme widgets", "widgets acme inc", "widget works of acme"]
    parts = [spark.createDataFrame([(n,) for n in own], "n string").select("n", f(F.col("n")).alias("name")) for own, f in ((people, names.parse_person), (orgs, names.parse_org))]
    df = spark.createDataFrame(parts[0].unionByName(parts[1]).filter("name IS NOT NULL").dropDuplicates(["n"]).toArrow())
    other = df.filter("hash(n) % 3 <> 0")
    nick = names.nickname_groups(["robert rob bob"])
    pairs = df.select(F.col("n").alias("rec"), F.col("name").alias("a")).crossJoin(other.select(F.col("n").alias("entity"), F.col("name").alias("b")))
    every = {(r["rec"], r["entity"]): (r["score"], r["how"]) for r in names.score_pairs(pairs, nicknames=nick).filter("score >= 0.5").collect()}
    for cut in (0.5, 0.65, 0.85):
        out = names.candidates(df, other, "n", "n", nick, cut)
        assert {(r["rec"], r["entity"]): (r["score"], r["how"]) for r in out.collect()} == {k: v for k, v in every.items() if v[0] >= cut}
    with pytest.raises(ValueError):
        names.candidates(df, other, "n", "n", nick, 0.4)
    text = lambda d: d.select(F.col("name.last").alias("text"))
    plan = names.alike_texts(text(df), text(other), 0.65)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_aggregate_compare_periods(spark):
    day = lambda df, *cols: df.withColumns({c: F.col(c).cast("date") for c in cols})
    p, q = ("2026-01-01", "2026-01-02"), ("2026-01-03", "2026-01-05")
    a = [("E", *p, "x", 8.0), ("F", *p, "x", 8.0), ("G", *p, "x", 9.0), ("H", *p, None, 5.0), ("E", *q, "x", 99.0), ("J", *p, "x", 4.0), ("J", *p, "y", 0.0), ("Z", "2026-01-02", "2026-01-01", "x", 1.0)]
    b = [("E", p[0], "x", 4.0), ("E", p[1], "x", 4.0), ("F", p[0], "y", 8.0), ("G", p[1], "x", 2.0), ("H", p[1], "x", 0.0), ("I", p[1], "x", 3.0), ("J", p[0], "x", 4.0), ("E", "2026-01-04", "x", 1.0), ("E", None, "x", 7.0)]
    a = day(spark.createDataFrame(a, "entity_key string, start string, end string, grp string, amount double"), "start", "end")
    b = day(spark.createDataFrame(b, "entity_key string, day string, grp string, amount double"), "day")
    show = lambda df: sorted((r["entity_key"] or "", str(r["start"]), r["kind"], r["diff"]) for r in df.collect())
    want = [("F", p[0], "group", 0.0), ("G", p[0], "both", 7.0), ("H", p[0], "only a", 5.0), ("I", p[0], "only b", -3.0)]
    assert show(rules.aggregate_compare_periods(a, b, 0.5)) == want
    assert show(rules.aggregate_compare_periods(a, b, 0.5, every_day=False, slack_days=1)) == [("E", q[0], "both", 98.0), *want]
    assert show(rules.aggregate_compare_periods(a.filter(f"start = '{q[0]}'"), b, 0.5)) == [("", "None", "no overlap", None)]
    assert show(rules.aggregate_compare_periods(a, b.limit(0), 0.5)) == []
