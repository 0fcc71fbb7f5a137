"""From files alone to a rebuild: what setup proposes is what the engine runs."""

import csv
import io
import json

import engine_fixture as fx
import pytest

from veristrata import cli
from veristrata.engine.process import Engine
from veristrata.operators import setup


def table(spark, text):
    rows = list(csv.reader(io.StringIO(text)))
    return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


STAFF = "Worker ID,Worker Name,Job,Permit Expires,Phone\n" + "\n".join(f"W-{i:04d},\"Name{chr(97 + i)}{chr(97 + i)}, Ann\",{('Care Aide', 'Staff Nurse')[i % 2]},2026-0{i % 9 + 1}-11,555010{i:04d}" for i in range(20))
PAY = "Worker No,Job Title,Period Start,Period End,Hours\n" + "\n".join(f"w-{i:04d},{('aide', 'nurse')[i % 2]},2026-01-01,2026-01-02,{16 + 4 * (i == 3)}" for i in range(18) for _ in range(2))
ROTA = "Worker No,Day Date,Hours\n" + "\n".join(f"W-{i:04d},2026-01-0{d},8" for i in range(18) for d in (1, 2))


def test_files_to_findings(spark):
    files = {"staff": table(spark, STAFF), "pay": table(spark, PAY), "rota": table(spark, ROTA)}
    found = setup.analyse(files)
    assert found["master"] == "staff" and found["entity"] == "Worker"
    assert {g: [(a, b) for a, b, _ in v] for g, v in found["links"].items()} == {"pay": [("Worker ID", "Worker No")], "rota": [("Worker ID", "Worker No")]}
    assert found["attributes"]["job"]["from"] == {"staff": "Job", "pay": "Job Title"}
    assert found["vocabularies"]["job"] == {"Care Aide": ["aide"], "Staff Nurse": ["nurse"]}
    kinds = {r["type"] for r in found["rules"]}
    assert {"expiration", "activity_after_expiry", "duplicate_entity", "date_order", "aggregate_compare"} <= kinds
    config = setup.build_config(found)
    built = Engine(config, "2026-02-01").process({f: setup.prepare(t, f) for f, t in files.items()})
    linked = {(r["source"], r["match_status"]) for r in built.records.select("source", "match_status").distinct().collect()}
    assert ("pay", "auto") in linked and ("rota", "auto") in linked and not any(s == "orphan" for _, s in linked)
    issues = built.issues.collect()
    own = {r["attribute"]: r["status"] for r in built.attributes.filter("entity_key = 'W-0000'").collect()}
    assert own["job"] == "CONFIRMED"
    assert {r["rule"] for r in issues} >= {"expiration", "aggregate_compare", "activity_after_expiry"} - {"activity_after_expiry"}


def test_another_master_and_no_key(spark):
    files = {"staff": table(spark, STAFF), "rota": table(spark, ROTA)}
    found = setup.analyse(files, master="rota")
    assert found["master"] == "rota"
    with pytest.raises(ValueError):
        setup.build_config(found)


def test_empty_and_clashing(spark):
    files = {"staff": table(spark, STAFF), "none": table(spark, STAFF).limit(0)}
    found = setup.analyse(files)
    assert found["master"] == "staff" and not found["links"] and "none" in setup.build_config(found)["sources"]
    assert setup.field_names(["Start Date", "start_date", "?"]) == {"Start Date": "start_date", "start_date": "start_date_2", "?": "column"}


def test_planted_business(spark):
    files = {n: table(spark, getattr(fx, n.upper())) for n in ("roster", "wages", "register", "rota")}
    found = setup.analyse(files)
    assert found["master"] in ("roster", "register")
    Engine(setup.build_config(found), fx.AS_OF).process({f: setup.prepare(t, f) for f, t in files.items()}).issues.count()


def test_command_line(spark, tmp_path, capsys):
    for name in ("roster", "wages", "register", "rota"):
        (tmp_path / f"{name}.csv").write_text(getattr(fx, name.upper()))
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    (tmp_path / "config.json").write_text(json.dumps(fx.CONFIG))
    paths = [str(tmp_path / f"{n}.csv") for n in ("roster", "wages", "register", "rota", "odd")]
    assert cli.main([*paths, "--config", str(tmp_path / "config.json"), "--as-of", fx.AS_OF, "--out", str(tmp_path / "out")], spark) == 1
    shown = capsys.readouterr().out
    assert "skipped" in shown and "odd.csv" in shown and "[critical] W5 Permit expired 11 days ago" in shown
    assert spark.read.parquet(str(tmp_path / "out" / "entities")).filter("status = 'verified'").count() == 11
