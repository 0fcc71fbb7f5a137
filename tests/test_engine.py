"""The full rebuild against planted findings, and the decisions that outlive it."""

import csv
import io

import engine_fixture as fx
import pytest

from veristrata.engine.process import Engine


def frames(spark, **changed):
    out, at = {}, 0
    for name in ("roster", "wages", "register", "rota"):
        rows = list(csv.DictReader(io.StringIO(changed.get(name, getattr(fx, name.upper())))))
        cols = list(rows[0])
        out[name] = spark.createDataFrame([(at + i, *(r[c] for c in cols)) for i, r in enumerate(rows)], "rec_id long, " + ", ".join(f"{c} string" for c in cols))
        at += 1000
    return out


@pytest.fixture(scope="module")
def built(spark):
    return Engine(fx.CONFIG, fx.AS_OF, fx.NICKNAMES).process(frames(spark))


def test_planted_findings(built):
    rows = built.issues.collect()
    missing = [(k, t) for k, t in fx.EXPECTED if not any(r["entity_key"] == k and t in r["title"] for r in rows)]
    assert not missing, (missing, sorted((str(r["entity_key"]), r["title"]) for r in rows))
    assert not any(r["entity_key"] in ("W1", "W2") and "disagree" in r["title"] for r in rows)
    assert len({r["fingerprint"] for r in rows}) == len(rows) and all(r["status"] == "open" for r in rows)
    assert all(0 < len(r["evidence"]) <= 10 for r in rows if r["rule"] in ("conflict", "match", "orphan", "duplicate_signature", "activity_after_expiry", "field_problem"))


def test_links_and_entities(built):
    kinds = {r["status"]: r["count"] for r in built.entities.groupBy("status").count().collect()}
    assert kinds == {"verified": 11, "unverified": 1}
    own = {(r["source"], r["name"]["display"]): (r["entity_key"], r["match_status"], r["match_method"]) for r in built.records.filter("name IS NOT NULL").collect()}
    assert own["rota", "Bob Clay"] == ("W2", "auto", "name: nickname") and own["wages", "Anna Brock"][:2] == ("W1", "review")
    assert own["register", "Dora Walsh"] == ("W4", "auto", "key: permit") and own["register", "Ivy Jonson"][0] == "W10"  # of two with that permit the one of that name
    assert own["wages", "Zed Stranger"] == ("U-stranger-zed", "orphan", None)


def test_attributes(built):
    got = {(r["entity_key"], r["attribute"]): r for r in built.attributes.collect()}
    assert len(got) == 12 * 7
    assert got["W4", "permit_ends"]["value"] == "2025-12-31" and got["W4", "permit_ends"]["status"] == "CONFLICT" and got["W4", "permit_ends"]["authority"] == "register"
    assert got["W1", "site"]["status"] == "CONFIRMED" and got["W1", "site"]["sources"] == {"roster": ["NORTH"], "wages": ["NORTH"], "rota": ["NORTH"]}
    assert got["W2", "name"]["status"] == "CONFIRMED" and got["W2", "name"]["note"] and got["W2", "name"]["value"] == "Robert Clay"
    assert got["W11", "permit"]["status"] == "MISSING" and got["W7", "phone"]["status"] == "SINGLE_SOURCE"


def test_decisions_outlive_rebuilds(spark, built):
    engine = Engine(fx.CONFIG, fx.AS_OF, fx.NICKNAMES)
    of = lambda b, k, t: next(r for r in b.issues.collect() if r["entity_key"] == k and t in r["title"])
    ends, match = of(built, "W4", "disagree on permit ends"), of(built, "W1", "may be the same")
    key = built.records.filter("match_status = 'review'").first()["name_key"]
    decisions = spark.createDataFrame([(1, ends["fingerprint"], "choose", "2026-06-30"), (2, match["fingerprint"], "confirm", None)], "id long, fingerprint string, action string, value string")
    overrides = spark.createDataFrame([("wages", key, "W1"), ("wages", "stranger|zed", "W99")], "source string, name_key string, entity_key string")
    auto = spark.createDataFrame([(7, "unusual_value|site", "dismiss", None, None), (8, "conflict|job", "dismiss", None, None)], "rule_id long, pattern string, action string, attribute string, value string")
    again = engine.process(frames(spark), decisions, overrides, auto)
    assert of(again, "W4", "disagree on permit ends")["status"] == "resolved"
    chosen = again.attributes.filter("entity_key = 'W4' AND attribute = 'permit_ends'").first()
    assert (chosen["value"], chosen["status"]) == ("2026-06-30", "RESOLVED")
    own = again.records.filter("source = 'wages' AND name.display = 'Anna Brock'").first()
    assert (own["match_status"], own["entity_key"]) == ("confirmed", "W1") and of(again, "W1", "may be the same")["status"] == "resolved"
    assert of(again, "W10", "site is SOUTH")["status"] == "auto" and of(again, "W4", "disagree on job")["status"] == "open"  # critical
    assert of(again, "U-stranger-zed", "not found")["status"] == "open"  # no entity W99
    mended = engine.process(frames(spark, roster=fx.ROSTER.replace("N103,2026-06-30", "N103,2025-12-31")), decisions, overrides, auto)
    assert not any(r["entity_key"] == "W4" and "permit ends" in r["title"] for r in mended.issues.collect())


def test_without_rows(spark):
    empty = {k: v.limit(0) for k, v in frames(spark).items()}
    b = Engine(fx.CONFIG, fx.AS_OF).process({"roster": empty["roster"], "wages": empty["wages"], "register": empty["register"], "rota": empty["rota"], "unknown": empty["rota"]})
    assert b.issues.count() == 0 and b.entities.count() == 0 and b.attributes.count() == 0
