"""Expiry and staleness on a stream: a moving clock, restarts, late rows, against the batch rules."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veristrata.operators import rules
from veristrata.streaming.timers import Expiry, Stale, standing, use_rocksdb, watch

SCHEMA = "entity_key string, attribute string, day date, at timestamp, extra int"
RULES = {"licence": Expiry(warn_days=30, critical_days=0), "seen": Stale(max_age_days=90)}
START = date(2024, 1, 1)


class Feed:
    """Each step writes rows as a file and runs the query anew from its checkpoint until all of it is done."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "in").mkdir()
        use_rocksdb(spark)

    def step(self, *rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.folder / "in"))
        q = watch(stream, RULES).writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return self

    def events(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def at(day, hours=8):
    return datetime.combine(day, datetime.min.time()) + timedelta(hours=hours)


def plus(n):
    return START + timedelta(days=n)


def tick(n):
    return (None, None, None, at(plus(n)), 0)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_time_opens_and_clears(feed):
    """No record of the entity comes in between: the clock alone opens the warning, then the expiry, over restarts."""
    feed.step(("e", "licence", plus(100), at(START), 1), ("e", "other", plus(1), at(START), 1))
    seen = lambda: sorted((r["day"], r["event"], r["severity"]) for r in feed.events().collect())
    assert seen() == []
    assert feed.step(tick(69)) and seen() == []
    feed.step(tick(70))
    warned = (plus(70), "issue_detected", "warning")
    assert seen() == [warned]
    feed.step(tick(150))
    expired = (plus(101), "issue_updated", "critical")
    assert seen() == [warned, expired]
    feed.step(("e", "licence", plus(400), at(plus(151)), 1), ("e", "licence", plus(400), at(plus(151)), 1))
    cleared = (plus(151), "issue_cleared", "critical")
    assert seen() == [warned, expired, cleared]
    feed.step(("e", "licence", plus(10), at(plus(2)), 1))  # late: nothing changes
    assert seen() == [warned, expired, cleared]
    feed.step(tick(380))
    assert seen() == [warned, expired, cleared, (plus(370), "issue_reopened", "warning")]
    feed.step(("e", "licence", None, at(plus(381)), 1))
    assert seen()[-1] == (plus(381), "issue_cleared", "warning")


def test_batches_make_no_difference(spark, tmp_path):
    """The same records in one batch and in four, and the batch rules at the last day."""
    rng = random.Random(5)
    rows = []
    for k, n in enumerate(sorted(rng.randrange(400) for _ in range(150))):
        key, kind = f"e{rng.randrange(12)}", rng.choice(["licence", "seen"])
        rows.append((key, kind, plus(n + (rng.randrange(-20, 200) if kind == "licence" else -rng.randrange(30))), at(plus(n)) + timedelta(seconds=k), 0))
    end = tick(520)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    whole, parts = Feed(spark, tmp_path / "a").step(*rows, end), Feed(spark, tmp_path / "b")
    for k in range(0, len(rows), 40):
        parts.step(*rows[k : k + 40])
    parts.step(end)
    got = [sorted(map(tuple, f.events().collect())) for f in (whole, parts)]
    assert got[0] == got[1] and len(got[0]) > 30
    last = spark.createDataFrame(rows, SCHEMA).groupBy("entity_key", "attribute").agg(F.max_by("day", "at").alias("day"))
    as_of = str(plus(520))
    want = rules.expiration(last.filter("attribute = 'licence'"), F.col("day"), as_of, 30, 0).select("entity_key", "attribute", "severity")
    want = want.union(rules.staleness(last.filter("attribute = 'seen'"), F.col("day"), as_of, 90).select("entity_key", "attribute", F.lit("warning")))
    now = standing(whole.events()).filter("active").select("entity_key", "attribute", "severity")
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))


def test_empty(feed):
    assert feed.step().events().count() == 0


def test_query(spark):
    """The query's events against its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from veristrata.plans import more  # noqa: F401
    from veristrata.plans.queries import ORACLES, QUERIES

    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test data")
    got = sorted((r["entity_key"], r["event"], r["day"]) for r in QUERIES["quiet_customers"](spark, path).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet'")
    want = sorted(con.execute(f"SELECT entity_key, event, day FROM ({ORACLES['quiet_customers']})").fetchall())
    assert got == want and want
