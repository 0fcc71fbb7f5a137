"""Issues that time opens and clears: expiry and staleness watched on a stream of records.

Each (entity, attribute) keeps its last date in state, and one event-time timer for the next day on which
its standing changes. So a licence expires, and an entity goes stale, on its day without a new record: any
row that moves the watermark is enough, rows of attributes without a rule included (a clock's ticks, say).
Days between two records of a key are gone through one boundary at a time, so that how records
fall into micro-batches makes no difference. State is kept in RocksDB and survives restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veristrata.operators import issues

DAY_MS = 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "entity_key string, attribute string, rule string, severity string, event string, epoch_day int"
#: Rows that only move the clock are dealt over so many keys, which never get state.
TICK_KEYS = 64


@dataclass(frozen=True)
class Expiry:
    """As operators.rules.expiration: critical when fewer than critical_days are left, a warning within warn_days."""

    warn_days: int = 60
    critical_days: int = 0
    rule: str = "expiration"

    def boundaries(self, day: int) -> list[tuple[int, str]]:
        critical, warn = day - self.critical_days + 1, day - self.warn_days
        return [(critical, "critical")] if critical <= warn else [(warn, "warning"), (critical, "critical")]


@dataclass(frozen=True)
class Stale:
    """As operators.rules.staleness: a finding when the date is more than max_age_days old."""

    max_age_days: int
    severity: str = "warning"
    rule: str = "staleness"

    def boundaries(self, day: int) -> list[tuple[int, str]]:
        return [(day + self.max_age_days + 1, self.severity)]


class Watch(StatefulProcessor):
    """State of a key: last record's time (ms) and date (epoch days), day up to which its events are out, severity that is open, whether one ever was."""

    def __init__(self, rules: dict[str, Expiry | Stale]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("watched", "at long, day int, done int, severity string, before boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rule = self.rules.get(key[1])
        if rule is None:
            for _ in rows:
                pass
            return
        new = {(int(at), None if pd.isna(day) else int(day)) for part in rows for at, day in zip(part["at_ms"], part["epoch_day"])}
        kept = self.value.get()
        had = None if kept is None else self._next(rule, kept[1], kept[2])
        at, day, done, severity, before = kept if kept is not None else (None, None, None, None, False)
        out = []
        for t, d in sorted(new, key=lambda r: (r[0], -(2**31) if r[1] is None else r[1])):
            if at is not None and t < at:
                continue  # older than what is known
            today = t // DAY_MS if done is None else max(t // DAY_MS, done)
            if at is not None:
                severity, before = self._advance(out, key, rule, day, done, today, severity, before)
            at, day, done = t, d, today
            severity, before = self._stand(out, key, rule, today, self._severity(rule, day, today), severity, before)
        self._keep(rule, at, day, done, severity, before, had)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.value.get()
        if kept is None:
            return
        at, day, done, severity, before = kept
        rule, out = self.rules[key[1]], []
        # up to the clock: a timer set here would wait for another micro-batch
        today = max(done, (expiredTimerInfo.getExpiryTimeInMs() + 1) // DAY_MS, timerValues.getCurrentWatermarkInMs() // DAY_MS)
        severity, before = self._advance(out, key, rule, day, done, today, severity, before)
        self._keep(rule, at, day, today, severity, before, None)  # the timer that has expired goes by itself
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _severity(rule: Expiry | Stale, day: int | None, today: int) -> str | None:
        passed = [] if day is None else [s for start, s in rule.boundaries(day) if start <= today]
        return passed[-1] if passed else None

    def _advance(self, out, key, rule, day, done, today, severity, before):
        """What happens after `done` up to `today` while the date stays."""
        for start, s in [] if day is None else rule.boundaries(day):
            if done < start <= today:
                severity, before = self._stand(out, key, rule, start, s, severity, before)
        return severity, before

    @staticmethod
    def _stand(out, key, rule, today, new, old, before):
        if new != old:
            event = "issue_cleared" if new is None else "issue_updated" if old is not None else "issue_reopened" if before else "issue_detected"
            out.append((key[0], key[1], rule.rule, new or old, event, today))
        return new, before or new is not None

    @staticmethod
    def _next(rule: Expiry | Stale, day: int | None, done: int) -> int | None:
        """The key's one timer (ms), as its state tells: no call to the state store is spent on asking."""
        ahead = [] if day is None else [start for start, _ in rule.boundaries(day) if start > done]
        return min(ahead) * DAY_MS - 1 if ahead else None  # over once the watermark reaches the day

    def _keep(self, rule, at, day, done, severity, before, had) -> None:
        self.value.update((at, day, done, severity, before))
        timer = self._next(rule, day, done)
        if timer == had:
            return
        if had is not None:
            self.handle.deleteTimer(had)
        if timer is not None:
            self.handle.registerTimer(timer)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["entity_key", "attribute", "rule", "severity", "event", "epoch_day"])


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this provider; it holds for queries started from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)


def watch(records: DataFrame, rules: dict[str, Expiry | Stale], delay: str = "0 seconds") -> DataFrame:
    """records (entity_key, attribute, day date, at timestamp), a stream -> fingerprint, entity_key, attribute, rule, severity, event, day.

    rules: attribute -> Expiry or Stale. The clock is the watermark of `at`, `delay` behind its latest; days are UTC's.
    The last record of a key counts (of equal times the latest day); one older than it, or not later
    than the clock when its micro-batch starts, is left aside; a null day clears what is open. Rows without entity, or of other attributes, only move the clock; a null `at`
    does nothing. An update (issue_updated) is a change of severity; issue_cleared names the severity that was open.
    Repeated records change nothing. Other columns of records don't matter.
    """
    known = F.coalesce(F.col("attribute").isin(*rules), F.lit(False)) & F.col("entity_key").isNotNull()
    tick = F.pmod(F.xxhash64("entity_key", "at"), F.lit(TICK_KEYS)).cast("string")
    keyed = records.select("entity_key", "attribute", "day", "at").withWatermark("at", delay).select(
        F.when(known, F.col("entity_key").cast("string")).otherwise(tick).alias("entity_key"), F.when(known, F.col("attribute")).otherwise("").alias("attribute"),
        F.unix_date("day").alias("epoch_day"), F.unix_millis("at").alias("at_ms"), "at",
    )
    found = keyed.filter("at_ms IS NOT NULL").groupBy("entity_key", "attribute").transformWithStateInPandas(Watch(rules), EVENTS, "Append", "EventTime")
    return found.select(issues.fingerprint(F.col("rule"), F.col("entity_key"), F.col("attribute")).alias("fingerprint"), "entity_key", "attribute", "rule", "severity", "event", F.date_from_unix_date("epoch_day").alias("day"))


def standing(events: DataFrame) -> DataFrame:
    """The event log so far -> fingerprint, entity_key, attribute, rule, severity, active, since of each issue."""
    # on one day a clearing comes after what it clears, an opening after a clearing only if a record of that day opens it anew
    step = F.when(F.col("event") == "issue_cleared", 1).when(F.col("event") == "issue_reopened", 2).when(F.col("event") == "issue_updated", 3).otherwise(0)
    last = F.max_by(F.struct("severity", "event", "day"), F.struct("day", step))
    s = events.groupBy("fingerprint", "entity_key", "attribute", "rule").agg(last.alias("e"))
    return s.select("fingerprint", "entity_key", "attribute", "rule", "e.severity", (F.col("e.event") != "issue_cleared").alias("active"), F.col("e.day").alias("since"))
