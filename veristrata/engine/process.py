"""The full rebuild: records of all sources -> links, entities, attributes with evidence, issues.

process() declares one plan per result. What later steps read several times (records, links,
attributes) is written once to spark.checkpoint.dir where that is set, else cached.
Settings are a plain dict: entity, reference, sources, attributes, matching, rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.engine.records import normalize_records, union_all, words_for
from veristrata.functions import names
from veristrata.functions.normalize import let, simplify
from veristrata.functions.settle import settle
from veristrata.operators import issues, resolve, rules, state
from veristrata.operators.intervals import covered_periods

ISSUE = {"attribute": "string", "record": "long", "evidence": "array<long>", "options": "array<string>", "related": "array<string>", "source": "string", "name_key": "string", "part_of": "int"}
#: Records that an issue cites at most.
CITED = 8


@dataclass
class Rebuild:
    records: DataFrame  # rec_id, source, ..., entity_key, match_status, match_method, score
    entities: DataFrame  # entity_key, status, name
    evidence: DataFrame  # entity_key, attribute, source, rec_id, raw, value, match_status
    attributes: DataFrame  # entity_key, attribute, value, status, authority, sources, n_sources, n_values, note
    issues: DataFrame
    review: DataFrame  # rec_id, entity_key (the candidate), score, ... of links that wait for a person or waited for one


def finding(df: DataFrame, rule: str, severity, category: str, key: Column, title: Column, *parts: Column, **more: Column) -> DataFrame:
    """Issues with the columns of ISSUE; the fingerprint is made of the rule and parts."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    own = [more.get(c, F.lit(None)).cast(t).alias(c) for c, t in ISSUE.items()]
    return df.select(issues.fingerprint(F.lit(rule), *parts).alias("fingerprint"), F.lit(rule).alias("rule"), level.alias("severity"), F.lit(category).alias("category"), key.cast("string").alias("entity_key"), title.alias("title"), *own)


def grouped(df: DataFrame, by: list[str], *sums: Column, most: int = CITED) -> DataFrame:
    """The sums of each group and ids, its `most` smallest rec_ids. Each task passes on that many of a group, so no task sees a whole one."""
    first = Window.partitionBy(*by).orderBy("rec_id")
    ids = df.select(*by, "rec_id").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("rec_id")).alias("ids"))
    return df.groupBy(*by).agg(*sums).join(ids, by)


def when(entities: DataFrame, attributes: DataFrame, condition: dict[str, list[str]] | None) -> DataFrame:
    """entities whose attributes have one of the allowed values each; no condition lets all through, a missing value fails."""
    for a, allowed in (condition or {}).items():
        ok = attributes.filter((F.col("attribute") == a) & F.col("value").isin(*allowed)).select("entity_key")
        entities = entities.join(ok, "entity_key", "left_semi")
    return entities


def first_of_each(found: list[DataFrame]) -> DataFrame:
    """All issues, of each fingerprint the one of the earliest frame."""
    every = union_all(*(f.withColumn("_o", F.lit(i)) for i, f in enumerate(found)))
    cols = ["rule", "severity", "category", "entity_key", "title", *ISSUE]
    return every.groupBy("fingerprint").agg(F.min_by(F.struct(*cols), F.struct("_o", "title")).alias("i")).select("fingerprint", "i.*")


def clustered(groups: DataFrame) -> DataFrame:
    """(rec_id, g, shown) -> (rec_id, entity_key), the same for all of a group."""
    return groups.join(groups.groupBy("g").agg(F.min_by("shown", "rec_id").alias("entity_key")), "g").select("rec_id", "entity_key")


class Engine:
    def __init__(self, config: dict, as_of: str, nicknames: list[str] | None = None):
        self.config, self.as_of = config, as_of
        self.nicknames = names.nickname_groups(nicknames or [])
        e = config["entity"]
        self.anchor, self.key, self.label = e["anchor_source"], e["key_field"], e.get("label", "Entity")
        self.orphan_severity = e.get("orphan_severity", {})
        m = config.get("matching", {})
        self.auto, self.floor = m.get("auto_accept", 0.92), m.get("review_floor", 0.75)

    def source_label(self, s: str) -> str:
        return self.config["sources"][s].get("label", s)

    # --- records and links -----------------------------------------------------------------

    def normalize(self, sources: dict[str, DataFrame]) -> DataFrame:
        """Records of the sources that the settings name; others are skipped."""
        known = [s for s in self.config["sources"] if s in sources]
        made = [normalize_records(sources[s], s, self.config["sources"][s], self.config.get("reference"), self.nicknames) for s in known]
        return union_all(*made)

    def anchors(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entities, anchor records with entity_key)."""
        own = records.filter(F.col("source") == self.anchor).withColumn("entity_key", F.col("v")[self.key])
        found = resolve.anchors(own, "entity_key", "name", "rec_id").select("entity_key", F.lit("verified").alias("status"), "name")
        return found, own.filter("entity_key IS NOT NULL")

    def _anchor_values(self, anchored: DataFrame, attributes) -> DataFrame:
        """(entity_key, attribute, value) of the anchor source's own values."""
        pairs = [(a, self.config["attributes"][a]["from"].get(self.anchor)) for a in attributes]
        cells = [F.struct(F.lit(a).alias("attribute"), F.col("v")[f].alias("value")) for a, f in pairs if f and f != "_name"]
        if not cells:
            return anchored.select("entity_key", F.lit("").alias("attribute"), F.lit("").alias("value")).limit(0)
        return anchored.select("entity_key", F.explode(F.array(*cells)).alias("c")).select("entity_key", "c.attribute", "c.value").filter("value IS NOT NULL").distinct()

    def link_keys(self, records: DataFrame, anchored: DataFrame) -> DataFrame | None:
        """(rec_id, entity_key, method) of the sources that match by keys, the first key with a hit."""
        out = []
        for s, spec in self.config["sources"].items():
            m = spec.get("match") or {}
            keys = m.get("keys") or ([{"field": m["field"], "entity_attribute": m["entity_attribute"]}] if m.get("by") == "key" else [])
            if s == self.anchor or not keys:
                continue
            field_of = lambda a: self.key if a == "__key__" else self.config["attributes"][a]["from"].get(self.anchor)
            keys = [k for k in keys if field_of(k["entity_attribute"])]
            if not keys:
                continue
            own = records.filter(F.col("source") == s).select("rec_id", "name", *(F.col("v")[k["field"]].alias(f"r{i}") for i, k in enumerate(keys)))
            ent = anchored.select("entity_key", "name", *(F.col("v")[field_of(k["entity_attribute"])].alias(f"e{i}") for i, k in enumerate(keys)))
            hit = resolve.link_by_keys(own, "rec_id", ent, [(f"r{i}", f"e{i}") for i in range(len(keys))], ("name", "name"), self.nicknames)
            how = F.element_at(F.array(*(F.lit(k["field"]) for k in keys)), F.substring("method", 2, 9).cast("int") + 1)
            out.append(hit.select("rec_id", "entity_key", F.concat(F.lit("key: "), how).alias("method")))
        return union_all(*out) if out else None

    def link_names(self, left: DataFrame, entities: DataFrame, anchored: DataFrame) -> DataFrame:
        """(rec_id, entity_key, score, decision, how) of records with a name; alike names and hints are decided once."""
        cases, none = [], F.array().cast("array<struct<attribute:string,value:string>>")
        for s, spec in self.config["sources"].items():
            m = spec.get("match") or {}
            if s != self.anchor and "name" in (m.get("by"), m.get("fallback")):
                hints = [F.struct(F.lit(a).alias("attribute"), F.col("v")[f].alias("value")) for a, f in (m.get("hints") or {}).items()]
                cases.append((s, F.array_sort(F.array(*hints)) if hints else none))
        hint = F.coalesce(*(F.when(F.col("source") == s, h) for s, h in cases)) if cases else none
        named = left.filter(F.col("source").isin([s for s, _ in cases]) & F.col("name").isNotNull()).select("rec_id", "name", hint.alias("hints"))
        named = named.withColumn("tid", F.sha1(F.to_json(F.struct("name", "hints")).cast("binary")))
        tuples = named.select("tid", "name", "hints").dropDuplicates(["tid"])
        found = names.candidates(tuples, entities, "tid", "entity_key", self.nicknames, cut=self.floor - 0.1).select(F.col("rec").alias("tid"), F.col("entity").alias("entity_key"), "score", "how")
        every = sorted({a for spec in self.config["sources"].values() for a in (spec.get("match") or {}).get("hints", {})})
        told = tuples.select("tid", F.explode("hints").alias("h")).select("tid", "h.attribute", "h.value").join(self._anchor_values(anchored, every), ["attribute", "value"]).groupBy("tid", "entity_key").agg(F.count(F.lit(1)).alias("n"))
        scored = found.join(told, ["tid", "entity_key"], "left").withColumn("s", F.round(F.col("score") + 0.01 * F.coalesce("n", F.lit(0)), 3))
        best = resolve.decide(scored, "tid", F.col("s"), "entity_key", self.auto, self.floor)
        best = best.join(found.select("tid", "entity_key", "how"), ["tid", "entity_key"])
        return named.select("rec_id", "tid").join(best, "tid").select("rec_id", "entity_key", "score", "decision", "how")

    def link(self, records: DataFrame, entities: DataFrame, anchored: DataFrame, overrides: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(records with entity_key, match_status, match_method, score; pairs that wait for a person)."""
        own = anchored.select("rec_id", "entity_key", F.lit("anchor").alias("match_status"), F.lit("anchor").alias("match_method"), F.lit(1.0).alias("score"))
        keyed, links = self.link_keys(records, anchored), [own]
        left = records.filter(F.col("source") != self.anchor)
        if keyed is not None:
            keyed = settle(keyed, "keyed")
            links.append(keyed.select("rec_id", "entity_key", F.lit("auto").alias("match_status"), F.col("method").alias("match_method"), F.lit(1.0).alias("score")))
            left = left.join(keyed, "rec_id", "left_anti")
        named = settle(self.link_names(left, entities, anchored), "named").filter("decision <> 'none'")
        review = named.filter("decision = 'review'").join(records.select("rec_id", "source", "name", "name_key"), "rec_id")
        byname = named.select("rec_id", "entity_key", F.col("decision").alias("match_status"), F.concat(F.lit("name: "), "how").alias("match_method"), "score")
        if overrides is not None:  # people's decisions hold for what no key has linked, and for entities that exist
            o = overrides.join(entities.select("entity_key", F.lit(True).alias("ok")), "entity_key", "left").filter(F.col("ok") | (F.col("entity_key") == state.NO_ENTITY))
            o = left.select("rec_id", "source", "name_key").join(o.select("source", "name_key", F.col("entity_key").alias("to")), ["source", "name_key"]).select("rec_id", "to")
            byname = byname.join(o, "rec_id", "left_anti").unionByName(o.filter(F.col("to") != state.NO_ENTITY).select("rec_id", F.col("to").alias("entity_key"), F.lit("confirmed").alias("match_status"), F.lit("decision").alias("match_method"), F.lit(1.0).alias("score")))
        return records.join(union_all(*links, byname), "rec_id", "left"), review

    def orphan_groups(self, linked: DataFrame) -> DataFrame:
        """(rec_id, g, shown) of records without an entity: their group, by name, else by their first identifier; such without either stay out."""
        return self._orphan_keys(linked).filter("g IS NOT NULL")

    def _orphan_keys(self, linked: DataFrame) -> DataFrame:
        ids = []
        for s, spec in self.config["sources"].items():
            ids += [F.when(F.col("source") == s, F.col("v")[f]) for f, own in spec["fields"].items() if own.get("type") in ("id", "license")]
        plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
        by_name = F.when(F.col("name").isNotNull(), F.concat(F.lit("n|"), "name_key"))
        shown = F.coalesce(F.concat_ws("-", F.lit("U"), plain(F.nullif(F.col("name.last"), F.lit(""))), plain(F.nullif(F.col("name.first"), F.lit("")))), F.lit("U"))
        left = linked.filter((F.col("source") != self.anchor) & F.col("entity_key").isNull())
        ident = F.coalesce(*ids, F.lit(None).cast("string"))
        left = left.select("rec_id", F.coalesce(by_name, F.concat(F.lit("i|"), ident)).alias("g"), F.when(F.col("name").isNotNull(), shown).otherwise(F.concat(F.lit("U-"), plain(ident))).alias("shown"))
        return left

    def orphans(self, linked: DataFrame) -> DataFrame:
        """(rec_id, entity_key) of records without an entity, one unverified entity a group, named by its first record."""
        groups = settle(self._orphan_keys(linked), "orphan_groups").filter("g IS NOT NULL")  # a filter before it would work out names twice
        return clustered(groups)

    # --- attributes ------------------------------------------------------------------------

    def evidence(self, records: DataFrame) -> DataFrame:
        """(entity_key, attribute, source, rec_id, raw, value, name, match_status) of all linked records."""
        cells = {}
        for a, spec in self.config["attributes"].items():
            for s, f in spec["from"].items():
                value = F.col("name.display") if f == "_name" else F.col("v")[f]
                name = F.col("name") if spec.get("compare") == "person_name" else F.lit(None).cast(names.NAME)
                cells.setdefault(s, []).append(F.struct(F.lit(a).alias("attribute"), F.lit(None).cast("string").alias("raw") if f == "_name" else F.col("raw")[f].alias("raw"), value.alias("value"), name.alias("name")))
        own = F.coalesce(*(F.when(F.col("source") == s, F.array(*c)) for s, c in cells.items()))
        out = records.filter("entity_key IS NOT NULL").select("entity_key", "source", "rec_id", "match_status", F.explode(own).alias("c"))
        return out.select("entity_key", "c.attribute", "source", "rec_id", "c.raw", "c.value", "c.name", "match_status").filter("value IS NOT NULL AND value <> ''")

    def reconcile(self, evidence: DataFrame, entities: DataFrame, decisions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(attributes of all entities, conflicts as issues). Records that wait for review don't count."""
        ranks = [(a, s, i) for a, spec in self.config["attributes"].items() for i, s in enumerate(spec.get("authority", []))]
        rank = F.coalesce(*(F.when((F.col("attribute") == a) & (F.col("source") == s), F.lit(i)) for a, s, i in ranks), F.lit(99))
        by = ["entity_key", "attribute"]
        loose = [a for a, spec in self.config["attributes"].items() if spec.get("compare") == "person_name"]
        # names are carried only where they are compared: a struct's minimum sorts its rows
        name = [F.min_by("name", "rec_id").alias("name")] if loose else []
        seen = evidence.filter("match_status <> 'review'").groupBy(*by, "source", "value").agg(F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n"), *name)
        if not loose:
            seen = seen.withColumn("name", F.lit(None).cast(names.NAME))
        # all that was seen of an entity's attribute in one row, ordered by source and first record; what follows is worked out within it
        held = seen.select(*by, F.struct("source", "first", "value", "n", rank.alias("rank"), "name").alias("s")).groupBy(*by).agg(F.collect_list("s").alias("s"))
        held = held.select(*by, F.sort_array("s").alias("s"))
        held = held.withColumn("w", F.sort_array(F.transform("s", lambda x: F.struct(x["value"].alias("value"), x["rank"].alias("rank"), x["first"].alias("first"), x["source"].alias("source"), x["n"].alias("n"), x["name"].alias("name")))))

        def runs(c: str, field: str) -> Column:
            """A sorted array cut where the field changes."""
            a, n = F.col(c), F.size(c)
            starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(a, i - 1)[field] != F.get(a, i - 2)[field]))
            return let(starts, lambda p: F.transform(p, lambda at, k: F.slice(a, at, F.coalesce(F.get(p, k + 1), n + 1) - at)))

        def value_of(run: Column) -> Column:
            x = F.get(run, F.lit(0))  # of the best rank, and its first
            name = F.array_min(F.transform(run, lambda y: F.struct(y["first"].alias("first"), y["name"].alias("name"))))["name"]
            return F.struct(x["value"].alias("value"), x["rank"].alias("rank"), x["first"].alias("first"), x["source"].alias("source"), F.aggregate(run, F.lit(0).cast("long"), lambda t, y: t + y["n"]).alias("n"), name.alias("name"))

        held = held.select(*by, F.transform(runs("w", "value"), value_of).alias("vs"), runs("s", "source").alias("per"))
        # the authority's first value, else the commonest, then the lowest
        order = lambda v: F.when(v["rank"] < 99, F.struct(v["rank"].alias("a"), v["first"].alias("b"), v["value"].alias("value"))).otherwise(F.struct(F.lit(99).alias("a"), (-v["n"]).alias("b"), v["value"].alias("value")))
        held = held.withColumn("c", F.array_min(F.transform("vs", lambda v: F.struct(order(v).alias("o"), v["value"].alias("value"), v["name"].alias("name"), F.when(v["rank"] < 99, v["source"]).alias("authority")))))
        in_source = lambda r: F.struct(F.get(r, F.lit(0))["source"].alias("source"), F.transform(r, lambda x: x["value"]).alias("value"))
        cited = F.sort_array(F.transform("per", lambda r: F.get(r, F.lit(0))["first"]))
        j = held.select(*by, "c", "vs", F.size("vs").cast("long").alias("n_values"), F.col("vs.value").alias("options"), F.map_from_entries(F.transform("per", in_source)).alias("sources"), cited.alias("cited"))
        unlike = F.col("n_values") > 1
        if loose:
            pairs = j.filter(F.col("attribute").isin(loose) & unlike).select(*by, F.explode("vs.name").alias("a"), F.col("c.name").alias("b"))
            scored = names.score_pairs(pairs.select("a", "b").distinct(), nicknames=self.nicknames)
            apart = pairs.join(scored.filter(F.col("score") < self.auto).select("a", "b"), ["a", "b"], "left_semi").select(*by).distinct().withColumn("apart", F.lit(True))
            j, unlike = j.join(apart, by, "left"), unlike & (~F.col("attribute").isin(loose) | F.coalesce("apart", F.lit(False)))
        j = j.withColumn("conflict", unlike)
        n_sources = F.size("sources")
        spec_of = lambda key, default: F.coalesce(*(F.when(F.col("attribute") == a, F.lit(s.get(key, default))) for a, s in self.config["attributes"].items()))
        j = j.withColumn("fingerprint", issues.fingerprint(F.lit("conflict"), F.col("entity_key"), F.col("attribute"), F.array_join("options", "|")))
        picked = F.lit(None).cast("string")
        if decisions is not None:
            last = decisions.groupBy("fingerprint").agg(F.max_by(F.struct("action", "value"), "id").alias("d"))
            j = j.join(last, "fingerprint", "left")
            picked = F.when((F.col("d.action") == "choose") & F.array_contains("options", F.col("d.value")), F.col("d.value"))
        status = F.when(F.col("conflict") & picked.isNotNull(), "RESOLVED").when(F.col("conflict"), "CONFLICT").when(n_sources > 1, "CONFIRMED").otherwise("SINGLE_SOURCE")
        made = settle(j.select(*by, F.when(F.col("conflict"), F.coalesce(picked, F.col("c.value"))).otherwise(F.col("c.value")).alias("value"), status.alias("status"), F.col("c.authority").alias("authority"), "sources", n_sources.cast("long").alias("n_sources"), "n_values", F.when(~F.col("conflict") & (F.col("n_values") > 1), F.lit("spelling differs between sources")).alias("note"), "conflict", "options", "fingerprint", "cited"), "attributes")
        grid = entities.select("entity_key", F.explode(F.array(*map(F.lit, self.config["attributes"]))).alias("attribute"))
        attributes = grid.join(made.drop("conflict", "options", "fingerprint", "cited"), by, "left").withColumns({"status": F.coalesce("status", F.lit("MISSING")), "n_sources": F.coalesce("n_sources", F.lit(0)), "n_values": F.coalesce("n_values", F.lit(0))})
        c = made.filter("conflict")
        labels = F.create_map(*(F.lit(x) for s in self.config["sources"] for x in (s, self.source_label(s))))
        own = F.element_at("sources", F.coalesce("authority", F.element_at(F.map_keys("sources"), 1)))
        differ = F.size(F.filter(F.map_values("sources"), lambda v: ~F.arrays_overlap(v, own)))
        heads_up = F.when(differ * 2 > F.size("sources"), F.lit(" (most sources disagree with the authority)")).otherwise(F.lit(""))
        title = F.concat(F.array_join(F.transform(F.map_keys("sources"), lambda s: F.element_at(labels, s)), " and "), F.lit(" disagree on "), F.translate("attribute", "_", " "), heads_up)
        words = F.when(F.col("attribute").isNotNull(), spec_of("category", "Data"))
        found = c.select("fingerprint", F.lit("conflict").alias("rule"), spec_of("severity", "warning").alias("severity"), words.alias("category"), "entity_key", title.alias("title"), "attribute", F.slice("cited", 1, CITED).alias("evidence"), "options")
        return attributes, found

    # --- issues ----------------------------------------------------------------------------

    def record_issues(self, records: DataFrame) -> list[DataFrame]:
        """Problems of records, keys that are missing or repeat, records alike in what must not repeat."""
        p = records.select("rec_id", "source", "rec_key", "entity_key", "raw", F.explode("problems").alias("p"))
        out = [finding(p, "field_problem", F.col("p.severity"), "Data", F.col("entity_key"), F.concat(F.translate("p.field", "_", " "), F.lit(": "), "p.message"), F.col("source"), F.coalesce("rec_key", F.col("rec_id").cast("string")), F.col("p.field"), F.col("raw")[F.col("p.field")], record=F.col("rec_id"), evidence=F.array("rec_id"))]
        anchor = records.filter(F.col("source") == self.anchor)
        none = anchor.filter(F.col("v")[self.key].isNull())
        out.append(finding(none, "missing_key", "critical", "Data", F.lit(None), F.lit(f"{self.label} without {words_for(self.key)}"), F.col("rec_id"), record=F.col("rec_id"), evidence=F.array("rec_id")))
        twice = grouped(anchor.withColumn("k", F.col("v")[self.key]).filter("k IS NOT NULL"), ["k"], F.count(F.lit(1)).alias("n")).filter("n > 1")
        out.append(finding(twice, "duplicate_key", "critical", "Data", F.col("k"), F.concat(F.lit(f"{words_for(self.key)} occurs "), F.col("n").cast("string"), F.lit(" times")), F.col("k"), evidence=F.col("ids")))
        rest = records.filter((F.col("source") != self.anchor) & F.col("rec_key").isNotNull())
        again = grouped(rest, ["source", "rec_key"], F.count(F.lit(1)).alias("n"), F.min("entity_key").alias("entity_key")).filter("n > 1")
        out.append(finding(again, "duplicate_record", "warning", "Data", F.col("entity_key"), F.concat(F.lit("record "), "rec_key", F.lit(" occurs "), F.col("n").cast("string"), F.lit(" times")), F.col("source"), F.col("rec_key"), evidence=F.col("ids")))
        for s, spec in self.config["sources"].items():
            fields = spec.get("duplicate_check")
            if fields:
                cells = [F.col("v")[f].alias(f"_{i}") for i, f in enumerate(fields)]
                own = records.filter(F.col("source") == s).select("rec_id", "entity_key", *cells).dropna(subset=[f"_{i}" for i in range(len(fields))])
                alike = grouped(own, [f"_{i}" for i in range(len(fields))], F.count(F.lit(1)).alias("n"), F.min("entity_key").alias("entity_key")).filter("n > 1")
                out.append(finding(alike, "duplicate_signature", "critical", spec.get("duplicate_category", "Data"), F.col("entity_key"), F.lit(spec.get("duplicate_title", "Possible duplicate record")), F.lit(s), *(F.col(f"_{i}") for i in range(len(fields))), evidence=F.col("ids")))
        return out

    def match_issues(self, review: DataFrame, orphaned: DataFrame, entities: DataFrame) -> list[DataFrame]:
        ent = entities.select("entity_key", F.col("name.display").alias("known"))
        g = grouped(review, ["source", "name_key", "entity_key"], F.min_by("name.display", "rec_id").alias("shown"), F.max("score").alias("score"), most=6).join(ent, "entity_key")
        same = F.concat("shown", F.lit(" may be the same "), F.lit(self.label.lower()), F.lit(" as "), "known", F.lit(" ("), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit(" % alike)"))
        out = [finding(g, "match", "warning", "Identity", F.col("entity_key"), same, F.col("source"), F.col("name_key"), F.col("entity_key"), evidence=F.col("ids"), options=F.array(F.lit("confirm"), F.lit("reject")), source=F.col("source"), name_key=F.col("name_key"))]
        level = F.coalesce(*(F.when(F.col("source") == s, F.lit(issues.SEVERITIES.index(v))) for s, v in self.orphan_severity.items()), F.lit(1))
        o = grouped(orphaned, ["entity_key"], F.min(level).alias("l"), F.min_by("name.display", "rec_id").alias("shown"), most=10)
        title = F.concat(F.coalesce("shown", "entity_key"), F.lit(f" not found in {self.source_label(self.anchor)}"))
        out.append(finding(o, "orphan", F.element_at(F.array(*map(F.lit, issues.SEVERITIES)), F.col("l") + 1), "Identity", F.col("entity_key"), title, F.col("entity_key"), evidence=F.col("ids")))
        return out

    def rule_issues(self, records: DataFrame, entities: DataFrame, attributes: DataFrame, loaded: set[str], only: Callable[[dict], bool] = lambda r: True, covered: dict[int, DataFrame] | None = None) -> list[DataFrame]:
        """Findings of the rules that `only` lets through; covered: the compared periods by a rule's place, where records aren't all there are."""
        out = []
        for i, r in enumerate(self.config.get("rules", [])):
            made = getattr(self, f"_{r['type']}", None)  # unknown kinds are ignored
            if made and only(r):
                more = {"covered": covered[i]} if covered and i in covered else {}
                out += [m.withColumn("part_of", F.lit(i)) for m in made(r, records, entities, attributes, loaded, **more) if m is not None]
        return out

    def _of(self, attributes: DataFrame, name: str) -> DataFrame:
        return attributes.filter(F.col("attribute") == name)

    def _presence(self, r, records, entities, attributes, loaded):
        for s, want in r["expect"].items():
            if s in loaded:
                own = when(entities.filter("status = 'verified'"), attributes, want.get("when"))
                gap = rules.presence(own, records.filter((F.col("source") == s) & F.col("entity_key").isNotNull()))
                yield finding(gap, "presence", want.get("severity", "warning"), want.get("category", "Data"), F.col("entity_key"), F.lit(want.get("message", f"Not in {self.source_label(s)}")), F.lit(r.get("id")), F.col("entity_key"), F.lit(s))

    def _required_attribute(self, r, records, entities, attributes, loaded):
        own = when(entities.filter("status = 'verified'"), attributes, r.get("when"))
        gap = self._of(attributes, r["attribute"]).filter("status = 'MISSING'").join(own.select("entity_key"), "entity_key", "left_semi")
        yield finding(gap, "required_attribute", r.get("severity", "warning"), r.get("category", "Data"), F.col("entity_key"), F.lit(r.get("message", "Missing")), F.lit(r.get("id")), F.col("entity_key"), attribute=F.lit(r["attribute"]))

    def _expiration(self, r, records, entities, attributes, loaded):
        own = self._of(attributes, r["attribute"]).withColumnRenamed("status", "agreed")
        found = rules.expiration(own, F.col("value").try_cast("date"), self.as_of, r.get("warn_days", 60), r.get("critical_days", 0))
        title = F.when(F.col("days") < 0, F.concat(F.lit(f"{r.get('label', words_for(r['attribute']))} expired "), (-F.col("days")).cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.lit(f"{r.get('label', words_for(r['attribute']))} expires in "), F.col("days").cast("string"), F.lit(" days")))
        note = F.when(F.col("agreed") == "CONFLICT", F.lit(" (the date is disputed)")).otherwise(F.lit(""))
        yield finding(found, "expiration", F.col("severity"), r.get("category", "Credentials"), F.col("entity_key"), F.concat(title, note), F.lit(r.get("id")), F.col("entity_key"), F.col("value"), attribute=F.lit(r["attribute"]))

    def _staleness(self, r, records, entities, attributes, loaded):
        found = rules.staleness(self._of(attributes, r["attribute"]), F.col("value").try_cast("date"), self.as_of, r["max_age_days"])
        yield finding(found, "staleness", r.get("severity", "warning"), r.get("category", "Credentials"), F.col("entity_key"), F.concat(F.lit(f"{r.get('label', words_for(r['attribute']))} is "), F.col("age").cast("string"), F.lit(" days old")), F.lit(r.get("id")), F.col("entity_key"), F.col("value"), attribute=F.lit(r["attribute"]))

    def _activity_after_expiry(self, r, records, entities, attributes, loaded):
        acts = []
        for s, a in r["activity"].items():
            fields = self.config["sources"][s]["fields"]
            measure = a.get("measure") or ("hours" if "hours" in fields else None)
            worked = F.col("v")[measure].try_cast("double") if measure else F.lit(1.0)  # a source without a measure only has what was worked
            acts.append(records.filter((F.col("source") == s) & F.col("entity_key").isNotNull()).select("entity_key", "rec_id", F.col("v")[a["date"]].try_cast("date").alias("day"), worked.alias("worked")))
        e = self._of(attributes, r["attribute"]).select("entity_key", F.col("value").try_cast("date").alias("expiry"))
        after = union_all(*acts)
        found = rules.activity_after_expiry(e, after)
        ids = grouped(rules.after_expiry(e, after), ["entity_key"], F.count(F.lit(1)).alias("n")).select("entity_key", "ids")
        found = found.join(ids, "entity_key")
        title = F.concat(F.lit(f"{r.get('title', 'Activity after expiry')}: "), F.col("hits").cast("string"), F.lit(" records from "), F.col("first_day").cast("string"))
        yield finding(found, "activity_after_expiry", r.get("severity", "critical"), r.get("category", "Credentials"), F.col("entity_key"), title, F.lit(r.get("id")), F.col("entity_key"), F.col("expiry"), attribute=F.lit(r["attribute"]), evidence=F.col("ids"))

    def _date_order(self, r, records, entities, attributes, loaded):
        own = records.filter(F.col("source") == r["source"])
        start, end = (F.col("v")[r[k]].try_cast("date") for k in ("start", "end"))
        found = rules.date_order(own, start, end, r.get("expected_days"))
        level = F.when(F.col("severity") == "warning", F.lit(r.get("severity", "warning"))).otherwise(F.col("severity"))
        title = F.when(F.col("severity") == "warning", F.lit("Ends before it starts")).otherwise(F.concat(F.lit("Covers "), F.col("days").cast("string"), F.lit(f" days, not {r.get('expected_days')}")))
        yield finding(found, "date_order", level, r.get("category", "Data"), F.col("entity_key"), title, F.lit(r.get("id")), F.coalesce("rec_key", F.col("rec_id").cast("string")), start, end, record=F.col("rec_id"), evidence=F.array("rec_id"))

    def _duplicate_entity(self, r, records, entities, attributes, loaded):
        wide = attributes.filter(F.col("attribute").isin(*r["match_on"])).groupBy("entity_key").agg(*(F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in r["match_on"]))
        pairs = rules.duplicate_entity(wide.join(entities.filter("status = 'verified'"), "entity_key", "left_semi"), "entity_key", list(r["match_on"]))
        why = F.array_join(F.transform("reasons", lambda x: F.translate(x["attribute"], "_", " ")), " and ")
        yield finding(pairs, "duplicate_entity", r.get("severity", "warning"), r.get("category", "Identity"), F.col("k1"), F.concat(F.lit(f"possible duplicate of {self.label.lower()} "), "k2", F.lit(": same "), why), F.lit(r.get("id")), F.col("k1"), F.col("k2"), related=F.array("k2"))

    def _unusual_value(self, r, records, entities, attributes, loaded):
        found = rules.unusual_value(self._of(attributes, r["attribute"]).drop("status"), F.col("value"), r["expected"], r.get("critical_pattern"), r.get("severity", "warning"))
        yield finding(found, "unusual_value", F.col("severity"), r.get("category", "Data"), F.col("entity_key"), F.concat(F.lit(f"{words_for(r['attribute'])} is "), "value"), F.lit(r.get("id")), F.col("entity_key"), F.col("value"), attribute=F.lit(r["attribute"]))

    def compare_sides(self, r: dict, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two sides of an aggregate_compare rule: (entity_key, start, end, grp, amount) and (entity_key, day, grp, amount)."""
        linked = records.filter("entity_key IS NOT NULL")
        cell = lambda side, k, t="date": F.col("v")[side[k]].try_cast(t) if side.get(k) else F.lit(None).cast(t)
        a, b = r["a"], r["b"]
        one = linked.filter(F.col("source") == a["source"]).select("entity_key", cell(a, "start").alias("start"), cell(a, "end").alias("end"), cell(a, "group", "string").alias("grp"), cell(a, "measure", "decimal(18,2)").alias("amount"))
        two = linked.filter(F.col("source") == b["source"]).select("entity_key", cell(b, "date").alias("day"), cell(b, "group", "string").alias("grp"), cell(b, "measure", "decimal(18,2)").alias("amount"))
        return one, two

    def covered(self, r: dict, records: DataFrame) -> DataFrame:
        """(start, end) of the periods that a rule compares: of all records of its sources, linked or not."""
        a, b = r["a"], r["b"]
        day = lambda side, k: F.col("v")[side[k]].try_cast("date")
        periods = records.filter(F.col("source") == a["source"]).select(day(a, "start").alias("start"), day(a, "end").alias("end"))
        dates = records.filter(F.col("source") == b["source"]).select(day(b, "date").alias("day")).filter("day IS NOT NULL")
        return settle(covered_periods(periods, dates, r.get("coverage", "every_day") == "every_day", r.get("slack_days", 0)), "covered")

    def _aggregate_compare(self, r, records, entities, attributes, loaded, covered=None):
        """covered: the periods to compare, where records aren't all there are."""
        a, b = self.compare_sides(r, records)
        covered = self.covered(r, records) if covered is None else covered
        found = rules.aggregate_compare_periods(a, b, r.get("tolerance", 0), r.get("coverage", "every_day") == "every_day", r.get("slack_days", 0), covered)
        verified = entities.filter("status = 'verified'")  # conditions are for these, others are always compared
        exempt = verified.join(when(verified, attributes, r.get("when")).select("entity_key"), "entity_key", "left_anti")
        only = found.filter("kind <> 'no overlap'").join(exempt.select("entity_key"), "entity_key", "left_anti")
        va, vb, unit = r["a"].get("verb", "A"), r["b"].get("verb", "B"), r.get("unit", "")
        money = r.get("unit_before", "")
        show = lambda c: F.concat(F.lit(money), F.regexp_replace(F.col(c).cast("string"), r"\.?0+$", ""), F.lit(unit))
        title = (
            F.when(F.col("kind") == "only a", F.concat(F.lit(f"{va} "), show("a"), F.lit(f" but not {vb.lower()}")))
            .when(F.col("kind") == "only b", F.concat(F.lit(f"{vb} "), show("b"), F.lit(f" but not {va.lower()}")))
            .when(F.col("kind") == "group", F.lit(f"{va} and {vb.lower()} agree but are booked to different groups"))
            .otherwise(F.concat(F.lit(f"{va} "), show("a"), F.lit(f" vs {vb.lower()} "), show("b")))
        )
        yield finding(only, "aggregate_compare", r.get("severity", "warning"), r.get("category", "Amounts"), F.col("entity_key"), title, F.lit(r.get("id")), F.col("entity_key"), F.col("start"), F.col("end"), F.col("kind"))
        yield finding(found.filter("kind = 'no overlap'"), "aggregate_compare", "info", r.get("category", "Amounts"), F.lit(None), F.lit(f"{r.get('label', 'Totals')}: no overlapping periods"), F.lit(r.get("id")), F.lit("no overlap"))

    # --- all of it -------------------------------------------------------------------------

    def process(self, sources: dict[str, DataFrame], decisions: DataFrame | None = None, overrides: DataFrame | None = None, auto_rules: DataFrame | None = None) -> Rebuild:
        """sources: name -> rows (rec_id unique over all sources, text columns). decisions (id, fingerprint, action, value),
        overrides (source, name_key, entity_key), auto_rules (rule_id, pattern "rule|attribute", action, attribute, value) outlive rebuilds.
        """
        records = settle(self.normalize(sources), "records")
        entities, anchored = self.anchors(records)
        linked, review = self.link(records, entities, anchored, overrides)
        linked = settle(linked, "linked")
        clusters = settle(self.orphans(linked), "clusters")
        linked = settle(
            linked.join(clusters.withColumnRenamed("entity_key", "_u"), "rec_id", "left").withColumns({"entity_key": F.coalesce("entity_key", "_u"), "match_status": F.coalesce("match_status", F.when(F.col("_u").isNotNull(), "orphan").otherwise("unlinked"))}).drop("_u"), "records"
        )
        orphaned = linked.filter("match_status = 'orphan'")
        unverified = orphaned.groupBy("entity_key").agg(F.min_by("name", "rec_id").alias("name")).select("entity_key", F.lit("unverified").alias("status"), "name")
        entities = settle(entities.unionByName(unverified), "entities")
        evidence = self.evidence(linked)
        attributes, conflicts = self.reconcile(evidence, entities, decisions)
        attributes = settle(attributes, "attributes")
        found = [*self.record_issues(linked), conflicts, *self.match_issues(review, orphaned, entities), *self.rule_issues(linked, entities, attributes, set(sources))]
        return Rebuild(linked, entities, evidence.drop("name"), attributes, settle(self.decided(first_of_each(found), attributes, decisions, auto_rules), "issues"), review)

    def decided(self, found: DataFrame, attributes: DataFrame, decisions: DataFrame | None, auto: DataFrame | None) -> DataFrame:
        """Issues with status (open, resolved, ...; auto if a learned rule applies) and rule_id."""
        out = found.withColumns({"action": F.lit(None).cast("string"), "rule_id": F.lit(None).cast("string")})
        if decisions is not None:
            last = decisions.groupBy("fingerprint").agg(F.max_by("action", "id").alias("_a"))
            out = out.join(last, "fingerprint", "left").withColumn("action", F.col("_a")).drop("_a")
        if auto is not None:
            own = out.filter("action IS NULL AND severity <> 'critical'").withColumn("pattern", F.concat_ws("|", "rule", F.coalesce("attribute", F.lit(""))))
            hit = own.select("fingerprint", "pattern", "entity_key").join(auto.select(F.col("rule_id").cast("string").alias("_r"), "pattern", F.col("attribute").alias("_at"), F.col("value").alias("_v")), "pattern")
            val = attributes.select("entity_key", F.col("attribute").alias("_at"), F.col("value").alias("_own"))
            hit = hit.join(val, ["entity_key", "_at"], "left").filter(F.col("_at").isNull() | (simplify(F.col("_own")) == simplify(F.col("_v")))).groupBy("fingerprint").agg(F.min("_r").alias("_r"))
            out = out.join(hit, "fingerprint", "left").withColumn("rule_id", F.col("_r")).drop("_r")
        return out.withColumn("status", F.when(F.col("rule_id").isNotNull(), "auto").otherwise(state.status(F.col("action")))).drop("action")
