"""A client's workspace that runs the engine: files and decisions in, versioned snapshots out, by full or incremental rebuilds.

A snapshot is a set of tables cut into PARTS buckets by the entity that a row is of. Each bucket is a folder; a manifest
names the folder of each, so that a rebuild writes only the buckets it has touched and refers to the rest where it is
(issues, which are few, are merged as a whole).
The manifest is written last: a rebuild that fails leaves the old snapshot, and earlier manifests stay readable.

What a change touches is found by joins with the change alone: records of the new file that differ from the old
one's; records that people's overrides name; where the anchor file has changed, records that share a key or a likely name
with a changed entity, old or new. Those are linked anew. The entities they were and are of, the clusters of unlinked records they
join or leave, records that share their key or signature, and the entities of changed decisions are worked out
again, with the functions of the full rebuild; everything else stays. Two kinds of rule look beyond an entity: duplicate_entity
always reads the attributes it matches on of all entities, and aggregate_compare is worked out as a whole when one of its two files has changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veristrata.engine.process import Engine, Rebuild, clustered, first_of_each
from veristrata.engine.records import union_all
from veristrata.functions import names
from veristrata.functions.settle import settle
from veristrata.operators import business, issues
from veristrata.operators.state import NO_ENTITY, Workspace, _file_system

PARTS = 32
#: Tables of a snapshot and the column whose value says which bucket a row is in.
TABLES = {"records": "entity_key", "entities": "entity_key", "evidence": "entity_key", "attributes": "entity_key", "review": "entity_key", "groups": "g", "issues": "entity_key"}


def _bucket(column: str) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(PARTS)).cast("int")


class Client(Workspace):
    """A workspace with a configuration; process() brings its snapshot up to date."""

    # --- setup ---------------------------------------------------------------------------------

    def stage_setup(self, proposal: dict) -> None:
        """Keep what setup has found in files, to be looked at and changed before it is saved."""
        self.set("proposal", json.dumps(proposal, default=str))

    def proposal(self) -> dict | None:
        return json.loads(self.get("proposal") or "null")

    def save_setup(self, config: dict, as_of: str, nicknames: list[str] | None = None) -> None:
        """Make a configuration the current one; the next process() is a full rebuild. Decisions stay."""
        self.set("config", json.dumps({"config": config, "as_of": as_of, "nicknames": nicknames or []}, sort_keys=True))
        self.set("proposal", "")
        self.append("events", [("setup", None, f"{len(config['sources'])} sources, {len(config['attributes'])} attributes, {len(config.get('rules', []))} rules")])

    def config(self) -> dict | None:
        return (json.loads(self.get("config") or "null") or {}).get("config")

    def set_as_of(self, as_of: str) -> None:
        own = json.loads(self.get("config"))
        self.set("config", json.dumps(own | {"as_of": as_of}, sort_keys=True))

    def engine(self) -> Engine:
        own = json.loads(self.get("config") or "null")
        if not own:
            raise ValueError("this workspace has no setup yet")
        return Engine(own["config"], own["as_of"], own["nicknames"])

    def receive_all(self, files: dict[str, DataFrame]) -> list[tuple[str, str | None]]:
        """(source, what went wrong or null) of each file; one that can't be read or isn't configured doesn't keep the others out."""
        out, known = [], (self.config() or {}).get("sources", {})
        for source, rows in files.items():
            try:
                if source not in known:
                    raise ValueError(f"no source {source!r} in the setup")
                self.receive(source, source, rows)
                out.append((source, None))
            except Exception as e:  # whatever a reader raises is told and kept in the log
                out.append((source, str(e).splitlines()[0][:200]))
                self.append("events", [("ingest_error", None, f"{source}: {out[-1][1]}")])
        return out

    # --- snapshots -----------------------------------------------------------------------------

    def manifest(self) -> dict | None:
        return json.loads(self.get("snapshot") or "null")

    def table(self, name: str, parts: set[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table of the snapshot, or some of its buckets; null before the first rebuild."""
        m = manifest or self.manifest()
        if m is None:
            return None
        own, schema = m["tables"][name], StructType.fromJson(json.loads(m["schemas"][name]))
        paths = [self._path(f"tables/{name}/{version}/part={p}") for p, version in own.items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def issues(self) -> DataFrame | None:
        return self.table("issues")

    def entities(self) -> DataFrame | None:
        return self.table("entities")

    def _write(self, name: str, df: DataFrame, run: str) -> dict[str, str]:
        """Writes df in buckets; part -> version of those that have rows."""
        path = self._path(f"tables/{name}/{run}")
        df.withColumn("part", _bucket(TABLES[name])).repartition("part").write.partitionBy("part").parquet(path)
        fs, at = _file_system(self.spark, path)
        return {n.removeprefix("part="): run for x in fs.listStatus(at) if (n := x.getPath().getName()).startswith("part=")}

    def _inputs(self) -> dict:
        files = {r["source"]: r["file_id"] for r in self.current("files", "source").filter("file_id IS NOT NULL").collect()}  # one row a source
        learned = self.rules().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("rule_id", "pattern", "action", "attribute", "value")), F.lit(0)).alias("h")).first()
        return {"config": self.get("config"), "files": files, "learned": f"{learned['n']} {learned['h']}"}

    def _decisions(self) -> DataFrame:
        return self.current("decisions", "fingerprint").filter("active").select("id", "fingerprint", "action", "value")

    def _overrides(self) -> DataFrame:
        return self.current("overrides", "source", "name_key").filter("active").select("source", "name_key", "entity_key")

    def _learned(self) -> DataFrame:
        return self.rules().select("rule_id", "pattern", "action", "attribute", "value")

    def process(self, full: bool = False) -> dict:
        """Bring the snapshot up to date; what was done: kind (full, incremental or none), touched entities (null for all)."""
        engine, now, old = self.engine(), self._inputs(), self.manifest()
        decisions, overrides = (settle(x, n) for x, n in ((self._decisions(), "decisions"), (self._overrides(), "overrides")))
        sources = {s: self.spark.read.parquet(self._path(f"records/source={s}/file_id={f}")) for s, f in now["files"].items() if s in engine.config["sources"]}
        same = old is not None and old["inputs"]["config"] == now["config"] and set(old["inputs"]["files"]) == set(now["files"])
        run = uuid.uuid4().hex
        decisions.write.parquet(self._path(f"tables/decisions/{run}"))
        overrides.write.parquet(self._path(f"tables/overrides/{run}"))
        if full or not same:
            built = engine.process(sources, decisions, overrides, self._learned())
            groups = engine.orphan_groups(built.records.withColumn("entity_key", F.when(F.col("match_status").isin("orphan", "unlinked"), F.lit(None)).otherwise(F.col("entity_key"))))
            made = {"records": built.records, "entities": built.entities, "evidence": built.evidence, "attributes": built.attributes, "review": built.review, "groups": groups}
            tables = {n: self._write(n, df, run) for n, df in made.items()}
            schemas = {n: df.schema.json() for n, df in made.items()}
            changed, touched, kind = self._merge_issues(built.issues, None, run), None, "full"
            for i, r in enumerate(engine.config.get("rules", [])):
                if r["type"] == "aggregate_compare":
                    engine.covered(r, built.records).write.parquet(self._path(f"tables/covered-{i}/{run}"))
                    tables[f"covered-{i}"] = run
        else:
            update = Update(self, engine, old, now, sources, decisions, overrides, run)
            if not update.needed():
                return {"kind": "none", "touched": 0}
            tables, schemas, changed, touched, kind = *update.apply(), "incremental"
        tables["issues"], schemas["issues"] = changed
        self.set("snapshot", json.dumps({"run": run, "inputs": now, "tables": tables, "schemas": schemas}))
        self.append("events", [("process", None, f"{kind} rebuild" + ("" if touched is None else f", {touched} entities"))])
        return {"kind": kind, "touched": touched}

    def _merge_issues(self, found: DataFrame, keep: DataFrame | None, run: str, parts: set[int] | None = None) -> tuple[dict, str]:
        """Writes the buckets of found issues with those seen before, which are no longer active unless in keep; logs what changed."""
        old = self.table("issues", parts)
        if old is None:
            old = self.spark.createDataFrame([], StructType([*found.schema.fields, *self.spark.createDataFrame([], "active boolean, event string").schema.fields]))
        fresh = found if keep is None else found.unionByName(keep.select(*found.columns))
        life = issues.lifecycle(old.select("fingerprint", "active"), fresh)
        rest = old.drop("active", "event").join(fresh.select("fingerprint"), "fingerprint", "left_anti")
        every = settle(fresh.unionByName(rest.select(*found.columns)).join(life, "fingerprint"), "issues")
        events = every.filter("event IS NOT NULL").select(F.col("event").alias("kind"), "fingerprint", F.col("title").alias("detail"))
        auto = every.join(old.select("fingerprint", F.col("status").alias("_was")), "fingerprint", "left").filter("active AND status = 'auto' AND coalesce(_was, '') <> 'auto'")
        self.append("events", events.unionByName(auto.select(F.lit("auto_resolved").alias("kind"), "fingerprint", F.col("title").alias("detail"))))
        return self._write("issues", every, run), every.schema.json()

    # --- what people do ------------------------------------------------------------------------

    def issue(self, fingerprint: str) -> dict:
        row = self.issues().filter(F.col("fingerprint") == fingerprint).first()
        if row is None:
            raise KeyError(fingerprint)
        return row.asDict()

    def resolve(self, fingerprint: str, action: str, value: str | None = None) -> dict:
        """Decide on an issue and rebuild: confirming or rejecting a match also links or unlinks all records of its name and source; reopen takes all of it back."""
        own = self.issue(fingerprint)
        match = own["rule"] == "match"
        if action == "reopen":
            self.append("decisions", [(fingerprint, "keep_open", None, own["status"] == "auto")])
            if match:
                self.append("overrides", [(own["source"], own["name_key"], None, False)])
            self.append("events", [("decision", fingerprint, "reopen")])
        else:
            if action == "keep_open":
                raise ValueError("an issue is left open by reopening it")
            self.decide(fingerprint, action, value, own["options"])
            if match and action in ("confirm", "reject"):
                self.override(own["source"], own["name_key"], own["entity_key"] if action == "confirm" else NO_ENTITY)
        return self.process()

    def learn_from(self, fingerprint: str, action: str, attribute: str | None = None, value: str | None = None) -> str:
        """A learned rule from an issue: for all of its kind, or only where an attribute of the entity has a value; then a rebuild."""
        own = self.issue(fingerprint)
        title = self.spark.range(1).select(business.generic_title(F.lit(own["title"])).alias("t")).first()["t"]
        label = f"{action}: {title}" + (f" when {attribute.replace('_', ' ')} is {value}" if attribute else "")
        rule_id = self.learn(f"{own['rule']}|{own['attribute'] or ''}", action, own["severity"], label, attribute, value)
        self.process()
        return rule_id

    def applied(self) -> DataFrame:
        """(rule_id, label, applied): learned rules with the active issues that each settles now."""
        n = self.issues().filter("active AND status = 'auto'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("applied"))
        return self.rules().select("rule_id", "label").join(n, "rule_id", "left").withColumn("applied", F.coalesce("applied", F.lit(0)))


class Update:
    """One incremental rebuild."""

    def __init__(self, client: Client, engine: Engine, old: dict, now: dict, sources: dict[str, DataFrame], decisions: DataFrame, overrides: DataFrame, run: str):
        self.client, self.engine, self.old, self.now, self.sources, self.run = client, engine, old, now, sources, run
        self.decisions, self.overrides = decisions, overrides
        self.fresh = {s for s in sources if old["inputs"]["files"].get(s) != now["files"][s]}
        before = {n: client.spark.read.parquet(client._path(f"tables/{n}/{old['run']}")) for n in ("decisions", "overrides")}
        both = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a))
        self.decided = settle(both(decisions.drop("id"), before["decisions"].drop("id")).select("fingerprint").distinct(), "decided")
        self.overruled = settle(both(overrides, before["overrides"]).select("source", "name_key").distinct(), "overruled")
        self.learned = old["inputs"]["learned"] != now["learned"]

    def needed(self) -> bool:
        return bool(self.fresh) or self.learned or not self.decided.isEmpty() or not self.overruled.isEmpty()

    def _parts(self, keys: DataFrame, column: str = "entity_key") -> set[int]:
        return {r[0] for r in keys.select(_bucket(column)).distinct().collect()}  # PARTS rows at most

    def _changed(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(records that are new or other than before, old records that are gone or other now) of the files received since."""
        own = records.filter(F.col("source").isin(*self.fresh)) if self.fresh else records.limit(0)
        content = F.xxhash64("source", F.to_json("raw"))
        new = self.engine.normalize({s: t for s, t in self.sources.items() if s in self.fresh}) if self.fresh else None
        before = own.withColumn("_h", content)
        if new is None:
            return records.select(*RECORD).limit(0), own
        new = settle(new.withColumn("_h", content), "normal")
        came = new.join(before.select("rec_id", "_h"), ["rec_id", "_h"], "left_anti").drop("_h")
        gone = before.join(new.select("rec_id", "_h"), ["rec_id", "_h"], "left_anti").drop("_h")
        return came.select(*RECORD), gone

    def _affected(self, records: DataFrame, came: DataFrame, gone: DataFrame, entities: DataFrame) -> DataFrame:
        """rec_id of records whose link may change though they didn't."""
        e, others = self.engine, records.filter(F.col("source") != self.engine.anchor)
        found = [others.join(self.overruled, ["source", "name_key"], "left_semi").select("rec_id")]
        if e.anchor in self.fresh:
            side = union_all(came.filter(F.col("source") == e.anchor).select(*RECORD), gone.filter(F.col("source") == e.anchor).select(*RECORD)).withColumn("entity_key", F.col("v")[e.key]).filter("entity_key IS NOT NULL")
            side = settle(side, "anchors")
            found.append(others.join(side.select("entity_key").distinct(), "entity_key", "left_semi").select("rec_id"))
            keyed = e.link_keys(records, side)
            if keyed is not None:
                found.append(keyed.select("rec_id"))
            names_now = side.filter("name IS NOT NULL").select("name", F.to_json("name").alias("id")).distinct()
            own = others.filter("name IS NOT NULL").select("name").distinct().withColumn("rid", F.to_json("name"))
            near = names.candidates(own, names_now, "rid", "id", e.nicknames, cut=e.floor - 0.1).select(F.col("rec").alias("_n")).distinct()
            found.append(others.withColumn("_n", F.to_json("name")).join(near, "_n", "left_semi").select("rec_id"))
        return union_all(*found).distinct()

    def apply(self) -> tuple[dict, dict, tuple[dict, str], int]:
        """(tables, schemas, issues) of the new snapshot and the number of touched entities."""
        c, e, t = self.client, self.engine, lambda n, parts=None: self.client.table(n, parts, self.old)
        records, old_entities = t("records"), t("entities")
        came, gone = (settle(x, n) for x, n in zip(self._changed(records), ("came", "gone")))
        stay = records.join(gone.select("rec_id"), "rec_id", "left_anti")
        anchors = union_all(stay.filter(F.col("source") == e.anchor).select(*RECORD), came.filter(F.col("source") == e.anchor).select(*RECORD))
        known, anchored = e.anchors(anchors)
        known = settle(known, "known")
        affected = settle(self._affected(stay, came, gone, old_entities), "affected")
        again = union_all(came, stay.filter(F.col("source") != e.anchor).join(affected, "rec_id", "left_semi").select(*RECORD))
        again = settle(again, "again")
        linked, review = e.link(again, known, anchored, self.overrides)
        linked, review = settle(linked, "linked"), settle(review, "review")
        # unlinked records: their groups, and what those are called now
        moved = union_all(gone.select("rec_id"), again.select("rec_id")).distinct()
        old_groups = t("groups")
        hit = union_all(old_groups.join(moved, "rec_id", "left_semi").select("g"), e.orphan_groups(linked).select("g")).distinct()
        hit = settle(hit, "hit")
        some = old_groups if hit.isEmpty() else t("groups", self._parts(hit, "g"))
        groups = settle(union_all(some.join(moved, "rec_id", "left_anti"), e.orphan_groups(linked)), "groups")
        named = settle(clustered(groups.join(hit, "g", "left_semi")), "clusters")
        # records as they are now, where they may be other than before
        lone = stay.join(moved, "rec_id", "left_anti").join(named.withColumnRenamed("entity_key", "_u"), "rec_id").withColumn("entity_key", F.col("_u")).drop("_u")
        fresh = linked.join(named.withColumnRenamed("entity_key", "_u"), "rec_id", "left").withColumns({"entity_key": F.coalesce("entity_key", "_u"), "match_status": F.coalesce("match_status", F.when(F.col("_u").isNotNull(), "orphan").otherwise("unlinked"))}).drop("_u")
        fresh = settle(union_all(fresh, lone.select(*fresh.columns)), "fresh")
        was = records.join(union_all(fresh.select("rec_id"), gone.select("rec_id")).distinct(), "rec_id", "left_semi")
        # touched entities; the empty text stands for records without one
        key = F.coalesce("entity_key", F.lit("")).alias("k")
        seen = t("review")
        owners = [was.select(key), fresh.select(key), seen.join(moved, "rec_id", "left_semi").select(key), review.select(key)]
        owners.append(c.issues().join(self.decided, "fingerprint", "left_semi").select(key))
        if e.anchor in self.fresh:
            a = union_all(came.select("source", "v"), gone.select("source", "v")).filter(F.col("source") == e.anchor).select(F.coalesce(F.col("v")[e.key], F.lit("")).alias("k"))
            owners.append(a)
        rest = stay.join(fresh.select("rec_id"), "rec_id", "left_anti")
        change = union_all(was.select("source", "rec_key", "v"), fresh.select("source", "rec_key", "v"))
        owners.append(rest.join(change.select("source", "rec_key").filter("rec_key IS NOT NULL").distinct(), ["source", "rec_key"], "left_semi").select(key))
        sign = self._signature()
        if sign is not None:
            mark = change.select("source", sign.alias("s")).filter("s IS NOT NULL").distinct()
            owners.append(rest.withColumn("s", sign).join(mark, ["source", "s"], "left_semi").select(key))
        touched = settle(union_all(*owners).distinct(), "touched")
        n_touched, parts = touched.count(), self._parts(touched, "k")
        of = lambda df, how="left_semi": df.withColumn("k", F.coalesce("entity_key", F.lit(""))).join(touched, "k", how).drop("k")
        # the touched entities, worked out by the functions of the full rebuild
        now = settle(union_all(of(t("records", parts).join(union_all(fresh.select("rec_id"), gone.select("rec_id")), "rec_id", "left_anti")), of(fresh).select(*records.columns)), "now")
        reviewed = settle(union_all(of(t("review", parts).join(moved, "rec_id", "left_anti")), of(review).select(*seen.columns)), "reviewed")
        orphaned = now.filter("match_status = 'orphan'")
        entities = settle(of(known).unionByName(orphaned.groupBy("entity_key").agg(F.min_by("name", "rec_id").alias("name")).select("entity_key", F.lit("unverified").alias("status"), "name")), "entities")
        evidence = e.evidence(now)
        attributes, conflicts = e.reconcile(evidence, entities, self.decisions)
        attributes = settle(attributes, "attributes")
        merge = lambda n, df: union_all(of(t(n, parts), "left_anti"), df.select(*t(n).columns))
        tables, schemas = dict(self.old["tables"]), dict(self.old["schemas"])
        for n, df in (("records", now), ("entities", entities), ("evidence", evidence.drop("name")), ("attributes", attributes), ("review", reviewed)):
            tables[n] = {p: v for p, v in tables[n].items() if int(p) not in parts} | c._write(n, merge(n, df), self.run)
        if not hit.isEmpty():
            g_parts = self._parts(hit, "g")
            tables["groups"] = {p: v for p, v in tables["groups"].items() if int(p) not in g_parts} | c._write("groups", groups, self.run)
        whole = lambda n: c.table(n, None, {"tables": tables, "schemas": schemas})
        loaded, rules = set(self.sources), e.config.get("rules", [])
        own = [*e.record_issues(now), conflicts, *e.match_issues(reviewed, orphaned, entities)]
        due = {i for i, r in enumerate(rules) if r["type"] == "aggregate_compare" and {r["a"]["source"], r["b"]["source"]} & self.fresh}
        covered = {}
        for i, r in enumerate(rules):
            if r["type"] == "aggregate_compare":
                if i in due:
                    covered[i] = e.covered(r, whole("records"))
                    covered[i].write.parquet(c._path(f"tables/covered-{i}/{self.run}"))
                    tables[f"covered-{i}"] = self.run
                else:
                    covered[i] = c.spark.read.parquet(c._path(f"tables/covered-{i}/{tables[f'covered-{i}']}"))
        place = {id(r): i for i, r in enumerate(rules)}
        own += [f.filter("rule <> 'aggregate_compare' OR entity_key IS NOT NULL") for f in e.rule_issues(now, entities, attributes, loaded, lambda r: r["type"] != "duplicate_entity" and place[id(r)] not in due, covered)]
        pairs = [r for r in rules if r["type"] == "duplicate_entity"]
        if pairs:
            matched = whole("attributes").filter(F.col("attribute").isin(*{a for r in pairs for a in r["match_on"]}))
            own += e.rule_issues(now, whole("entities"), matched, loaded, lambda r: r["type"] == "duplicate_entity")
        if due:
            own += e.rule_issues(whole("records"), whole("entities"), whole("attributes"), loaded, lambda r: place[id(r)] in due)
        found = first_of_each(own)
        # issues that nothing touched stay: of other entities, and of rules that are told above as a whole
        was_active = t("issues").filter("active")
        wide = (F.col("rule") == "duplicate_entity") | F.col("part_of").isin(*due) if due else F.col("rule") == "duplicate_entity"
        global_ = (F.col("rule") == "aggregate_compare") & F.col("entity_key").isNull()
        untouched = was_active.withColumn("k", F.coalesce("entity_key", F.lit(""))).join(touched.withColumn("_t", F.lit(True)), "k", "left").filter(~F.coalesce(wide, F.lit(False)) & (F.col("_t").isNull() | global_)).drop("k", "_t")
        cols = found.columns
        every = found.unionByName(untouched.select(*cols).join(found.select("fingerprint"), "fingerprint", "left_anti"))
        decided = e.decided(every, whole("attributes"), self.decisions, c._learned())
        return tables, schemas, c._merge_issues(decided, None, self.run), n_touched

    def _signature(self) -> F.Column | None:
        """What must not repeat in a source, as one text; null where a field of it is."""
        cases = []
        for s, spec in self.engine.config["sources"].items():
            if spec.get("duplicate_check"):
                cells = [F.col("v")[f] for f in spec["duplicate_check"]]
                whole = cells[0].isNotNull()
                for x in cells[1:]:
                    whole = whole & x.isNotNull()
                cases.append(F.when((F.col("source") == s) & whole, F.to_json(F.array(*cells))))
        return F.coalesce(*cases) if cases else None


RECORD = ["rec_id", "source", "rec_key", "name", "name_key", "v", "raw", "problems"]
