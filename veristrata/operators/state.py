"""A workspace: what people decided and what was received, as append-only Parquet logs that survive rebuilds.

Each log's current state is the last row of a key. A rebuild writes its issues as a new
snapshot and only then names it as the current one, so a failed rebuild leaves the old one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import issues as _issues
from veristrata.operators.views import create_view

LOGS = {
    "decisions": "fingerprint string, action string, value string, active boolean",
    "overrides": "source string, name_key string, entity_key string, active boolean",
    "auto_rules": "rule_id string, pattern string, action string, label string, attribute string, value string",
    "events": "kind string, fingerprint string, detail string",
    "settings": "key string, value string",
    "files": "file_id string, source string, name string, sha256 string, n_rows long",
    "rule_switches": "rule_id string, on boolean",
}
#: Folders and logs that a reset leaves as they are.
KEPT = ("settings",)
# The status that a decision gives an issue.
STATUS = {"choose": "resolved", "confirm": "resolved", "reject": "resolved", "acknowledge": "acknowledged", "dismiss": "dismissed", "keep_open": "open"}
NO_ENTITY = "__none__"


def status(action: F.Column) -> F.Column:
    """Status of an issue with the given last decision; open without one."""
    return F.coalesce(*(F.when(action == a, F.lit(s)) for a, s in STATUS.items()), F.lit("open"))


def apply_overrides(links: DataFrame, overrides: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """links (rec_id, source, name_key, entity_key, score, decision) after people's overrides (source, name_key, entity_key).

    An override to NO_ENTITY unlinks, any other one links with certainty if entities (entity_key) has
    its target. links are those by name: what a key has linked isn't overruled.
    """
    o = overrides.select("source", "name_key", F.col("entity_key").alias("_to"))
    if entities is not None:
        there = entities.select(F.col("entity_key").alias("_to")).distinct().withColumn("_ok", F.lit(True))
        o = o.join(there, "_to", "left").filter(F.col("_ok") | (F.col("_to") == NO_ENTITY)).drop("_ok")
    j = links.join(o, ["source", "name_key"], "left")
    gone, set_ = F.col("_to") == NO_ENTITY, F.col("_to").isNotNull()
    return j.select("rec_id", "source", "name_key", F.when(gone, None).otherwise(F.coalesce("_to", "entity_key")).alias("entity_key"), F.when(gone, None).when(set_, F.lit(1.0)).otherwise(F.col("score")).alias("score"), F.when(gone, "rejected").when(set_, "confirmed").otherwise(F.col("decision")).alias("decision"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _move(spark: SparkSession, path: str, to: str) -> None:
    fs, source = _file_system(spark, path)
    target = _file_system(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{path} couldn't be moved to {to}")


def workspaces(spark: SparkSession, root: str) -> list[str]:
    """Names of the workspaces under root, removed ones left out."""
    fs, path = _file_system(spark, root)
    found = fs.listStatus(path) if fs.exists(path) else []
    return sorted(n for x in found if x.isDirectory() and not (n := x.getPath().getName()).startswith("_"))


def remove_workspace(spark: SparkSession, root: str, slug: str) -> None:
    """Take a workspace off the list; its folder is kept under another name."""
    _move(spark, f"{root.rstrip('/')}/{slug}", f"{root.rstrip('/')}/_deleted_{slug}_{uuid.uuid4().hex}")


class Workspace:
    """One client's folder of logs, records and snapshots."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        fs, path = _file_system(self.spark, self._path(name))
        return fs.exists(path)

    def append(self, log: str, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, LOGS[log])
        df.withColumns({"at": F.current_timestamp(), "id": F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.monotonically_increasing_id())}).write.mode("append").parquet(self._path(log))

    def log(self, name: str) -> DataFrame:
        schema = f"{LOGS[name]}, at timestamp, id string"
        return self.spark.read.schema(schema).parquet(self._path(name)) if self._exists(name) else self.spark.createDataFrame([], schema)

    def current(self, name: str, *by: str) -> DataFrame:
        """The last row of each key."""
        every = self.log(name)
        last = F.max_by(F.struct(*every.columns), F.struct("at", "id"))
        return every.groupBy(*by).agg(last.alias("_last")).select("_last.*")

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.current("settings", "key").filter(F.col("key") == key).select("value").first()
        return row[0] if row else default

    def set(self, key: str, value: str) -> None:
        self.append("settings", [(key, value)])

    def receive(self, source: str, name: str, records: DataFrame, sha256: str | None = None) -> str:
        """Store records; the file replaces the earlier ones of its source."""
        file_id = uuid.uuid4().hex
        records.write.parquet(self._path(f"records/source={source}/file_id={file_id}"))
        n = self.spark.read.parquet(self._path(f"records/source={source}/file_id={file_id}")).count()
        self.append("files", [(file_id, source, name, sha256, n)])
        self.append("events", [("ingest", None, f"{name}: {n} rows")])
        return file_id

    def records(self, source: str) -> DataFrame | None:
        """Records of the source's current file, if it has one."""
        row = self.current("files", "source").filter(F.col("source") == source).select("file_id").first()
        return self.spark.read.parquet(self._path(f"records/source={source}/file_id={row[0]}")) if row and row[0] else None

    def files(self) -> DataFrame:
        """All files received, newest first, and whether their records are the source's current ones."""
        now = self.current("files", "source").select(F.col("file_id").alias("now")).filter("now IS NOT NULL")
        every = self.log("files").filter("file_id IS NOT NULL").join(now, F.col("file_id") == F.col("now"), "left")
        return every.select("file_id", "source", "name", "n_rows", "at", F.col("now").isNotNull().alias("active")).orderBy(F.desc("at"))

    def deactivate(self, file_id: str) -> None:
        """The file's source has no records until another file is received; a file that isn't current stays as it is."""
        row = self.current("files", "source").filter(F.col("file_id") == file_id).select("source", "name").first()
        if row:
            self.append("files", [(None, row["source"], row["name"], None, 0)])
            self.append("events", [("file removed", None, row["name"])])

    def rename(self, name: str) -> None:
        self.set("name", name)

    def reset(self) -> None:
        """Empty all but the settings; what was there is moved to a folder of its own."""
        to = f"_reset_{uuid.uuid4().hex}"
        for name in [n for n in (*LOGS, "records", "issues") if n not in KEPT and self._exists(n)]:
            _move(self.spark, self._path(name), self._path(f"{to}/{name}"))
        self.set("issues", "")

    def events(self, n: int = 50) -> DataFrame:
        """The newest n events."""
        return self.log("events").orderBy(F.desc("at"), F.desc("id")).limit(n)

    def info(self) -> dict:
        """The workspace's name, current records, and active issues that are open, critical ones apart."""
        files, now = self.files().filter("active"), self.issues()
        own = now.filter("active AND status = 'open'").agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("severity") == "critical").alias("urgent")).first() if now is not None else {"open": 0, "urgent": 0}
        return {"name": self.get("name", self.root.rsplit("/", 1)[-1]), "records": files.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0], "open": own["open"], "urgent": own["urgent"]}

    def decide(self, fingerprint: str, action: str, value: str | None = None, options: list[str] | None = None) -> None:
        """Record a decision; choosing needs a value that was observed."""
        if action not in STATUS:
            raise ValueError(f"unknown decision: {action!r}")
        if action == "choose" and value not in (options or []):
            raise ValueError("the chosen value isn't one of the observed ones")
        self.append("decisions", [(fingerprint, action, value, True)])
        self.append("events", [("decision", fingerprint, action)])

    def reopen(self, fingerprint: str) -> None:
        """Take back a decision; a learned rule doesn't apply to the issue any more."""
        self.append("decisions", [(fingerprint, "keep_open", None, True)])
        self.append("events", [("decision", fingerprint, "reopen")])

    def override(self, source: str, name_key: str, entity_key: str | None) -> None:
        """Link all records of a name of a source to an entity, or (None) to nothing."""
        self.append("overrides", [(source, name_key, entity_key or NO_ENTITY, True)])

    def learn(self, pattern: str, action: str, severity: str, label: str = "", attribute: str | None = None, value: str | None = None) -> str:
        """Keep a rule for the issues of a pattern (rule|attribute), on condition of a value of their entity's attribute; earlier rules win."""
        if severity == "critical" or action not in ("acknowledge", "dismiss"):
            raise ValueError("a learned rule may only acknowledge or dismiss issues that aren't critical")
        rule_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # in the order of making, two at once included
        self.append("auto_rules", [(rule_id, pattern if "|" in pattern else f"{pattern}|", action, label, attribute, value)])
        self.append("events", [("rule", None, label or pattern)])
        return rule_id

    def switch(self, rule_id: str, on: bool) -> None:
        """Switch a learned rule off or on; the next rebuild follows."""
        self.append("rule_switches", [(rule_id, on)])
        self.append("events", [("rule on" if on else "rule off", None, rule_id)])

    def rules(self) -> DataFrame:
        """Learned rules that aren't switched off."""
        off = self.current("rule_switches", "rule_id").filter("NOT on").select("rule_id")
        return self.log("auto_rules").join(off, "rule_id", "left_anti")

    def issues(self) -> DataFrame | None:
        """The current snapshot: issue columns, active and status."""
        run = self.get("issues")
        return self.spark.read.parquet(self._path(f"issues/{run}")) if run else None

    def rebuild(self, found: DataFrame) -> DataFrame:
        """Merge the issues of a rebuild (issue columns) into the next snapshot and log what changed."""
        old = self.issues()
        before = old.select("fingerprint", "active") if old is not None else self.spark.createDataFrame([], "fingerprint string, active boolean")
        life = _issues.lifecycle(before, found)
        every = found.select(*_issues.COLUMNS)
        if old is not None:
            every = every.unionByName(old.select(*_issues.COLUMNS).join(found.select("fingerprint"), "fingerprint", "left_anti"))
        last = self.current("decisions", "fingerprint").filter("active").select("fingerprint", "action")
        decided = every.join(life, "fingerprint").join(last, "fingerprint", "left").withColumn("decided", F.col("action").isNotNull())
        rules = self.rules().filter("attribute IS NULL").select("rule_id", "pattern", F.col("action").alias("rule_action"))  # conditions are for who knows the attributes
        first = rules.groupBy("pattern").agg(F.min_by("rule_action", "rule_id").alias("rule_action"))
        own = F.concat_ws("|", "rule", F.coalesce(F.col("attribute") if "attribute" in decided.columns else F.lit(None), F.lit("")))
        j = decided.withColumn("_pattern", own).join(first, F.col("_pattern") == first["pattern"], "left")
        auto = F.col("rule_action").isNotNull() & (F.col("severity") != "critical") & ~F.col("decided")
        run = uuid.uuid4().hex
        j.select(*_issues.COLUMNS, "active", "event", F.when(auto, "auto").otherwise(status(F.col("action"))).alias("status")).write.parquet(self._path(f"issues/{run}"))
        new = self.spark.read.parquet(self._path(f"issues/{run}"))
        self.append("events", new.filter("event IS NOT NULL").select(F.col("event").alias("kind"), "fingerprint", F.col("title").alias("detail")))
        self.set("issues", run)
        return new

    def catalog(self) -> list[str]:
        """Temp views of the logs and the current issues."""
        made = [create_view(self.log(n), f"ws_{n}") for n in LOGS]
        now = self.issues()
        return made + ([create_view(now, "ws_issues")] if now is not None else [])

    def browse(self, view: str, n: int = 200) -> DataFrame:
        return self.spark.table(view).limit(min(n, 1000))

    def export_csv(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").option("header", True).csv(self._path(f"exports/{name}"))
        return self._path(f"exports/{name}")
