"""python -m veristrata FILES... [--config FILE] [--as-of DATE] [--out FOLDER]: files to issues in one go."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import date
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.engine.process import Engine, Rebuild
from veristrata.operators import business, infer, setup
from veristrata.sources import sheet, tabular

#: First rows that the heading is looked for in.
HEAD = 15


def read(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """(cells, first rows) of a delimited file or a workbook."""
    reader = sheet if path.lower().endswith((".xlsx", ".xlsm")) else tabular
    cells = reader.read_cells(spark, path)
    return cells, [r["cells"] for r in cells.filter(F.col("row_num") <= HEAD).orderBy("row_num").collect()]


def table(cells: DataFrame, head: list[list[str]]) -> DataFrame:
    """The rows below the heading as text columns; headings that are blank or repeat are numbered."""
    at = infer.header_row(head)
    names = [n for n in head[at]] if head else []
    seen: dict[str, int] = {}
    for i, n in enumerate(names):
        base = n or "column"
        seen[base] = seen.get(base, 0) + 1
        names[i] = base if seen[base] == 1 else f"{base} {seen[base]}"
    body = cells.filter((F.col("row_num") > at + 1) & F.exists("cells", lambda c: c != ""))
    return body.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def configured(spark: SparkSession, paths: Sequence[str], config: dict) -> tuple[dict[str, DataFrame], list[str]]:
    """(source -> rows for the engine, what went wrong with which file); files of one source are put together."""
    found: dict[str, list[DataFrame]] = {}
    known = {s: {"label": own.get("label", s), "fields": {f: [x["header"]] if "header" in x else [] for f, x in own["fields"].items()}, "required": [f for f, x in own["fields"].items() if x.get("required")]} for s, own in config["sources"].items()}
    wrong = []
    for path in paths:
        try:
            cells, head = read(spark, path)
            source, at, binding, _ = tabular.detect_source(head, Path(path).name, known)
        except ValueError as e:
            wrong.append(f"{path}: {e}")
            continue
        rows = tabular.records(cells, binding, at + 1)
        found.setdefault(source, []).append(rows.select(F.xxhash64(F.lit(source), "file", "row_num").alias("rec_id"), *(f"`{f}`" for f in binding)))
    return {s: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for s, parts in found.items()}, wrong


def run(spark: SparkSession, paths: Sequence[str], config: dict | None = None, as_of: str | None = None) -> tuple[Rebuild, dict, list[str]]:
    """(rebuild, configuration, files that couldn't be used). Without a configuration the files propose one."""
    wrong: list[str] = []
    if config is None:
        files = {Path(p).stem: table(*read(spark, p)) for p in paths}
        config = setup.build_config(setup.analyse(files))
        sources = {f: setup.prepare(t, f) for f, t in files.items()}
    else:
        sources, wrong = configured(spark, paths, config)
    return Engine(config, as_of or date.today().isoformat()).process(sources), config, wrong


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="veristrata", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("--config", help="configuration as JSON; without it the files propose one")
    p.add_argument("--as-of", help="the day that counts as today")
    p.add_argument("--out", help="folder for issues, entities and attributes as Parquet and the configuration")
    p.add_argument("--top", type=int, default=50, help="issues to print")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("veristrata").getOrCreate()
    built, config, wrong = run(spark, a.files, json.loads(Path(a.config).read_text()) if a.config else None, a.as_of)
    for line in wrong:
        print(f"skipped {line}")
    for r in built.issues.groupBy("severity").count().orderBy("severity").collect():
        print(f"{r['severity']}: {r['count']}")
    listed = business.issue_list(built.issues, built.entities)
    for r in listed.limit(a.top).collect():
        print(f"[{r['severity']}] {r['entity_key'] or '-'} {r['title']}")
    if a.out:
        for name in ("issues", "entities", "attributes"):
            getattr(built, name).write.mode("overwrite").parquet(f"{a.out}/{name}")
        spark.createDataFrame([(json.dumps(config),)], "value string").write.mode("overwrite").text(f"{a.out}/config")
    return 1 if wrong else 0
