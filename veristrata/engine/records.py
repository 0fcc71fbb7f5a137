"""Raw rows of a source as normalised records: typed values, problems, names, by the source's settings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import names, normalize
from veristrata.operators.codes import similar_codes

PROBLEM = "array<struct<field:string,severity:string,message:string>>"


def normalize_value(c: Column, spec: dict, vocabularies: dict[str, dict[str, str]] | None = None) -> tuple[Column, Column]:
    """(value as it shows, problem or null) of a text column under a field's settings (type, ref, min, max)."""
    kind, none = spec.get("type", "text"), F.lit(None).cast("string")
    if kind == "date":
        day, problem = normalize.date(c)
        return F.date_format(day, "yyyy-MM-dd"), problem
    if kind == "number":
        n, problem = normalize.number(c, spec.get("min"), spec.get("max"))
        return F.when(n.isNotNull(), normalize.display(n, "double")), problem
    if kind == "code":
        return normalize.code(c, normalize.vocabulary((vocabularies or {}).get(spec.get("ref"), {})))
    if kind in ("phone", "email"):
        return getattr(normalize, kind)(c)
    if kind == "person_name":
        name = names.parse_person(c)
        return name["display"], F.when(~normalize.is_empty(c) & name.isNull(), F.concat(F.lit("not a name: "), c))
    if kind == "org_name":
        return names.parse_org(c)["display"], none
    if kind in ("id", "license", "text"):
        return {"id": normalize.identifier, "license": normalize.license_number, "text": normalize.text}[kind](c), none
    raise ValueError(f"unknown field type {kind!r}")


def words_for(field: str) -> str:
    return re.sub(r"[_\s]+", " ", field).strip()


def record_name(columns: list[str], spec: dict) -> Column:
    """The name struct of a source's rows, from its full name field or its first and last ones."""
    own = spec.get("name") or {}
    get = lambda f: F.col(f) if f in columns else F.lit(None).cast("string")
    if "full" in own:
        org = (spec["fields"].get(own["full"]) or {}).get("type") == "org_name"
        return (names.parse_org if org else names.parse_person)(get(own["full"]))
    if own:
        return names.person(get(own.get("first")), get(own.get("last")))
    return F.lit(None).cast(names.NAME)


def normalize_records(rows: DataFrame, source: str, spec: dict, vocabularies: dict | None = None, nicknames: dict[str, list[int]] | None = None) -> DataFrame:
    """rows (rec_id, text columns) -> rec_id, source, rec_key, name, name_key, v, raw, problems.

    v and raw map fields to what they show and to what was read. A required field that is blank
    or that the file lacks has that problem instead of its type's. Problems of phones are
    info, others warnings. Codes that no alias settles take that of the most similar alias; only their
    distinct values leave the JVM.
    """
    fields, has = spec["fields"], set(rows.columns)
    value, raw, found = [], [], []
    words = {f: w for f, own in fields.items() if own.get("type") == "code" and f in has and (w := normalize.vocabulary((vocabularies or {}).get(own.get("ref"), {})))}
    if words:
        near = similar_codes(rows, words)
        for i, f in enumerate(words):
            own = near.filter(F.col("field") == f).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_near_{f}"))
            rows = rows.join(own, F.col(f) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    for f, own in fields.items():
        c = F.col(f) if f in has else F.lit(None).cast("string")
        shown, problem = normalize_value(c, own, vocabularies)
        if f in words:
            shown, problem = F.coalesce(shown, F.col(f"_near_{f}")), F.when(F.col(f"_near_{f}").isNull(), problem)
        if own.get("required"):
            problem = F.when(normalize.is_empty(c), F.lit(f"{words_for(f)} is blank")).otherwise(problem) if f in has else F.lit(f"{words_for(f)} is missing from the file")
        level = "info" if own.get("type") == "phone" else "warning"
        value += [F.lit(f), normalize.let(shown, lambda x: F.nullif(x, F.lit("")))]
        raw += [F.lit(f), c]
        found.append(F.when(problem.isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(level).alias("severity"), problem.alias("message"))))
    name = record_name(sorted(has), spec)
    out = rows.select("rec_id", F.lit(source).alias("source"), name.alias("name"), F.create_map(*value).alias("v"), F.create_map(*raw).alias("raw"), F.array_compact(F.array(*found)).cast(PROBLEM).alias("problems"))
    key = F.col("v")[spec["record_key"]] if spec.get("record_key") else F.lit(None).cast("string")
    return out.select("rec_id", "source", key.alias("rec_key"), "name", names.name_key(F.col("name"), nicknames).alias("name_key"), "v", "raw", "problems")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
