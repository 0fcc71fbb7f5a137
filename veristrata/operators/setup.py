"""From a business's files to a configuration that the engine runs: links, master file, attributes, vocabularies, rules.

Work on rows is distributed aggregation and joins of distinct values; what is decided here has one
item per column, pair of columns, or spelling of a column that is a code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.engine.records import record_name
from veristrata.functions import normalize
from veristrata.operators import align, infer

#: Spellings that a vocabulary is made of at most; a column with more of them is compared as text.
VOCABULARY = 2_000
#: Words in a file's name that speak for it as the master.
MASTER = {"master", "main", "roster", "directory", "register", "list"}
# Least share of keys and of names that two files have in common, how much alike headings add.
KEY_SHARE, NAME_SHARE, HEADING = 0.5, 0.4, 0.4
#: Least sum of shared values and alike headings for two columns to be one attribute.
SAME_ATTRIBUTE = 0.6
#: Share of its most frequent value from which on an attribute's other values are unusual.
USUAL = 0.9
#: Days after which a proposed rule calls a verification stale.
MAX_AGE = 180
_NAMES = ("person_name", "org_name", "first_name", "last_name")
_TYPES = {"codeid": "license", "first_name": "text", "last_name": "text", "code": "text"}


def field_names(headers: list[str]) -> dict[str, str]:
    """heading -> field: its words joined by _, numbered from 2 where headings give the same."""
    out, seen = {}, {}
    for h in headers:
        base = "_".join(align.words(h)) or "column"
        seen[base] = seen.get(base, 0) + 1
        out[h] = base if seen[base] == 1 else f"{base}_{seen[base]}"
    return out


def name_of(profile: dict) -> dict[str, str] | None:
    """Which columns name a row's entity: one full name, or a first and a last one."""
    by = {}
    for c, p in profile["columns"].items():
        by.setdefault(p["type"], c)
    full = by.get("person_name") or by.get("org_name")
    if full:
        return {"full": full}
    return {"first": by["first_name"], "last": by["last_name"]} if "first_name" in by and "last_name" in by else None


def shared_values(files: dict[str, DataFrame], profiles: dict[str, dict]) -> dict[tuple[str, str], list[dict]]:
    """(file, other file) -> pairs of their columns (column_a, column_b, share) with values in common; one job for all files."""
    skip = {*_NAMES, "number", "text"}
    typed = {f: (t, {c: p["type"] for c, p in profiles[f]["columns"].items() if p["type"] not in skip}) for f, t in files.items()}
    out: dict[tuple[str, str], list[dict]] = {}
    for r in infer.column_index(typed).collect() if typed else []:  # one row a pair of columns
        out.setdefault((r["file_a"], r["file_b"]), []).append(r.asDict())
    return out


def key_links(shared: dict[tuple[str, str], list[dict]], profiles: dict[str, dict]) -> dict[tuple[str, str], list[tuple[str, str, float]]]:
    """(file with keys, other file) -> (key, other's column, share of the other's values that are keys)."""
    out = {}
    for (f, g), pairs in shared.items():
        own, other = profiles[f]["keys"], profiles[g]["columns"]
        found = infer.links([r for r in pairs if r["column_a"] in own and other[r["column_b"]]["type"] in infer.KEYS], KEY_SHARE)
        if found:
            out[f, g] = found
    return out


def choose_master(profiles: dict[str, dict], linked: dict) -> str:
    """The file with keys, names and one row an entity that most files link to; the first by name of equal ones."""

    def points(f: str) -> float:
        p = profiles[f]
        hint = bool(MASTER & set(align.words(re.sub(r"\.\w+$", "", f))))
        return 3 * bool(p["keys"]) + 2 * (name_of(p) is not None) + 2 * (p["kind"] == "profile") + sum(x == f for x, _ in linked) + 2 * hint + len(p["columns"]) / 100

    return max(sorted(profiles), key=points)


def shared_names(a: DataFrame, b: DataFrame, pa: dict, pb: dict) -> float:
    """Share of b's distinct names that a has, alike spellings included; 0 where either file has no names."""
    if not name_of(pa) or not name_of(pb):
        return 0.0
    made = []
    for t, p in ((a, pa), (b, pb)):
        fields = field_names(t.columns)
        spec = {"name": {k: fields[c] for k, c in name_of(p).items()}, "fields": {fields[c]: {"type": x["type"]} for c, x in p["columns"].items()}}
        renamed = t.toDF(*fields.values())
        made.append(renamed.select(record_name(renamed.columns, spec).alias("name")))
    return align.name_overlap(*made).first()["share"] or 0.0


def code_values(table: DataFrame, profile: dict) -> dict[str, dict[str, int]]:
    """Spellings of each code column with their counts; columns with more than VOCABULARY of them are left out."""
    columns = [c for c, p in profile["columns"].items() if p["type"] == "code" and p["n_distinct"] <= VOCABULARY]
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    if columns:
        pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in columns))
        seen = table.select(F.explode(pairs).alias("x")).select("x.*").filter(~normalize.is_empty(F.col("v"))).groupBy("c", "v").count()
        for r in seen.collect():  # at most VOCABULARY rows a column
            out[r["c"]][r["v"]] = r["count"]
    return out


def attribute_pairs(shared: list[dict], pa: dict, pb: dict, va: dict, vb: dict) -> list[tuple[str, str, float]]:
    """(a's column, b's column, score) of columns that hold the same attribute, each column once.

    The score is the share of b's values that a has (shared_values), for codes other spellings of them included,
    and HEADING times how alike the headings are.
    """
    share = {(r["column_a"], r["column_b"]): r["share"] for r in shared if not {pa["columns"][r["column_a"]]["type"], pb["columns"][r["column_b"]]["type"]} & set(infer.KEYS)}
    for x, xs in va.items():
        for y, ys in vb.items():
            if xs and ys:
                share[x, y] = sum(v in xs or align.alias_match(v, xs) is not None for v in ys) / len(ys)
    scored = [{"column_a": x, "column_b": y, "share": s + HEADING * align.header_similarity(x, y)} for (x, y), s in share.items()]
    return infer.links(scored, SAME_ATTRIBUTE)


def _flagged(profile: dict, flag: str) -> list[str]:
    return [c for c, p in profile["columns"].items() if flag in p["flags"]]


def _plain_dates(profile: dict) -> list[str]:
    return [c for c, p in profile["columns"].items() if p["type"] == "date" and not {"expiry", "verified"} & set(p["flags"])]


def _rules(profiles: dict, master: str, linked: set[str], attributes: dict, usual: dict[str, str], shared_keys: list[str]) -> list[dict]:
    fields = {f: field_names(list(p["columns"])) for f, p in profiles.items()}
    flags = lambda a: {x for f, c in attributes[a]["from"].items() for x in profiles[f]["columns"][c]["flags"]}
    activity = {f: p for f, p in profiles.items() if f in linked and p["kind"] == "activity" and _plain_dates(p)}
    out: list[dict] = [{"type": "presence", "expect": {f: {} for f in sorted(linked) if profiles[f]["kind"] == "profile"}}]
    for a in attributes:
        if "expiry" in flags(a):
            out.append({"type": "expiration", "attribute": a})
            if activity:
                out.append({"type": "activity_after_expiry", "attribute": a, "activity": {f: {"date": fields[f][(_flagged(p, "end") or _plain_dates(p))[0]]} for f, p in activity.items()}})
        if "verified" in flags(a):
            out.append({"type": "staleness", "attribute": a, "max_age_days": MAX_AGE})
        if a in usual:
            out.append({"type": "unusual_value", "attribute": a, "expected": [usual[a]]})
    same = shared_keys + [a for a, s in attributes.items() if profiles[master]["columns"].get(s["from"].get(master), {}).get("type") in ("phone", "email")]
    if same:
        out.append({"type": "duplicate_entity", "match_on": same})
    for f, p in profiles.items():
        start, end = _flagged(p, "start"), _flagged(p, "end")
        if start and end and start[0] != end[0]:
            out.append({"type": "date_order", "source": f, "start": fields[f][start[0]], "end": fields[f][end[0]]})
            for g, q in activity.items():
                for flag in ("hours", "money"):
                    if f in activity and g != f and _flagged(p, flag) and _flagged(q, flag) and not (_flagged(q, "start") and _flagged(q, "end")):
                        a = {"source": f, "measure": fields[f][_flagged(p, flag)[0]], "start": fields[f][start[0]], "end": fields[f][end[0]]}
                        b = {"source": g, "measure": fields[g][_flagged(q, flag)[0]], "date": fields[g][_plain_dates(q)[0]]}
                        out.append({"type": "aggregate_compare", "a": a, "b": b, "label": f"{f} and {g}"})
    return [r for r in out if r.get("expect", True)]


def analyse(files: dict[str, DataFrame], master: str | None = None) -> dict:
    """What the files (name -> table of texts) propose: profiles, master, entity, links, attributes, vocabularies, rules.

    An attribute has the columns it comes from, by file, and its authorities in order: the master, or
    before it a file of one row an entity that holds the expiry or verification dates. Files linked
    by neither keys nor names have no attributes. An empty file has a profile and nothing else.
    """
    profiles = {f: infer.profile_file(t) for f, t in files.items()}
    shared = shared_values(files, profiles)
    linked = key_links(shared, profiles)
    master = master or choose_master(profiles, linked)
    others = [f for f in files if f != master]
    keys = {g: linked[master, g] for g in others if (master, g) in linked}
    met = {g: s for g in others if (s := shared_names(files[master], files[g], profiles[master], profiles[g])) >= NAME_SHARE}
    joined = {g for g in others if g in keys or g in met}
    spelt = {f: code_values(t, profiles[f]) for f, t in files.items() if f == master or f in joined}
    attributes: dict[str, dict] = {}
    fields = field_names(list(profiles[master]["columns"]))
    for c, p in profiles[master]["columns"].items():
        if p["type"] not in ("text", "number", *_NAMES) and c != (profiles[master]["keys"] or [None])[0]:
            attributes[fields[c]] = {"from": {master: c}, "authority": [master]}
    for g in sorted(joined):
        p = profiles[g]
        pairs = {b: fields[a] for a, b, _ in attribute_pairs(shared.get((master, g), []), profiles[master], p, spelt[master], spelt[g])}
        pairs |= {b: fields[a] for a, b, _ in keys.get(g, []) if fields[a] in attributes}
        for c, x in p["columns"].items():
            dated = p["kind"] == "profile" and {"expiry", "verified"} & set(x["flags"])
            name = pairs.get(c) or (f"{g}_{field_names(list(p['columns']))[c]}" if dated else None)
            if name:
                own = attributes.setdefault(name, {"from": {}, "authority": []})
                own["from"][g] = c
                own["authority"] = [g, *own["authority"]] if dated else [*own["authority"], g]
    vocabularies, usual = {}, {}
    for a, own in attributes.items():
        values = {v: n for f, c in own["from"].items() for v, n in spelt.get(f, {}).get(c, {}).items()}
        if values:
            vocabularies[a] = align.clusters(values)
        count = spelt[master].get(own["from"].get(master), {})
        total = {k: sum(count.get(v, 0) for v in [k, *more]) for k, more in vocabularies.get(a, {}).items()}
        top = max(total, key=lambda k: (total[k], k), default=None)
        if top is not None and len(total) > 1 and total[top] >= USUAL * sum(total.values()):
            usual[a] = top
    shared_keys = [fields[c] for c in profiles[master]["keys"][1:]]
    rules = _rules(profiles, master, joined, attributes, usual, shared_keys)
    entity = align.entity_word(profiles[master]["keys"] + list(profiles[master]["columns"]), master)
    return {"profiles": profiles, "master": master, "entity": entity, "links": keys, "names": met, "attributes": attributes, "vocabularies": vocabularies, "rules": rules}


def build_config(found: dict) -> dict:
    """The engine's configuration for what analyse() proposes (or someone changed in it).

    Fields are named by field_names; rename a file's columns by it (see prepare). The master
    needs a key: without one ValueError is raised.
    """
    profiles, master = found["profiles"], found["master"]
    if not profiles[master]["keys"]:
        raise ValueError(f"no column of {master} tells its rows apart")
    names = {f: field_names(list(p["columns"])) for f, p in profiles.items()}
    ref = {(f, c): a for a, own in found["attributes"].items() for f, c in own["from"].items() if a in found["vocabularies"]}
    # both ends of a link are normalised alike
    licence = {x for g, pairs in found["links"].items() for a, b, _ in pairs if "codeid" in (profiles[master]["columns"][a]["type"], profiles[g]["columns"][b]["type"]) for x in ((master, a), (g, b))}
    key = profiles[master]["keys"][0]
    sources = {}
    for f, p in profiles.items():
        fields = {}
        for c, x in p["columns"].items():
            kind = "license" if (f, c) in licence else "code" if (f, c) in ref else _TYPES.get(x["type"], x["type"])
            fields[names[f][c]] = {"type": kind, "header": c} | ({"ref": ref[f, c]} if kind == "code" else {}) | ({"required": True} if (f, c) == (master, key) else {})
        own = {"label": " ".join(align.words(re.sub(r"\.\w+$", "", f))).capitalize() or f, "kind": p["kind"], "fields": fields}
        if name_of(p):
            own["name"] = {k: names[f][c] for k, c in name_of(p).items()}
        if p["keys"]:
            own["record_key"] = names[f][p["keys"][0]]
        if f != master:
            keys = [{"field": names[f][b], "entity_attribute": "__key__" if a == key else names[master][a]} for a, b, _ in found["links"].get(f, []) if a == key or names[master][a] in found["attributes"]]
            by_name = name_of(p) is not None and name_of(profiles[master]) is not None
            own["match"] = ({"by": "key", "keys": keys} | ({"fallback": "name"} if by_name else {})) if keys else {"by": "name"} if by_name else {}
        if p["kind"] == "activity" and name_of(p):
            checked = [*name_of(p).values(), *(c for c, x in p["columns"].items() if x["type"] in ("date", "number"))]
            own["duplicate_check"] = [names[f][c] for c in checked]
        sources[f] = own
    attributes = {a: {"from": {f: names[f][c] for f, c in own["from"].items()}, "authority": own["authority"]} for a, own in found["attributes"].items()}
    label = found["entity"]
    severity = {f: "critical" if profiles[f]["kind"] == "activity" else "warning" for f in profiles if f != master}
    return {"entity": {"anchor_source": master, "key_field": names[master][key], "label": label, "orphan_severity": severity}, "reference": found["vocabularies"], "sources": sources, "attributes": attributes, "matching": {"auto_accept": 0.92, "review_floor": 0.75}, "rules": found["rules"]}


def prepare(table: DataFrame, source: str, row: F.Column | None = None) -> DataFrame:
    """table as the engine takes it: rec_id and one text column a field.

    row tells the table's rows apart (default: their place in it); rec_id is a hash of source and row.
    """
    fields = field_names(table.columns)
    at = F.monotonically_increasing_id() if row is None else row
    return table.select(F.xxhash64(F.lit(source), at).alias("rec_id"), *(F.col(f"`{c}`").cast("string").alias(n) for c, n in fields.items()))
