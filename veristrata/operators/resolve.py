"""Entity resolution: anchors, links by key and by name, link decisions, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions.names import score_pairs


def anchors(records: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """One entity per key: (entity_key, name, n_records), the name of the first record."""
    return records.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("entity_key")).agg(F.min_by(name, order).alias("name"), F.count(F.lit(1)).alias("n_records"))


def duplicate_keys(records: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with n; rows with a null in the key don't count."""
    return records.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _by_name(records: DataFrame, entities: DataFrame, nicknames: dict[str, list[int]] | None) -> DataFrame:
    """records (rec_id, _v, _a), entities (_v, entity_key, _b) -> (rec_id, entity_key): of the entities that share _v the one with the most similar name, then the smallest.

    A record without a name gets the smallest. Distinct names of a value are scored, not rows.
    """
    heads = entities.groupBy("_v").agg(F.min("entity_key").alias("entity_key"), F.max("entity_key").alias("_last"))
    shared = heads.filter("entity_key <> _last").select("_v")
    named = records.filter("_a IS NOT NULL")
    x = named.select("_v", "_a").join(shared, "_v", "left_semi").distinct()
    y = entities.join(shared, "_v", "left_semi").groupBy("_v", "_b").agg(F.min("entity_key").alias("entity_key"))
    meet = x.join(y, "_v")
    scores = score_pairs(meet.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("b IS NOT NULL").distinct(), nicknames=nicknames).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "score")
    rank = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "entity_key")
    best = meet.join(scores, ["_a", "_b"], "left").groupBy("_v", "_a").agg(F.min(rank)["entity_key"].alias("_best"))
    return records.join(heads, "_v").join(best, ["_v", "_a"], "left").select("rec_id", F.coalesce("_best", "entity_key").alias("entity_key"))


def link_by_keys(records: DataFrame, rec_id: str, entities: DataFrame, keys: list[tuple[str, str]], names: tuple[str, str] | None = None, nicknames: dict[str, list[int]] | None = None) -> DataFrame:
    """(rec_id, entity_key, method): the first key (record column, entity column) with a hit links.

    names are the columns of the name structs (of records, of entities): of several entities with the
    key's value the one with the most similar name links, ties go to the smallest, as without names.
    One equi join per key; the priority is settled by one pre-aggregated minimum.
    """
    hits = None
    for i, (r, e) in enumerate(keys):
        x, y = records.select(F.col(rec_id).alias("rec_id"), F.col(r).alias("_v"), *([F.col(names[0]).alias("_a")] if names else [])), entities.select(F.col(e).alias("_v"), "entity_key", *([F.col(names[1]).alias("_b")] if names else []))
        k = _by_name(x, y, nicknames) if names else x.join(y, "_v")
        k = k.select("rec_id", F.struct(F.lit(i).alias("p"), "entity_key").alias("h"))
        hits = k if hits is None else hits.unionByName(k)
    best = hits.groupBy("rec_id").agg(F.min("h").alias("h"))
    method = F.element_at(F.array(*(F.lit(r) for r, _ in keys)), F.col("h.p") + 1)
    return best.select("rec_id", F.col("h.entity_key").alias("entity_key"), method.alias("method"))


def decide(candidates: DataFrame, rec: str, score: Column, entity: str, auto: float = 0.92, floor: float = 0.75, gap: float = 0.03) -> DataFrame:
    """(rec, entity, score, decision) of the best candidate: auto, review or none.

    Scores rank as they are and count as 1 at most. Two candidates at or above auto within the gap are left for review.
    """
    w = Window.partitionBy(rec).orderBy(F.desc("score"), entity)
    ranked = candidates.withColumn("score", score).select(rec, entity, "score", F.row_number().over(w).alias("r"), F.lead("score").over(w).alias("second")).filter("r = 1")
    ranked = ranked.withColumns({c: F.when(F.col(c) > 1.0, F.lit(1.0)).otherwise(F.col(c)) for c in ("score", "second")})
    close = (F.col("second") >= auto) & (F.col("score") - F.col("second") < gap)
    decision = F.when((F.col("score") >= auto) & ~F.coalesce(close, F.lit(False)), "auto").when(F.col("score") >= floor, "review").otherwise("none")
    return ranked.select(rec, entity, "score", decision.alias("decision"))


def orphans(records: DataFrame, links: DataFrame, rec_id: str) -> DataFrame:
    """Records without a link."""
    return records.join(links.select(F.col("rec_id").alias(rec_id)), rec_id, "left_anti")


def reconcile(evidence: DataFrame, entities: DataFrame, authority: list[str]) -> DataFrame:
    """evidence (entity_key, source, rec_ord, value) -> entity_key, value, status, n_sources, n_values.

    The value is the first one of the most authoritative source that has any; without such a
    source the commonest, then the lowest. MISSING entities have no evidence.
    """
    order = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(authority)), F.lit(len(authority)))
    seen = evidence.filter("value IS NOT NULL AND value <> ''").groupBy("entity_key", "value", "source").agg(F.min("rec_ord").alias("first"), F.count(F.lit(1)).alias("n"))
    by = seen.groupBy("entity_key", "value").agg(F.min(F.struct(order.alias("a"), F.col("first"))).alias("best"), F.sum("n").alias("n"), F.collect_set("source").alias("sources"))
    ranked = F.when(F.col("best.a") < len(authority), F.struct(F.col("best.a").alias("a"), F.col("best.first").alias("f"), "value")).otherwise(F.struct(F.lit(len(authority)).alias("a"), (-F.col("n")).cast("bigint").alias("f"), F.col("value")))
    one = by.groupBy("entity_key").agg(F.min(ranked).alias("b"), F.count(F.lit(1)).alias("n_values"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("long").alias("n_sources"))
    status = F.when(F.col("n_values").isNull(), "MISSING").when(F.col("n_values") > 1, "CONFLICT").when(F.col("n_sources") > 1, "CONFIRMED").otherwise("SINGLE_SOURCE")
    j = entities.select("entity_key").join(one, "entity_key", "left")
    return j.select("entity_key", F.col("b.value").alias("value"), status.alias("status"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_values", F.lit(0)).alias("n_values"))


def review_groups(pairs: DataFrame, name_key: str, candidate: str, order: str, most: int = 6) -> DataFrame:
    """(name_key, candidate, n, evidence): records that await one decision, with the first `most` of them.

    The first records are ranked in salted parts before they meet, so that no task sorts a whole group.
    """
    by = [name_key, candidate]
    salted = pairs.select(*by, order, F.pmod(F.xxhash64(order), F.lit(64)).alias("_p"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(order))).filter(F.col("_r") <= most)
    first = ranked.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("evidence"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(first, by)
