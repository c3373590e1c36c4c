"""Join shapes: exact keys, intervals, longest prefix, anti and semi joins, set operations, idempotent appends and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3600


def exact_matches(items: DataFrame) -> DataFrame:
    """Stage 1: pairs (a < b) with an equal canonical URL or content hash, without a time window. Two hash joins, never an OR predicate.

    Each item is paired with the first item of its key, which keeps a key's pairs linear in its size; closing the pairs transitively
    gives the same groups as all pairs."""
    def star(key: str) -> DataFrame:
        first = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("a"))
        return items.join(first, key).where("id <> a").select("a", F.col("id").alias("b"))

    return star("url").unionByName(star("content_hash")).distinct()


def artifact_matches(items: DataFrame, hours: int = 48, require_artifact: bool = True) -> DataFrame:
    """Stage 2: pairs (a < b, once each) with a shared entity, and a shared identity key unless that isn't required, whose times differ by ``hours`` at most;
    ``items(id, keys, entities, at)`` with distinct ids. An interval join: each item meets its own time bucket and the next ones. Rows are joined by all that a
    pair must share, and a pair is handed on by the least of what it shares only, so that no other pairs are made and none are told apart afterwards."""
    bucket = F.floor(F.col("at") / (hours * HOUR))
    shared = ["keys", "entities"] if require_artifact else ["entities"]
    rows = items.select("id", "at", bucket.alias("bucket"), *(F.array_distinct(F.array_compact(c)).alias(c) for c in shared))
    for c in shared:
        rows = rows.withColumn(f"one_{c}", F.explode(c))
    mine = lambda side: [F.col(c).alias(f"{c}_{side}") for c in shared]
    on = [f"one_{c}" for c in shared]
    left = rows.select(F.col("id").alias("a"), F.col("at").alias("at_a"), "bucket", *on, *mine("a"))
    right = rows.select(F.col("id").alias("b"), F.col("at").alias("at_b"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), *on, *mine("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= hours * HOUR)
    for c in shared:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        near = near & ((F.size(x) == 1) | (F.size(y) == 1) | (F.col(f"one_{c}") == F.array_min(F.array_intersect(x, y))))
    return left.join(right, [*on, "bucket"]).where(near).select("a", "b")


def cluster_candidates(events: DataFrame, evidence: DataFrame, items: DataFrame, vectors: DataFrame, since: int) -> DataFrame:
    """Events since a time with their evidence's URL and hash sets, and their vector where there is one."""
    urls = evidence.join(items.select(F.col("id").alias("item_id"), "url"), "item_id").groupBy("event_id").agg(F.collect_set("url").alias("urls"), F.collect_set("content_hash").alias("hashes"))
    df = events.where(F.col("occurred_at") >= since).join(urls, "event_id")
    return df.join(vectors.select(F.col("vec_id").alias("event_id"), "embedding"), "event_id", "left")


def unclustered_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items without evidence: a left anti join."""
    return items.join(evidence.select(F.col("item_id").alias("id")), "id", "left_anti")


def awaiting_analysis(scores: DataFrame, analyses: DataFrame, stage: str, version: str) -> DataFrame:
    """Events whose latest score passed the gate and that have no verdict for the stage and prompt version."""
    from .history import latest

    done = analyses.where((F.col("stage") == stage) & (F.col("prompt_version") == version)).select("event_id")
    return latest(scores, "event_id").where("gate_passed").join(done, "event_id", "left_anti").select("event_id", "combined").orderBy(F.desc("combined"), "event_id")


def evidence_envelope(evidence: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with its item's and source's columns and its place in its event's time order."""
    df = evidence.select("event_id", "item_id", "source_id").join(items.select(F.col("id").alias("item_id"), "title", F.coalesce("published_at", "fetched_at").alias("at")), "item_id")
    df = df.join(sources.select(F.col("id").alias("source_id"), "category"), "source_id")
    return df.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy("at", "item_id")))


def scorable_events(events: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with a nested array of evidence, sorted; events without evidence have an empty one."""
    df = evidence.join(sources.select(F.col("id").alias("source_id"), F.col("category").alias("source_category"), "is_official", "reliability"), "source_id")
    nested = df.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.col("attached_at").alias("published_at"), "source_id", "source_category", "is_official", "reliability"))).alias("evidence"))
    empty = F.array().cast("array<struct<published_at:bigint,source_id:string,source_category:string,is_official:boolean,reliability:double>>")
    return events.join(nested, "event_id", "left").withColumn("evidence", F.coalesce("evidence", empty))


def entity_lookup(events: DataFrame, weights: DataFrame) -> DataFrame:
    """The heaviest entity of each event with its weight; ``events(event_id, entities)``, ``weights(entity, weight)``."""
    df = events.select("event_id", F.explode("entities").alias("entity")).join(weights, "entity")
    best = df.groupBy("event_id").agg(F.max(F.struct("weight", "entity")).alias("b"))
    return best.select("event_id", "b.entity", "b.weight")


def replay_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of ids only in a, only in b, in both, and their Jaccard agreement: one full outer join."""
    left, right = a.select("event_id").distinct().withColumn("in_a", F.lit(1)), b.select("event_id").distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, "event_id", "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    df = both.agg(n(F.col("in_b").isNull()).alias("only_a"), n(F.col("in_a").isNull()).alias("only_b"), n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"), F.count("*").alias("n"))
    return df.select("only_a", "only_b", "common", F.round(F.when(F.col("n") > 0, F.col("common") / F.col("n")).otherwise(1.0), 6).alias("agreement"))


def tier_one_arrivals(items: DataFrame, sources: DataFrame, since: int) -> DataFrame:
    first = sources.where("priority = 1").select(F.col("id").alias("source_id"))
    return items.where(F.col("fetched_at") > since).join(first, "source_id", "left_semi").agg(F.count("*").alias("n"))


def label_errors(assigned: DataFrame, wrong: str) -> DataFrame:
    """Pairs i < j that are wrongly ``merged`` or ``missed``; ``assigned(id, cluster, label)``. An equi-join on what the pair shares."""
    key, other = ("cluster", "label") if wrong == "merged" else ("label", "cluster")
    a, b = assigned.select(F.col("id").alias("a"), key, F.col(other).alias("oa")), assigned.select(F.col("id").alias("b"), key, F.col(other).alias("ob"))
    return a.join(b, key).where("a < b and oa <> ob").select("a", "b")


def append_new_items(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("source_id", "external_id"), first_by: str = "id") -> DataFrame:
    """Rows of ``batch`` that ``existing`` lacks, the first of each key; appending them twice adds nothing."""
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), first_by).alias("_r")).select(*keys, "_r.*")
    return first.join(existing.select(*keys), list(keys), "left_anti").select(*batch.columns)


def upsert_by_key(base: DataFrame, updates: DataFrame, key: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """Declared columns of ``updates`` win (a missing value keeps the old one), protected ones stay as they were."""
    declared = [c for c in updates.columns if c != key and c not in protected]
    new = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in declared))
    df = base.join(new, key, "full_outer")
    return df.select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if c in declared else F.col(c) for c in base.columns if c != key))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Normalised forms that more than one entity owns."""
    return aliases.groupBy("normalized").agg(F.countDistinct("entity_id").alias("owners")).where("owners > 1")


def items_with_source(items: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted items, in the caller's order (``ids(place, id)``), with their source's columns."""
    df = items.join(ids, "id").join(sources.select(F.col("id").alias("source_id"), "category", "priority"), "source_id")
    return df.select("place", "id", "source_id", "category", "priority").orderBy("place")


def reconcile_tables(expected: DataFrame, copy: DataFrame) -> DataFrame:
    """``(name, n)`` of both sides compared: missing, mismatched, empty."""
    df = expected.toDF("name", "expected").join(copy.toDF("name", "found"), "name", "left")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("expected"), "mismatch").when(F.col("found") == 0, "empty").otherwise("ok")
    return df.select("name", "expected", "found", fault.alias("status"))


def labelled_set(items: DataFrame, shortest: int = 12) -> DataFrame:
    """Weak labels: the same normalised title of at least ``shortest`` characters over two or more sources."""
    title = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    df = items.select("id", "source_id", title.alias("label")).where(F.length("label") >= shortest)
    shared = df.groupBy("label").agg(F.countDistinct("source_id").alias("sources")).where("sources >= 2")
    return df.join(shared, "label").select("id", "label")


#: Fixed value: tokens that name a version or a build.
VERSION_TOKEN = r"(?i)\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b|\bb[0-9]{4,}\b"


def version_labels(items: DataFrame, labelled: DataFrame) -> DataFrame:
    """Weak labels of what the titles left: an item whose title has exactly one distinct version token is an event of its own, the least id of each (source, version).
    Null titles and sources have none."""
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(F.col("title"), F.lit(VERSION_TOKEN), F.lit(0)), lambda x: F.lower(x)))
    df = items.join(labelled.select("id"), "id", "left_anti").select("id", "source_id", tokens.alias("t")).where("size(t) = 1 and source_id is not null")
    first = df.groupBy("source_id", F.get("t", F.lit(0)).alias("version")).agg(F.min("id").alias("id"))
    return first.select("id", F.concat_ws(":", F.lit("version"), "source_id", "version").alias("label"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and the union of two id sets."""
    return a.select("event_id").intersect(b.select("event_id")).agg(F.count("*").alias("common")).crossJoin(a.select("event_id").union(b.select("event_id")).distinct().agg(F.count("*").alias("total")))


def newly_surfaced(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of b that a lacks."""
    return b.select("event_id").distinct().exceptAll(a.select("event_id").distinct())


def union_alerts(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def array_unions(rows: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Per ``key`` the distinct elements of each array column, sorted. Elements are exploded and told apart by a hash aggregation before they gather, so a key
    collects each of its elements once however many rows hold it; a key whose arrays are all empty or null has empty ones."""
    out = rows.select(key).distinct()
    for c in arrays:
        each = rows.select(key, F.explode(c).alias("x")).where("x is not null").distinct()
        out = out.join(each.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias(c)), key, "left")
    return out.select(key, *(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in arrays))


def merge_members(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """What an event has gathered from its members: ``event_id, entities, keys, urls, hashes, occurred_at``, sorted arrays without repeats and the earliest
    time. ``evidence(event_id, item_id, attached_at)``, ``items(id, entities, keys, url, content_hash)``."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    rows = evidence.select("event_id", "item_id", "attached_at").join(items.select(F.col("id").alias("item_id"), "entities", "keys", one("url").alias("urls"), one("content_hash").alias("hashes")), "item_id")
    first = rows.groupBy("event_id").agg(F.min("attached_at").alias("occurred_at"))
    return array_unions(rows, "event_id", ["entities", "keys", "urls", "hashes"]).join(first, "event_id")


#: Authority of source categories.
AUTHORITY = {
    "OFFICIAL_SOURCE": 100,
    "TECHNICAL_RESEARCHER": 70,
    "EXPERT_ANALYST": 60,
    "EARLY_SIGNAL": 50,
    "JOURNALIST": 40,
    "COMMUNITY_SIGNAL": 20,
    "AMPLIFIER": 10,
}


def authority(category: Column) -> Column:
    out = F.lit(0)
    for name, value in AUTHORITY.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def select_primary(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The item of highest source authority of each event; ties: earliest attached, then lowest id."""
    df = evidence.join(sources.select(F.col("id").alias("source_id"), "category"), "source_id")
    best = df.groupBy("event_id").agg(F.min(F.struct((-authority(F.col("category"))).alias("rank"), "attached_at", "item_id"))["item_id"].alias("primary_item"))
    return best


def evidence_roles(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """primary, reaction (community, amplifier) or corroborating, for each evidence row."""
    primary = select_primary(evidence, sources)
    df = evidence.join(sources.select(F.col("id").alias("source_id"), "category"), "source_id").join(primary, "event_id")
    role = F.when(F.col("item_id") == F.col("primary_item"), "primary").when(F.col("category").isin("COMMUNITY_SIGNAL", "AMPLIFIER"), "reaction").otherwise("corroborating")
    return df.select("event_id", "item_id", role.alias("role"))


def operator_unmerged(audit: DataFrame) -> DataFrame:
    """Items that an operator pulled apart, which clustering leaves alone."""
    return audit.where("actor = 'operator' and action in ('unmerge', 'split')").select("item_id").distinct()
