"""Registered queries of clustering, vectors, and the streaming jobs' batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import clustering as C
from .operators import joins as J
from .plans.views import BASE
from .queries import query
from .streaming import streams as T

VECTOR_AT = f"{BASE} + vec_id * 600"
#: The ten thresholds of the sweep, and three that pairs of the given tables reach.
THRESHOLDS = [0.3, 0.35, 0.4, *C.SWEEP]
_THRESHOLD_SQL = ", ".join(f"({t}::double)" for t in THRESHOLDS)


def vector_items(v) -> DataFrame:
    return v("embeddings").select(F.col("vec_id").alias("id"), F.expr(VECTOR_AT).alias("at"), "embedding", (F.col("vec_id") % 3).cast("string").alias("category"))


def story_items(v) -> DataFrame:
    """Items of documents with hashed vectors of their first 680 characters (the reference's cut). Those whose text begins with a letter up to M have the first
    three letters as an identity key, the others none."""
    key = F.when(F.col("title").rlike("^[A-M]"), F.array(F.concat(F.lit("model:"), F.lower(F.substring("title", 1, 3))))).otherwise(F.array().cast("array<string>"))
    df = v("v_items").select("id", "url", "content_hash", key.alias("keys"), F.array("source_id").alias("entities"), F.lit("ai").alias("category"), F.coalesce("published_at", "fetched_at").alias("at"), "source_id", F.substring("body", 1, 680).alias("head"))
    return C.hash_embed(df, "head").drop("head")


@query(
    "j3_similar_pairs",
    f"""with e as (select vec_id, {VECTOR_AT} as at, embedding::double[] as v from embeddings)
    select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from e a join e b on a.vec_id < b.vec_id and abs(a.at - b.at) <= 172800 and list_cosine_similarity(a.v, b.v) >= 0.3""",
)
def _(v):
    df = C.similar_pairs(vector_items(v), 0.3)
    return df.select("a", "b", F.round("similarity", 6).alias("similarity"))


#: The probability with which a pair of document vectors at the threshold itself is found; nearer ones are found with more.
RECALL = 0.95


@query("j3_similar_pairs_whole")
def _(v):
    """Pairs of document vectors at the clustering's own threshold, by shared cells."""
    return C.similar_pairs(story_items(v), recall=RECALL)


@query("n17_hash_embed")
def _(v):
    df = story_items(v)
    return df.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"))


@query("c1_cluster_items")
def _(v):
    """All stages, with operator-unmerged items (every 97th) left alone."""
    audit = v("v_items").select(F.col("id").alias("item_id"), F.lit("operator").alias("actor"), F.when(F.col("id") % 97 == 5, "unmerge").otherwise("merge").alias("action"))
    return C.cluster_items(story_items(v), recall=RECALL, excluded=J.operator_unmerged(audit)).withColumn("similarity", F.round("similarity", 6))


@query(
    "c1_edges",
    """select id, min(head) as head from (with recursive s as (select id, min(id) over (partition by content_hash) as a from v_items union all select id, min(id) over (partition by url) from v_items),
    f as (select id, min(a) as a from s where a < id group by id), r(id, head) as (select id, a from f union select r.id, f.a from r join f on f.id = r.head) select * from r) q group by id""",
)
def _(v):
    return C.exact_heads(v("v_items"))


@query("c3_open_events")
def _(v):
    items = story_items(v)
    return C.open_events(C.cluster_items(items, recall=RECALL), items).select("event_id", "category", "occurred_at")


@query("c3_attach_evidence")
def _(v):
    items = story_items(v)
    return C.attach_evidence(C.cluster_items(items, recall=RECALL), items, v("v_sources")).select("event_id", "item_id", "role", "stage")


@query("c6_unmerge", """with n as (select *, count(*) over (partition by event_id) as n from v_evidence) select item_id, case when item_id % 5 = 0 and n > 1 then -item_id else event_id end as event_id from n""")
def _(v):
    ev = v("v_evidence")
    return C.unmerge(ev, ev.where("item_id % 5 = 0").select("item_id")).select("item_id", "event_id")


_SORTED = "array_to_string(list_sort(list(distinct {})), ',')"


@query(
    "c8_member_features",
    f"""select event_id, {_SORTED.format("i.source_id")} as entities, {_SORTED.format("lower(substr(i.title, 1, 3))")} as keys, {_SORTED.format("i.url")} as urls, {_SORTED.format("i.content_hash")} as hashes,
    min(attached_at) as occurred_at from v_evidence e join v_items i on i.id = e.item_id group by event_id""",
)
def _(v):
    items = v("v_items").select("id", F.array("source_id").alias("entities"), F.array(F.lower(F.substring("title", 1, 3))).alias("keys"), "url", "content_hash")
    df = J.merge_members(v("v_evidence"), items)
    return df.select("event_id", *(F.array_join(c, ",").alias(c) for c in ("entities", "keys", "urls", "hashes")), "occurred_at")


@query("a16_cluster_quality")
def _(v):
    clustered = C.cluster_items(story_items(v), recall=RECALL).select("id", F.col("event_id").alias("cluster"))
    return A.pairwise_quality(clustered.join(v("v_items").select("id", F.col("content_hash").alias("label")), "id"))


@query(
    "a17_threshold_sweep",
    f"""with e as (select vec_id, {VECTOR_AT} as at, embedding::double[] as v, label from embeddings),
    p as (select list_cosine_similarity(a.v, b.v) as s, a.label = b.label as same from e a join e b on a.vec_id < b.vec_id and abs(a.at - b.at) <= 172800)
    select t as threshold, count(*) filter (same) as tp, count(*) filter (not same) as fp from (values {_THRESHOLD_SQL}) x(t) left join p on s >= t group by t""",
)
def _(v):
    labels = v("embeddings").select(F.col("vec_id").alias("id"), "label")
    return C.threshold_sweep(vector_items(v), labels, THRESHOLDS)


@query("a17_threshold_sweep_whole")
def _(v):
    """The ten thresholds over document vectors, where texts of one beginning are the truth."""
    labels = v("v_items").select("id", F.col("url").alias("label"))
    return C.threshold_sweep(story_items(v), labels, list(C.SWEEP))


@query("t6_stream_spend", "select spent_at // 86400 * 86400 as day, provider, sum(cost_micro)::bigint as cost_micro from v_ledger group by all")
def _(v):
    return T.stream_spend(v("v_ledger").select(F.timestamp_seconds("spent_at").alias("ts"), "provider", "cost_micro"))


@query("t2_stream_exact_dedup", "select content_hash from v_items group by content_hash")
def _(v):
    return T.stream_exact_dedup(v("v_items")).select("content_hash")
