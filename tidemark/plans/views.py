"""Views that bind the operators to the given tables. Each is SQL that Spark and DuckDB read alike, so queries and their checks share inputs.

Times are epoch seconds (long). ``BASE`` is the first hour, ``NOW`` the clock of every registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = 1_700_000_000
NOW = BASE + 240 * 3600

#: Source categories with their default reliability.
CATEGORIES = (
    ("OFFICIAL_SOURCE", 0.95),
    ("EARLY_SIGNAL", 0.65),
    ("EXPERT_ANALYST", 0.75),
    ("JOURNALIST", 0.6),
    ("TECHNICAL_RESEARCHER", 0.8),
    ("AMPLIFIER", 0.3),
    ("COMMUNITY_SIGNAL", 0.45),
)
_CATEGORY = "case n % 7 " + " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(CATEGORIES)) + " end"
_RELIABILITY = "case n % 7 " + " ".join(f"when {i} then cast({r} as double)" for i, (_, r) in enumerate(CATEGORIES)) + " end"

VIEWS = {
    "v_sources": f"""
        select id, n, 'src ' || cast(n as string) as name, {_CATEGORY} as category, cast(1 + n % 4 as int) as priority, n % 7 = 0 as is_official,
            {_RELIABILITY} as reliability, cast(case n % 4 when 0 then 300 when 1 then 900 when 2 then 3600 else 21600 end as int) as poll_interval_sec,
            case when n % 6 = 5 then null else {BASE} + n * 36000 end as last_success_at, {BASE} + n * 40000 as last_checked_at, cast({BASE} as bigint) as created_at,
            case when n % 9 = 8 then cast({NOW} + 600 as bigint) end as circuit_open_until, n % 11 <> 10 as active
        from (select source as id, cast(coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), ''), '0') as bigint) as n from documents group by source)""",
    "v_items": f"""
        select doc_id as id, source as source_id, cast(doc_id as string) as external_id, substr(text, 1, 80) as title, text as body,
            'https://www' || cast(length(coalesce(source, '')) % 2 as string) || '.example.com/' || md5(substr(text, 1, 64)) as url, md5(text) as content_hash,
            case when doc_id % 10 = 0 then null else {BASE} + (doc_id % 240) * 3600 end as published_at,
            {BASE} + (doc_id % 240) * 3600 + (doc_id % 9) * 3600 as fetched_at
        from documents where text is not null""",
    "v_evidence": """
        select h.event_id, i.id as item_id, i.source_id, coalesce(i.published_at, i.fetched_at) as attached_at, i.content_hash from v_items i
        join (select content_hash, min(id) as event_id from v_items group by content_hash) h on h.content_hash = i.content_hash""",
    "v_events": f"""
        select e.event_id, min(i.title) as title, min(i.body) as summary, min(coalesce(i.published_at, i.fetched_at)) as occurred_at,
            min(case when i.published_at is null then 1 else 0 end) = 1 as occurred_estimated, min(i.fetched_at) as first_seen_at,
            case e.event_id % 5 when 0 then 'ai' when 1 then 'software' when 2 then 'hardware' when 3 then 'policy_platform' else 'social_trend' end as category
        from v_evidence e join v_items i on i.id = e.item_id group by e.event_id""",
    "v_scores": """
        select event_id as id, user_id as event_id, cast(floor(value) as bigint) % 101 as combined, event_type in ('click', 'purchase') as gate_passed,
            case when event_type in ('click', 'purchase') then null else event_type end as killed_by, cast(event_id % 100 as bigint) as importance,
            cast((event_id * 7) % 100 as bigint) as relevance from events""",
    "v_fetch_log": f"""
        select event_id as id, user_id as source_id, {BASE} + event_id * 60 as started_at,
            case event_type when 'error' then 'timeout' when 'view' then 'not_modified' else 'ok' end as outcome,
            cast(event_id % 7 as bigint) as items_found, cast(event_id % 3 as bigint) as items_new, cast(event_id % 1000 as bigint) as bytes,
            event_type = 'view' as not_modified, case when event_type = 'error' then 'timed out' end as error, 'etag' || cast(event_id % 50 as string) as etag from events""",
    "v_observations": f"""
        select user_id % 20 as trend_id, {BASE} + (event_id // 500) * 86400 as observed_at, count(*) as mention_count, count(distinct user_id) as distinct_sources
        from events group by user_id % 20, event_id // 500""",
    "v_ledger": f"""
        select event_id as id, event_type as stage, case user_id % 3 when 0 then 'alpha' when 1 then 'alpha-2-20250101' else 'beta' end as model,
            case user_id % 2 when 0 then 'p0' else 'p1' end as provider, cast(round(abs(value) * 1000) as bigint) as cost_micro, cast(event_id % 4000 as bigint) as input_tokens,
            cast(event_id % 900 as bigint) as output_tokens, cast(event_id % 5 as bigint) * 100 as cache_read_tokens, cast(event_id % 3 as bigint) * 50 as cache_write_tokens,
            {BASE} + event_id * 60 as spent_at from events""",
    "v_analyses": f"""
        select event_id as id, user_id as event_id, event_type as stage, case event_id % 5 when 0 then 'skipped' when 1 then 'error' else 'ok' end as status,
            case when event_id % 5 = 0 then 'below_threshold' when event_id % 5 = 1 then 'api_error' end as skip_code, 'alpha' as model,
            cast(event_id % 1000 as bigint) as cost_micro, cast(event_id % 2 as bigint) * 100 as cache_read_tokens, 'v' || cast(event_id % 3 as string) as prompt_version,
            {BASE} + event_id * 60 as created_at, props as payload from events""",
    "v_alerts": """
        select event_id as seq, case event_type when 'purchase' then 'urgent' when 'click' then 'high' else 'low' end as tier, 'k' || cast(user_id as string) as dedupe_key, event_id % 1440 as minute
        from events""",
    "v_labels": """
        select l.doc_id, l.quality, l.toxic, d.source, d.text from labels l join documents d on d.doc_id = l.doc_id""",
}
NEEDS = {
    "v_evidence": ("v_items",),
    "v_events": ("v_evidence", "v_items"),
}


def _spark_sql(sql: str) -> str:
    return sql.replace("event_id // 500", "(event_id div 500)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spark_sql(VIEWS[name])
    used = [t for t in ("documents", "events", "labels", *NEEDS.get(name, ())) if f" {t} " in f"{sql} ".replace("\n", " ").replace(")", " ")]
    for t in used:
        for before in ("from ", "join "):
            sql = sql.replace(f"{before}{t} ", f"{before}{{{t}}} ").replace(f"{before}{t})", f"{before}{{{t}}})")
        if sql.endswith(f"from {t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front, for DuckDB."""
    found: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, ()):
            need(x)
        if name not in found:
            found.append(name)

    for name in VIEWS:
        if name in sql:
            need(name)
    if not found:
        return sql
    front = "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in found)
    return f"{front}, {sql.removeprefix('with ')}" if sql.startswith("with ") else f"{front} {sql}"
