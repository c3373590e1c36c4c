"""Registered queries of the library's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as N
from .operators import aggregates as A
from .operators import clustering as C
from .operators import history as H
from .operators import joins as J
from .plans.views import BASE, NOW, view, with_views
from .sources import entities as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of a view reader ``v(name)``; ``sql`` is its check, with the views in front."""

    def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda view_name: view(spark, sf_dir, view_name))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return wrap


LATEST = "(select * from v_scores where id in (select max(id) from v_scores group by event_id))"


@query("w1_latest_scores", f"select event_id, id, combined, gate_passed from {LATEST} x where gate_passed order by combined desc, event_id limit 100")
def _(v):
    return H.latest_scores(v("v_scores"), 100, passed_only=True).select("event_id", "id", "combined", "gate_passed")


@query(
    "a8_gate_kill_rate",
    f"""select coalesce(rule, 'all') as rule, count(*) as n, sum(killed)::bigint as killed, round(sum(killed) / count(*), 6) as kill_rate from
    (select case when gate_passed then 'passed' else coalesce(killed_by, 'unknown') end as rule, case when gate_passed then 0 else 1 end as killed from {LATEST} x) group by rollup (rule)""",
)
def _(v):
    return H.gate_kill_rate(v("v_scores"))


@query(
    "a8_kill_rate_without_rule",
    f"""select count(*) as n, sum(killed)::bigint as killed, round(sum(killed) / count(*), 6) as kill_rate, count(*) filter (rule is distinct from 'view') as n_without, sum(killed) filter (rule is distinct from 'view')::bigint as killed_without,
    round(sum(killed) filter (rule is distinct from 'view') / count(*) filter (rule is distinct from 'view'), 6) as kill_rate_without
    from (select killed_by as rule, case when gate_passed then 0 else 1 end as killed from {LATEST} x) q""",
)
def _(v):
    """The views' rules are event types; 'view' stands for the rule that is left out."""
    return H.kill_rate_without(v("v_scores"), "view")


@query("w2_latest_analysis", """select event_id, id, stage, cast(json_extract_string(payload, '$.k') as bigint) as k from v_analyses
    where id in (select max(id) from v_analyses where status = 'ok' group by event_id)""")
def _(v):
    return H.latest_analysis(v("v_analyses"))


@query(
    "w3_velocity",
    """select event_id, sum(case when attached_at - first_at <= 21600 then 1 else 0 end)::bigint - 1 as followers, count(distinct case when category = 'COMMUNITY_SIGNAL' then source_id end) as community,
    cast(round((0.45 * least(1.0, (sum(case when attached_at - first_at <= 21600 then 1 else 0 end) - 1) / 5) + 0.35 * (case when count(distinct case when category = 'COMMUNITY_SIGNAL' then source_id end) > 0 then 1 else 0 end)
      + 0.2 * least(1.0, count(distinct case when category = 'COMMUNITY_SIGNAL' then source_id end) / 3)) * 100) as bigint) as velocity
    from (select e.*, s.category, min(attached_at) over (partition by event_id) as first_at from v_evidence e join v_sources s on s.id = e.source_id) group by event_id""",
)
def _(v):
    return H.velocity(v("v_evidence"), v("v_sources"))


LIFECYCLE = f"""o as (select *, row_number() over (partition by trend_id order by observed_at) as rn, count(*) over (partition by trend_id) as n from v_observations),
    g as (select trend_id, max(n) as n, min(observed_at) as first_at, max(observed_at) as last_at, coalesce(avg(mention_count) filter (rn <= n // 2), 0) as early, coalesce(avg(mention_count) filter (rn > n // 2), 0) as late,
      coalesce(avg(mention_count) filter (rn > n - 2), 0) as tail, coalesce(avg(mention_count) filter (rn > n - 4 and rn <= n - 2), avg(mention_count) filter (rn <= n // 2), 0) as before,
      max(distinct_sources) as breadth, coalesce(avg(distinct_sources) filter (rn > n // 2), 0) as lb from o group by trend_id),
    h as (select *, case when early = 0 then case when late > 0 then 1 else 0 end else (late - early) / early end as gr, case when before = 0 then case when tail > 0 then 1 else 0 end else (tail - before) / before end as mo,
      least(1.0::double, least(1.0::double, breadth / 8) * 0.6::double + (case when breadth = 0 then 0 else greatest(0.0::double, (breadth - lb) / breadth) end) * 0.4::double) as sa from g),
    l as (select trend_id, n, first_at, last_at, breadth, round(gr, 6) as growth, round(mo, 6) as momentum, round(sa, 6) as saturation, case when ({NOW} - last_at) / 86400 > 14 then 'DECLINING' when n < 3 then 'UNKNOWN'
      when sa >= 0.7 and mo <= 0.1 then 'SATURATED' when breadth >= 5 then 'MAINSTREAM' when gr >= 0.5 then 'ACCELERATING' when gr >= 0 then 'EMERGING' else 'DECLINING' end as stage from h),
    lifecycle as (select *, case stage when 'EMERGING' then 'ACT' when 'ACCELERATING' then 'DIFFERENTIATE' when 'MAINSTREAM' then 'ONLY_IF_UNIQUE' else 'IGNORE' end as decision from l)"""


@query("w4_trend_lifecycle", f"with {LIFECYCLE} select * from lifecycle")
def _(v):
    return H.trend_lifecycle(v("v_observations"), NOW)


@query(
    "w5_breaker_state",
    """select id, source_id, failures::bigint as failures, case when failures >= 3 then started_at + least(21600, 1800 * power(2, least(failures - 3, 10)))::bigint end as open_until from
    (select *, sum(case when outcome = 'timeout' then 1 else 0 end) over (partition by source_id, run order by id) as failures from
      (select *, sum(case when outcome = 'timeout' then 0 else 1 end) over (partition by source_id order by id) as run from v_fetch_log))""",
)
def _(v):
    return H.breaker_state(v("v_fetch_log"))


@query(
    "w6_plan_alerts",
    """with a as (select *, dedupe_key in ('k1', 'k2', 'k3') as was_sent, (minute // 60 >= 23 or minute // 60 < 7) and tier <> 'urgent' as asleep from v_alerts),
    b as (select *, tier in ('urgent', 'high') and not was_sent and not asleep as alive from a),
    f as (select dedupe_key, min(seq) as s from b where alive group by dedupe_key order by s limit 4)
    select b.seq, tier, b.dedupe_key, case when tier = 'low' then 'below_tier' when was_sent or f.s < b.seq then 'duplicate' when asleep then 'quiet_hours' when f.s = b.seq and alive then 'sent' else 'daily_cap' end as decision
    from b left join f on f.dedupe_key = b.dedupe_key""",
)
def _(v):
    alerts = v("v_alerts")
    return H.plan_alerts(alerts, alerts.where("dedupe_key in ('k1', 'k2', 'k3')"))


@query(
    "w6_plan_alerts_by_day",
    """select seq, day, tier, dedupe_key, decision from (with recursive a as (select *, seq // 1440 as day, (minute // 60 >= 23 or minute // 60 < 7) and tier <> 'urgent' as asleep from v_alerts),
    g as (select dedupe_key, day from a where seq % 500 = 0), b as (select *, dedupe_key in (select dedupe_key from g) as was_sent from a),
    l as (select day, dedupe_key, min(seq) as f from b where tier in ('urgent', 'high') and not was_sent and not asleep group by all),
    d as (select day, list(dedupe_key order by f) as keys, greatest(0, 4 - coalesce((select count(*) from g where g.day = l.day), 0))::bigint as c from l group by day),
    n as (select *, row_number() over (order by day) as i from d),
    r as (select 0::bigint as i, 0::bigint as day, []::varchar[] as gone, []::varchar[] as today
      union all select i, day, list_concat(gone, t), t from (select n.i, n.day, r.gone, list_slice(list_filter(n.keys, lambda k: not list_contains(r.gone, k)), 1, n.c) as t from r join n on n.i = r.i + 1)),
    w as (select u.day, u.key, l.f from (select day, unnest(today) as key from r) u join l on l.day = u.day and l.dedupe_key = u.key)
    select b.*, case when tier = 'low' then 'below_tier' when was_sent or w.f < seq then 'duplicate' when asleep then 'quiet_hours' when w.f = seq then 'sent' else 'daily_cap' end as decision from b left join w on w.key = b.dedupe_key)""",
)
def _(v):
    """A day has 1,440 alerts; every five-hundredth was sent before the run."""
    alerts = v("v_alerts").withColumn("day", F.floor(F.col("seq") / 1440))
    return H.plan_alerts_by_day(alerts, alerts.where("seq % 500 = 0"))


@query(
    "w7_budget_state",
    """select id, day, cost_micro, spent_before, case when spent_before >= 10000000 then 'SUSPENDED' when spent_before >= 9000000 then 'TRIAGE' when spent_before >= 7000000 then 'FRUGAL' else 'NORMAL' end as mode from
    (select id, spent_at // 86400 as day, cost_micro, coalesce(sum(cost_micro) over (partition by spent_at // 86400 order by id rows between unbounded preceding and 1 preceding), 0)::bigint as spent_before from v_ledger)""",
)
def _(v):
    return H.budget_state(v("v_ledger"), 10_000_000)


@query(
    "w7_budget_decisions",
    """select id, day, cost_micro, spent_before, allowed from (with recursive l as (select id, spent_at // 86400 as day, cost_micro, row_number() over (partition by spent_at // 86400 order by id) as rn from v_ledger),
    r as (select id, day, cost_micro, rn, 0::bigint as spent_before, cost_micro <= 10000000 as allowed from l where rn = 1
      union all select l.id, l.day, l.cost_micro, l.rn, s::bigint, s < 10000000 and s + l.cost_micro <= 10000000
        from (select day, rn, spent_before + case when allowed then cost_micro else 0 end as s from r) p join l on l.day = p.day and l.rn = p.rn + 1)
    select * from r)""",
)
def _(v):
    return H.budget_decisions(v("v_ledger"), 10_000_000)


POSTS = f"""(select event_id as post_id, user_id as author, substr(props, 1, 20) as text, case when event_id % 7 = 0 then 'x' else md5(substr(props, 1, 20)) end as reviewed_hash, {BASE} + event_id * 60 as posted_at from events)"""


@query(
    "w8_publication_audit",
    f"""select post_id, array_to_string(list_filter([case when trim(text) = '' then 'empty' end, case when length(text) > 12 then 'too_long' end, case when md5(text) <> reviewed_hash then 'changed' end,
      case when nth > 5 then 'over_daily_limit' end, case when posted_at - before < 1800 then 'too_soon' end], lambda x: x is not null), ',') as faults from
    (select *, lag(posted_at) over (partition by author order by posted_at, post_id) as before, row_number() over (partition by author, posted_at // 86400 order by posted_at, post_id) as nth from {POSTS} p)""",
)
def _(v):
    e = v("events")
    text = F.substring("props", 1, 20)
    posts = e.select(F.col("event_id").alias("post_id"), F.col("user_id").alias("author"), text.alias("text"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.md5(text)).alias("reviewed_hash"), (F.lit(BASE) + F.col("event_id") * 60).alias("posted_at"))
    return H.publication_audit(posts, longest=12)


@query(
    "w9_largest_clusters",
    """select event_id, count(*) as evidence_count from v_evidence where event_id in (select event_id from v_events order by first_seen_at desc, event_id desc limit 500)
    group by event_id having count(*) > 1 order by evidence_count desc, event_id limit 5""",
)
def _(v):
    return H.largest_clusters(v("v_events"), v("v_evidence"))


@query("a1_event_aggregates", "select event_id, count(*) as evidence_count, count(distinct source_id) as source_count, max(is_official) as has_official from v_evidence e join v_sources s on s.id = e.source_id group by event_id")
def _(v):
    return A.event_aggregates(v("v_evidence"), v("v_sources"))


@query("a2_duplicate_keys", "select source_id, content_hash, count(*) as n from v_items group by all having count(*) > 1")
def _(v):
    return A.duplicate_keys(v("v_items"), ["source_id", "content_hash"])


SINCE = BASE + 100_000


@query(
    "a3_ingest_summary",
    f"""select s.id as source_id, count(l.id) as fetches, coalesce(sum(items_found), 0)::bigint as found, coalesce(sum(items_new), 0)::bigint as new, count(error) as failures, max(outcome) as last_outcome
    from (select n as id from v_sources) s left join v_fetch_log l on l.source_id = s.id and l.started_at >= {SINCE} group by s.id""",
)
def _(v):
    return A.ingest_summary(v("v_sources").select(F.col("n").alias("id")), v("v_fetch_log"), SINCE)


@query("a4_sources_by_priority", "select priority, count(*) as n from v_sources where active group by priority")
def _(v):
    return A.sources_by_priority(v("v_sources"))


@query("a5_spend_since", f"select coalesce(sum(cost_micro), 0)::bigint as cost_micro from v_ledger where spent_at >= {SINCE} and provider = 'p0'")
def _(v):
    return A.spend_since(v("v_ledger"), SINCE, "p0")


@query("a6_spend_breakdown", f"""select stage, model, count(*) as calls, count(*) filter (status = 'skipped') as skipped, sum(cost_micro)::bigint as cost_micro, sum(cache_read_tokens)::bigint as cache_read_tokens
    from v_analyses where created_at >= {SINCE} group by all""")
def _(v):
    return A.spend_breakdown(v("v_analyses"), SINCE)


@query("a7_evidence_facts", """select event_id, max(is_official) as has_official, max(regexp_matches(title, 'v[0-9]|[0-9]\\.[0-9]')) as has_version, count(distinct case when category = 'EXPERT_ANALYST' then e.source_id end) as experts
    from v_evidence e join v_items i on i.id = e.item_id join v_sources s on s.id = e.source_id group by event_id""")
def _(v):
    return A.evidence_facts(v("v_evidence"), v("v_items"), v("v_sources"))


@query(
    "a10_detection_latency",
    """with h as (select (first_seen_at - occurred_at) / 3600 as hours from v_events where not occurred_estimated and (first_seen_at - occurred_at) / 3600 between 0 and 168),
    r as (select hours, row_number() over (order by hours) - 1 as i, count(*) over () as n from h)
    select max(n) as n, max(hours) filter (i = least(n - 1, floor(n * 0.5))) as p50, max(hours) filter (i = least(n - 1, floor(n * 0.75))) as p75, max(hours) filter (i = least(n - 1, floor(n * 0.9))) as p90,
      max(hours) filter (i = least(n - 1, floor(n * 0.99))) as p99, min(hours) as least, max(hours) as most from r""",
)
def _(v):
    return A.detection_latency(v("v_events"))


@query(
    "a11_corpus_span",
    """with r as (select occurred_at as t, row_number() over (order by occurred_at) - 1 as i, count(*) over () as n from v_events)
    select (max(t) - min(t)) / 86400 as full_days, (max(t) filter (i = floor((n - 1) * 0.95)) - max(t) filter (i = floor((n - 1) * 0.05))) / 86400 as middle_days from r""",
)
def _(v):
    return A.corpus_span(v("v_events"))


@query("a12_source_health", f"select id, round(({NOW} - last_success_at) / 3600, 6) as hours_since, last_success_at is null or ({NOW} - last_success_at) / 3600 > 48 as dead from v_sources")
def _(v):
    return A.source_health(v("v_sources"), NOW)


@query("a13_run_summary", """select count(*) as considered, count(*) filter (outcome = 'ok') as fetched, count(*) filter (not_modified) as not_modified, sum(items_found)::bigint as found, sum(items_new)::bigint as new,
    count(error) as failures from v_fetch_log""")
def _(v):
    return A.run_summary(v("v_fetch_log"))


@query("a13_run_results", """select count(*) as considered, count(*) filter (s is null) as fetched, count(*) filter (s = 'not_due') as skipped_not_due, count(*) filter (s = 'circuit_open') as skipped_circuit_open,
    count(*) filter (s is null and not_modified) as not_modified, (sum(items_found) filter (s is null))::bigint as found, (sum(items_new) filter (s is null))::bigint as new, count(*) filter (s is null and outcome not in ('ok', 'not_modified')) as failures
    from (select *, case when bytes % 7 = 0 then 'not_due' when bytes % 11 = 0 then 'circuit_open' end as s from v_fetch_log) x""")
def _(v):
    return A.run_results(v("v_fetch_log").withColumn("skipped", F.when(F.col("bytes") % 7 == 0, "not_due").when(F.col("bytes") % 11 == 0, "circuit_open")))


@query(
    "a14_usage_cost",
    """select model, priced_as, count(*) as calls, sum(c)::bigint as cost_micro, round(sum(c) * 0.5)::bigint as batch_saves from
    (select model, p.name as priced_as, round(((input_tokens + 1.25::double * cache_write_tokens + 0.1::double * cache_read_tokens) * pin + output_tokens * pout) / 1e6)::bigint as c
     from v_ledger l join (values ('alpha', 3000000, 15000000), ('alpha-2', 5000000, 25000000), ('beta', 800000, 4000000)) p(name, pin, pout) on starts_with(l.model, p.name)
     qualify row_number() over (partition by l.id order by length(p.name) desc) = 1) group by all""",
)
def _(v):
    return A.usage_cost(v("v_ledger"), A.price_table(v("v_ledger").sparkSession))


#: Prices by the beginnings of sources' names and of event types: a table that grows with its source.
_PRICES = "(select source as name, 1000 * max(length(source)) + count(*) as price_in, count(*) as price_out from documents where source is not null group by source)"


@query(
    "j12_price_usage",
    f"""with u as (select event_id as id, 'src' || cast(user_id % 40 as varchar) || '-' || event_type as model from events), p as {_PRICES}
    select id, model, p.name as priced_as, price_in::bigint as price_in, price_out::bigint as price_out from u left join p on starts_with(u.model, p.name)
    qualify row_number() over (partition by id order by length(p.name) desc nulls last) = 1""",
)
def _(v):
    usage = v("events").select(F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string"), F.lit("-"), "event_type").alias("model"))
    prices = v("documents").where("source is not null").groupBy(F.col("source").alias("name")).agg((1000 * F.max(F.length("source")) + F.count("*")).alias("price_in"), F.count("*").alias("price_out"))
    return A.price_usage(usage, prices).select("id", "model", "priced_as", "price_in", "price_out")


@query(
    "a14_estimate_cost",
    """select id, round((input_tokens / 3.5::double * coalesce(pin, 5000000) + output_tokens * coalesce(pout, 25000000)) / 1e6, 6) as estimated_micro from v_ledger l
    left join (values ('alpha', 3000000, 15000000), ('alpha-2', 5000000, 25000000)) p(name, pin, pout) on starts_with(l.model, p.name) qualify row_number() over (partition by l.id order by length(p.name) desc nulls last) = 1""",
)
def _(v):
    calls = v("v_ledger").select("id", "model", F.col("input_tokens").alias("prompt_chars"), F.col("output_tokens").alias("max_output_tokens"))
    prices = A.price_table(calls.sparkSession).where("name <> 'beta'")  # an unlisted model has the dearest rate
    return A.estimate_cost(calls, prices).select("id", F.round("estimated_micro", 6).alias("estimated_micro"))


@query("a15_cache_hit_ratio", "select count(*) as issued, count(*) filter (cache_read_tokens > 0) as hits, round(count(*) filter (cache_read_tokens > 0) / count(*), 6) as ratio from v_analyses where status <> 'skipped'")
def _(v):
    return A.cache_hit_ratio(v("v_analyses"))


@query("a15_skip_reasons", "select skip_code, count(*) as n from v_analyses where skip_code is not null group by all")
def _(v):
    return A.skip_reasons(v("v_analyses"))


ASSIGNED = "(select id, content_hash as cluster, source_id as label from v_items)"


@query(
    "a16_pairwise_quality",
    f"""with a as (select * from {ASSIGNED}), b as (select (select coalesce(sum(n * (n - 1) // 2), 0) from (select count(*) as n from a group by cluster, label))::bigint as tp,
      (select sum(n * (n - 1) // 2) from (select count(*) as n from a group by cluster))::bigint as c, (select sum(n * (n - 1) // 2) from (select count(*) as n from a group by label))::bigint as l,
      (select count(*) * (count(*) - 1) // 2 from a)::bigint as t)
    select tp, c - tp as fp, l - tp as fn, t - c - l + tp as tn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1
    from (select *, case when c > 0 then tp / c else 1 end as p, case when l > 0 then tp / l else 1 end as r from b) q""",
)
def _(v):
    return A.pairwise_quality(v("v_items").select("id", F.col("content_hash").alias("cluster"), F.col("source_id").alias("label")))


@query("a18_merge_stats", """select stage, count(*) as n, round(count(*) / (select count(*) from v_evidence where item_id <> event_id), 6) as share from
    (select case when item_id % 3 = 0 then 1 when item_id % 3 = 1 then 2 else 3 end as stage from v_evidence where item_id <> event_id) group by stage""")
def _(v):
    stage = F.when(F.col("item_id") % 3 == 0, 1).when(F.col("item_id") % 3 == 1, 2).otherwise(3)
    return A.merge_stats(v("v_evidence").select(F.when(F.col("item_id") != F.col("event_id"), "merge").otherwise("new").alias("action"), stage.alias("stage")))


@query("a18_merge_rates", """select opened, merged, unmerged, round(merged / (opened + merged), 6) as merge_rate, round(unmerged / merged, 6) as unmerge_rate from
    (select count(*) filter (item_id = event_id) as opened, count(*) filter (item_id <> event_id) as merged, count(*) filter (item_id <> event_id and length(source_id) + item_id % 11 = 9) as unmerged from v_evidence) x""")
def _(v):
    actions = F.array_compact(F.array(F.when(F.col("item_id") == F.col("event_id"), "new").otherwise("merge"), F.when((F.col("item_id") != F.col("event_id")) & (F.length("source_id") + F.col("item_id") % 11 == 9), "unmerge")))
    return A.merge_rates(v("v_evidence").select(F.explode(actions).alias("action")))


@query(
    "a19_detector_quality",
    """select coalesce(family, 'all') as family, count(*) as n, count(*) filter (hostile and not flagged) as missed, count(*) filter (not hostile and flagged) as false_flags from
    (select source as family, toxic = 1 as hostile, regexp_matches(lower(text), 'idiot|moron|scum|trash') as flagged from v_labels) group by rollup (family)""",
)
def _(v):
    df = v("v_labels")
    return A.detector_quality(df.select(F.col("source").alias("family"), (F.col("toxic") == 1).alias("hostile"), F.rlike(F.lower("text"), F.lit("idiot|moron|scum|trash")).alias("flagged")))


@query("a20_probe_summary", """select count(*) filter (error is null) as ok, count(error) as failed, count(*) filter (not_modified) as warnings, count(*) filter (error is not null and priority = 1) as priority_failures
    from v_fetch_log l join v_sources s on s.n = l.source_id""")
def _(v):
    return A.probe_summary(v("v_fetch_log"), v("v_sources"))


DRIVER_NAMES = "(['" + "','".join(A.DRIVERS) + "'])"
DRIVER_SQL = f"(select event_id, list_distinct([{DRIVER_NAMES}[1 + event_id % 9], {DRIVER_NAMES}[1 + event_id // 7 % 9], {DRIVER_NAMES}[1 + event_id // 3 % 9]]) as drivers from v_events)"


@query(
    "a21_attention_score",
    f"""with w(d, w) as (values {", ".join(f"('{k}', {x}::double)" for k, x in A.DRIVERS.items())}),
    x as (select event_id, w.d, w.w from (select event_id, unnest(drivers) as d from {DRIVER_SQL} q) e join w on w.d = e.d),
    s as (select event_id, round(sum(w), 6) as attention, string_agg(d, ',' order by w desc, d) as ds from x group by event_id)
    select event_id, attention, case when attention >= 2.2 then 'HIGH' when attention >= 1.1 then 'MEDIUM' else 'LOW' end as level, array_to_string(string_split(ds, ',')[1:3], ',') as top from s""",
)
def _(v):
    names = F.array(*map(F.lit, A.DRIVERS))
    at = lambda e: F.get(names, F.expr(e).cast("int"))
    return A.attention_score(v("v_events").select("event_id", F.array(at("event_id % 9"), at("(event_id div 7) % 9"), at("(event_id div 3) % 9")).alias("drivers")))


@query("a22_table_counts", "select 'documents' as name, count(*) as n from documents union all select 'events', count(*) from events union all select 'pages', count(*) from pages")
def _(v):
    return A.table_counts({n: v(n) for n in ("documents", "events", "pages")})


@query("a23_hourly_requests", "select started_at // 3600 * 3600 as hour, count(*) as requests, count(*) >= 45 as exhausted from v_fetch_log group by started_at // 3600")
def _(v):
    return A.hourly_request_budget(v("v_fetch_log"), 60)


@query("a24_source_state", """select source_id, max(started_at) as last_checked_at, max(started_at) filter (outcome in ('ok', 'not_modified')) as last_success_at,
    max(started_at) filter (items_found > 0) as last_event_at, max_by(etag, id) as etag from v_fetch_log group by source_id""")
def _(v):
    return A.source_state(v("v_fetch_log"))


@query("a24_source_state_verified", """select source_id, max(started_at) as last_checked_at, max(started_at) filter (outcome in ('ok', 'not_modified')) as last_success_at, max(started_at) filter (items_found > 0) as last_event_at,
    max_by(etag, id) as etag, max_by(lm, id) filter (outcome in ('ok', 'not_modified') and lm is not null) as last_modified, max(started_at) filter (outcome in ('ok', 'not_modified') and items_new > 1) as verified_at
    from (select *, case when bytes % 3 > 0 then 'day ' || cast(bytes as varchar) end as lm from v_fetch_log) x group by source_id""")
def _(v):
    modified = F.when(F.col("bytes") % 3 > 0, F.concat(F.lit("day "), F.col("bytes").cast("string")))
    return A.source_state(v("v_fetch_log").withColumns({"last_modified": modified, "verified": F.col("items_new") > 1}))


@query("j1_exact_groups", "select a, b from (select min(id) over (partition by content_hash) as a, id as b from v_items union select min(id) over (partition by url) as a, id as b from v_items) where a <> b")
def _(v):
    return J.exact_matches(v("v_items"))


KEYED = "(select id, source_id, coalesce(published_at, fetched_at) as at, lower(substr(title, 1, 3)) as key from v_items)"


@query(
    "j2_artifact_matches",
    f"select distinct a.id as a, b.id as b from {KEYED} a join {KEYED} b on a.key = b.key and a.source_id = b.source_id and abs(a.at - b.at) <= 172800 and a.id < b.id",
)
def _(v):
    df = v("v_items").select("id", F.array(F.lower(F.substring("title", 1, 3))).alias("keys"), F.array("source_id").alias("entities"), F.coalesce("published_at", "fetched_at").alias("at"))
    return J.artifact_matches(df)


@query(
    "j4_cluster_candidates",
    f"""select e.event_id, u.urls, u.hashes, v.vec_id is not null as has_vector from v_events e join (select event_id, count(distinct i.url) as urls, count(distinct i.content_hash) as hashes
      from v_evidence x join v_items i on i.id = x.item_id group by event_id) u on u.event_id = e.event_id left join embeddings v on v.vec_id = e.event_id where occurred_at >= {BASE + 360000}""",
)
def _(v):
    df = J.cluster_candidates(v("v_events"), v("v_evidence"), v("v_items"), v("embeddings"), BASE + 360_000)
    return df.select("event_id", F.size("urls").cast("long").alias("urls"), F.size("hashes").cast("long").alias("hashes"), F.col("embedding").isNotNull().alias("has_vector"))


@query("j5_unclustered_items", "select id from v_items where id not in (select item_id from v_evidence where event_id % 3 = 0)")
def _(v):
    return J.unclustered_items(v("v_items"), v("v_evidence").where("event_id % 3 = 0")).select("id")


@query("j6_awaiting_analysis", f"select event_id, combined from {LATEST} x where gate_passed and not exists (select 1 from v_analyses a where a.event_id = x.event_id and stage = 'click' and prompt_version = 'v1')")
def _(v):
    return J.awaiting_analysis(v("v_scores"), v("v_analyses"), "click", "v1")


@query("j7_evidence_envelope", """select event_id, item_id, category, row_number() over (partition by event_id order by coalesce(published_at, fetched_at), item_id) as place
    from v_evidence e join v_items i on i.id = e.item_id join v_sources s on s.id = e.source_id""")
def _(v):
    return J.evidence_envelope(v("v_evidence"), v("v_items"), v("v_sources")).select("event_id", "item_id", "category", F.col("place").cast("long").alias("place"))


@query("j9_scorable_events", """select e.event_id, count(x.item_id) as n, coalesce(string_agg(x.source_id, ',' order by x.attached_at, x.source_id), '') as sources from v_events e left join v_evidence x on x.event_id = e.event_id group by e.event_id""")
def _(v):
    df = J.scorable_events(v("v_events"), v("v_evidence"), v("v_sources"))
    return df.select("event_id", F.size("evidence").cast("long").alias("n"), F.array_join(F.transform("evidence", lambda x: x["source_id"]), ",").alias("sources"))


@query("j10_entity_lookup", "select event_id, max(source_id) filter (n = m) as entity, max(m) as weight from (select event_id, source_id, n, max(n) over (partition by event_id) as m from v_evidence e join v_sources s on s.id = e.source_id) group by event_id")
def _(v):
    events = v("v_evidence").groupBy("event_id").agg(F.collect_set("source_id").alias("entities"))
    return J.entity_lookup(events, v("v_sources").select(F.col("id").alias("entity"), F.col("n").alias("weight")))


SETS = "a as (select distinct event_id from v_scores where combined >= 60), b as (select distinct event_id from v_scores where importance >= 80)"


def _sets(v):
    return v("v_scores").where("combined >= 60"), v("v_scores").where("importance >= 80")


@query("j11_replay_disagreement", f"""with {SETS} select (select count(*) from (select * from a except select * from b)) as only_a, (select count(*) from (select * from b except select * from a)) as only_b,
    (select count(*) from (select * from a intersect select * from b)) as common, round((select count(*) from (select * from a intersect select * from b)) / (select count(*) from (select * from a union select * from b)), 6) as agreement""")
def _(v):
    return J.replay_disagreement(*_sets(v))


@query("j14_tier_one_arrivals", f"select count(*) as n from v_items i join v_sources s on s.id = i.source_id where priority = 1 and fetched_at > {BASE + 360000}")
def _(v):
    return J.tier_one_arrivals(v("v_items"), v("v_sources"), BASE + 360_000)


@query("j13_label_errors", f"select a.id as a, b.id as b from {ASSIGNED} a join {ASSIGNED} b on a.cluster = b.cluster and a.label <> b.label and a.id < b.id")
def _(v):
    return J.label_errors(v("v_items").select("id", F.col("content_hash").alias("cluster"), F.col("source_id").alias("label")), "merged")


@query("u2_agreement", f"with {SETS} select (select count(*) from (select * from a intersect select * from b)) as common, (select count(*) from (select * from a union select * from b)) as total")
def _(v):
    return J.agreement(*_sets(v))


@query("u3_newly_surfaced", f"with {SETS} select * from b except select * from a")
def _(v):
    return J.newly_surfaced(*_sets(v))


@query("u1_union_alerts", "select seq, tier from v_alerts where tier = 'urgent' union all select seq, tier from v_alerts where seq < 100")
def _(v):
    a = v("v_alerts").select("seq", "tier")
    return J.union_alerts(a.where("tier = 'urgent'"), a.where("seq < 100"))


@query("u4_member_features", "select event_id, array_to_string(list_sort(list(distinct source_id)), ',') as entities from v_evidence group by event_id")
def _(v):
    """The union of the members' entity arrays."""
    items = v("v_items").select(F.col("id").alias("item_id"), F.array("source_id", "source_id").alias("entities"))
    ev = v("v_evidence").select("event_id", "item_id").join(items, "item_id")
    return J.array_unions(ev, "event_id", ["entities"]).select("event_id", F.array_join("entities", ",").alias("entities"))


_STAR = "(select id, min(id) over (partition by content_hash) as a from v_items union select id, min(id) over (partition by url) from v_items)"


@query(
    "c2_exact_dedup_groups",
    f"""select id as item_id, min(low) as event_id from (with recursive s as (select * from {_STAR} z), e as (select id as x, a as y from s union select a, id from s),
    r(id, low) as (select id, id from v_items union select e.x, r.low from r join e on e.y = r.id where r.low < e.x) select * from r) q group by id""",
)
def _(v):
    return C.exact_dedup_groups(v("v_items")).select("item_id", "event_id")


AUTH = "case category when 'OFFICIAL_SOURCE' then 100 when 'TECHNICAL_RESEARCHER' then 70 when 'EXPERT_ANALYST' then 60 when 'EARLY_SIGNAL' then 50 when 'JOURNALIST' then 40 when 'COMMUNITY_SIGNAL' then 20 else 10 end"
PRIMARY = f"(select event_id, item_id, category, row_number() over (partition by event_id order by {AUTH} desc, attached_at, item_id) as rn from v_evidence e join v_sources s on s.id = e.source_id)"


@query("c4_select_primary", f"select event_id, item_id as primary_item from {PRIMARY} p where rn = 1")
def _(v):
    return J.select_primary(v("v_evidence"), v("v_sources"))


@query("c5_evidence_role", f"select event_id, item_id, case when rn = 1 then 'primary' when category in ('COMMUNITY_SIGNAL', 'AMPLIFIER') then 'reaction' else 'corroborating' end as role from {PRIMARY} p")
def _(v):
    return J.evidence_roles(v("v_evidence"), v("v_sources"))


@query("c7_operator_unmerged", "select distinct user_id as item_id from events where event_type in ('click', 'error') and event_id % 3 = 0")
def _(v):
    e = v("events")
    action = F.when(F.col("event_type") == "click", "unmerge").when(F.col("event_type") == "error", "split").otherwise("merge")
    return J.operator_unmerged(e.select(F.col("user_id").alias("item_id"), action.alias("action"), F.when(F.col("event_id") % 3 == 0, "operator").otherwise("pipeline").alias("actor")))


@query("k1_recent_events", "select event_id, first_seen_at from v_events order by first_seen_at desc, event_id desc limit 50")
def _(v):
    return H.recent(v("v_events"), "first_seen_at", "event_id", 50).select("event_id", "first_seen_at")


@query("k1_recent_items", "select id, fetched_at from v_items order by fetched_at desc, id desc limit 50")
def _(v):
    return H.recent(v("v_items"), "fetched_at", "id", 50).select("id", "fetched_at")


@query("k1_recent_fetches", "select id, source_id, started_at, outcome from v_fetch_log order by started_at desc, id desc limit 50")
def _(v):
    return H.recent(v("v_fetch_log"), "started_at", "id", 50).select("id", "source_id", "started_at", "outcome")


@query("k2_list_sources", "select id, priority, name, row_number() over (order by priority, name, id) as place from v_sources")
def _(v):
    from pyspark.sql.window import Window

    return v("v_sources").select("id", "priority", "name", F.row_number().over(Window.orderBy("priority", "name", "id")).cast("long").alias("place"))


@query("k3_page_after", "select id, title from v_items where id > 100 order by id limit 200")
def _(v):
    return H.page_after(v("v_items"), "id", 100, 200).select("id", "title")


@query("k5_lookup", "select event_id, ts, user_id from events where event_id = 77")
def _(v):
    return H.lookup(v("events"), "event_id", 77).select("event_id", "ts", "user_id")


@query("s5_append_new_items", "select id, source_id, external_id from v_items where id % 4 <> 0")
def _(v):
    items = v("v_items").select("id", "source_id", "external_id")
    return J.append_new_items(items.where("id % 4 = 0"), items.unionByName(items.where("id % 2 = 0")))


@query("s7_upsert_by_key", """select coalesce(a.id, b.id) as id, coalesce(b.name, a.name) as name, a.priority from (select id, name, priority from v_sources where n % 3 <> 0) a
    full join (select id, case when n % 2 = 0 then 'new ' || name end as name from v_sources where n % 4 <> 1) b on a.id = b.id""")
def _(v):
    s = v("v_sources")
    updates = s.where("n % 4 <> 1").select("id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("new "), "name")).alias("name"), F.lit(9).alias("priority"))
    return J.upsert_by_key(s.where("n % 3 <> 0").select("id", "name", "priority"), updates, "id", ("priority",))


@query("s8_alias_conflicts", "select lower(substr(title, 1, 2)) as normalized, count(distinct source_id) as owners from v_items group by 1 having count(distinct source_id) > 1")
def _(v):
    return J.alias_conflicts(v("v_items").select(F.lower(F.substring("title", 1, 2)).alias("normalized"), F.col("source_id").alias("entity_id")))


@query(
    "s8_registry_problems",
    """with e as (select cast(s_nationkey % 20 as varchar) as id from supplier),
    a as (select cast(c_nationkey as varchar) as entity_id, regexp_replace(lower(case when c_custkey % 50 = 0 then '--' else c_mktsegment end), '[^a-z0-9]+', '', 'g') as normalized from customer)
    select 'duplicate_entity' as problem, id as key, count(*) as n from e group by id having count(*) > 1
    union all select 'empty_alias', entity_id, count(*) from a where normalized = '' group by entity_id
    union all select 'unknown_entity', entity_id, count(*) from a where entity_id not in (select id from e) group by entity_id
    union all select 'shared_alias', normalized, count(distinct entity_id) from a where normalized <> '' group by normalized having count(distinct entity_id) > 1""",
)
def _(v):
    entities = v("supplier").select((F.col("s_nationkey") % 20).cast("string").alias("id"))
    alias = F.when(F.col("c_custkey") % 50 == 0, "--").otherwise(F.col("c_mktsegment"))
    aliases = v("customer").select(F.col("c_nationkey").cast("string").alias("entity_id"), N.normalize_alias(alias, False).alias("normalized"))
    return E.registry_problems(entities, aliases)


@query(
    "s9_registry_aliases",
    """with d as (select s_suppkey, unnest([s_name, upper(s_name), 'Supplier ' || s_suppkey, 'S-' || s_nationkey]) as alias, unnest([0, 1, 2, 3]) as place from supplier),
    n as (select *, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') as normalized from d)
    select cast(s_suppkey as varchar) as entity_id, arg_min(alias, place) as alias, normalized, arg_min(place = 3, place) as requires_exact_case from n group by s_suppkey, normalized""",
)
def _(v):
    names = F.array("s_name", F.upper("s_name"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")))
    exact = F.array(F.concat(F.lit("S-"), F.col("s_nationkey").cast("string")))
    return E.registry_aliases(v("supplier").select(F.col("s_suppkey").cast("string").alias("id"), names.alias("aliases"), exact.alias("case_sensitive_aliases")), normalise=False)


@query("s10_items_with_source", "select i.id, i.source_id, category, priority, -i.id as place from v_items i join v_sources s on s.id = i.source_id where i.id % 5 = 0")
def _(v):
    ids = v("v_items").where("id % 5 = 0").select("id", (-F.col("id")).alias("place"))
    return J.items_with_source(v("v_items"), v("v_sources"), ids)


@query("s11_reconcile_tables", "select 'documents' as name, count(*) as expected, count(*) as found, 'ok' as status from documents union all select 'events', count(*), count(*) - 1, 'mismatch' from events union all select 'gone', 5, null, 'missing'")
def _(v):
    counts = A.table_counts({"documents": v("documents"), "events": v("events")})
    expected = counts.unionByName(counts.where("name = 'events'").select(F.lit("gone").alias("name"), F.lit(5).cast("long").alias("n")))
    return J.reconcile_tables(expected, counts.withColumn("n", F.col("n") - F.when(F.col("name") == "events", 1).otherwise(0)))


@query("s13_labelled_set", """with t as (select id, source_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as label from v_items)
    select id, label from t where length(label) >= 12 and label in (select label from t group by label having count(distinct source_id) >= 2)""")
def _(v):
    return J.labelled_set(v("v_items"))


_VERSIONS = f"list_distinct(list_transform(regexp_extract_all(body, '{J.VERSION_TOKEN}'), lambda x: lower(x)))"


@query("s13_version_labels", f"""with t as (select id, source_id, body, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as label from v_items),
    done as (select id from t where length(label) >= 12 and label in (select label from t group by label having count(distinct source_id) >= 2)),
    o as (select id, source_id, {_VERSIONS} as ts from t where id not in (select id from done) and source_id is not null)
    select min(id) as id, 'version:' || source_id || ':' || ts[1] as label from o where len(ts) = 1 group by source_id, ts[1]""")
def _(v):
    """The whole text stands for a title here, as few of the first lines name a version."""
    items = v("v_items")
    return J.version_labels(items.select("id", "source_id", F.col("body").alias("title")), J.labelled_set(items))
