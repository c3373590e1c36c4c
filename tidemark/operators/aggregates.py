"""Grouped reports over events, evidence, logs and ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import at_ranks

HOUR, DAY = 3600, 86_400


def _n(condition: Column | str) -> Column:
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(condition, 1).otherwise(0))


def event_aggregates(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence count, distinct sources, and whether an official source is among them."""
    df = evidence.join(sources.select(F.col("id").alias("source_id"), "is_official"), "source_id")
    return df.groupBy("event_id").agg(F.count("*").alias("evidence_count"), F.countDistinct("source_id").alias("source_count"), F.max("is_official").alias("has_official"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ingest_summary(sources: DataFrame, log: DataFrame, since: int, latest_outcome: bool = False) -> DataFrame:
    """Per source, silent ones too: fetches, found, new, failures, and ``max(outcome)`` (alphabetical) or the latest one."""
    recent = log.where(F.col("started_at") >= since)
    last = F.max_by("outcome", "id") if latest_outcome else F.max("outcome")
    sums = recent.groupBy("source_id").agg(
        F.count("*").alias("fetches"), F.sum("items_found").alias("found"), F.sum("items_new").alias("new"), _n("error is not null").alias("failures"), last.alias("last_outcome")
    )
    df = sources.select(F.col("id").alias("source_id")).join(sums, "source_id", "left")
    return df.select("source_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fetches", "found", "new", "failures")), "last_outcome")


def sources_by_priority(sources: DataFrame) -> DataFrame:
    return sources.where("active").groupBy("priority").agg(F.count("*").alias("n"))


def spend_since(ledger: DataFrame, since: int, provider: str | None = None) -> DataFrame:
    df = ledger.where(F.col("spent_at") >= since)
    df = df.where(F.col("provider") == provider) if provider else df
    return df.agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro"))


def spend_breakdown(analyses: DataFrame, since: int) -> DataFrame:
    df = analyses.where(F.col("created_at") >= since)
    return df.groupBy("stage", "model").agg(F.count("*").alias("calls"), _n("status = 'skipped'").alias("skipped"), F.sum("cost_micro").alias("cost_micro"), F.sum("cache_read_tokens").alias("cache_read_tokens"))


def evidence_facts(evidence: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Official source, version-like title and distinct experts, in one pass."""
    df = evidence.select("event_id", "item_id", "source_id").join(items.select(F.col("id").alias("item_id"), "title"), "item_id")
    df = df.join(sources.select(F.col("id").alias("source_id"), "is_official", "category"), "source_id")
    return df.groupBy("event_id").agg(
        F.max("is_official").alias("has_official"),
        F.max(F.rlike("title", F.lit(r"v[0-9]|[0-9]\.[0-9]"))).alias("has_version"),
        F.countDistinct(F.when(F.col("category") == "EXPERT_ANALYST", F.col("source_id"))).alias("experts"),
    )


def detection_latency(events: DataFrame, fractions: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Hours from occurrence to first sight, without estimated times and outside 0 to 168; element ``min(n - 1, floor(n * f))`` of the sorted hours.

    Elements come from histograms around their rank (:func:`~tidemark.operators.scans.at_ranks`), so no task orders all events."""
    hours = (F.col("first_seen_at") - F.col("occurred_at")) / HOUR
    df = events.where("not occurred_estimated").select(hours.alias("hours")).where("hours between 0 and 168")
    n = df.count()
    picks = at_ranks(df, "hours", [min(n - 1, math.floor(n * f)) for f in fractions]) if n else [None] * len(fractions)
    found = [F.lit(x).cast("double").alias(f"p{round(f * 100)}") for f, x in zip(fractions, picks)]
    return df.agg(F.when(F.count("*") > 0, F.count("*")).alias("n"), F.min("hours").alias("least"), F.max("hours").alias("most")).select("n", *found, "least", "most")


def corpus_span(events: DataFrame) -> DataFrame:
    """Days from first to last event, and of the middle 90 %, by ranks ``floor((n - 1) * f)`` of the times that are not null."""
    df = events.where("occurred_at is not null").select("occurred_at")
    n = df.count()
    low, high = at_ranks(df, "occurred_at", [math.floor((n - 1) * f) for f in (0.05, 0.95)]) if n else (None, None)
    middle = (F.lit(high).cast("double") - F.lit(low).cast("double")) / DAY
    return df.agg(((F.max("occurred_at") - F.min("occurred_at")) / DAY).alias("full_days")).select("full_days", middle.alias("middle_days"))


def source_health(sources: DataFrame, now: int) -> DataFrame:
    """Hours since the last success; dead when there was none in 48 hours."""
    hours = (F.lit(now) - F.col("last_success_at")) / HOUR
    return sources.select("id", F.round(hours, 6).alias("hours_since"), (hours.isNull() | (hours > 48)).alias("dead"))


def run_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("considered"), _n("outcome = 'ok'").alias("fetched"), _n("not_modified").alias("not_modified"), F.sum("items_found").alias("found"), F.sum("items_new").alias("new"), _n("error is not null").alias("failures")
    )


def run_results(results: DataFrame) -> DataFrame:
    """The summary of a run over ``results(outcome, skipped, not_modified, items_found, items_new)``, one row a source considered: ``skipped`` is null for those that were fetched.
    Failures are fetched ones that ended neither well nor unmodified. No rows give zeros."""
    fetched = F.col("skipped").isNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(fetched, F.col(c))), F.lit(0))
    return results.agg(
        F.count("*").alias("considered"), n(fetched).alias("fetched"), n(F.col("skipped") == "not_due").alias("skipped_not_due"), n(F.col("skipped") == "circuit_open").alias("skipped_circuit_open"),
        n(fetched & F.col("not_modified")).alias("not_modified"), total("items_found").alias("found"), total("items_new").alias("new"), n(fetched & ~F.col("outcome").isin("ok", "not_modified")).alias("failures"),
    )


def cache_hit_ratio(analyses: DataFrame) -> DataFrame:
    df = analyses.where("status <> 'skipped'")
    return df.agg(F.count("*").alias("issued"), _n("cache_read_tokens > 0").alias("hits"), F.round(_n("cache_read_tokens > 0") / F.count("*"), 6).alias("ratio"))


def skip_reasons(analyses: DataFrame) -> DataFrame:
    return analyses.where("skip_code is not null").groupBy("skip_code").agg(F.count("*").alias("n"))


def merge_stats(audit: DataFrame) -> DataFrame:
    """Merges by stage with their share of all merges; ``audit(action, stage)``."""
    df = audit.where("action = 'merge'").groupBy("stage").agg(F.count("*").alias("n"))
    total = audit.where("action = 'merge'").agg(F.count("*").alias("total"))
    return df.crossJoin(total).select("stage", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def merge_rates(audit: DataFrame) -> DataFrame:
    """``audit(action)`` with ``new``, ``merge`` and ``unmerge``: the share of attached items that were merged, and that of merges which were taken back; null over nothing."""
    df = audit.agg(_n("action = 'new'").alias("opened"), _n("action = 'merge'").alias("merged"), _n("action = 'unmerge'").alias("unmerged"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return df.select("opened", "merged", "unmerged", rate(F.col("merged"), F.col("opened") + F.col("merged")).alias("merge_rate"), rate(F.col("unmerged"), F.col("merged")).alias("unmerge_rate"))


def detector_quality(flags: DataFrame) -> DataFrame:
    """``flags(family, hostile, flagged)``: counts of missed and falsely flagged by family and in all, by one rollup."""
    df = flags.rollup("family").agg(F.count("*").alias("n"), _n("hostile and not flagged").alias("missed"), _n("not hostile and flagged").alias("false_flags"))
    return df.select(F.coalesce("family", F.lit("all")).alias("family"), "n", "missed", "false_flags")


def probe_summary(log: DataFrame, sources: DataFrame) -> DataFrame:
    df = log.join(sources.select(F.col("n").alias("source_id"), "priority"), "source_id")
    return df.agg(_n("error is null").alias("ok"), _n("error is not null").alias("failed"), _n("not_modified").alias("warnings"), _n("error is not null and priority = 1").alias("priority_failures"))


#: Weights of attention drivers and the levels' thresholds.
DRIVERS = {
    "independently_testable": 1.0,
    "strong_before_after": 0.9,
    "surprising_result": 0.85,
    "measurable_comparison": 0.75,
    "visually_demonstrable": 0.7,
    "practical_consequence": 0.65,
    "competitive_implication": 0.6,
    "novelty": 0.5,
    "timing_window": 0.35,
}
ATTENTION_HIGH, ATTENTION_MEDIUM = 2.2, 1.1


def attention_score(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of an event's distinct drivers' weights, level, and its three strongest drivers; ``events(event_id, drivers)``."""
    table = F.create_map(*[x for k, v in (weights or DRIVERS).items() for x in (F.lit(k), F.lit(v))])
    scored = F.transform(F.array_distinct("drivers"), lambda d: F.struct((-F.coalesce(table[d], F.lit(0.0))).alias("w"), d.alias("d")))
    df = events.withColumn("_s", F.array_sort(scored))
    total = F.round(F.aggregate("_s", F.lit(0.0), lambda a, x: a - x["w"]), 6)
    level = F.when(total >= ATTENTION_HIGH, "HIGH").when(total >= ATTENTION_MEDIUM, "MEDIUM").otherwise("LOW")
    return df.select("event_id", total.alias("attention"), level.alias("level"), F.array_join(F.transform(F.slice("_s", 1, 3), lambda x: x["d"]), ",").alias("top"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def hourly_request_budget(log: DataFrame, limit: int, share: float = 0.75) -> DataFrame:
    """Requests in each hour against ``share`` of the hourly limit."""
    df = log.groupBy((F.floor(F.col("started_at") / HOUR) * HOUR).alias("hour")).agg(F.count("*").alias("requests"))
    return df.select("hour", "requests", (F.col("requests") >= share * limit).alias("exhausted"))


def source_state(log: DataFrame) -> DataFrame:
    """Last checked, last success, last event and latest tag of each source, rebuilt from the log. A log with ``last_modified`` and ``verified`` gives the latest such date
    of a successful fetch, and when one last confirmed the feed."""
    good = F.col("outcome").isin("ok", "not_modified")
    more = []
    if "last_modified" in log.columns:
        more.append(F.max_by("last_modified", F.when(good & F.col("last_modified").isNotNull(), F.col("id"))).alias("last_modified"))
    if "verified" in log.columns:
        more.append(F.max(F.when(good & F.col("verified"), F.col("started_at"))).alias("verified_at"))
    return log.groupBy("source_id").agg(
        F.max("started_at").alias("last_checked_at"),
        F.max(F.when(good, F.col("started_at"))).alias("last_success_at"),
        F.max(F.when(F.col("items_found") > 0, F.col("started_at"))).alias("last_event_at"),
        F.max_by("etag", "id").alias("etag"),
        *more,
    )


def pairwise_quality(assigned: DataFrame) -> DataFrame:
    """TP, FP, FN, TN over all unordered pairs of ``assigned(id, cluster, label)``, with precision, recall (1 where nothing was to be found) and F1 (0 where both
    are), from group sizes: linear in the rows."""
    pairs = lambda keys: assigned.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))
    both, cluster, label = pairs(["cluster", "label"]), pairs(["cluster"]), pairs(["label"])
    total = assigned.agg(F.expr("count(*) * (count(*) - 1) div 2").alias("p"))
    df = both.toDF("tp").crossJoin(cluster.toDF("c")).crossJoin(label.toDF("l")).crossJoin(total.toDF("t"))  # one row each
    df = df.select("tp", (F.col("c") - F.col("tp")).alias("fp"), (F.col("l") - F.col("tp")).alias("fn"), (F.col("t") - F.col("c") - F.col("l") + F.col("tp")).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return df.select("tp", "fp", "fn", "tn", *(F.round(x, 6).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))))


def strategy_summary(decisions: DataFrame) -> DataFrame:
    """Counts by action and by reason in one pass of grouping sets; ``decisions(action, reason)``."""
    df = decisions.groupingSets([[F.col("action")], [F.col("reason")], []], F.col("action"), F.col("reason")).agg(F.count("*").alias("n"))
    return df.select(F.coalesce("action", F.lit("*")).alias("action"), F.coalesce("reason", F.lit("*")).alias("reason"), "n")


#: Actions that hold back.
RESTRAINED = ("DONT_POST", "WAIT", "VERIFY")


def restraint(decisions: DataFrame) -> DataFrame:
    """One row: how many of ``decisions(action, manual_flag)`` hold back, their share (0 of none), and how many are flagged for a person."""
    df = decisions.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("action").isin(*RESTRAINED).cast("long")), F.lit(0)).alias("restrained"), F.coalesce(F.sum(F.col("manual_flag").cast("long")), F.lit(0)).alias("manual_flags"))
    return df.select("n", "restrained", F.round(F.when(F.col("n") > 0, F.col("restrained") / F.col("n")).otherwise(0.0), 6).alias("restraint_rate"), "manual_flags")


#: Price in micro-USD for each million tokens (input, output), by model name or its beginning.
PRICES = (("alpha", 3_000_000, 15_000_000), ("alpha-2", 5_000_000, 25_000_000), ("beta", 800_000, 4_000_000))
CACHE_WRITE, CACHE_READ, BATCH = 1.25, 0.1, 0.5


def price_table(spark: SparkSession, prices: tuple[tuple[str, int, int], ...] = PRICES) -> DataFrame:
    """The listed prices as a table ``(name, price_in, price_out)``."""
    return spark.createDataFrame(list(prices), "name string, price_in long, price_out long")


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each row with ``priced_as, price_in, price_out``: the price of the longest listed beginning of its model's name (the name itself is the longest there can
    be); nulls where none is listed. ``prices(name, price_in, price_out)`` is a table of any size: each distinct model name is exploded into its beginnings,
    which join it by equality. A name listed twice has its highest price."""
    listed = prices.groupBy("name").agg(F.max(F.struct("price_in", "price_out")).alias("price"))
    models = usage.select("model").where("model is not null").distinct()
    beginnings = models.withColumn("name", F.explode(F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substring("model", F.lit(1), n))))
    best = beginnings.join(listed, "name").groupBy("model").agg(F.max(F.struct(F.length("name").alias("n"), "name", "price")).alias("best"))
    best = best.select("model", F.col("best.name").alias("priced_as"), F.col("best.price.price_in").alias("price_in"), F.col("best.price.price_out").alias("price_out"))
    return usage.join(best, "model", "left")


#: Characters a token for an estimate, and the dearest listed rate, which an unknown model has.
CHARS_A_TOKEN, DEAREST = 3.5, (5_000_000, 25_000_000)


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls(model, prompt_chars, max_output_tokens, ...)`` with ``estimated_micro``: no cache hit, the output at full length."""
    df = price_usage(calls, prices)
    cost = F.col("prompt_chars") / CHARS_A_TOKEN * F.coalesce("price_in", F.lit(DEAREST[0])) + F.col("max_output_tokens") * F.coalesce("price_out", F.lit(DEAREST[1]))
    return df.withColumn("estimated_micro", cost / 1e6)


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost in micro-USD by model: cache writes at 1.25 of the input price, reads at 0.1; what a batch would save."""
    df = price_usage(usage, prices)
    cost = (F.col("input_tokens") + CACHE_WRITE * F.col("cache_write_tokens") + CACHE_READ * F.col("cache_read_tokens")) * F.col("price_in") + F.col("output_tokens") * F.col("price_out")
    total = F.round(F.sum(F.round(cost / 1e6).cast("long")))
    return df.groupBy("model", "priced_as").agg(F.count("*").alias("calls"), total.cast("long").alias("cost_micro"), F.round(total * (1 - BATCH)).cast("long").alias("batch_saves"))
