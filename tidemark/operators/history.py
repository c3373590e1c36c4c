"""Latest-per-key reads, top-k, and the ordered (window) jobs over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import run_length, sum_before, value_before

HOUR, DAY = 3600, 86_400
#: Outcomes that count as transport failures, and the breaker's limits in seconds.
FAILURES = ("http_error", "network_error", "timeout", "too_large")
BREAKER_AFTER, BREAKER_FIRST, BREAKER_MOST = 3, 1800, 21_600


def latest(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The row of greatest ``order`` of each key: one pass with partial aggregation, no window over a key's history."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_best"))
    return best.select(key, *(F.col(f"_best.{c}") for c in (order, *rest)))


def latest_scores(scores: DataFrame, limit: int | None = None, passed_only: bool = False) -> DataFrame:
    """Latest score row (greatest id) of each event, filtered before the limit, by combined score; ties by event."""
    df = latest(scores, "event_id")
    if passed_only:
        df = df.where("gate_passed")
    df = df.orderBy(F.desc("combined"), "event_id")
    return df.limit(limit) if limit else df


def gate_kill_rate(scores: DataFrame) -> DataFrame:
    """Over latest scores: totals and kill rate, and counts by rule, by one rollup."""
    df = latest(scores, "event_id").withColumn("rule", F.when(F.col("gate_passed"), "passed").otherwise(F.coalesce("killed_by", F.lit("unknown"))))
    by = df.rollup("rule").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gate_passed"), 0).otherwise(1)).alias("killed"))
    return by.select(F.coalesce("rule", F.lit("all")).alias("rule"), "n", "killed", F.round(F.col("killed") / F.col("n"), 6).alias("kill_rate"))


def kill_rate_without(scores: DataFrame, rule: str = "too_old") -> DataFrame:
    """One row over latest scores: how many, how many the gate killed and their share, and the same over the events that ``rule`` did not kill (the rate of what
    came within the gate's window). Rates of no events are null."""
    df = latest(scores, "event_id").select(F.when(F.col("gate_passed"), 0).otherwise(1).alias("k"), (F.col("killed_by").eqNullSafe(F.lit(rule))).alias("out"))
    inside = lambda c: F.sum(F.when(~F.col("out"), c))
    df = df.agg(F.count("*").alias("n"), F.sum("k").alias("killed"), F.coalesce(inside(F.lit(1)), F.lit(0)).alias("n_without"), inside(F.col("k")).alias("killed_without"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return df.select("n", "killed", rate("killed", "n").alias("kill_rate"), "n_without", "killed_without", rate("killed_without", "n_without").alias("kill_rate_without"))


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Latest successful analysis of each event with a field of its JSON payload."""
    df = latest(analyses.where("status = 'ok'"), "event_id")
    return df.select("event_id", "id", "stage", F.get_json_object("payload", "$.k").cast("long").alias("k"))


def velocity(evidence: DataFrame, sources: DataFrame, hours: int = 6) -> DataFrame:
    """Per event: followers within ``hours`` of the first item (of 5), community pickup, community breadth (of 3), weighted .45/.35/.20."""
    df = evidence.join(sources.select(F.col("id").alias("source_id"), "category"), "source_id")
    first = evidence.groupBy("event_id").agg(F.min("attached_at").alias("first_at"))
    community = F.col("category") == "COMMUNITY_SIGNAL"
    df = df.join(first, "event_id").groupBy("event_id").agg(
        (F.sum(F.when(F.col("attached_at") - F.col("first_at") <= hours * HOUR, 1).otherwise(0)) - 1).alias("followers"),
        F.countDistinct(F.when(community, F.col("source_id"))).alias("community"),
    )
    value = 0.45 * F.least(F.lit(1.0), F.col("followers") / 5) + 0.35 * F.when(F.col("community") > 0, 1.0).otherwise(0.0) + 0.2 * F.least(F.lit(1.0), F.col("community") / 3)
    return df.select("event_id", "followers", "community", F.round(value * 100).cast("long").alias("velocity"))


#: What to do at each stage of a trend.
STAGE_DECISION = {"UNKNOWN": "IGNORE", "EMERGING": "ACT", "ACCELERATING": "DIFFERENTIATE", "MAINSTREAM": "ONLY_IF_UNIQUE", "SATURATED": "IGNORE", "DECLINING": "IGNORE"}


def trend_lifecycle(observations: DataFrame, now: int) -> DataFrame:
    """Stage and decision of each trend from its observations in time order.

    Growth compares the means of the halves (split at floor(n/2)), momentum those of the last two and the two before (the first half
    where there are none), saturation the peak breadth (of 8) and its decay."""
    w = Window.partitionBy("trend_id").orderBy("observed_at")
    df = observations.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("trend_id")))
    half, mentions = F.floor(F.col("n") / 2), F.col("mention_count")
    mean = lambda value, cond: F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))
    df = df.groupBy("trend_id").agg(
        F.max("n").alias("n"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        mean(mentions, F.col("rn") <= half).alias("early"),
        mean(mentions, F.col("rn") > half).alias("late"),
        mean(mentions, F.col("rn") > F.col("n") - 2).alias("tail"),
        F.coalesce(F.avg(F.when((F.col("rn") > F.col("n") - 4) & (F.col("rn") <= F.col("n") - 2), mentions)), mean(mentions, F.col("rn") <= half)).alias("before"),
        F.max("distinct_sources").alias("breadth"),
        mean(F.col("distinct_sources"), F.col("rn") > half).alias("late_breadth"),
    )
    change = lambda new, old: F.when(F.col(old) == 0, F.when(F.col(new) > 0, 1.0).otherwise(0.0)).otherwise((F.col(new) - F.col(old)) / F.col(old))
    decay = F.when(F.col("breadth") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("breadth") - F.col("late_breadth")) / F.col("breadth")))
    df = df.withColumn("growth", change("late", "early")).withColumn("momentum", change("tail", "before"))
    df = df.withColumn("saturation", F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("breadth") / 8) * 0.6 + decay * 0.4))
    stage = (
        F.when((F.lit(now) - F.col("last_at")) / DAY > 14, "DECLINING")
        .when(F.col("n") < 3, "UNKNOWN")
        .when((F.col("saturation") >= 0.7) & (F.col("momentum") <= 0.1), "SATURATED")
        .when(F.col("breadth") >= 5, "MAINSTREAM")
        .when(F.col("growth") >= 0.5, "ACCELERATING")
        .when(F.col("growth") >= 0, "EMERGING")
        .otherwise("DECLINING")
    )
    decision = F.create_map(*[F.lit(x) for kv in STAGE_DECISION.items() for x in kv])
    df = df.withColumn("stage", stage)
    rounded = [F.round(c, 6).alias(c) for c in ("growth", "momentum", "saturation")]
    return df.select("trend_id", "n", "first_at", "last_at", "breadth", *rounded, "stage", decision[F.col("stage")].alias("decision"))


def breaker_state(fetch_log: DataFrame) -> DataFrame:
    """Running consecutive transport failures of each source, in order of distinct ids; from the third on the breaker is open for 30 min * 2^k, 6 h at most.
    A source's log is scanned in slices, so one that holds most of the rows is many tasks."""
    df = run_length(fetch_log, ["source_id"], "id", F.col("outcome").isin(*FAILURES), "failures")
    over = F.least(F.col("failures") - BREAKER_AFTER, F.lit(10))
    wait = F.least(F.lit(BREAKER_MOST), BREAKER_FIRST * F.pow(F.lit(2), over)).cast("long")
    return df.select("id", "source_id", F.col("failures").cast("long"), F.when(F.col("failures") >= BREAKER_AFTER, F.col("started_at") + wait).alias("open_until"))


def plan_alerts(alerts: DataFrame, sent: DataFrame, floor: str = "high", cap: int = 4, quiet: tuple[int, int] = (23, 7), minute: str = "minute") -> DataFrame:
    """Decision for each alert in order: tier floor, duplicate, quiet hours (urgent passes), cap.

    Survivors pass the first three; the first of each key is sent while the cap lasts, so rank among the first ones is enough."""
    tiers = F.when(F.col("tier") == "urgent", 3).when(F.col("tier") == "high", 2).otherwise(1)
    least = {"urgent": 3, "high": 2, "low": 1}[floor]
    hour = F.floor(F.col(minute) / 60)
    asleep = ((hour >= quiet[0]) | (hour < quiet[1])) & (F.col("tier") != "urgent")
    already = sent.select("dedupe_key").distinct().withColumn("_sent", F.lit(True))
    df = alerts.join(already, "dedupe_key", "left").withColumn("_alive", (tiers >= least) & F.col("_sent").isNull() & ~asleep)
    first = df.where("_alive").groupBy("dedupe_key").agg(F.min("seq").alias("_first"))
    df = df.join(first, "dedupe_key", "left")
    leads = df.where("_alive and seq = _first").select("seq").orderBy("seq").limit(cap).withColumn("_go", F.lit(True))
    df = df.join(F.broadcast(leads), "seq", "left")
    sent_first = df.where("_go").select("dedupe_key", F.col("seq").alias("_when"))
    df = df.join(F.broadcast(sent_first), "dedupe_key", "left")
    decision = (
        F.when(tiers < least, "below_tier")
        .when(F.col("_sent").isNotNull() | (F.col("_when") < F.col("seq")), "duplicate")
        .when(asleep, "quiet_hours")
        .when(F.col("_go"), "sent")
        .otherwise("daily_cap")
    )
    return df.select("seq", "tier", "dedupe_key", decision.alias("decision"))



def plan_alerts_by_day(alerts: DataFrame, sent: DataFrame, floor: str = "high", cap: int = 4, quiet: tuple[int, int] = (23, 7)) -> DataFrame:
    """The same decisions over any number of days, in order of ``(day, seq)``: ``alerts(seq, day, minute, tier, dedupe_key)`` with distinct ``seq`` and whole day numbers,
    ``sent(dedupe_key, day)`` the alerts that went out before. A day sends ``cap`` less what ``sent`` has of it; a key that the cap held back may go on a later day.

    On the i-th day at most ``cap * (i - 1)`` keys have gone before, so its first ``cap * i`` keys decide it: only these rows, whose number follows from the days and
    not from the alerts, pass in order through one task. Null days, tiers and keys are none of the listed: such alerts are below the tier or never equal."""
    import pyarrow as pa

    tiers = F.when(F.col("tier") == "urgent", 3).when(F.col("tier") == "high", 2).otherwise(1)
    least = {"urgent": 3, "high": 2, "low": 1}[floor]
    hour = F.floor(F.col("minute") / 60)
    asleep = ((hour >= quiet[0]) | (hour < quiet[1])) & (F.col("tier") != "urgent")
    already = sent.select("dedupe_key").distinct().withColumn("_sent", F.lit(True))
    df = alerts.select("seq", "day", "tier", "dedupe_key", (tiers < least).alias("_low"), asleep.alias("_asleep")).join(already, "dedupe_key", "left")
    leads = df.where("not _low and _sent is null and not _asleep and day is not null and dedupe_key is not null").groupBy("day", "dedupe_key").agg(F.min("seq").alias("seq"))
    first_day, last_day = alerts.agg(F.min("day"), F.max("day")).first()
    span = 0 if first_day is None else last_day - first_day + 1
    place = F.row_number().over(Window.partitionBy("day").orderBy("seq"))
    near = leads.withColumn("_rn", place).where(F.col("_rn") <= cap * span).where(F.col("_rn") <= cap * (F.col("day") - F.lit(first_day) + 1))
    near = near.join(sent.groupBy("day").agg(F.count("*").alias("_gone")), "day", "left").select("day", "seq", "dedupe_key", (cap - F.coalesce("_gone", F.lit(0))).alias("_left"))

    def fold(batches):
        gone, today, count = set(), None, 0
        for batch in batches:
            out = []
            for day, seq, key, left in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if day != today:
                    today, count = day, 0
                if count < left and key not in gone:
                    gone.add(key)
                    count += 1
                    out.append((key, day, seq))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["dedupe_key", "_day", "_when"])

    near = near.select(F.col("day").cast("long"), F.col("seq").cast("long"), "dedupe_key", F.col("_left").cast("long"))
    went = near.repartition(1).sortWithinPartitions("day", "seq").mapInArrow(fold, "dedupe_key string, _day long, _when long")
    df = df.join(went, "dedupe_key", "left")
    decision = (
        F.when(F.col("_low"), "below_tier")
        .when(F.col("_sent").isNotNull() | F.coalesce((F.col("_day") < F.col("day")) | ((F.col("_day") == F.col("day")) & (F.col("_when") < F.col("seq"))), F.lit(False)), "duplicate")
        .when(F.col("_asleep"), "quiet_hours")
        .when(F.col("_when") == F.col("seq"), "sent")
        .otherwise("daily_cap")
    )
    return df.select("seq", "day", "tier", "dedupe_key", decision.alias("decision"))


#: Shares of the daily budget at which the mode changes.
MODES = ((1.0, "SUSPENDED"), (0.9, "TRIAGE"), (0.7, "FRUGAL"))


def mode_of(spent: Column, budget: int) -> Column:
    out = F.lit("NORMAL")
    for share, name in reversed(MODES):
        out = F.when(spent >= share * budget, name).otherwise(out)
    return out


def budget_state(ledger: DataFrame, budget: int) -> DataFrame:
    """Running spend of each UTC day before each call, and the mode that it puts the next call in. A day is scanned in slices of its ids."""
    df = sum_before(ledger.withColumn("day", F.floor(F.col("spent_at") / DAY)), ["day"], "id", F.coalesce("cost_micro", F.lit(0)), "spent_before")
    return df.select("id", F.col("day").cast("long"), "cost_micro", "spent_before", mode_of(F.col("spent_before"), budget).alias("mode"))


def budget_decisions(calls: DataFrame, budget: int) -> DataFrame:
    """The sequential form: a call whose cost would pass the budget is refused and spends nothing. Each decision needs the one before it, so a
    day's calls stream in order of id through one task, which holds a batch and the day's sum; Spark sorts them, on disk where they are many.
    A call without a cost is refused."""
    import pyarrow as pa

    def fold(batches):
        today, spent = None, 0
        for batch in batches:
            before, allowed = [], []
            for day, cost in zip(batch.column("day").to_pylist(), batch.column("cost_micro").to_pylist()):
                if day != today:
                    today, spent = day, 0
                fits = cost is not None and spent < budget and spent + cost <= budget
                before.append(spent)
                allowed.append(fits)
                spent += cost if fits else 0
            rows = [*batch.select(["id", "day", "cost_micro"]).columns, pa.array(before, pa.int64()), pa.array(allowed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(rows, names=["id", "day", "cost_micro", "spent_before", "allowed"])

    df = calls.select(F.col("id").cast("long"), F.floor(F.col("spent_at") / DAY).cast("long").alias("day"), F.col("cost_micro").cast("long"))
    ordered = df.repartition("day").sortWithinPartitions("day", "id")
    return ordered.mapInArrow(fold, "id long, day long, cost_micro long, spent_before long, allowed boolean")


def publication_audit(posts: DataFrame, longest: int = 280, per_day: int = 5, gap: int = 1800) -> DataFrame:
    """Faults of each post ``(post_id, author, text, reviewed_hash, posted_at)``: empty, too long, changed since review, over the day's limit, too soon. An
    author's posts are scanned in slices of an hour."""
    text = F.coalesce("text", F.lit(""))
    posts = sum_before(posts.withColumn("_day", F.floor(F.col("posted_at") / DAY)), ["author", "_day"], "posted_at", F.lit(1), "_earlier", ["post_id"], 3600)
    posts = value_before(posts, ["author"], "posted_at", "_last", ["post_id"], 3600)
    faults = F.array_compact(
        F.array(
            F.when(F.trim(text) == "", "empty"),
            F.when(F.length(text) > longest, "too_long"),
            F.when(F.md5(text) != F.col("reviewed_hash"), "changed"),
            F.when(F.col("_earlier") >= per_day, "over_daily_limit"),
            F.when(F.col("posted_at") - F.col("_last") < gap, "too_soon"),
        )
    )
    return posts.select("post_id", F.array_join(faults, ",").alias("faults"))


def largest_clusters(events: DataFrame, evidence: DataFrame, recent: int = 500, top: int = 5) -> DataFrame:
    """Of the ``recent`` newest events, the ``top`` with the most evidence (more than one)."""
    newest = events.orderBy(F.desc("first_seen_at"), F.desc("event_id")).limit(recent).select("event_id")
    counts = evidence.join(F.broadcast(newest), "event_id").groupBy("event_id").agg(F.count("*").alias("evidence_count"))
    return counts.where("evidence_count > 1").orderBy(F.desc("evidence_count"), "event_id").limit(top)


def recent(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows; ties by greatest key."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def page_after(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """Keyset page."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Point read; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))
