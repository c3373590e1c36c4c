"""Explainable weighted scores with rule caps, the rule gate, and replay under other weights.

Events carry ``event_id, title, summary, category, entities, artifacts(models, versions, repos, title_models, title_versions), occurred_at, occurred_estimated,
first_seen_at, injection_flagged`` and a nested ``evidence`` array ``(published_at, source_id, source_category, is_official, reliability)``, so that a score is one
projection without a shuffle. A component is clamp01(value) * weight; a score is the rounded hundredfold of the clamped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400

# Weights and thresholds of the scores.
IMPORTANCE = {"source_reliability": 0.24, "corroboration": 0.2, "novelty": 0.16, "technical_impact": 0.16, "velocity": 0.12, "recency": 0.12}
RELEVANCE = {"entity_proximity": 0.3, "testability": 0.28, "differentiation": 0.22, "teaching_potential": 0.2}
VELOCITY = {"corroboration_rate": 0.45, "community_pickup": 0.35, "community_breadth": 0.2}
CATEGORY_IMPORTANCE = {"ai": 0.9, "software": 0.7, "hardware": 0.65, "policy_platform": 0.8, "social_trend": 0.5}
HALF_LIFE_HOURS, SATURATION, VELOCITY_HOURS, EXPERT_PENALTY = 18, 5, 6, 0.25
IMPACT_TERMS = (
    (r"(?i)\b(?:breaking change|backwards[- ]incompatible|deprecat\w+|end[- ]of[- ]life|sunset)\b", 1.0),
    (r"(?i)\b(?:outage|incident|degraded|elevated error rates?|down for)\b", 0.9),
    (r"(?i)\b(?:open[- ]?weights?|open[- ]?sourc\w+|apache 2\.0|mit licen[cs]e)\b", 0.85),
    (r"(?i)\b(?:price|pricing|cost per|per million tokens?|free tier|rate limits?)\b", 0.8),
    (r"(?i)\b(?:release[sd]?|launch\w*|general availability|now available|ships?)\b", 0.7),
    (r"(?i)\b(?:benchmark|state[- ]of[- ]the[- ]art|sota|outperform\w*)\b", 0.55),
    (r"(?i)\b(?:context window|throughput|latency|tokens? per second)\b", 0.6),
    (r"(?i)\b(?:preview|beta|experimental|research preview)\b", 0.45),
)
TEACHING_TERMS = (
    r"(?i)\b(?:how to|tutorial|guide|walkthrough|worked example|step[- ]by[- ]step)\b",
    r"(?i)\b(?:technique|pattern|workflow|recipe|approach)\b",
    r"(?i)\b(?:gotcha|pitfall|caveat|limitation|failure mode|does ?n[o']t work)\b",
    r"(?i)\b(?:benchmark|measured|we tested|in practice|real[- ]world)\b",
    r"(?i)\b(?:migration|upgrade path|breaking change)\b",
)
TESTABLE = {
    "anthropic": 1.0, "supabase": 1.0, "flutter": 0.95, "vercel": 0.9, "openai": 0.85, "huggingface": 0.8, "github": 0.75, "google-deepmind": 0.7, "cloudflare": 0.65, "alibaba": 0.6,
    "deepseek": 0.6, "mistral": 0.6, "meta": 0.55, "google": 0.5, "microsoft": 0.45, "nvidia": 0.4, "amazon": 0.4, "xai": 0.4, "apple": 0.25,
}
CONFIDENCE = {"OFFICIAL_SOURCE": 1.0, "TECHNICAL_RESEARCHER": 0.7, "EXPERT_ANALYST": 0.65, "EARLY_SIGNAL": 0.5, "JOURNALIST": 0.45, "COMMUNITY_SIGNAL": 0.25, "AMPLIFIER": 0.1}
CONFIDENCE_HIGH, CONFIDENCE_MED, CONFIDENCE_SOURCES = 0.75, 0.45, 2
LEVELS = ("LOW", "MED", "HIGH")
TAGS = ("SPECULATIVE", "INFERRED", "OBSERVED", "VERIFIED")
LEVEL_VALUE = {"HIGH": 1.0, "MED": 0.6, "LOW": 0.25}

# The gate.
NOISE_TITLES = (r"(?i)\b(?:promo|discount|coupon)\s+codes?\b", r"(?i)\b\d+%\s+off\b", r"(?i)^best\s+\d+\b", r"(?i)\bdeals?\s+(?:of the day|this week)\b", r"(?i)\bgift guide\b", r"(?i)^\s*(?:re:|fwd:)")
ACTIVITY_SOURCES = ("gh-user-simonw", "gh-user-karpathy", "gh-user-ggerganov")
ACTIVITY_TITLES = (r"(?i)\b(?:commented on|opened|closed|reopened|contributed to|starred|forked|deleted)\b", r"(?i)\bpushed\b")
CORROBORATED_SOURCES = ("arxiv-cs-ai",)
OFF_TOPIC: tuple[str, ...] = ()
MAX_AGE_DAYS, MIN_IMPORTANCE, MIN_COMBINED = 7, 20, 30


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(0.0))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(p))
    return out


def _total(components: list[tuple[str, Column, float]]) -> Column:
    out = F.lit(0.0)
    for _, value, weight in components:
        out = out + clamp(value) * weight
    return F.round(clamp(out) * 100).cast("long")


def _explained(components: list[tuple[str, Column, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), clamp(v).alias("value"), F.lit(w).alias("weight"), (clamp(v) * w).alias("contribution")) for n, v, w in components])


def _hours(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0.0), (later - earlier) / HOUR)


def _sources(where=None) -> Column:
    rows = F.col("evidence") if where is None else F.filter("evidence", where)
    return F.array_distinct(F.transform(rows, lambda e: e["source_id"]))


def _text() -> Column:
    return F.concat_ws("\n", "title", "summary")


def velocity_parts() -> list[tuple[str, Column, float]]:
    first = F.array_min(F.transform("evidence", lambda e: e["published_at"]))
    followers = F.greatest(F.size(F.filter("evidence", lambda e: (e["published_at"] - first) / HOUR <= VELOCITY_HOURS)) - 1, F.lit(0))
    community = F.size(_sources(lambda e: e["source_category"] == "COMMUNITY_SIGNAL"))
    values = (followers / SATURATION, F.when(community > 0, 1.0).otherwise(0.0), community / 3)
    return [(n, v, w) for (n, w), v in zip(VELOCITY.items(), values)]


def importance_parts(now: int | Column) -> list[tuple[str, Column, float]]:
    now = F.lit(now) if isinstance(now, int) else now
    impact = F.greatest(*[F.when(F.rlike(_text(), F.lit(p)), w).otherwise(0.0) for p, w in IMPACT_TERMS], _lookup(CATEGORY_IMPORTANCE, F.col("category")) * 0.5)
    values = (
        F.coalesce(F.array_max(F.transform("evidence", lambda e: e["reliability"])), F.lit(0.0)),
        F.size(_sources()) / SATURATION,
        F.when(F.col("occurred_estimated"), 0.5).otherwise(1 - _hours(F.col("first_seen_at"), F.col("occurred_at")) / 72),
        impact,
        F.col("velocity") / 100,
        F.pow(F.lit(0.5), _hours(now, F.col("occurred_at")) / HALF_LIFE_HOURS),
    )
    return [(n, v, w) for (n, w), v in zip(IMPORTANCE.items(), values)]


def relevance_parts(entity_weights: dict[str, float]) -> list[tuple[str, Column, float]]:
    best = lambda table: F.coalesce(F.array_max(F.transform("entities", lambda e: _lookup(table, e))), F.lit(0.0))
    artifact = (F.size("artifacts.models") > 0) | (F.size("artifacts.versions") > 0)
    experts = F.size(_sources(lambda e: e["source_category"] == "EXPERT_ANALYST"))
    teaching = sum((F.when(F.rlike(_text(), F.lit(p)), 1).otherwise(0) for p in TEACHING_TERMS), F.lit(0))
    values = (best(entity_weights), best(TESTABLE) * F.when(artifact, 1.0).otherwise(0.6), 1 - experts * EXPERT_PENALTY, teaching / 3)
    return [(n, v, w) for (n, w), v in zip(RELEVANCE.items(), values)]


def confidence_columns(df: DataFrame) -> DataFrame:
    """Adds ``confidence``, ``evidence_tag`` and ``caps`` (which caps lowered something). Caps only ever lower."""
    sources, official = F.size(_sources()), F.exists("evidence", lambda e: e["is_official"])
    best = F.coalesce(F.array_max(F.transform("evidence", lambda e: _lookup(CONFIDENCE, e["source_category"]))), F.lit(0.0))
    raw = clamp(best) * 0.65 + clamp(sources / CONFIDENCE_SOURCES) * 0.35
    df = df.withColumns(
        {
            "_level": F.when(raw >= CONFIDENCE_HIGH, 2).when(raw >= CONFIDENCE_MED, 1).otherwise(0),
            "_tag": F.when(official, 3).when(sources >= 2, 2).otherwise(1),
            "_official": official,
            "_single": sources < CONFIDENCE_SOURCES,
        }
    )
    flagged, estimated = F.col("injection_flagged"), F.col("occurred_estimated")
    level, tag = F.col("_level"), F.col("_tag")
    steps = [
        ("no_official_source", ~F.col("_official"), 0, 0, lambda l, t: (l > 0) | (t > 0)),
        ("single_source", F.col("_single"), 1, 3, lambda l, t: l == 2),
        ("injection", flagged, 0, 1, lambda l, t: (l > 0) | (t == 3)),
        ("estimated_time", estimated, 2, 2, lambda l, t: t == 3),
    ]
    caps = []
    for name, applies, most_level, most_tag, lowers in steps:
        caps.append(F.when(applies & lowers(level, tag), name))
        level = F.when(applies, F.least(level, F.lit(most_level))).otherwise(level)
        tag = F.when(applies, F.least(tag, F.lit(most_tag))).otherwise(tag)
    names = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    df = df.withColumns({"confidence": names(LEVELS, level), "evidence_tag": names(TAGS, tag), "caps": F.array_compact(F.array(*caps))})
    return df.drop("_level", "_tag", "_official", "_single")


def score_events(events: DataFrame, now: int | Column, entity_weights: dict[str, float], breakdown: bool = False) -> DataFrame:
    """Adds ``velocity, importance, relevance, confidence, evidence_tag, caps, combined``, and the components with ``breakdown``."""
    df = events.withColumn("velocity", _total(velocity_parts()))
    importance, relevance = importance_parts(now), relevance_parts(entity_weights)
    df = confidence_columns(df.withColumn("importance", _total(importance)).withColumn("relevance", _total(relevance)))
    if breakdown:
        df = df.withColumn("importance_parts", _explained(importance)).withColumn("relevance_parts", _explained(relevance))
    combined = (F.col("importance") * 0.55 + F.col("relevance") * 0.45) * (0.6 + 0.4 * _lookup(LEVEL_VALUE, F.col("confidence")))
    return df.withColumn("combined", F.round(combined).cast("long"))


def gate_rule(now: int | Column, importance: str = "importance", combined: str = "combined") -> Column:
    """The first rule that kills the event, or null."""
    now = F.lit(now) if isinstance(now, int) else now
    sources = _sources()
    among = lambda names: F.exists(sources, lambda s: s.isin(*names))
    released = (F.size("artifacts.versions") > 0) | (F.size("artifacts.models") > 0)
    titled = (F.size("artifacts.title_models") > 0) | (F.size("artifacts.title_versions") > 0)
    others = F.filter(sources, lambda s: ~s.isin(*CORROBORATED_SOURCES))
    return (
        F.when(_any(F.col("title"), NOISE_TITLES), "noise_title")
        .when(among(ACTIVITY_SOURCES) & _any(F.col("title"), ACTIVITY_TITLES) & ~released, "activity_noise")
        .when((now - F.col("occurred_at")) / DAY > MAX_AGE_DAYS, "too_old")
        .when((F.size(sources) < 2) & ~titled, "uncorroborated_and_unspecific")
        .when(F.col("category").isin(*OFF_TOPIC) if OFF_TOPIC else F.lit(False), "off_topic")
        .when(among(CORROBORATED_SOURCES) & (F.size(others) == 0), "arxiv_uncorroborated")
        .when(F.col(importance) < MIN_IMPORTANCE, "below_importance_floor")
        .when(F.col(combined) < MIN_COMBINED, "below_combined_floor")
    )


def apply_gate(scored: DataFrame, now: int | Column) -> DataFrame:
    df = scored.withColumn("killed_by", gate_rule(now))
    return df.withColumn("gate_passed", F.col("killed_by").isNull())


def replay(scored: DataFrame, candidates: list[dict], now: int | Column) -> DataFrame:
    """``candidate, event_id, passed, rule``: the gate under each candidate's multipliers, floor and age limit. As in the reference behaviour, the
    combined score of a candidate leaves out the confidence factor."""
    now = F.lit(now) if isinstance(now, int) else now
    number = lambda c, k: F.lit(c.get(k)).cast("double").alias(k)
    rows = F.array(*[F.struct(F.lit(c["name"]).alias("name"), number(c, "importance_multiplier"), number(c, "relevance_multiplier"), number(c, "min_combined"), number(c, "max_age_days")) for c in candidates])
    df = scored.withColumn("c", F.explode(rows))
    bounded = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))
    weighed = F.col("importance") * F.col("c.importance_multiplier") * 0.55 + F.col("relevance") * F.col("c.relevance_multiplier") * 0.45
    df = df.withColumn("_combined", bounded(weighed)).withColumn("_importance", bounded(F.col("importance") * F.col("c.importance_multiplier")))
    low = F.coalesce(F.col("_combined") < F.col("c.min_combined"), F.lit(False))
    old = F.coalesce((now - F.col("occurred_at")) / DAY > F.col("c.max_age_days"), F.lit(False))
    rule = F.when(low, "candidate_min_combined").when(old, "candidate_max_age").otherwise(gate_rule(now, "_importance", "_combined"))
    return df.select(F.col("c.name").alias("candidate"), "event_id", rule.isNull().alias("passed"), rule.alias("rule"))


def replay_summary(replayed: DataFrame) -> DataFrame:
    df = replayed.groupBy("candidate").agg(F.count("*").alias("total"), F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("passed"))
    return df.select("candidate", "total", "passed", F.round((F.col("total") - F.col("passed")) / F.col("total"), 6).alias("kill_rate"))


def classify_outcome(posts: DataFrame) -> DataFrame:
    """Verdict on ``posts(post_id, impressions, reposts, high_signal_replies, mentions_by_respected, conversation_depth, follows)``."""
    wide = (F.col("impressions") > 10_000) | (F.col("reposts") > 50)
    authoritative = (F.col("high_signal_replies") > 0) | (F.col("mentions_by_respected") > 0) | (F.col("conversation_depth") >= 3)
    verdict = F.when(wide & ~authoritative, "low_quality_virality").when(authoritative & (F.col("follows") > 0), "authority_growth").when(authoritative, "mixed").otherwise("quiet")
    return posts.select("post_id", verdict.alias("verdict"))
