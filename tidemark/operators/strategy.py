"""Angles, options and recommendations of events, and alerts of sources and events: rule chains as column expressions.

Inputs carry ``event_id, title, summary, testable, has_version, has_official, source_count, expert_count, still_unknown, do_not_say, confidence, relevance,
combined, hours_since, injection_flagged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edged

HOUR, DAY = 3600, 86_400
EARLY_HOURS = 6

# Rumours (the sixth alternative binds as written: any word beginning with "may", or "might"), and accusations.
RUMOUR = (
    r"(?i)\b(?:rumou?r(?:ed|s)?|leaked?|leak)\b",
    r"(?i)\b(?:reportedly|allegedly|purportedly|supposedly)\b",
    r"(?i)\b(?:sources? (?:say|claim|tell|familiar)|people familiar with)\b",
    r"(?i)\b(?:unconfirmed|not (?:yet )?confirmed|awaiting confirmation)\b",
    r"(?i)\b(?:said to be|believed to be|understood to be)\b",
    r"(?i)\b(?:in talks|exploring|considering|weighing)\s+(?:a|an|to)\b",
    r"(?i)\bmay|might|could\s+(?:soon\s+)?(?:launch|release|announce|acquire|ship)\b",
)
ACCUSATION = (
    r"(?i)\b(?:accus\w+|alleg\w+|blames?|blamed)\b",
    r"(?i)\b(?:stole|stolen|theft|plagiaris\w+|copied without|ripped off)\b",
    r"(?i)\b(?:fraud\w*|scam|deceptive|misleading claims?|faked?|fabricat\w+)\b",
    r"(?i)\b(?:lawsuit|sues?|sued|suing|legal action|cease and desist|injunction)\b",
    r"(?i)\b(?:violat\w+|breach(?:ed|es)?|infring\w+)\b.{0,40}\b(?:licen[cs]e|terms|patent|copyright|contract)\b",
    r"(?i)\b(?:attributed? to|linked to|traced to|blamed on)\b.{0,40}\b(?:attack|breach|hack|group|actor|state)\b",
    r"(?i)\b(?:cheat\w+|gam(?:ed|ing) the benchmark|benchmark(?:s)? (?:were|was) (?:rigged|manipulated))\b",
    r"(?i)\b(?:misconduct|unethical|wrongdoing|cover[- ]?up)\b",
)
# Signals of the angles, in order.
ANGLES = {
    "technical_explanation": r"(?i)\b(?:how it works|architecture|implementation|under the hood|mechanism|algorithm|protocol|api|sdk|runtime)\b",
    "comparison": r"(?i)\b(?:versus|vs\.?|compared to|competitor|alternative|rival|outperform\w*|beats?|matches)\b",
    "version_diff": r"(?i)\b(?:v?\d+\.\d+|version|release|update|upgrade|changelog|migration|breaking)\b",
    "benchmark_interpretation": r"(?i)\b(?:benchmark|score[sd]?|eval|evaluation|sota|state[- ]of[- ]the[- ]art|leaderboard|accuracy|pass@)\b",
    "cost_implication": r"(?i)\b(?:price|pricing|cost|per million|per token|free tier|rate limit|quota|billing|\$)\b",
    "second_order_effect": r"(?i)\b(?:deprecat\w+|end[- ]of[- ]life|sunset|migration|breaking change|licen[cs]e|terms|policy)\b",
    "myth_correction": r"(?i)\b(?:actually|contrary to|misconception|myth|commonly believed|not what|clarif\w+|correction)\b",
    "skepticism": r"(?i)\b(?:claims?|reportedly|allegedly|according to|unconfirmed|rumou?r|leak|sources say|we believe)\b",
}
TEACHABLE = ("technical_explanation", "cost_implication", "benchmark_interpretation", "myth_correction")
TEACHING = ("technical_explanation", "cost_implication", "comparison", "version_diff", "benchmark_interpretation", "myth_correction")
EXPERIMENT_MINUTES = {"technical_explanation": 45, "cost_implication": 60, "comparison": 90, "version_diff": 60, "benchmark_interpretation": 90}
MOST_MINUTES = 120
CONFIDENCE_FACTOR = {"HIGH": 1.0, "MED": 0.75, "LOW": 0.4}


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, edged(p))
    return out


def _text() -> Column:
    return F.concat_ws("\n", "title", "summary")


def forcing_rule() -> Column:
    """accusation (with a manual flag), injection, rumour, thin evidence; null if none applies."""
    return (
        F.when(_any(_text(), ACCUSATION), "accusation")
        .when(F.col("injection_flagged"), "injection_flagged")
        .when(_any(_text(), RUMOUR), "rumour_or_leak")
        .when(~F.col("has_official") & (F.col("source_count") < 2), "thin_evidence")
    )


def find_angles(events: DataFrame) -> DataFrame:
    """Adds ``angles``: (kind, strength) of those that apply, strongest first, in listed order among equals; experts crowd all of them."""
    has = lambda k: F.rlike(_text(), edged(ANGLES[k]))
    thin = ~F.col("has_official") | (F.col("source_count") < 2)
    gap = F.exists("still_unknown", lambda u: F.rlike(u, F.lit("(?i)method|how|measur|detail")))
    strength = {
        "technical_explanation": F.when(F.col("testable") & (has("technical_explanation") | F.col("has_version")), 0.9),
        "comparison": F.when(has("comparison") & F.col("has_version"), 0.7),
        "version_diff": F.when(F.col("has_version") & has("version_diff"), 0.75),
        "benchmark_interpretation": F.when(has("benchmark_interpretation"), F.when(gap, 0.8).otherwise(0.55)),
        "cost_implication": F.when(has("cost_implication"), 0.85),
        "second_order_effect": F.when(has("second_order_effect"), 0.8),
        "myth_correction": F.when(has("myth_correction"), 0.7),
        "skepticism": F.when(has("skepticism") | thin, F.when(thin, 0.75).otherwise(0.5)),
    }
    left = 1 - F.least(F.lit(0.6), F.col("expert_count") * 0.2)
    all_ = F.array(*[F.struct((-s * left).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(strength.items())])
    ordered = F.array_sort(F.filter(all_, lambda a: a["s"].isNotNull()))
    return events.withColumn("angles", F.transform(ordered, lambda a: F.struct(a["kind"].alias("kind"), (-a["s"]).alias("strength"))))


def content_options(events: DataFrame) -> DataFrame:
    """Adds ``options``: (kind, fit) of quote, reply, original, educational and wait, best first."""
    best = F.get("angles", F.lit(0))["strength"]
    none = F.size("angles") == 0
    teachable = F.get(F.filter("angles", lambda a: a["kind"].isin(*TEACHABLE)), F.lit(0))["strength"]
    factor = F.create_map(*[F.lit(x) for kv in CONFIDENCE_FACTOR.items() for x in kv])[F.col("confidence")]
    unknown = F.size("still_unknown")
    fits = {
        "quote": F.when(none, 0.15).otherwise(F.least(F.lit(0.85), best * F.when(F.col("hours_since") <= EARLY_HOURS, 1.0).otherwise(0.5))) * factor,
        "reply": F.when(none, 0.1).otherwise(F.least(F.lit(0.7), best * F.when(F.col("expert_count") > 0, 0.9).otherwise(0.5))) * factor,
        "original": F.when(none, 0.1).otherwise(F.least(F.lit(1.0), best + F.when(F.col("testable"), 0.15).otherwise(0.0))) * factor,
        "educational": F.when(teachable.isNull(), 0.1).otherwise(F.least(F.lit(0.9), teachable * 0.95)) * factor,
        "wait": F.when(F.col("confidence") == "LOW", 0.9).when(unknown > 2, 0.6).otherwise(0.2),
    }
    all_ = F.array_sort(F.array(*[F.struct((-f).alias("f"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, f) in enumerate(fits.items())]))
    return events.withColumn("options", F.transform(all_, lambda o: F.struct(o["kind"].alias("kind"), (-o["f"]).alias("fit"))))


def recommend(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``event_id, action, reason, option, manual_flag``, and the columns to keep: forcing first, then the refusals in order, then when to post."""
    df = content_options(find_angles(events)).withColumn("forced", forcing_rule())
    best = F.get("angles", F.lit(0))["strength"]
    experts = F.col("expert_count")
    refused = (
        F.when(F.size("angles") == 0, "no_unique_angle")
        .when(experts >= 3, "saturated")
        .when((experts >= 1) & (best < 0.5), "better_explained_elsewhere")
        .when(F.col("confidence") == "LOW", "weak_evidence")
        .when(F.size("still_unknown") >= 4, "insufficient_information")
        .when(F.col("relevance") < 30, "low_authority_gain")
        .when(F.size("do_not_say") >= 5, "reputational_risk")
    )
    option = F.get(F.filter("options", lambda o: o["kind"] != "wait"), F.lit(0))
    now = (option["fit"] >= 0.6) & (F.col("combined") >= 50) & (F.col("hours_since") <= EARLY_HOURS)
    action = F.when(F.col("forced") == "accusation", "VERIFY").when(F.col("forced").isNotNull(), "WAIT").when(refused.isNotNull(), "DONT_POST").when(now, "POST_NOW").otherwise("POST_SOON")
    chosen = F.when(F.col("forced").isNotNull(), "wait").when(refused.isNull(), option["kind"])
    return df.select("event_id", action.alias("action"), F.coalesce("forced", refused, F.lit("none")).alias("reason"), chosen.alias("option"), (F.coalesce("forced", F.lit("")) == "accusation").alias("manual_flag"), *(keep or []))


def rank_stream(scores: DataFrame, events: DataFrame, evidence: DataFrame, items: DataFrame, sources: DataFrame, analyses: DataFrame, now: int, limit: int = 200) -> DataFrame:
    """The list that is read first: the ``limit`` best of the latest scores that passed the gate, each with its facts, what its latest good analysis said, and the
    recommendation that follows; best first, ties by event.

    ``scores(id, event_id, importance, relevance, combined, confidence, evidence_tag, caps, entities, testability, source_count, gate_passed)``, ``events(event_id, title, category,
    occurred_at)``, ``analyses(id, event_id, status, payload)`` with JSON payloads. An event without an analysis, or whose payload is no JSON, has nothing unknown and
    nothing that must not be said. Strategy sees the title alone. Evidence and analyses are narrowed to the list's events (``limit`` ids, broadcast) before they are grouped."""
    from .aggregates import evidence_facts
    from .history import latest, latest_scores
    from .scoring import TESTABLE

    page = latest_scores(scores, limit, passed_only=True)
    ids = F.broadcast(page.select("event_id"))
    listed = lambda df: df.join(ids, "event_id", "left_semi")
    facts = evidence_facts(listed(evidence), items, sources)
    payload, none = F.try_parse_json("payload"), F.array().cast("array<string>")
    texts = lambda key: F.coalesce(F.try_variant_get(payload, f"$.{key}", "array<string>"), none)
    said = latest(listed(analyses.select("id", "event_id", "status", "payload")).where("status = 'ok'"), "event_id").select(
        "event_id", F.col("id").alias("analysis_id"), texts("stillUnknown").alias("still_unknown"), texts("doNotSay").alias("do_not_say"), F.try_variant_get(payload, "$.injectionObserved", "boolean").alias("injection")
    )
    df = page.join(listed(events.select("event_id", "title", "category", "occurred_at")), "event_id").join(facts, "event_id", "left").join(said, "event_id", "left")
    ready = [e for e, w in TESTABLE.items() if w >= 0.8]
    df = df.withColumns(
        {
            "summary": F.lit(""), "testable": (F.col("testability") > 0.5) | F.exists("entities", lambda e: e.isin(*ready)), "expert_count": F.coalesce("experts", F.lit(0)),
            "has_official": F.coalesce("has_official", F.lit(False)), "has_version": F.coalesce("has_version", F.lit(False)), "still_unknown": F.coalesce("still_unknown", none),
            "do_not_say": F.coalesce("do_not_say", none), "injection_flagged": F.coalesce("injection", F.lit(False)), "hours_since": F.greatest(F.lit(0.0), (F.lit(now) - F.col("occurred_at")) / HOUR),
        }
    )
    shown = ["title", "category", "occurred_at", "importance", "relevance", "combined", "confidence", "evidence_tag", "caps", "entities", "source_count", "has_official", "has_version", "expert_count", "analysis_id"]
    return recommend(df, keep=shown).orderBy(F.desc("combined"), "event_id")


def teaching_candidates(events: DataFrame) -> DataFrame:
    """Events with a teachable angle that can be tested (a myth's correction need not be)."""
    df = find_angles(events)
    angle = F.get(F.filter("angles", lambda a: a["kind"].isin(*TEACHING)), F.lit(0))["kind"]
    return df.select("event_id", angle.alias("angle"), "testable").where("angle is not null and (testable or angle = 'myth_correction')").select("event_id", "angle")


def experiment_queue(events: DataFrame) -> DataFrame:
    """Testable events whose best angle has an experiment of at most ``MOST_MINUTES``."""
    minutes = F.create_map(*[F.lit(x) for kv in EXPERIMENT_MINUTES.items() for x in kv])
    df = find_angles(events).where("testable").select("event_id", F.get("angles", F.lit(0))["kind"].alias("angle"))
    return df.withColumn("minutes", minutes[F.col("angle")]).where(F.col("minutes") <= MOST_MINUTES)


def trend_cards(trends: DataFrame, observations: DataFrame, now: int) -> DataFrame:
    """Lifecycle of each trend with its observations' span and its missing fields; observations with a column ``manual`` also say whether any was made by hand."""
    from .history import trend_lifecycle

    life = trend_lifecycle(observations, now)
    df = trends.join(life, "trend_id", "left")
    by_hand = []
    if "manual" in observations.columns:
        df = df.join(observations.groupBy("trend_id").agg(F.max("manual").alias("_manual")), "trend_id", "left")
        by_hand = [F.coalesce("_manual", F.lit(False)).alias("any_manual")]
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in trends.columns if c != "trend_id"]))
    return df.select("trend_id", F.coalesce("n", F.lit(0)).alias("n"), "first_at", "last_at", F.coalesce("stage", F.lit("UNKNOWN")).alias("stage"), F.coalesce("decision", F.lit("IGNORE")).alias("decision"), F.array_join(missing, ",").alias("missing"), *by_hand)


# Hours of silence until an alert, and seconds until a source counts as stale, by priority.
FRESHNESS_HOURS, FRESHNESS_ELSE = {1: 6, 2: 24, 3: 72, 4: 168}, 72
STALE_SECONDS = {1: 6 * HOUR, 2: 24 * HOUR, 3: 72 * HOUR, 4: 14 * DAY}


def _by_priority(values: dict[int, int], default: int | None) -> Column:
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(F.col("priority") == k, v).otherwise(out)
    return out


def dedupe_key(tier: Column, fact: Column) -> Column:
    return F.concat(tier, F.lit(":"), F.substring(F.sha2(F.trim(F.lower(fact)), 256), 1, 16))


def freshness_alerts(sources: DataFrame, now: int) -> DataFrame:
    """``id, tier, dedupe_key`` of sources that never succeeded, or not within their priority's hours."""
    hours = (F.lit(now) - F.col("last_success_at")) / HOUR
    never = F.col("last_success_at").isNull()
    tier = F.when(never, "urgent").when(hours > _by_priority(FRESHNESS_HOURS, FRESHNESS_ELSE), F.when(F.col("priority") == 1, "urgent").otherwise("high"))
    fact = F.concat(F.when(never, "never-succeeded:").otherwise("stale:"), "id")
    return sources.select("id", tier.alias("tier"), dedupe_key(F.lit("urgent"), fact).alias("dedupe_key")).where("tier is not null")


def stale_sources(sources: DataFrame, now: int) -> DataFrame:
    """Active sources silent since their last success, or creation, for longer than their priority allows."""
    silent = F.lit(now) - F.coalesce("last_success_at", "created_at")
    df = sources.where("active").select("id", "priority", silent.alias("silent_for"), _by_priority(STALE_SECONDS, None).alias("threshold"))
    return df.where("silent_for > threshold").orderBy("priority", F.desc("silent_for"))


def event_alerts(decisions: DataFrame) -> DataFrame:
    """Urgent alerts of manually flagged events and of those to post now."""
    fact = F.when(F.col("manual_flag"), F.concat(F.lit("manual-flag:"), F.col("event_id").cast("string"))).when(F.col("action") == "POST_NOW", F.concat(F.lit("post-now:"), F.col("event_id").cast("string")))
    return decisions.select("event_id", F.lit("urgent").alias("tier"), fact.alias("fact")).where("fact is not null").select("event_id", "tier", dedupe_key(F.lit("urgent"), F.col("fact")).alias("dedupe_key"))


def due_sources(sources: DataFrame, now: int, jitter: int = 0) -> DataFrame:
    """Active sources with a closed circuit whose poll interval has passed."""
    closed = F.col("circuit_open_until").isNull() | (F.col("circuit_open_until") <= now)
    due = F.col("last_checked_at").isNull() | (F.col("last_checked_at") + F.col("poll_interval_sec") + jitter <= now)
    return sources.where(F.col("active") & closed & due)


def route_events(triage: DataFrame, threshold: int) -> DataFrame:
    """Skip code of ``triage(event_id, status, is_real_event, worth_analysis, combined)``, or null for deep analysis."""
    code = F.when(F.col("status") != "ok", "triage_failed").when(~F.col("is_real_event"), "not_an_event").when(~F.col("worth_analysis"), "not_worth_it").when(F.col("combined") < threshold, "below_threshold")
    return triage.select("event_id", code.alias("skip_code"))


ANALYSIS = "struct<claims:array<struct<text:string,evidence_ids:array<string>>>,narrative:string,confidence:string>"


def validate_analyses(analyses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Faults of ``analyses(id, event_id, payload)``: bad JSON, a cited id that is not the event's evidence, a number in the narrative that no claim has."""
    parsed = analyses.withColumn("p", F.from_json("payload", ANALYSIS))
    cited = parsed.select("id", "event_id", F.explode("p.claims").alias("c")).select("id", "event_id", F.explode("c.evidence_ids").alias("evidence_id"))
    known = evidence.select("event_id", F.col("item_id").cast("string").alias("evidence_id"))
    unknown = cited.join(known, ["event_id", "evidence_id"], "left_anti").groupBy("id").agg(F.count("*").alias("unknown"))
    numbers = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\d[\d,.]*\d|\d"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
    claimed = F.array_distinct(F.flatten(F.transform("p.claims", lambda c: numbers(c["text"]))))
    stray = F.exists(numbers(F.col("p.narrative")), lambda n: ~F.array_contains(claimed, n))
    df = parsed.join(unknown, "id", "left")
    bad = F.col("p").isNull() | F.col("p.claims").isNull()
    faults = F.array_compact(F.array(F.when(bad, "shape"), F.when(F.coalesce("unknown", F.lit(0)) > 0, "unknown_evidence"), F.when(~bad & stray, "unsupported_number")))
    return df.select("id", F.array_join(faults, ",").alias("faults"))
