"""Registered queries of scoring, gate, replay, strategy and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as N
from .operators import aggregates as A
from .operators import analyses as P
from .operators import joins as J
from .operators import scoring as R
from .operators import strategy as S
from .plans.views import BASE, NOW
from .queries import LIFECYCLE, query

NAMES = list(R.TESTABLE)
WEIGHTS = {n: (i + 1) / 20 for i, n in enumerate(NAMES)}
CLOCK = BASE + 120 * 3600
CANDIDATES = [
    {"name": "baseline", "importance_multiplier": 1.0, "relevance_multiplier": 1.0},
    {"name": "strict", "importance_multiplier": 0.9, "relevance_multiplier": 1.1, "min_combined": 45.0},
    {"name": "fresh", "importance_multiplier": 1.2, "relevance_multiplier": 0.8, "max_age_days": 2.0},
]


def scorable(v) -> DataFrame:
    """v_events with evidence, entities, artifacts and flags made from the event's number."""
    df = J.scorable_events(v("v_events"), v("v_evidence"), v("v_sources"))
    names = F.array(*map(F.lit, NAMES))
    one = lambda e: F.get(names, F.expr(e).cast("int"))
    few = lambda c, x: F.when(F.expr(c), F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    artifacts = F.struct(none.alias("models"), few("event_id % 4 = 0", "v1.2").alias("versions"), none.alias("repos"), none.alias("title_models"), few("event_id % 8 = 0", "v1.2").alias("title_versions"))
    return df.withColumns({"entities": F.array_distinct(F.array(one("event_id % 19"), one("(event_id div 19) % 19"))), "artifacts": artifacts, "injection_flagged": F.expr("event_id % 13 = 0")})


def scored(v, now: int = CLOCK) -> DataFrame:
    return R.score_events(scorable(v), now, WEIGHTS)


def _case(key: str, values: dict) -> str:
    return f"(case {key} " + " ".join(f"when '{k}' then {x}::double" for k, x in values.items()) + " else 0::double end)"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_LIST = "(['" + "','".join(NAMES) + "'])"
_TEXT = "title || chr(10) || summary"
_IMPACT = ", ".join(f"case when regexp_matches({_TEXT}, '{_q(p)}') then {w}::double else 0::double end" for p, w in R.IMPACT_TERMS)
_TEACH = " + ".join(f"(case when regexp_matches({_TEXT}, '{_q(p)}') then 1 else 0 end)" for p in R.TEACHING_TERMS)
_C = lambda x: f"greatest(0.0::double, least(1.0::double, {x}))"
FACTS = f"""facts as (select event_id, count(*) as items, count(distinct e.source_id) as sources, max(reliability) as reliability, bool_or(is_official) as official,
      count(distinct case when category = 'COMMUNITY_SIGNAL' then e.source_id end) as community, count(distinct case when category = 'EXPERT_ANALYST' then e.source_id end) as experts,
      max({_case("category", R.CONFIDENCE)}) as best, count(*) filter ((attached_at - first_at) / 3600 <= 6) - 1 as followers
    from (select x.*, s.category, s.reliability, s.is_official, min(attached_at) over (partition by event_id) as first_at from v_evidence x join v_sources s on s.id = x.source_id) e group by event_id),
  s1 as (select v.event_id, v.title, v.summary, v.category, v.occurred_at, v.occurred_estimated, v.first_seen_at, f.sources, f.official, f.experts, f.reliability, f.best,
      v.event_id % 13 = 0 as flagged, v.event_id % 4 = 0 as versioned, v.event_id % 8 = 0 as titled, list_distinct([{_LIST}[1 + v.event_id % 19], {_LIST}[1 + v.event_id // 19 % 19]]) as entities,
      round({_C(f"{_C('followers / 5')} * 0.45::double + (case when community > 0 then 1 else 0 end) * 0.35::double + {_C('community / 3')} * 0.2::double")} * 100)::bigint as velocity
    from v_events v join facts f on f.event_id = v.event_id),
  s2 as (select *, round({_C(f'''{_C('reliability')} * 0.24::double + {_C('sources / 5')} * 0.2::double
        + {_C("case when occurred_estimated then 0.5::double else 1 - greatest(0.0::double, (first_seen_at - occurred_at) / 3600) / 72 end")} * 0.16::double
        + greatest({_IMPACT}, {_case("category", R.CATEGORY_IMPORTANCE)} * 0.5::double) * 0.16::double + velocity / 100 * 0.12::double
        + {_C(f"power(0.5::double, greatest(0.0::double, ({CLOCK} - occurred_at) / 3600) / 18)")} * 0.12::double''')} * 100)::bigint as importance,
      round({_C(f'''(select max({_case("n", WEIGHTS)}) from (select unnest(entities) as n)) * 0.3::double
        + {_C(f"(select max({_case('n', R.TESTABLE)}) from (select unnest(entities) as n)) * (case when versioned then 1.0::double else 0.6::double end)")} * 0.28::double
        + {_C("1 - experts * 0.25::double")} * 0.22::double + {_C(f"({_TEACH}) / 3")} * 0.2::double''')} * 100)::bigint as relevance,
      best * 0.65::double + {_C("sources / 2")} * 0.35::double as raw from s1),
  s3 as (select *, case when raw >= 0.75 then 2 when raw >= 0.45 then 1 else 0 end as l0, case when official then 3 when sources >= 2 then 2 else 1 end as t0 from s2),
  s4 as (select *, least(l0, case when official then 2 else 0 end, case when sources < 2 then 1 else 2 end, case when flagged then 0 else 2 end) as level,
      least(t0, case when official then 3 else 0 end, case when flagged then 1 else 3 end, case when occurred_estimated then 2 else 3 end) as tag from s3),
  s5 as (select *, (['LOW', 'MED', 'HIGH'])[1 + level] as confidence, (['SPECULATIVE', 'INFERRED', 'OBSERVED', 'VERIFIED'])[1 + tag] as evidence_tag,
      round((importance * 0.55::double + relevance * 0.45::double) * (0.6::double + 0.4::double * (case level when 2 then 1.0::double when 1 then 0.6::double else 0.25::double end)))::bigint as combined from s4)"""
_NOISE = " or ".join(f"regexp_matches(title, '{_q(p)}')" for p in R.NOISE_TITLES)


def _gate(importance: str, combined: str) -> str:
    return f"""case when {_NOISE} then 'noise_title' when ({CLOCK} - occurred_at) / 86400 > 7 then 'too_old' when sources < 2 and not titled then 'uncorroborated_and_unspecific'
      when {importance} < 20 then 'below_importance_floor' when {combined} < 30 then 'below_combined_floor' end"""


@query("r1_importance", f"with {FACTS} select event_id, velocity, importance from s5")
def _(v):
    return scored(v).select("event_id", "velocity", "importance")


@query("r2_relevance", f"with {FACTS} select event_id, relevance from s5")
def _(v):
    return scored(v).select("event_id", "relevance")


@query(
    "r3_confidence",
    f"""with {FACTS} select event_id, confidence, evidence_tag, array_to_string(list_filter([case when not official and (l0 > 0 or t0 > 0) then 'no_official_source' end,
      case when sources < 2 and (case when official then l0 else 0 end) = 2 then 'single_source' end,
      case when flagged and (least(l0, case when official then 2 else 0 end, case when sources < 2 then 1 else 2 end) > 0 or least(t0, case when official then 3 else 0 end) = 3) then 'injection' end,
      case when occurred_estimated and least(t0, case when official then 3 else 0 end, case when flagged then 1 else 3 end) = 3 then 'estimated_time' end], lambda x: x is not null), ',') as caps from s5""",
)
def _(v):
    return scored(v).select("event_id", "confidence", "evidence_tag", F.array_join("caps", ",").alias("caps"))


@query("r4_combined", f"with {FACTS} select event_id, combined from s5")
def _(v):
    return scored(v).select("event_id", "combined")


@query("r5_score_breakdown")
def _(v):
    df = R.score_events(scorable(v), CLOCK, WEIGHTS, breakdown=True)
    parts = F.explode(F.concat("importance_parts", "relevance_parts")).alias("p")
    return df.select("event_id", parts).select("event_id", "p.name", F.round("p.value", 6).alias("value"), "p.weight", F.round("p.contribution", 6).alias("contribution"))


@query("r6_apply_gate", f"with {FACTS} select event_id, {_gate('importance', 'combined')} as killed_by from s5")
def _(v):
    return R.apply_gate(scored(v), CLOCK).select("event_id", "killed_by")


_B = lambda x: f"round(greatest(0.0::double, least(100.0::double, {x})))"


@query(
    "r7_replay",
    f"""with {FACTS}, c(name, im, rm, mc, ma) as (values ('baseline', 1.0::double, 1.0::double, null::double, null::double), ('strict', 0.9, 1.1, 45.0, null), ('fresh', 1.2, 0.8, null, 2.0)),
    x as (select s5.*, c.name, c.mc, c.ma, {_B("importance * im * 0.55::double + relevance * rm * 0.45::double")} as cc, {_B("importance * im")} as ci from s5, c),
    y as (select name, case when cc < mc then 'candidate_min_combined' when ({CLOCK} - occurred_at) / 86400 > ma then 'candidate_max_age' else {_gate('ci', 'cc')} end as rule from x)
    select name as candidate, count(*) as total, count(*) filter (rule is null) as passed, round(count(rule) / count(*), 6) as kill_rate from y group by name""",
)
def _(v):
    return R.replay_summary(R.replay(scored(v), CANDIDATES, CLOCK))


POSTS = """(select conv_id as post_id, sum(length(text)) * 7 as impressions, max(turn) * 9 as reposts, count(*) filter (role = 'assistant' and length(text) % 5 = 0) as high_signal_replies,
    0::bigint as mentions_by_respected, count(*) as conversation_depth, max(length(text)) % 3 as follows from conversations group by conv_id)"""


@query(
    "r8_classify_outcome",
    f"""select post_id, case when wide and not auth then 'low_quality_virality' when auth and follows > 0 then 'authority_growth' when auth then 'mixed' else 'quiet' end as verdict from
    (select *, impressions > 10000 or reposts > 50 as wide, high_signal_replies > 0 or mentions_by_respected > 0 or conversation_depth >= 3 as auth from {POSTS} p)""",
)
def _(v):
    n = F.length("text")
    posts = v("conversations").groupBy(F.col("conv_id").alias("post_id")).agg(
        (F.sum(n) * 7).alias("impressions"), (F.max("turn") * 9).alias("reposts"), F.sum(F.when((F.col("role") == "assistant") & (n % 5 == 0), 1).otherwise(0)).alias("high_signal_replies"),
        F.lit(0).alias("mentions_by_respected"), F.count("*").alias("conversation_depth"), (F.max(n) % 3).alias("follows"),
    )
    return R.classify_outcome(posts)


@query("r9_rank_stream")
def _(v):
    facts = A.evidence_facts(v("v_evidence"), v("v_items"), v("v_sources"))
    df = R.apply_gate(scored(v), CLOCK).where("gate_passed").join(facts, "event_id")
    return df.select("event_id", "title", "combined", "confidence", "has_official", "experts").orderBy(F.desc("combined"), "event_id").limit(200)


def strategic(v) -> DataFrame:
    """Scored events with the columns that strategy needs."""
    df = scored(v)
    sources = F.array_distinct(F.transform("evidence", lambda e: e["source_id"]))
    experts = F.array_distinct(F.transform(F.filter("evidence", lambda e: e["source_category"] == "EXPERT_ANALYST"), lambda e: e["source_id"]))
    several = lambda n, word: F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), n), lambda i: F.concat(F.lit(word), i.cast("string")))
    return df.select(
        "event_id", "title", "summary", "confidence", "relevance", "combined", "injection_flagged", (F.col("event_id") % 3 == 0).alias("testable"), (F.col("event_id") % 4 == 0).alias("has_version"),
        F.exists("evidence", lambda e: e["is_official"]).alias("has_official"), F.size(sources).alias("source_count"), F.size(experts).alias("expert_count"),
        several(F.expr("cast(event_id % 6 as int)"), "how ").alias("still_unknown"), several(F.expr("cast((event_id div 6) % 6 as int)"), "no ").alias("do_not_say"),
        F.greatest(F.lit(0.0), (F.lit(CLOCK) - F.col("occurred_at")) / 3600).alias("hours_since"),
    )


def _or(patterns) -> str:
    return "(" + " or ".join(f"regexp_matches(t, '{_q(p)}')" for p in patterns) + ")"


_HAS = {k: f"regexp_matches(t, '{_q(p)}')" for k, p in S.ANGLES.items()}
STRATEGY = f"""{FACTS},
  p1 as (select *, {_TEXT} as t, event_id % 3 = 0 as testable, event_id % 4 = 0 as ver, event_id % 6 as unknown, event_id // 6 % 6 as dont, greatest(0.0::double, ({CLOCK} - occurred_at) / 3600) as hours,
      not official or sources < 2 as thin, 1 - least(0.6::double, experts * 0.2::double) as rest from s5),
  angle as (select event_id, kind, s * rest as strength, i from (select event_id, rest, unnest([
      {{'i': 0, 'kind': 'technical_explanation', 's': case when testable and ({_HAS['technical_explanation']} or ver) then 0.9::double end}},
      {{'i': 1, 'kind': 'comparison', 's': case when {_HAS['comparison']} and ver then 0.7::double end}},
      {{'i': 2, 'kind': 'version_diff', 's': case when ver and {_HAS['version_diff']} then 0.75::double end}},
      {{'i': 3, 'kind': 'benchmark_interpretation', 's': case when {_HAS['benchmark_interpretation']} then case when unknown > 0 then 0.8::double else 0.55::double end end}},
      {{'i': 4, 'kind': 'cost_implication', 's': case when {_HAS['cost_implication']} then 0.85::double end}},
      {{'i': 5, 'kind': 'second_order_effect', 's': case when {_HAS['second_order_effect']} then 0.8::double end}},
      {{'i': 6, 'kind': 'myth_correction', 's': case when {_HAS['myth_correction']} then 0.7::double end}},
      {{'i': 7, 'kind': 'skepticism', 's': case when {_HAS['skepticism']} or thin then case when thin then 0.75::double else 0.5::double end end}}], recursive := true) from p1) where s is not null),
  top as (select event_id, max(strength) as strongest, max(strength) filter (kind in ('technical_explanation', 'cost_implication', 'benchmark_interpretation', 'myth_correction')) as teach,
      arg_min(kind, (-strength, i)) as kind, arg_min(kind, (-strength, i)) filter (kind in ('technical_explanation', 'cost_implication', 'comparison', 'version_diff', 'benchmark_interpretation', 'myth_correction')) as teaching from angle group by event_id),
  p2 as (select p1.*, top.strongest, top.teach, top.kind, top.teaching, case confidence when 'HIGH' then 1.0::double when 'MED' then 0.75::double else 0.4::double end as cf from p1 left join top on top.event_id = p1.event_id),
  p3 as (select *, case when {_or(S.ACCUSATION)} then 'accusation' when flagged then 'injection_flagged' when {_or(S.RUMOUR)} then 'rumour_or_leak' when not official and sources < 2 then 'thin_evidence' end as forced,
      (case when strongest is null then 0.15::double else least(0.85::double, strongest * (case when hours <= 6 then 1.0::double else 0.5::double end)) end) * cf as quote,
      (case when strongest is null then 0.1::double else least(0.7::double, strongest * (case when experts > 0 then 0.9::double else 0.5::double end)) end) * cf as reply,
      (case when strongest is null then 0.1::double else least(1.0::double, strongest + (case when testable then 0.15::double else 0.0::double end)) end) * cf as original,
      (case when teach is null then 0.1::double else least(0.9::double, teach * 0.95::double) end) * cf as educational,
      case when confidence = 'LOW' then 0.9::double when unknown > 2 then 0.6::double else 0.2::double end as wait from p2),
  p4 as (select *, case when strongest is null then 'no_unique_angle' when experts >= 3 then 'saturated' when experts >= 1 and strongest < 0.5 then 'better_explained_elsewhere' when confidence = 'LOW' then 'weak_evidence'
      when unknown >= 4 then 'insufficient_information' when relevance < 30 then 'low_authority_gain' when dont >= 5 then 'reputational_risk' end as refused,
      greatest(quote, reply, original, educational) as fit,
      case greatest(quote, reply, original, educational) when quote then 'quote' when reply then 'reply' when original then 'original' else 'educational' end as choice from p3),
  decision as (select event_id, case when forced = 'accusation' then 'VERIFY' when forced is not null then 'WAIT' when refused is not null then 'DONT_POST' when fit >= 0.6 and combined >= 50 and hours <= 6 then 'POST_NOW' else 'POST_SOON' end as action,
      coalesce(forced, refused, 'none') as reason, case when forced is not null then 'wait' when refused is null then choice end as option, coalesce(forced, '') = 'accusation' as manual_flag from p4)"""


@query("r11_forcing_rules", f"with {STRATEGY} select event_id, forced from p3")
def _(v):
    return strategic(v).select("event_id", S.forcing_rule().alias("forced"))


@query("r12_find_angles", f"with {STRATEGY} select event_id, kind, round(strength, 6) as strength from angle")
def _(v):
    return S.find_angles(strategic(v)).select("event_id", F.explode("angles").alias("a")).select("event_id", "a.kind", F.round("a.strength", 6).alias("strength"))


@query("r13_content_options", f"with {STRATEGY} select event_id, round(quote, 6) as quote, round(reply, 6) as reply, round(original, 6) as original, round(educational, 6) as educational, round(wait, 6) as wait from p3")
def _(v):
    df = S.content_options(S.find_angles(strategic(v)))
    fit = lambda k: F.round(F.get(F.filter("options", lambda o: o["kind"] == k), F.lit(0))["fit"], 6).alias(k)
    return df.select("event_id", *map(fit, ("quote", "reply", "original", "educational", "wait")))


@query("r10_recommend", f"with {STRATEGY} select * from decision")
def _(v):
    return S.recommend(strategic(v))


@query("a9_strategy_summary", f"""with {STRATEGY} select coalesce(action, '*') as action, coalesce(reason, '*') as reason, count(*) as n from decision group by grouping sets ((action), (reason), ())""")
def _(v):
    return A.strategy_summary(S.recommend(strategic(v)))


_BEST = f"(select max({_case('n', R.TESTABLE)}) from (select unnest(entities) as n))"
_MADE = f"{_TEXT} as t, event_id % 3 = 0 as testable, event_id % 4 = 0 as ver, event_id % 6 as unknown, event_id // 6 % 6 as dont"
_SAID = f"title || chr(10) as t, {_BEST} * (case when versioned then 1.0::double else 0.6::double end) > 0.5::double or {_BEST} >= 0.8::double as testable, coalesce(k, 0) % 6 as unknown, coalesce(k, 0) // 6 % 6 as dont"
STREAM = STRATEGY.replace(_MADE, _SAID).replace(
    "\n  p1 as",
    """\n  a1 as (select event_id, id as analysis_id, cast(json_extract_string(payload, '$.k') as bigint) as k from v_analyses where id in (select max(id) from v_analyses where status = 'ok' group by event_id)),
  f1 as (select e.event_id, bool_or(regexp_matches(i.title, 'v[0-9]|[0-9]\\.[0-9]')) as ver from v_evidence e join v_items i on i.id = e.item_id group by e.event_id),
  s6 as (select s5.* replace (coalesce(k % 17 = 0, false) as flagged), k, analysis_id, f1.ver from s5 left join a1 on a1.event_id = s5.event_id left join f1 on f1.event_id = s5.event_id),
  p1 as""",
    1,
).replace("as rest from s5)", "as rest from s6)", 1)


@query(
    "r9_stream_with_strategy",
    f"""with {STREAM}, listed as (select event_id from s5 where ({_gate('importance', 'combined')}) is null order by combined desc, event_id limit 200)
    select p4.event_id, title, category, combined, confidence, evidence_tag, official as has_official, ver as has_version, experts as expert_count, analysis_id, action, reason, option, manual_flag
    from p4 join decision on decision.event_id = p4.event_id where p4.event_id in (select event_id from listed)""",
)
def _(v):
    """An analysis says as many unknowns and warnings as the number in its payload has it."""
    df = R.apply_gate(R.score_events(scorable(v), CLOCK, WEIGHTS, breakdown=True), CLOCK)
    part = F.get(F.filter("relevance_parts", lambda p: p["name"] == "testability"), F.lit(0))["value"]
    sources = F.size(F.array_distinct(F.transform("evidence", lambda e: e["source_id"])))
    scores = df.select(F.col("event_id").alias("id"), "event_id", "importance", "relevance", "combined", "confidence", "evidence_tag", "caps", "entities", part.alias("testability"), sources.alias("source_count"), "gate_passed")
    k = F.get_json_object("payload", "$.k").cast("long")
    several = lambda n, word: F.transform(F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(word), i.cast("string")))
    said = F.to_json(F.struct(several(k % 6, "how ").alias("stillUnknown"), several(F.floor(k / 6) % 6, "no ").alias("doNotSay"), (k % 17 == 0).alias("injectionObserved")))
    analyses = v("v_analyses").select("id", "event_id", "status", said.alias("payload"))
    df = S.rank_stream(scores, v("v_events"), v("v_evidence"), v("v_items"), v("v_sources"), analyses, CLOCK)
    return df.select("event_id", "title", "category", "combined", "confidence", "evidence_tag", "has_official", "has_version", "expert_count", "analysis_id", "action", "reason", "option", "manual_flag")


@query("a9_restraint", f"""with {STRATEGY} select count(*) as n, count(*) filter (action in ('DONT_POST', 'WAIT', 'VERIFY')) as restrained, round(count(*) filter (action in ('DONT_POST', 'WAIT', 'VERIFY')) / count(*), 6) as restraint_rate,
    count(*) filter (manual_flag) as manual_flags from decision""")
def _(v):
    return A.restraint(S.recommend(strategic(v)))


@query("r14_teaching_candidates", f"with {STRATEGY} select event_id, teaching as angle from p2 where teaching is not null and (testable or teaching = 'myth_correction')")
def _(v):
    return S.teaching_candidates(strategic(v))


@query("r14_experiment_queue", f"""with {STRATEGY} select event_id, kind as angle, case kind when 'technical_explanation' then 45 when 'cost_implication' then 60 when 'comparison' then 90 when 'version_diff' then 60 else 90 end as minutes
    from p2 where testable and kind in ('technical_explanation', 'cost_implication', 'comparison', 'version_diff', 'benchmark_interpretation')""")
def _(v):
    return S.experiment_queue(strategic(v))


@query("r15_trend_cards", f"""with {LIFECYCLE}, tr as (select distinct user_id % 25 as trend_id from events)
    select tr.trend_id, coalesce(n, 0) as n, first_at, last_at, coalesce(stage, 'UNKNOWN') as stage, coalesce(decision, 'IGNORE') as decision, case when tr.trend_id % 2 = 0 then 'format' else '' end as missing
    from tr left join lifecycle l on l.trend_id = tr.trend_id""")
def _(v):
    trends = v("events").select((F.col("user_id") % 25).alias("trend_id")).distinct().withColumn("name", F.lit("t")).withColumn("format", F.when(F.col("trend_id") % 2 == 1, "f"))
    return S.trend_cards(trends, v("v_observations"), NOW)


@query("r15_trend_cards_by_hand", f"""with {LIFECYCLE}, tr as (select distinct user_id % 25 as trend_id from events), m as (select trend_id, bool_or(mention_count % 29 = 0) as hand from v_observations group by trend_id)
    select tr.trend_id, coalesce(n, 0) as n, first_at, last_at, coalesce(stage, 'UNKNOWN') as stage, coalesce(decision, 'IGNORE') as decision, '' as missing, coalesce(hand, false) as any_manual
    from tr left join lifecycle l on l.trend_id = tr.trend_id left join m on m.trend_id = tr.trend_id""")
def _(v):
    trends = v("events").select((F.col("user_id") % 25).alias("trend_id")).distinct().withColumn("name", F.lit("t"))
    return S.trend_cards(trends, v("v_observations").withColumn("manual", F.col("mention_count") % 29 == 0), NOW)


_KEY = "'urgent:' || substr(sha256({}), 1, 16)"


@query(
    "r16_freshness_alerts",
    f"""select id, tier, {_KEY.format("trim(lower(case when last_success_at is null then 'never-succeeded:' else 'stale:' end || id))")} as dedupe_key from
    (select *, case when last_success_at is null then 'urgent' when ({NOW} - last_success_at) / 3600 > (case priority when 1 then 6 when 2 then 24 when 3 then 72 when 4 then 168 else 72 end) then case when priority = 1 then 'urgent' else 'high' end end as tier from v_sources)
    where tier is not null""",
)
def _(v):
    return S.freshness_alerts(v("v_sources"), NOW)


@query("r17_stale_sources", f"""select * from (select id, priority, {NOW} - coalesce(last_success_at, created_at) as silent_for, (case priority when 1 then 21600 when 2 then 86400 when 3 then 259200 when 4 then 1209600 end)::bigint as threshold
    from v_sources where active) where silent_for > threshold""")
def _(v):
    return S.stale_sources(v("v_sources"), NOW)


@query("r18_event_alerts", f"""with {STRATEGY} select event_id, 'urgent' as tier, {_KEY.format("(case when manual_flag then 'manual-flag:' else 'post-now:' end) || event_id::varchar")} as dedupe_key from decision where manual_flag or action = 'POST_NOW'""")
def _(v):
    return S.event_alerts(S.recommend(strategic(v)))


@query("r19_due_sources", f"select id from v_sources where active and (circuit_open_until is null or circuit_open_until <= {NOW}) and (last_checked_at is null or last_checked_at + poll_interval_sec <= {NOW})")
def _(v):
    return S.due_sources(v("v_sources"), NOW).select("id")


@query("r20_validate_analyses")
def _(v):
    items = v("v_items").select("id", F.col("id").alias("event_id"), "title")
    claim = F.struct(F.concat(F.lit("It grew 12 percent: "), "title").alias("text"), F.array(F.when(F.col("id") % 4 == 0, "nowhere").otherwise(F.col("id").cast("string"))).alias("evidence_ids"))
    payload = F.to_json(F.struct(F.array(claim).alias("claims"), F.when(F.col("id") % 3 == 0, "Up 12 percent").otherwise("Up 13 percent").alias("narrative"), F.lit("MED").alias("confidence")))
    analyses = items.select("id", "event_id", F.when(F.col("id") % 7 == 0, "not json").otherwise(payload).alias("payload"))
    return S.validate_analyses(analyses, items.select("event_id", F.col("id").alias("item_id")))


_PROSE = "regexp_replace(regexp_replace({}, '(?i)\\bev-[0-9]+\\b', '', 'g'), '\\b(?:19|20)[0-9]{{2}}\\b', '', 'g')"
_JOINED = lambda t: f"regexp_replace(regexp_replace({t}, '[.,]([0-9]{{3}})\\b', '\\1', 'g'), '[_\\s]', '', 'g')"
_STRAY = lambda t: f"case when regexp_matches({t}, '{_q(N.YEAR_ONLY)}') then [] else list_filter(list_transform(regexp_extract_all({t}, '{_q(N.FACTUAL_NUMBER)}'), lambda n: trim(n)), lambda n: not contains(sourced, {_JOINED('n')})) end"


@query(
    "r20_check_analyses",
    f"""with o as (select distinct e.event_id from v_evidence e join v_sources s on s.id = e.source_id where is_official),
    a as (select i.id, e.event_id, title, body, length(body) as n, length(body) between 1 and 2500 and length(title) > 0 as good from v_items i join v_evidence e on e.item_id = i.id),
    b as (select a.*, {_PROSE.format("body")} as t1, {_PROSE.format("title")} as t2, {_PROSE.format("substr(body, 100, 300)")} as t3, {_JOINED("substr(body, 1, 800)")} as sourced,
      n % 4 = 0 and not exists (select 1 from v_evidence x where x.item_id = a.id + 1 and x.event_id = a.event_id) as lost, o.event_id is null or n % 13 = 0 as low,
      (['HIGH', 'MED', 'LOW'])[1 + n % 3] as said, (['POST_NOW', 'POST_SOON', 'WAIT', 'VERIFY', 'IGNORE'])[1 + n % 5] as act from a left join o on o.event_id = a.event_id),
    c as (select *, case when good then list_distinct(list_concat({_STRAY("t1")}, {_STRAY("t2")}, {_STRAY("t3")})) else [] end as stray from b)
    select id, event_id, case when not good then 'shape' when lost then 'unknown_evidence' when len(stray) > 0 then 'unsupported_number' else 'ok' end as verdict, case when good and lost then cast(id + 1 as varchar) else '' end as unknown_ids,
      array_to_string(list_sort(stray), ' ') as stray_numbers, case when good then case when low then 'LOW' else said end end as confidence,
      case when good then case when (low or said = 'LOW') and act in ('POST_NOW', 'POST_SOON') then 'VERIFY' else act end end as action from c""",
)
def _(v):
    """Payloads made of the items' texts: the whole text is the story, its first 800 characters the claim, which cites the item and, in every fourth length, the next one."""
    items = v("v_items").join(v("v_evidence").select(F.col("item_id").alias("id"), "event_id"), "id")
    n = F.length("body")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (n % by).cast("int"))
    own = F.col("id").cast("string")
    cited = F.when(n % 4 == 0, F.array(own, (F.col("id") + 1).cast("string"))).otherwise(F.array(own))
    claim = F.struct(F.substring("body", 1, 800).alias("text"), cited.alias("evidenceIds"), F.lit("OBSERVED").alias("tag"))
    texts = lambda *names: F.struct(*(F.lit("as it says").alias(x) for x in names))
    payload = F.struct(
        F.col("body").alias("whatHappened"), F.col("title").alias("whatChanged"), F.lit("").alias("before"), F.substring("body", 100, 300).alias("after"), F.array(texts("audience", "implication")).alias("implications"), F.array(claim).alias("claims"),
        F.array(F.lit("method")).alias("stillUnknown"), pick(("HIGH", "MED", "LOW"), 3).alias("confidence"), pick(P.ACTIONS, 5).alias("recommendedAction"), F.array(F.lit("nothing")).alias("doNotSay"),
        texts("hook", "substance", "soWhat", "testableClaim").alias("draftMaterial"), F.array(F.lit("novelty")).alias("attentionDrivers"), F.lit("").alias("attentionReason"), texts("kind", "whatToShow", "sourceHint").alias("mediaIdea"),
        (n % 13 == 0).alias("injectionObserved"), F.lit("").alias("injectionNote"),
    )
    official = v("v_evidence").join(v("v_sources").where("is_official").select(F.col("id").alias("source_id")), "source_id", "left_semi").select("event_id")
    df = P.check_analyses(items.select("id", "event_id", F.to_json(payload).alias("payload")), v("v_evidence").select("event_id", F.col("item_id").alias("evidence_id")), official)
    return df.select("id", "event_id", "verdict", F.array_join("unknown_ids", ",").alias("unknown_ids"), F.array_join(F.array_sort("stray_numbers"), " ").alias("stray_numbers"), "confidence", "action")


@query("r21_route_events", "select event_id, case when status <> 'ok' then 'triage_failed' when event_id % 5 = 0 then 'not_an_event' when event_id % 7 = 0 then 'not_worth_it' when cost_micro % 100 < 40 then 'below_threshold' end as skip_code from v_analyses")
def _(v):
    t = v("v_analyses").select("event_id", "status", (F.col("event_id") % 5 != 0).alias("is_real_event"), (F.col("event_id") % 7 != 0).alias("worth_analysis"), (F.col("cost_micro") % 100).alias("combined"))
    return S.route_events(t, 40)


