"""Signals of text that addresses the reader's model rather than its reader."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sanitize

# Invisible characters, and the patterns of each kind of signal, in order.
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{180E}\x{00AD}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{061C}\x00-\x08\x0B\x0C\x0E-\x1F]"
#: Fixed value: what surrounds the first of the invisible characters (this class is the narrower one, with all control characters).
AROUND = r"[^\n\r\x{2028}\x{2029}]{0,30}[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{180E}\x{00AD}\x{202A}-\x{202E}\x00-\x1F][^\n\r\x{2028}\x{2029}]{0,30}"
PATTERNS = (
    ("instruction_override", r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:all\s+|any\s+|the\s+|your\s+|previous\s+|prior\s+|above\s+)*(?:previous\s+|prior\s+|earlier\s+|all\s+)?(?:instructions?|prompts?|rules?|directions?|context)\b"),
    ("system_prompt_probe", r"(?i)\b(?:reveal|print|output|show|repeat|display|disclose)\s+(?:me\s+)?(?:your\s+|the\s+)?(?:system\s+prompt|initial\s+instructions?|prompt\s+above|configuration|your\s+rules)\b"),
    ("score_manipulation", r"(?i)\b(?:assign|set|give|mark|rate|score)\s+(?:this\s+|it\s+|the\s+)?(?:an?\s+)?(?:importance|priority|relevance|score|rating)(?:\s+(?:score|rating|level|value))?\s*(?:of|to|=|:|as)?\s*(?:100|max|maximum|highest|top|10/10)\b"),
    ("score_manipulation", r"(?i)\bthis\s+is\s+(?:a\s+)?(?:critical|urgent|breaking|extremely\s+important)\b[^.]{0,60}\b(?:must|should)\s+be\s+(?:ranked|scored|prioriti[sz]ed|surfaced)\b"),
    ("fabricated_authority", r"(?i)(?:^|[\s>])(?:as\s+)?(?:the\s+)?(?:system|admin|administrator|developer|operator)(?:\s+(?:says?|note|message|instruction))?\s*:"),
    ("exfiltration_bait", r"(?i)\b(?:fetch|visit|retrieve|download|GET|curl|browse\s+to|open)\s+(?:this\s+|the\s+following\s+)?(?:url|link|address|endpoint)\b|\bfor\s+(?:more|full)\s+(?:detail|context)[^.]{0,30}\bhttps?://"),
    ("role_confusion", r"(?i)(?:^|\n)\s*(?:###\s*)?(?:system|assistant|human|user)\s*:\s*"),
    ("role_confusion", r"(?i)<\|(?:im_start|im_end|system|endoftext)\|>|\[/?INST\]|<<SYS>>"),
    ("score_manipulation", r"(?i)\b(?:importance|priority|relevance|urgency|confidence|brand_relevance|importance_score|recommended_action)\s*[:=]\s*(?:100|max|maximum|critical|highest|high\b|post_now)"),
    ("score_manipulation", r"(?i)\bthe\s+most\s+important\s+(?:announcement|news|event|release|story)\s+(?:in|of)\s+(?:the\s+)?(?:history|all\s+time|the\s+year|the\s+decade)\b"),
    ("score_manipulation", r"(?i)\bdo\s+not\s+(?:verify|wait|check|confirm|fact.?check)\b|\bpublish\s+(?:this\s+)?(?:immediately|within\s+the\s+next|right\s+now)\b[^.]{0,80}\bor\b"),
    ("score_manipulation", r"(?is)\b(?:your\s+audience|your\s+following|your\s+followers)\b.{0,200}?\b(?:rate\s+(?:it|this)\s+(?:highly|high)|prioriti[sz]e\s+(?:this|it)|score\s+(?:this|it)\s+high)"),
    ("score_manipulation", r"(?i)\b(?:independently\s+)?(?:confirmed|verified|corroborated)\s+by\b[^.]{0,120}?(?:,[^.]{0,60}){2,}"),
    ("fabricated_authority", r"(?i)\b(?:official(?:ly)?\s+(?:announcement|statement|communication)|verified\s+source|authoritative\s+(?:source|document))\b[^.]{0,120}\b(?:trust|tag(?:ged)?|treat|mark(?:ed)?|should\s+be)\b"),
    ("fabricated_authority", r"(?i)</?(?:system|instructions?|admin|prompt)\s*>"),
    ("fabricated_authority", r"(?i)\b(?:pgp|gpg|cryptographically)\s+(?:signed|authenticated|verified)\b[^.]{0,120}\b(?:trust|must\s+be|should\s+be)\b"),
    ("fabricated_authority", r"(?i)\b(?:message|note|instruction)\s+from\s+the\s+(?:system\s+)?(?:operator|administrator|owner)\b|\b(?:disable|bypass|skip|ignore)\s+(?:the\s+)?(?:confidence\s+cap|safety\s+check|validation|guardrails?)\b"),
    ("exfiltration_bait", r"(?i)\b(?:repeat|echo|output|print)\s+(?:your\s+)?(?:full\s+|entire\s+|complete\s+)?(?:system\s+prompt|instructions?|configuration)\b"),
    ("exfiltration_bait", r"(?i)\b(?:ANTHROPIC_API_KEY|DATABASE_URL|OPENAI_API_KEY|AWS_SECRET|X_API_KEY)\b|\b(?:output|print|reveal|show)\s+the\s+values?\s+of\b[^.]{0,60}\b(?:env|environment|variable|secret|key)"),
    ("exfiltration_bait", r"(?i)https?://[^\s)]*[?&](?:leak|exfil|collect|data|prompt|steal)="),
    ("schema_attack", r"(?i)\badd\s+(?:a\s+)?(?:new\s+)?(?:field|key|property|parameter)\s+(?:called|named)\b|\binclude\s+(?:a\s+)?(?:field|key)\s+[\"'`]"),
    ("schema_attack", r"(?i)\bcite\s+(?:the\s+)?evidence\s+id\b|\bevidence[_\s]?ids?\s*[:=]\s*[\"'`\[]"),
    ("instruction_override", r"(?i)\byou\s+are\s+now\b|\bforget\s+(?:everything|all)\b[^.]{0,60}\b(?:before|prior|previously)\b|\bstart\s+fresh\b[^.]{0,60}\binstructions?\b"),
    ("instruction_override", r"(?i)\b(?:disregard|ignore)\s+(?:everything|all|anything)\s+(?:above|below|before|prior\s+to)\b|\bnew\s+instructions\s+(?:follow|below)\b"),
    ("instruction_override", r"(?i)style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|left\s*:\s*-\d{3,}px|position\s*:\s*absolute)"),
)

#: For each pattern, in their order, words in lower case of which every match holds one: where a text has none, the pattern needs not run.
HINTS = (
    ("ignore", "disregard", "forget", "override"),
    ("prompt", "initial", "configuration", "rules"),
    ("importance", "priority", "relevance", "score", "rating"),
    ("critical", "urgent", "breaking", "important"),
    ("system", "admin", "developer", "operator"),
    ("url", "link", "address", "endpoint", "http"),
    ("system", "assistant", "human", "user"),
    ("<|", "inst]", "<<sys>>"),
    ("importance", "priority", "relevance", "urgency", "confidence", "recommended_action"),
    ("important",),
    ("verify", "wait", "check", "confirm", "publish"),
    ("audience", "follow"),
    ("confirmed", "verified", "corroborated"),
    ("official", "verified", "authoritative"),
    ("<",),
    ("pgp", "gpg", "cryptographically"),
    ("operator", "administrator", "owner", "confidence", "safety", "validation", "guardrail"),
    ("repeat", "echo", "output", "print"),
    ("_api_key", "database_url", "aws_secret", "value"),
    ("http",),
    ("called", "named", "include"),
    ("evidence",),
    ("now", "forget", "fresh"),
    ("disregard", "ignore", "instruction"),
    ("style",),
)


def _signal(kind: str, evidence: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.substring(evidence, 1, 200).alias("evidence"))


def detect_injection(df: DataFrame, column: str) -> DataFrame:
    """Adds ``signals``: (kind, evidence of at most 200 characters), one of each kind and first 40 characters; ``sanitize``'s counts of hidden content add one.

    The evidence of obfuscation is the text around the first invisible character, 30 characters to either side within its line. Patterns see the raw text, and where that holds invisible characters, the text without them too. Null is empty."""
    counted = sanitize(df, column, normalise=False)
    raw = F.coalesce(F.col(column), F.lit(""))
    hinted = lambda low, words: reduce(or_, (F.contains(low, F.lit(w)) for w in words))
    matches = lambda t, low: F.array(*[F.when(hinted(low, words), F.regexp_extract(t, p, 0)).otherwise("") for (_, p), words in zip(PATTERNS, HINTS, strict=True)])
    # columns of their own, used more than once below, so that each pattern runs once over a text
    counted = counted.withColumn("_obfuscated", F.rlike(raw, F.lit(INVISIBLE))).withColumn("_visible", F.when(F.col("_obfuscated"), F.regexp_replace(raw, INVISIBLE, "")))
    counted = counted.withColumn("_low", F.lower(raw)).withColumn("_visible_low", F.lower("_visible"))
    counted = counted.withColumn("_raw_matches", matches(raw, F.col("_low"))).withColumn("_visible_matches", F.when(F.col("_obfuscated"), matches(F.col("_visible"), F.col("_visible_low"))))
    kinds = F.array(*[F.lit(k) for k, _ in PATTERNS])

    def best(m: Column, i: Column) -> Column:
        match = F.when(m != "", m).otherwise(F.coalesce(F.get("_visible_matches", i), F.lit("")))
        return F.struct(F.get(kinds, i).alias("kind"), F.substring(match, 1, 200).alias("evidence"))

    found = F.filter(F.transform("_raw_matches", best), lambda s: s["evidence"] != "")
    around = F.coalesce(F.nullif(F.regexp_extract(raw, AROUND, 0), F.lit("")), F.lit("invisible characters"))
    hidden = (F.col("hidden_elements") > 0) | (F.col("zero_width") > 8) | (F.col("bidi") > 0) | (F.col("scripts") > 0)
    counts = F.format_string("hidden elements: %d, zero-width: %d, bidi: %d, comments: %d, scripts: %d", "hidden_elements", "zero_width", "bidi", "comments", "scripts")
    alone = lambda c, s: F.array_compact(F.array(F.when(c, s)))
    every = F.concat(alone(F.col("_obfuscated"), _signal("obfuscation", around)), found, alone(hidden, _signal("hidden_content", counts)))
    counted = counted.withColumn("_signals", every)
    same = lambda a, b: (a["kind"] == b["kind"]) & (F.substring(a["evidence"], 1, 40) == F.substring(b["evidence"], 1, 40))
    once = F.aggregate("_signals", F.array().cast("array<struct<kind:string,evidence:string>>"), lambda acc, s: F.when(F.exists(acc, lambda x: same(x, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return counted.withColumn("signals", once).select(*df.columns, "signals")
