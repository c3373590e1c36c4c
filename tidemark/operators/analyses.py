"""Checks of model-written analyses: the payload's shape as a variant, the provenance of ids and numbers, and caps on what it may conclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FACTUAL_NUMBER, YEAR_ONLY
from ..tables import written

# Fixed values of the payload's format: least and most characters of its texts, most elements of its lists, and the words that may stand.
TEXTS = {"whatHappened": (1, 2500), "whatChanged": (1, 2500), "before": (0, 1200), "after": (0, 1200), "attentionReason": (0, 600), "injectionNote": (0, 1000)}
CLAIM, IMPLICATION = {"text": (1, 800)}, {"audience": (1, 80), "implication": (1, 1200)}
DRAFT = {"hook": (1, 600), "substance": (1, 800), "soWhat": (1, 600), "testableClaim": (0, 600)}
MEDIA = {"whatToShow": (0, 600), "sourceHint": (0, 300)}
MOST = {"implications": 6, "claims": 20, "stillUnknown": 10, "doNotSay": 10, "attentionDrivers": 6}
NOTE = (1, 600)
CONFIDENCES, ACTIONS = ("HIGH", "MED", "LOW"), ("POST_NOW", "POST_SOON", "WAIT", "VERIFY", "IGNORE")
CAREFUL = ("WAIT", "VERIFY", "IGNORE")
CLAIM_TAGS = ("VERIFIED", "OBSERVED", "INFERRED", "SPECULATIVE")
MEDIA_KINDS: tuple[str, ...] = ()  # any text, unless the caller lists some
KEYS = (*TEXTS, *MOST, "confidence", "recommendedAction", "draftMaterial", "mediaIdea", "injectionObserved")
NARRATIVE = ("whatHappened", "whatChanged", "before", "after")


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("missing"))


def _is_text(v: Column, least: int, most: int) -> Column:
    n = F.length(F.try_variant_get(v, "$", "string"))
    return F.coalesce((_type(v) == "STRING") & n.between(least, most), F.lit(False))


def _is_one_of(v: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce((_type(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*words), F.lit(False))


def _is_list(v: Column, least: int, most: int | None, good) -> Column:
    """A list of ``least`` to ``most`` elements that are all good."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    n = F.size(parts)
    within = (n >= least) & (n <= most) if most is not None else n >= least
    return F.coalesce(F.startswith(_type(v), F.lit("ARRAY")) & within & F.forall(parts, good), F.lit(False))


def _has_only(v: Column, keys) -> Column:
    """An object with these keys and no others."""
    found = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    wanted = F.array(*map(F.lit, sorted(keys)))
    return F.coalesce(F.startswith(_type(v), F.lit("OBJECT")) & (F.array_sort(found) == wanted), F.lit(False))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _texts(v: Column, limits: dict[str, tuple[int, int]]) -> list[Column]:
    return [_is_text(_at(v, k), *span) for k, span in limits.items()]


def shape_faults(v: Column, media_kinds: tuple[str, ...] = MEDIA_KINDS, drivers: tuple[str, ...] = ()) -> Column:
    """Names of the parts of a payload (a variant) that break its format, in the order of ``KEYS``: a missing part, one of another type, too short or too long,
    a word that is not listed, an object with missing or further keys. ``json`` alone where there is no JSON, ``keys`` where the payload itself has too few or
    too many keys."""
    kind = lambda x: _is_one_of(x, media_kinds) if media_kinds else _is_text(x, 1, 2**31 - 1)
    driver = lambda x: _is_one_of(x, drivers) if drivers else _is_text(x, 1, 2**31 - 1)
    note = lambda x: _is_text(x, *NOTE)
    claim = lambda x: _all([_has_only(x, (*CLAIM, "evidenceIds", "tag")), *_texts(x, CLAIM), _is_list(_at(x, "evidenceIds"), 1, None, lambda i: _is_text(i, 1, 2**31 - 1)), _is_one_of(_at(x, "tag"), CLAIM_TAGS)])
    implication = lambda x: _all([_has_only(x, IMPLICATION), *_texts(x, IMPLICATION)])
    inside = {"implications": implication, "claims": claim, "stillUnknown": note, "doNotSay": note, "attentionDrivers": driver}
    good = {k: _is_text(_at(v, k), *span) for k, span in TEXTS.items()}
    good |= {k: _is_list(_at(v, k), 0, most, inside[k]) for k, most in MOST.items()}
    good["confidence"], good["recommendedAction"] = _is_one_of(_at(v, "confidence"), CONFIDENCES), _is_one_of(_at(v, "recommendedAction"), ACTIONS)
    draft, media = _at(v, "draftMaterial"), _at(v, "mediaIdea")
    good["draftMaterial"] = _all([_has_only(draft, DRAFT), *_texts(draft, DRAFT)])
    good["mediaIdea"] = _all([_has_only(media, (*MEDIA, "kind")), *_texts(media, MEDIA), kind(_at(media, "kind"))])
    good["injectionObserved"] = _type(_at(v, "injectionObserved")) == "BOOLEAN"
    faults = F.array_compact(F.array(F.when(~_has_only(v, KEYS), "keys"), *[F.when(~good[k], k) for k in KEYS]))
    return F.when(v.isNull(), F.array(F.lit("json"))).otherwise(faults)


def _digits(text: Column) -> Column:
    """Numbers without their separators of thousands, in either country's writing; decimals stay."""
    return F.regexp_replace(F.regexp_replace(text, r"[.,](?=\d{3}\b)", ""), r"[_\s]", "")


def stray_numbers(v: Column) -> Column:
    """Measurements in a payload's prose that stand in no claim, once each; ids of evidence and years are no measurements."""
    claims = F.transform(F.try_variant_get(v, "$.claims", "array<variant>"), lambda c: F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
    sourced = _digits(F.coalesce(F.array_join(claims, " "), F.lit("")))

    def of(key: str) -> Column:
        text = F.regexp_replace(F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")), r"(?i)\bev-\d+\b", "")
        text = F.regexp_replace(text, r"\b(?:19|20)\d{2}\b", "")
        found = F.transform(F.regexp_extract_all(text, F.lit(FACTUAL_NUMBER), F.lit(0)), lambda n: F.trim(n))
        return F.when(F.rlike(text, F.lit(YEAR_ONLY)), F.array().cast("array<string>")).otherwise(F.filter(found, lambda n: ~F.contains(sourced, _digits(n))))

    return F.array_distinct(F.concat(*map(of, NARRATIVE)))


def check_analyses(analyses: DataFrame, evidence: DataFrame, official: DataFrame, media_kinds: tuple[str, ...] = MEDIA_KINDS, drivers: tuple[str, ...] = ()) -> DataFrame:
    """``id, event_id, verdict, shape, unknown_ids, stray_numbers, confidence, action`` for each of ``analyses(id, event_id, payload)``.

    ``verdict`` is the first fault: ``shape`` (its parts listed), ``unknown_evidence`` (a cited id that is none of ``evidence(event_id, evidence_id)``),
    ``unsupported_number``, or ``ok``. Confidence and action are the payload's, lowered: LOW without an official source (``official(event_id)`` lists the events that have one) or
    with an injection observed, and at LOW no more than to wait, verify or ignore; null unless the shape is right. Ids are distinct. Null payloads are no JSON.
    Cited ids are exploded and joined by equality, so an event with much evidence is not gathered anywhere."""
    own = analyses.select("id", "event_id", F.try_parse_json("payload").alias("v")).select("id", "event_id", "v", shape_faults(F.col("v"), media_kinds, drivers).alias("shape"))
    parsed = own.withColumn("stray_numbers", F.when(F.size("shape") == 0, stray_numbers(F.col("v"))).otherwise(F.array().cast("array<string>")))
    ids = F.flatten(F.transform(F.try_variant_get("v", "$.claims", "array<variant>"), lambda c: F.try_variant_get(c, "$.evidenceIds", "array<string>")))
    text = lambda key: F.try_variant_get("v", f"$.{key}", "string")
    read = parsed.select(
        "id", "event_id", "shape", "stray_numbers", F.when(F.size("shape") == 0, F.array_distinct(ids)).alias("cited"), text("confidence").alias("said"), text("recommendedAction").alias("asked"),
        F.try_variant_get("v", "$.injectionObserved", "boolean").alias("observed"),
    )
    parsed = written(read, "analyses")  # payloads are read once, what is joined is what they say
    cited = parsed.select("id", "event_id", F.explode("cited").alias("evidence_id"))
    known = evidence.select("event_id", F.col("evidence_id").cast("string").alias("evidence_id"))
    unknown = cited.join(known, ["event_id", "evidence_id"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("evidence_id")).alias("unknown_ids"))
    df = parsed.join(unknown, "id", "left").join(official.select("event_id").distinct().withColumn("_official", F.lit(True)), "event_id", "left")
    df = df.withColumn("unknown_ids", F.coalesce("unknown_ids", F.array().cast("array<string>")))
    verdict = F.when(F.size("shape") > 0, "shape").when(F.size("unknown_ids") > 0, "unknown_evidence").when(F.size("stray_numbers") > 0, "unsupported_number").otherwise("ok")
    low, action = F.col("_official").isNull() | F.col("observed"), F.col("asked")
    confidence = F.when(low, "LOW").otherwise(F.col("said"))
    action = F.when((confidence == "LOW") & ~action.isin(*CAREFUL), "VERIFY").otherwise(action)
    good = lambda c: F.when(F.size("shape") == 0, c)
    return df.select("id", "event_id", verdict.alias("verdict"), "shape", "unknown_ids", "stray_numbers", good(confidence).alias("confidence"), good(action).alias("action"))
