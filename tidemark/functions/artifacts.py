"""Named artifacts (models, versions, repositories) and entities of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_alias

# Patterns of model names, versions and repositories, and words that look like repositories.
MODELS = (
    r"(?i)\bclaude-[a-z0-9]+(?:-[a-z0-9]+)*\b",
    r"(?i)\bgpt-[0-9][a-z0-9]*(?:-[a-z0-9]+)*\b",
    r"(?i)\bo[1-9]-(?:mini|preview|pro)\b",
    r"(?i)\bgemini-[0-9][a-z0-9.]*(?:-[a-z]+)*\b",
    r"(?i)\bllama[-\s]?[0-9](?:\.[0-9]+)?(?:[-\s][a-z]+)?\b",
    r"(?i)\b(?:mistral|mixtral|codestral)-[a-z0-9]+(?:[-x][a-z0-9]+)*\b",
    r"(?i)\bqwen[0-9](?:\.[0-9]+)?(?:-[a-z0-9]+)*\b",
    r"(?i)\bdeepseek-[a-z][0-9]?(?:-[a-z0-9]+)*\b",
    r"(?i)\bgrok-[0-9](?:-[a-z]+)*\b",
    r"(?i)\b(?:phi|gemma)-[0-9](?:\.[0-9]+)?(?:-[a-z]+)*\b",
)
VERSION = r"(?i)\bv[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-[a-z0-9.]+)?\b|\b[0-9]+\.[0-9]+\.[0-9]+(?:-[a-z0-9.]+)?\b|\bb[0-9]{4,}\b"
REPO = r"(?i)\b(?:github\.com/)?([a-z0-9][a-z0-9-]{0,38}/[a-z0-9][a-z0-9._-]{0,99})\b"
REPO_STOPWORDS = ("and", "or", "input", "output", "read", "write", "yes", "no", "on", "off", "http", "https", "am", "pm", "w", "n", "s", "e", "a", "i", "km", "kg", "ms", "gb", "tb")
MODEL_ENTITY = (
    ("^claude-", "anthropic"),
    ("^gpt-", "openai"),
    ("^o[1-9]-", "openai"),
    ("^gemini-", "google-deepmind"),
    (r"^llama[-\s]?[0-9]", "meta"),
    ("^(?:mistral|mixtral|codestral)-", "mistral"),
    ("^qwen[0-9]", "alibaba"),
    ("^deepseek-", "deepseek"),
    ("^grok-", "xai"),
    ("^gemma-", "google-deepmind"),
    ("^phi-", "microsoft"),
)


def _unique(values: Column) -> Column:
    low = F.transform(values, lambda x: F.trim(F.lower(x)))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: x != "")))


def models(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in MODELS])
    return _unique(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "-")))


def versions(text: Column) -> Column:
    return _unique(F.regexp_extract_all(text, F.lit(VERSION), 0))


def repos(text: Column) -> Column:
    def real(x: Column) -> Column:
        parts = F.split(F.lower(x), "/")
        return ~F.exists(parts, lambda p: p.isin(*REPO_STOPWORDS) | F.rlike(p, F.lit("^[0-9]+$")))

    return _unique(F.filter(F.regexp_extract_all(text, F.lit(REPO), 1), real))


def extract_artifacts(df: DataFrame, text: str, title: str) -> DataFrame:
    """Adds ``artifacts``: models, versions and repos of the text, and models and versions of the title."""
    t, h = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    return df.withColumn("artifacts", F.struct(models(t).alias("models"), versions(t).alias("versions"), repos(t).alias("repos"), models(h).alias("title_models"), versions(h).alias("title_versions")))


def _keyed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(kind + ":"), x))


def identity_keys(artifacts: Column) -> Column:
    """Keys of what the title names."""
    return F.array_distinct(F.concat(_keyed("model", artifacts["title_models"]), _keyed("version", artifacts["title_versions"])))


def artifact_keys(artifacts: Column) -> Column:
    return F.array_distinct(F.concat(_keyed("model", artifacts["models"]), _keyed("version", artifacts["versions"]), _keyed("repo", artifacts["repos"])))


def entities_of_models(models_: Column) -> Column:
    """The vendor of each model name, first rule wins."""
    def vendor(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, entity in reversed(MODEL_ENTITY):
            out = F.when(F.rlike(m, F.lit(pattern)), entity).otherwise(out)
        return out

    return F.array_distinct(F.array_compact(F.transform(models_, vendor)))


#: Words of a piece of text whose grams are listed at once.
PIECE_WORDS = 4096
#: Hash slots of the filter before the registry's join. With very many aliases more grams pass it; none is lost.
ALIAS_SLOTS = 1 << 19


def extract_entities(df: DataFrame, key: str, text: str, aliases: DataFrame, entities: DataFrame, most: int = 3, normalise: bool = True) -> DataFrame:
    """``key, entities``: ids found by their aliases in grams of one to ``most`` words; an exact-case alias must stand in the text
    as it is written; by relevance (highest first), then id.

    ``aliases(entity_id, alias, normalized, requires_exact_case)``, ``entities(id, operator_relevance)``. Null and empty texts have no row. A text is read in
    pieces of ``PIECE_WORDS`` words that overlap; before anything moves, grams are met with the hash slots that aliases occupy, so only names, and the share
    of other grams that fall into such a slot, are joined to the registry."""
    # Words are folded once a text; line feeds stand between them, which folding neither makes nor moves.
    raw = df.select(key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "\n").alias("_raw"))
    both = F.zip_with(F.split("_raw", "\n"), F.split(normalize_alias(F.col("_raw"), normalise, "\n"), "\n"), lambda r, n: F.struct(r.alias("raw"), n.alias("normalized")))
    words = raw.select(key, F.filter(both, lambda w: w["raw"] != "").alias("_w"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1)), F.lit(PIECE_WORDS)), lambda i: F.slice("_w", i, PIECE_WORDS + most - 1))
    pieces = words.select(key, F.explode_outer(pieces).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.least(F.size("_w"), F.lit(PIECE_WORDS)), F.lit(1)))

    def gram(i: Column, n: Column) -> Column:
        part = F.slice("_w", i, n)
        return F.concat(F.array_join(part["normalized"], ""), F.lit("\n"), F.array_join(part["raw"], " "))  # one string: distinct by hash

    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.filter(starts, lambda i: i + n - 1 <= F.size("_w")), lambda i: gram(i, n))))
    # An outer explode, as the plain one would build its array once more in a filter of its own.
    rows = pieces.select(key, F.explode_outer(F.array_distinct(grams)).alias("_g"))
    rows = rows.select(key, F.substring_index("_g", "\n", -1).alias("raw"), F.substring_index("_g", "\n", 1).alias("normalized")).where("normalized <> ''")
    slot = F.pmod(F.xxhash64("normalized"), F.lit(ALIAS_SLOTS)).alias("_slot")
    # At most ALIAS_SLOTS numbers, however many aliases there are.
    rows = rows.select("*", slot).join(F.broadcast(aliases.select(slot).distinct()), "_slot", "left_semi").drop("_slot")
    hits = rows.join(aliases, "normalized").where(~F.col("requires_exact_case") | F.contains("raw", F.col("alias")))
    found = hits.select(key, F.col("entity_id").alias("_entity")).distinct().join(entities.select(F.col("id").alias("_entity"), "operator_relevance"), "_entity")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("operator_relevance")).alias("r"), F.col("_entity").alias("e")))), lambda x: x["e"])
    return found.groupBy(key).agg(ordered.alias("entities"))
