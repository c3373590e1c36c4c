"""Feed items in their final form: every transform of titles and texts, composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import artifacts as G
from ..functions import injection as I
from ..functions import text as N
from ..functions import web as U
from ..tables import written

#: Characters of a title, of a summary, and of the summary's head that is embedded.
TITLE_CHARS, SUMMARY_CHARS, EMBEDDED_CHARS = 500, 2000, 600


def normalize_items(items: DataFrame, sources: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each of ``items(id, source_id, title, body, url, content_hash, published_at, fetched_at)`` whose source is among
    ``sources(id, category, is_official, reliability, entity)``; aliases and entities are those of :func:`extract_entities`.

    Title and body are cleaned apart (500 and 2,000 characters: the feature's own cuts) and searched for injection as they came. Entities are those that
    the text names, then those that its models imply, with the source's own in front unless it is among them. An item without a publishing time has that of
    its fetch and is marked. Null titles and bodies are empty; a null address stays null; rows that repeat an id need distinct ids first, as the entities
    are joined by it."""
    df = I.detect_injection(items, "title").withColumnRenamed("signals", "_title_signals")
    df = I.detect_injection(df, "body").withColumnRenamed("signals", "_body_signals")
    for column, name, most in (("title", "_t", TITLE_CHARS), ("body", "_b", SUMMARY_CHARS)):
        kept = df.columns
        df = N.sanitize(df, column, most).select(*kept, F.col("clean").alias(name), F.col("truncated").alias(f"{name}_cut"))
    # Cleaned and searched once: the whole texts end here, rows and entities are made of the cut ones.
    df = written(df.drop("title", "body").withColumn("_both", F.concat_ws("\n", "_t", "_b")), "cleaned")
    df = U.canonicalize_url(G.extract_artifacts(df, "_both", "_t"), "url")
    named = G.extract_entities(df.select("id", "_both"), "id", "_both", aliases, entities).withColumnRenamed("entities", "_named")
    own = sources.select(F.col("id").alias("source_id"), F.col("category").alias("source_category"), "is_official", "reliability", F.col("entity").alias("_own"))
    df = df.join(own, "source_id").join(named, "id", "left")
    none = F.array().cast("array<string>")
    found = F.array_union(F.coalesce("_named", none), G.entities_of_models(F.col("artifacts.models")))
    first = F.when(F.col("_own").isNotNull() & ~F.array_contains(found, F.col("_own")), F.array("_own")).otherwise(none)
    df = df.withColumn("entities", F.concat(first, found))
    embedded = F.regexp_replace(F.concat("_t", F.lit("\n\n"), F.substring("_b", 1, EMBEDDED_CHARS)), r"^\s+|\s+$", "")
    return df.select(
        "id", "source_id", "source_category", "is_official", "reliability", F.col("_t").alias("title"), F.col("_b").alias("summary"), "canonical_url", "content_hash", "entities", "artifacts",
        N.infer_category(F.col("_both"), F.col("entities")).alias("category"), F.coalesce("published_at", "fetched_at").alias("occurred_at"), F.col("published_at").isNull().alias("occurred_estimated"),
        "fetched_at", F.concat("_title_signals", "_body_signals").alias("signals"), (F.col("_t_cut") | F.col("_b_cut")).alias("truncated"), embedded.alias("embedding_text"),
    )
