"""The registry of entities and their aliases, as tables, with its checks.

Edge cases: null lists of aliases count as empty; null names are kept; an empty registry gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_alias

SEED = "id string, name string, operator_relevance double, aliases array<string>, case_sensitive_aliases array<string>"


def registry_aliases(seeds: DataFrame, normalise: bool = True) -> DataFrame:
    """``(entity_id, alias, normalized, requires_exact_case)`` of ``seeds(id, aliases, case_sensitive_aliases)``: of the spellings of one
    entity with one normal form, the first declared; those that need their exact case come last. Entities that share a form each
    keep it: :func:`registry_problems` reports them."""
    listed = lambda c, exact: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(x.alias("alias"), F.lit(exact).alias("requires_exact_case")))
    declared = F.concat(listed("aliases", False), listed("case_sensitive_aliases", True))
    rows = seeds.select(F.col("id").alias("entity_id"), F.posexplode(declared).alias("place", "_a")).select("entity_id", "place", "_a.*")
    rows = rows.withColumn("normalized", normalize_alias(F.col("alias"), normalise))
    first = rows.groupBy("entity_id", "normalized").agg(F.min_by(F.struct("alias", "requires_exact_case"), "place").alias("_a"))
    return first.select("entity_id", "_a.alias", "normalized", "_a.requires_exact_case")


def load_registry(spark: SparkSession, path: str, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """``entities(id, name, operator_relevance)`` and their aliases, from JSON lines with the columns of ``SEED``."""
    seeds = spark.read.schema(SEED).json(path)
    return seeds.select("id", "name", "operator_relevance"), registry_aliases(seeds, normalise)


def registry_problems(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(problem, key, n)``: entity ids declared more than once, aliases that normalise to nothing, aliases of entities that are not
    declared, and forms that more than one entity owns. A sound registry has no row."""
    ids = entities.groupBy("id").agg(F.count("*").alias("n"))
    empty = F.coalesce("normalized", F.lit("")) == ""
    owned = aliases.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"))
    shared = aliases.where(~empty).groupBy("normalized").agg(F.countDistinct("entity_id").alias("n")).where("n > 1")
    unknown = owned.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    row = lambda df, problem, key, n: df.select(F.lit(problem).alias("problem"), F.col(key).alias("key"), F.col(n).alias("n"))
    out = row(ids.where("n > 1"), "duplicate_entity", "id", "n")
    out = out.unionByName(row(owned.where("empty > 0"), "empty_alias", "entity_id", "empty"))
    out = out.unionByName(row(unknown, "unknown_entity", "entity_id", "n"))
    return out.unionByName(row(shared, "shared_alias", "normalized", "n"))
