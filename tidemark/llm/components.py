"""Connected components by contraction: each round every node joins its neighbour of least hash, edges between joined nodes go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_small, stored

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)`` (longs); equal roots: same component. Which node is the root is arbitrary but
    deterministic. A round's hash order is new, so long chains shrink by a constant factor a round too."""
    pairs = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "cc-labels")
    for number in range(MAX_ROUNDS):
        if pairs.isEmpty():
            return labels
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("v"))
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), order("b").alias("o")), F.struct(F.col("b").alias("u"), order("a").alias("o")))).alias("x")).select("x.u", "x.o")
        nearest = both.groupBy("u").agg(F.min("o").alias("o"))
        step = stored(nearest.select("u", F.least("o", order("u"))["v"].alias("p")), "cc-step")
        at = lambda c: step.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))
        next_pairs = join_small(join_small(pairs, at("a"), ["a"]), at("b"), ["b"]).where("pa <> pb")
        next_pairs = stored(next_pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        moved = join_small(labels, step.toDF("root", "p"), ["root"], "left").select("node", F.coalesce("p", "root").alias("root"))
        next_labels = stored(moved, "cc-labels")
        for old in (pairs, step, labels):
            discard(old)
        pairs, labels = next_pairs, next_labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
