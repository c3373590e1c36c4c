"""Running values over long logs, and elements by rank, without one task that orders a whole key or table.

A log's rows have whole numbers to order them. They are cut into slices of ``SLICE`` numbers, so a slice of a key has that many rows at most where the numbers
are its rows' own ids; a summary of each (key, slice) is scanned instead of the rows, and what it says is carried into each slice, which is then ordered alone.
One hot key is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 16
#: Buckets of one pass of a rank selection: as many rows as come to the driver.
BUCKETS = 4096


def sliced(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / F.lit(width or SLICE)))


def _before(key: list[str]):
    return Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, key: list[str], summary: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns of a scanned ``summary`` of its (key, slice), by a join that null keys take part in."""
    renamed = summary.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*key, "_slice"])), *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*key, "_slice"])]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(renamed, on).drop(*(f"_k{i}" for i in range(len(key) + 1)))


def sum_before(df: DataFrame, key: list[str], order: str, value: Column, out: str, tie: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over a key's rows before this one, 0 for its first."""
    df = sliced(df.withColumn("_value", value), order, width)
    summary = df.groupBy(*key, "_slice").agg(F.sum("_value").alias("_sum")).withColumn("_carry", F.coalesce(F.sum("_sum").over(_before(key)), F.lit(0)))
    within = Window.partitionBy(*key, "_slice").orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, -1)
    df = carried(df, key, summary, ["_carry"])
    return df.withColumn(out, F.col("_carry") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_value", "_slice", "_carry")


def run_length(df: DataFrame, key: list[str], order: str, hit: Column, out: str) -> DataFrame:
    """Adds how many rows up to this one are hits in a row, without a break; 0 where it is none."""
    df = sliced(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), order)
    within = Window.partitionBy(*key, "_slice").orderBy(order)
    df = df.withColumn("_breaks", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(within))
    last = F.max("_breaks").over(Window.partitionBy(*key, "_slice"))
    tail = F.when(F.col("_hit") & (F.col("_breaks") == F.col("_last")), 1).otherwise(0)
    summary = df.withColumn("_last", last).groupBy(*key, "_slice").agg(F.count("*").alias("_n"), F.max("_last").alias("_last"), F.sum(tail).alias("_tail"))
    # Hits before a slice: all of the slices since the last break, and that one's tail.
    upto = F.sum(F.when(F.col("_last") == 0, F.col("_n")).otherwise(F.col("_tail"))).over(Window.partitionBy(*key).orderBy("_slice"))
    summary = summary.withColumn("_upto", upto).withColumn("_base", F.when(F.col("_last") > 0, F.col("_upto") - F.col("_tail")))
    carry = F.coalesce(F.max("_upto").over(_before(key)) - F.coalesce(F.max("_base").over(_before(key)), F.lit(0)), F.lit(0))
    df = carried(df, key, summary.withColumn("_carry", carry), ["_carry"])
    run = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(Window.partitionBy(*key, "_slice", "_breaks").orderBy(order))
    found = F.when(F.col("_hit"), run + F.when(F.col("_breaks") == 0, F.col("_carry")).otherwise(0)).otherwise(0)
    return df.withColumn(out, found).drop("_hit", "_breaks", "_slice", "_carry")


def value_before(df: DataFrame, key: list[str], order: str, out: str, tie: list[str], width: int) -> DataFrame:
    """Adds the ``order`` value of the key's row before this one, null for its first."""
    df = sliced(df, order, width)
    summary = df.groupBy(*key, "_slice").agg(F.max(order).alias("_max")).withColumn("_carry", F.max("_max").over(_before(key)))
    within = Window.partitionBy(*key, "_slice").orderBy(order, *tie)
    df = carried(df, key, summary, ["_carry"])
    return df.withColumn(out, F.coalesce(F.lag(order).over(within), "_carry")).drop("_slice", "_carry")


def at_ranks(df: DataFrame, value: str, ranks: list[int]) -> list:
    """The elements of ``value`` (a number, without nulls) at ``ranks``, counted from 0 in ascending order; null beyond the last. Each pass is a histogram of
    ``BUCKETS`` at most between two values; the bucket that holds the rank is what the next one looks into, until it holds one value only."""
    out = []
    for rank in ranks:
        inside, below = df.select(F.col(value).alias("x")), 0
        while True:
            ends = inside.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
            low, high = ends["low"], ends["high"]
            if low is None or low == high:
                break
            share = (F.col("x") - F.lit(low)) / (F.lit(high).cast("double") - F.lit(low).cast("double"))
            bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int").alias("bucket")
            rows = inside.groupBy(bucket).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()  # BUCKETS rows at most
            found = None
            for r in sorted(rows, key=lambda r: r["bucket"]):
                if rank < below + r["n"]:
                    found = r
                    break
                below += r["n"]
            if found is None:
                low = None
                break
            inside = df.select(F.col(value).alias("x")).where(F.col("x").between(found["low"], found["high"]))
        out.append(low)
    return out
