"""Segmented scans and rank selection against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, history, scans


def log(n=600, seed=3):
    rng = np.random.default_rng(seed)
    for i in rng.permutation(n).tolist():
        yield i, None if i % 50 == 7 else "hot" if rng.random() < 0.6 else f"k{int(rng.integers(0, 4))}", bool(rng.random() < 0.85), None if i % 31 == 0 else int(rng.integers(0, 9)), i // 3 * 40


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_scans_equal_loops(spark, size, monkeypatch):
    monkeypatch.setattr(scans, "SLICE", size)
    rows = list(log())
    df = spark.createDataFrame(rows, "id long, k string, hit boolean, x long, at long").repartition(3)
    run, total, last, want = {}, {}, {}, {}
    for i, k, hit, x, at in sorted(rows):
        run[k] = run.get(k, 0) + 1 if hit else 0
        want[i] = run[k], total.get(k, 0), last.get(k)
        total[k] = total.get(k, 0) + (x or 0)
        last[k] = at
    got = scans.run_length(df, ["k"], "id", F.col("hit"), "run")
    got = scans.sum_before(got, ["k"], "id", F.coalesce("x", F.lit(0)), "before")
    got = scans.value_before(got, ["k"], "at", "last", ["id"], size * 50)
    assert {r["id"]: (r["run"], r["before"], r["last"]) for r in got.collect()} == want


@pytest.mark.parametrize("buckets", [2, 3, 4096])
def test_ranks(spark, buckets, monkeypatch):
    monkeypatch.setattr(scans, "BUCKETS", buckets)
    rng = np.random.default_rng(buckets)
    values = [*rng.exponential(1.0, 200).tolist(), *[0.25] * 150, -1e9, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [0, 1, 100, 175, 200, 350, 351]
    assert scans.at_ranks(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    assert scans.at_ranks(df, "v", [352]) == [None] and scans.at_ranks(df.limit(0), "v", [0]) == [None]


def test_reports_of_nothing(spark):
    events = spark.createDataFrame([], "occurred_at long, first_seen_at long, occurred_estimated boolean")
    assert aggregates.corpus_span(events).first().asDict() == {"full_days": None, "middle_days": None}
    assert set(aggregates.detection_latency(events).first().asDict().values()) == {None}
    no_log = spark.createDataFrame([], "id long, source_id long, outcome string, started_at long")
    assert history.breaker_state(no_log).count() == 0


def test_one_hot_source_is_many_tasks(spark, monkeypatch):
    """A source that holds every row: no task orders more than a slice of it."""
    monkeypatch.setattr(scans, "SLICE", 1000)
    df = spark.range(20_000).selectExpr("id", "1L as source_id", "if(id % 10 = 0, 'ok', 'timeout') as outcome", "id * 60 as started_at")
    state = history.breaker_state(df)
    assert state.where("failures <> id % 10").count() == 0
    slices = scans.sliced(df, "id").groupBy("source_id", "_slice").count()
    assert slices.agg(F.max("count")).first()[0] == 1000 and slices.count() == 20
