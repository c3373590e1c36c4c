"""Pairs by shared keys and entities against all pairs, and what their join makes."""

import numpy as np
import pytest

from tidemark.operators import joins

HOUR = 3600
SCHEMA = "id long, keys array<string>, entities array<string>, at long"


@pytest.mark.parametrize("require", [True, False])
def test_pairs_of_several_keys_come_once(spark, require):
    rng = np.random.default_rng(3)
    some = lambda names: [names[i] for i in rng.integers(0, len(names), rng.integers(0, 4))]
    rows = [(i, some(["k1", "k2", "k3", None]), some(["e1", "e2", "e3", "e4", None]), int(rng.integers(-100, 200)) * HOUR) for i in range(90)] + [(90, None, ["e1"], 0), (91, ["k1"], None, 0)]
    both = lambda x, y: bool({*(x or ())} & {*(y or ())} - {None})
    want = sorted((r[0], s[0]) for r in rows for s in rows if r[0] < s[0] and abs(r[3] - s[3]) <= 48 * HOUR and both(r[2], s[2]) and (both(r[1], s[1]) or not require))
    assert want and sorted(map(tuple, joins.artifact_matches(spark.createDataFrame(rows, SCHEMA), 48, require).collect())) == want


def test_join_makes_no_pairs_of_other_entities(spark):
    """A key that all items share makes pairs of equal entities only, and no pairs are shuffled to be told apart."""
    rows = spark.range(400).selectExpr("id", "array('k') as keys", "array(concat('e', id % 100)) as entities", "0L as at")
    plan = (df := joins.artifact_matches(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 100 * 6 and "Aggregate" not in plan and "one_entities" in plan.split("Join Inner")[1].split("\n")[0]
