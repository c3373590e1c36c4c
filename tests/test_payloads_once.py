"""Payloads are parsed in one pass; what follows joins what they say."""

import json

from tidemark.operators import analyses


def test_payloads_are_read_once(spark):
    rows = spark.createDataFrame([(1, 1, "no json"), (2, 1, json.dumps({"claims": []})), (3, 2, None)], "id long, event_id long, payload string")
    evidence = spark.createDataFrame([(1, "e1")], "event_id long, evidence_id string")
    df = analyses.check_analyses(rows, evidence, evidence.select("event_id"))
    assert [(r["id"], r["verdict"], r["shape"][0], r["confidence"]) for r in df.orderBy("id").collect()] == [(1, "shape", "json", None), (2, "shape", "keys", None), (3, "shape", "json", None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan.lower() and "variant" not in plan.lower()
