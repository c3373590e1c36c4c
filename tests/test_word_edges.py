"""Terms beside letters that ASCII lacks: an edge lies between the two, as the patterns' SQL and reference read them."""

from pyspark.sql import functions as F

from tests.test_goldens import column, strategic
from tidemark.functions import text
from tidemark.operators import aggregates, strategy


def test_category_beside_other_letters(spark):
    none = F.array().cast("array<string>")
    texts = ["a chipö here", "égpu", "prixé pricing", "viralé", "chips", "chip_set"]
    assert column(spark, texts, lambda x: text.infer_category(x, none)) == ["hardware", "hardware", "policy_platform", "social_trend", "software", "software"]


def test_forcing_beside_other_letters(spark):
    titles = ["Firm suedö today", "It was éstolen", "Claims ülawsuit", "a leaké", "suedö_ and sued_"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "event_id long, title string").withColumns({"summary": F.lit(""), "injection_flagged": F.lit(False), "has_official": F.lit(True), "source_count": F.lit(3)})
    found = rows.select("event_id", strategy.forcing_rule().alias("forced")).orderBy("event_id").collect()
    assert [r["forced"] for r in found] == ["accusation", "accusation", "accusation", "rumour_or_leak", "accusation"]


def test_recommendation_beside_other_letters(spark):
    r = strategy.recommend(strategic(spark, title="Firm suedö over API pricing")).first()
    assert (r["action"], r["reason"], r["option"], r["manual_flag"]) == ("VERIFY", "accusation", "wait", True)


def test_restraint_beside_other_letters(spark):
    r = aggregates.restraint(strategy.recommend(strategic(spark, title="Firm suedö over API pricing"))).first()
    assert (r["n"], r["restrained"], r["manual_flags"]) == (1, 1, 1)


def test_summary_beside_other_letters(spark):
    rows = aggregates.strategy_summary(strategy.recommend(strategic(spark, title="Firm suedö over API pricing"))).collect()
    assert {(r["action"], r["reason"]) for r in rows} == {("VERIFY", "*"), ("*", "accusation"), ("*", "*")}


def test_alert_beside_other_letters(spark):
    found = strategy.event_alerts(strategy.recommend(strategic(spark, title="Firm suedö over API pricing", hours_since=9.0))).collect()
    assert [r["tier"] for r in found] == ["urgent"]
