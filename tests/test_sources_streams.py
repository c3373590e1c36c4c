"""Feeds, the landing source and the streaming jobs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, joins
from tidemark.operators.aggregates import price_table
from tidemark.sources import feeds, landing
from tidemark.streaming import streams

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title> One </title><link>https://e.example/1</link><description>&lt;p&gt;b&lt;/p&gt;</description><pubDate>Mon, 06 Jan 2025 10:00:00 GMT</pubDate></item>
<item><title>Two</title><link>https://e.example/2</link><guid>g2</guid><pubDate>nonsense</pubDate></item>
<item><title></title><link>https://e.example/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title>Three</title><id>tag:3</id><link rel="self" href="https://e.example/self"/><link rel="alternate" href="https://e.example/alt"/><updated>2025-01-06T10:00:00Z</updated><author><name>A</name></author><summary>s</summary></entry></feed>"""


def test_feed_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    rows = {r["title"]: r for r in feeds.read_feed_items(spark, str(tmp_path)).collect()}
    assert set(rows) == {"One", "Two", "Three"}
    assert rows["One"]["external_id"] == rows["One"]["url"] == "https://e.example/1" and rows["One"]["body"] == "<p>b</p>" and rows["One"]["published_at"] == 1736157600
    assert rows["Two"]["external_id"] == "g2" and rows["Two"]["published_at"] is None
    assert rows["Three"]["url"] == "https://e.example/alt" and rows["Three"]["external_id"] == "tag:3" and rows["Three"]["author"] == "A" and rows["Three"]["published_at"] == 1736157600


def test_feed_outcomes(spark):
    cases = {
        RSS: ("ok", 3, False),
        ATOM: ("ok", 1, False),
        RSS + "garbage": ("ok", 3, True),
        '<rss version="2.0"><channel></channel></rss>': ("empty_feed", 0, False),
        '<rss version="2.0"><channel>': ("not_a_feed", 0, False),
        '{"a": 1}': ("not_a_feed", 0, False),
        "<!DOCTYPE html><html><body>x</body></html>": ("not_a_feed", 0, False),
        None: ("not_a_feed", 0, False),
    }
    docs = spark.createDataFrame([(str(i), b) for i, b in enumerate(cases)], "path string, body string")
    rows = feeds.classify_feed_documents(docs).orderBy("path").collect()
    assert [(r["outcome"], r["n_items"], r["warning"]) for r in rows] == list(cases.values())
    assert rows[0]["newest_at"] == rows[1]["newest_at"] == 1736157600 and rows[3]["newest_at"] is None


def test_feed_faults_and_times(spark):
    item = lambda d: f"<item><title>t</title><pubDate>{d}</pubDate></item>"
    feed = lambda x: f'<rss version="2.0"><channel><pubDate>Wed, 01 Jan 2031 00:00:00 GMT</pubDate>{x}</channel></rss>'
    cases = [
        (feed(item("Mon, 06 Jan 2025 10:00:00 GMT") + item("Tue, 07 Jan 2025 10:00:00 GMT") + item("soon")), False, 1736244000),
        (feed(item("never")), False, None),
        (feed(item("2025-01-06") + "<open>"), True, 1736121600),
        (feed("<item a=b><title>t</title></item>"), True, None),
    ]
    rows = feeds.classify_feed_documents(spark.createDataFrame([(str(i), b) for i, (b, _, _) in enumerate(cases)], "path string, body string")).orderBy("path").collect()
    assert [(r["outcome"], r["warning"], r["newest_at"]) for r in rows] == [("ok", w, t) for _, w, t in cases]


def test_batch_costs(spark):
    rows = spark.createDataFrame([("a", "alpha-2-x", 1000, 100), ("b", "none", 5, 5), ("c", None, None, None)], "custom_id string, model string, input_tokens long, output_tokens long")
    found = {r["custom_id"]: r["cost_micro"] for r in feeds.batch_costs(rows, price_table(spark)).collect()}
    assert found == {"a": 3750, "b": None, "c": None}


def test_batch_results(spark, tmp_path):
    ok = {"custom_id": "a", "result": {"type": "succeeded", "message": {"content": [{"text": '{"x": 1}'}], "usage": {"input_tokens": 5, "output_tokens": 2}}}}
    bad = {"custom_id": "b", "result": {"type": "succeeded", "message": {"content": [{"text": "no"}]}}}
    error = {"custom_id": "c", "result": {"type": "errored", "error": {"message": "m"}}}
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, (ok, bad, error))))
    rows = {r["custom_id"]: r for r in feeds.batch_results(spark, str(tmp_path)).collect()}
    assert [rows[k]["status"] for k in "abc"] == ["ok", "invalid_json", "errored"] and rows["a"]["input_tokens"] == 5 and rows["c"]["error"] == "m"


def test_logs_are_partitioned_by_date(spark, tmp_path):
    df = spark.createDataFrame([("s", "m", 5, 0, 0), ("s", "m", 0, 0, 86_400)], "stage string, model string, cost_micro long, cache_read_tokens long, created_at long")
    for _ in range(2):
        feeds.append_analyses(df, str(tmp_path / "a"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4 and spark.read.parquet(str(tmp_path / "l")).count() == 2
    assert sorted(p.name for p in (tmp_path / "a").glob("date=*")) == ["date=1970-01-01", "date=1970-01-02"]


def test_landing_source(spark, tmp_path):
    landing.register(spark)
    for i in range(5):
        (tmp_path / f"s{i}.xml").write_text(f"body {i}")
    df = spark.read.format("landing").option("path", str(tmp_path)).option("filesPerTask", "2").load()
    assert {r["source_id"]: r["body"] for r in df.collect()} == {f"s{i}": f"body {i}" for i in range(5)}


def test_landing_stream_goes_on_from_its_cursor(spark, tmp_path):
    """A restarted stream takes only the files behind its offset, whatever has happened to those before."""
    landing.register(spark)
    (tmp_path / "in").mkdir()

    def land(*names):
        for name in names:
            (tmp_path / "in" / f"{name}.xml").write_text(f"body {name}")

    def run():
        stream = spark.readStream.format("landing").option("path", str(tmp_path / "in")).option("filesPerTask", "1").load()
        q = stream.writeStream.foreachBatch(lambda df, n: batches.append(sorted(r["source_id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    batches = []
    land("a", "b", "c")
    run()
    assert sum(batches, []) == ["a", "b", "c"]
    (tmp_path / "in" / "a.xml").unlink()
    land("d", "e")
    batches.clear()
    run()
    assert sorted(sum(batches, [])) == ["d", "e"]
    batches.clear()
    run()
    assert sum(batches, []) == []


def test_new_items_by_keyed_state(spark, tmp_path):
    rows = [[(3, "s", "x"), (1, "s", "x"), (2, None, "x")], [(4, "s", "x"), (5, None, "x"), (6, "s", None), (7, "s", "y")]]
    schema, found = "id long, source_id string, external_id string", []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = streams.stream_new_items(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl_ms=3_600_000)
        q = new.writeStream.foreachBatch(lambda df, n: found.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [x for x in found if x] == [[1, 2], [6, 7]]


def test_stream_of_artifact_matches_equals_batch(spark, tmp_path):
    rows = [(i, [f"k{i % 3}"], [f"e{i % 2}"], i * 9 * 3600) for i in range(20)]
    items = spark.createDataFrame(rows, "id long, keys array<string>, entities array<string>, at long")
    for i in range(0, 20, 7):
        items.where(f"id between {i} and {i + 6}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
    q = streams.stream_artifact_matches(stream, late="30 days").writeStream.format("memory").queryName("matches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.table("matches").select("a", "b").collect())) == sorted(map(tuple, joins.artifact_matches(items).collect()))


def test_crash_between_the_writes_repeats_nothing(spark, tmp_path, monkeypatch):
    schema = "id long, url string, content_hash string, keys array<string>, entities array<string>, category string, at long, embedding array<float>"
    rows = [(i, f"u{i % 2}", f"h{i}", [], ["e"], "ai", i * 3600, None) for i in range(4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    append, out = streams._append, str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.stream_cluster(stream, str(tmp_path / "seen"), str(tmp_path / "cp"), clustering.cluster_items, out, trigger={"availableNow": True}).awaitTermination(300)

    def crash(df, path, number):
        if path.endswith("seen"):
            raise OSError("lost")
        append(df, path, number)

    monkeypatch.setattr(streams, "_append", crash)
    with pytest.raises(Exception, match="lost"):
        run()
    assert spark.read.parquet(out).count() == 4
    monkeypatch.setattr(streams, "_append", append)
    run()
    assert sorted((r["id"], r["event_id"]) for r in spark.read.parquet(out).collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_user_embedder(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    out = clustering.embed_with(df, lambda texts: [[float(len(t)), 1.0] for t in texts], "t", 2)
    assert [list(r["embedding"]) for r in out.collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, target, seen = tmp_path / "in", str(tmp_path / "out"), []
    first = spark.createDataFrame([(1, "s1", "x"), (2, "s2", "y"), (3, "s1", "x")], "id long, source_id string, external_id string")
    sources = spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, priority int")
    then = streams.priority_trigger(sources, lambda hot: seen.append(sorted(r["id"] for r in hot.collect())))
    for n, batch in enumerate((first, first.unionByName(spark.createDataFrame([(4, "s2", "z")], first.schema)))):
        batch.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(first.schema).parquet(str(source))
        q = streams.stream_ingest(stream, target, str(tmp_path / "cp"), {"availableNow": True}, then)
        q.awaitTermination(120)
        assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ([1, 2] if n == 0 else [1, 2, 4])
    assert seen == [[1]]


def test_stream_cluster_equals_batch(spark, tmp_path):
    schema = "id long, url string, content_hash string, keys array<string>, entities array<string>, category string, at long, embedding array<float>"
    rows = [(i, f"u{i % 3}", f"h{i}", [], ["e"], "ai", i * 3600, [1.0, 0.1 * i]) for i in range(6)]
    out = str(tmp_path / "out")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.stream_cluster(stream, str(tmp_path / "seen"), str(tmp_path / "cp"), clustering.cluster_items, out, trigger={"availableNow": True}).awaitTermination(300)
    whole = {r["id"]: r["event_id"] for r in clustering.cluster_items(spark.createDataFrame(rows, schema)).collect()}
    assert {r["id"]: r["event_id"] for r in spark.read.parquet(out).collect()} == whole


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = [(i, f"k{i % 3}", "p", 5) for i in range(6)]
    spark.createDataFrame(rows, "s long, content_hash string, provider string, cost_micro long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("s long, content_hash string, provider string, cost_micro long").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("s") * 20_000))

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(result(streams.stream_exact_dedup(stream()), "dedup", "append")) == 3
    assert {(r["day"], r["cost_micro"]) for r in result(streams.stream_spend(stream()), "spend", "complete")} == {(0, 25), (86_400, 5)}
    mentions = stream().select("ts", F.lit(1).alias("trend_id"), F.col("content_hash").alias("source_id"))
    assert sum(r["mention_count"] for r in result(streams.stream_mentions(mentions), "mentions", "complete")) == 12


def test_stream_alerts_keep_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "day long, seq long, dedupe_key string"
    q, found = None, {}
    for part in ([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], [(1, 4, "a"), (1, 5, "c"), (2, 6, "a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = streams.stream_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cap=2)
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    found = {r["seq"]: r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: "sent", 2: "duplicate", 3: "sent", 4: "duplicate", 5: "daily_cap", 6: "sent"}


def test_stream_freshness_timer(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "source_id string, seconds long"
    spark.createDataFrame([("s", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = streams.stream_freshness(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = df.writeStream.format("memory").queryName("fresh").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("fresh").count():
                break
        assert spark.table("fresh").first()["source_id"] == "s"
    finally:
        q.stop()
