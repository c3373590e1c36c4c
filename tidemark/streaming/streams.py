"""Structured Streaming forms of the jobs. Each returns a started query or a streaming DataFrame; checkpoints and paths are arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.joins import append_new_items


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _table(spark: SparkSession, path: str, like: DataFrame, before: int | None = None) -> DataFrame:
    """A table that may not have been written yet; of one in batches (:func:`_append`) those before a number."""
    place, system = _place(spark, path)
    if not system.exists(place):
        return spark.createDataFrame([], like.schema)
    rows = spark.read.schema(like.schema).parquet(path) if before is None else spark.read.schema(f"{_ddl(like)}, batch long").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before).drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _append(rows: DataFrame, path: str, batch: int) -> None:
    """Writes a batch's rows to a folder of its own, so that a batch that is run again after a crash replaces what it had written."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class FirstSeen(StatefulProcessor):
    """State of one key: that it has been seen, for ``ttl_ms`` of processing time (0: for ever). The first row of a key passes, by ``first_by``."""

    def __init__(self, columns: list[str], first_by: str, ttl_ms: int) -> None:
        self.columns, self.first_by, self.ttl_ms = columns, first_by, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            part = part.sort_values(self.first_by).head(1)
            if best is None or part[self.first_by].iloc[0] < best[self.first_by].iloc[0]:
                best = part
        if not self.seen.exists() and best is not None:
            self.seen.update((True,))
            yield best[self.columns]

    def close(self) -> None:
        pass


def stream_new_items(items: DataFrame, keys: tuple[str, ...] = ("source_id", "external_id"), first_by: str = "id", ttl_ms: int = 0) -> DataFrame:
    """The first row of each key, told by keyed state and not by what has been written: a batch costs its own rows, however large the target has grown. With a
    time to live, a key that has not come for that long may pass again. Rows with a null key are told apart like any other. Needs the RocksDB state store."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    processor, mode = FirstSeen(items.columns, first_by, ttl_ms), "ProcessingTime" if ttl_ms else "None"
    return items.withColumn("_name", name).groupBy("_name").transformWithStateInPandas(processor, items.schema, "Append", mode)


def stream_ingest(items: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, then: Callable[[DataFrame], None] | None = None, keys: tuple[str, ...] = ("source_id", "external_id"), ttl_ms: int = 0) -> StreamingQuery:
    """Appends items whose key has not come before; replayed batches replace themselves. ``then`` sees each batch's new rows (the fast path for priority-1
    items). What is known is state of the query's checkpoint (:func:`stream_new_items`); the target is not read."""

    def each(batch: DataFrame, number: int) -> None:
        new = batch.persist()
        try:
            _append(new, target, number)
            if then:
                then(new)
        finally:
            new.unpersist()

    new = stream_new_items(items, keys, ttl_ms=ttl_ms)
    return new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def stream_artifact_matches(items: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """J2 as a stream joined with itself: pairs ``a, b`` (a < b) that share an identity key and an entity and whose times ``ts`` differ by ``hours`` at most.
    Watermarks and the interval bound the state: an item is held for the window and the lateness. A pair that shares several keys comes once for each."""
    span = F.expr(f"interval {hours} hours")
    side = lambda n: items.withWatermark("ts", late).select(*(F.col(c).alias(f"{c}_{n}") for c in ("id", "entities", "ts")), F.explode(F.array_distinct("keys")).alias(f"key_{n}"))
    a, b = side("a"), side("b")
    near = (F.col("key_a") == F.col("key_b")) & (F.col("ts_b") >= F.col("ts_a") - span) & (F.col("ts_b") <= F.col("ts_a") + span)
    return a.join(b, near & (F.col("id_a") < F.col("id_b")) & F.arrays_overlap("entities_a", "entities_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("key_a").alias("key"))


def priority_trigger(sources: DataFrame, start: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """For ``stream_ingest(then=...)``: calls ``start`` with the batch's items of priority-1 sources, if there are any."""
    first = sources.where("priority = 1").select(F.col("id").alias("source_id"))

    def then(new: DataFrame) -> None:
        hot = new.join(first, "source_id", "left_semi")
        if not hot.isEmpty():
            start(hot)

    return then


def stream_exact_dedup(items: DataFrame, key: str = "content_hash", within: str | None = None, time: str = "ts") -> DataFrame:
    """First item of each key: with unbounded state as the identity has no window, or within a watermark."""
    return items.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if within else items.dropDuplicates([key])


def stream_cluster(items: DataFrame, seen: str, checkpoint: str, cluster: Callable[[DataFrame], DataFrame], out: str, hours: int = 48, trigger: dict | None = None) -> StreamingQuery:
    """Clusters each batch's new items together with the stored items that they can match: those with an equal URL or hash at any time, those within the window
    on either side. ``cluster`` gets these items and returns ``id, event_id, stage, similarity``; stored items keep their decisions. A batch writes its decisions and
    then its items to folders of its own number and reads those of earlier numbers: after a crash between the two it runs again and repeats nothing."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = _table(spark, seen, batch, number)
        new = append_new_items(stored, batch, ("id",)).persist()
        try:
            span = new.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
            if span["low"] is None:
                return
            near = stored.where(F.col("at").between(span["low"] - hours * 3600, span["high"] + hours * 3600))
            same = stored.join(new.select("url").distinct(), "url", "left_semi").unionByName(stored.join(new.select("content_hash").distinct(), "content_hash", "left_semi"))
            decided = cluster(near.unionByName(same).dropDuplicates(["id"]).unionByName(new)).join(new.select("id"), "id", "left_semi")
            _append(decided, out, number)
            _append(new, seen, number)
        finally:
            new.unpersist()

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


class AlertCap(StatefulProcessor):
    """State of one day: the keys that were sent, and how many. Alerts come as ``day, seq, dedupe_key``."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "dedupe_key string", "seq long")
        self.number = handle.getValueState("number", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.number.get()[0] if self.number.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if self.sent.containsKey((r.dedupe_key,)):
                out.append((key[0], r.seq, "duplicate"))
            elif n >= self.cap:
                out.append((key[0], r.seq, "daily_cap"))
            else:
                n += 1
                self.sent.updateValue((r.dedupe_key,), (int(r.seq),))
                out.append((key[0], r.seq, "sent"))
        self.number.update((n,))
        yield pd.DataFrame(out, columns=["day", "seq", "decision"])

    def close(self) -> None:
        pass


def stream_alerts(alerts: DataFrame, cap: int = 4) -> DataFrame:
    """Decision for each alert with dedup and the daily cap held as state. Needs the RocksDB state store."""
    return alerts.groupBy("day").transformWithStateInPandas(AlertCap(cap), "day long, seq long, decision string", "Append", "None")


class Freshness(StatefulProcessor):
    """State of one source: its last success; a timer tells when it has been silent for too long. Rows come as ``source_id, seconds`` (the limit)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seconds long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seconds = int(pd.concat(list(rows))["seconds"].iloc[-1])
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.last.update((now, seconds))
        self.handle.registerTimer(now + seconds * 1000)
        yield pd.DataFrame({"source_id": pd.Series([], dtype=str), "silent_seconds": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, seconds = self.last.get()
        yield pd.DataFrame({"source_id": [key[0]], "silent_seconds": [int((timerValues.getCurrentProcessingTimeInMs() - at) // 1000)]})

    def close(self) -> None:
        pass


def stream_freshness(successes: DataFrame) -> DataFrame:
    """Sources that have been silent for longer than their limit, by processing-time timers."""
    return successes.groupBy("source_id").transformWithStateInPandas(Freshness(), "source_id string, silent_seconds long", "Append", "ProcessingTime")


def stream_spend(ledger: DataFrame, late: str = "1 hour") -> DataFrame:
    """Spend by UTC day and provider; ``ledger(ts timestamp, provider, cost_micro)``."""
    df = ledger.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "provider").agg(F.sum("cost_micro").alias("cost_micro"))
    return df.select(F.unix_timestamp("w.start").alias("day"), "provider", "cost_micro")


def stream_mentions(mentions: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mentions and approximate source breadth of each trend in sliding windows; ``mentions(ts, trend_id, source_id)``."""
    df = mentions.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "trend_id")
    return df.agg(F.count("*").alias("mention_count"), F.approx_count_distinct("source_id").alias("sources")).select(F.unix_timestamp("w.start").alias("start"), "trend_id", "mention_count", "sources")
