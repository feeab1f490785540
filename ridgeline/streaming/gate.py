"""The gate and sessions on streams."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeline.operators.gate import decide, stored

#: State of any size lives in this store, whose changes go to the checkpoint folder; Spark's default keeps all of it in memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Name of the statistics that every micro-batch of the gate reports.
STATISTICS = "gate"
#: Groups that relationships are dealt to by hash; a checkpoint is bound to their number.
BUCKETS = 1_024


class RelationshipCounters(StatefulProcessor):
    """Numbers the alerts of all relationships of a bucket; the state is one number a relationship, read and written once a micro-batch."""

    def __init__(self, key: str, order: tuple[str, ...]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "names array<string>, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(rows)).sort_values(list(self.order), kind="stable")
        known, names = self.seen.get(), now[self.key]
        before = Counter(dict(zip(*known, strict=True))) if known else Counter()
        places = names.groupby(names, dropna=False, sort=False).cumcount() + [before[n] for n in names]
        before.update(names)
        self.seen.update((list(before), list(before.values())))
        yield now[["alert_id", self.key, "severity", "attack"]].assign(seen=places)

    def close(self) -> None:
        pass


class RelationshipCounter(StatefulProcessor):
    """Numbers the alerts of one relationship, whose number is forgotten after a time without alerts."""

    def __init__(self, key: str, order: tuple[str, ...], ttl_ms: int):
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # rows without a value come last
        now = sorted(rows, key=lambda r: [(r[c] is None, r[c] if r[c] is not None else 0) for c in self.order])
        known = self.seen.get()
        before = known[0] if known else 0
        self.seen.update((before + len(now),))
        for i, r in enumerate(now):
            yield Row(alert_id=r["alert_id"], **{self.key: key[0]}, severity=r["severity"], attack=r["attack"], seen=before + i)

    def close(self) -> None:
        pass


def stream_gate(alerts: DataFrame, key: str = "rel_key", order: tuple[str, ...] = ("ts", "alert_id"), ttl_ms: int | None = None, **limits) -> DataFrame:
    """(alert_id, key, severity, attack, seen, reason, store) of streamed alerts (alert_id, key, ts, severity, attack) (STR-01, 02).

    The state of a relationship is one number; within a micro-batch a key's alerts are counted in ``order``, so replaying
    a table gives what the batch gate gives. The numbers of a bucket of relationships are one value of the state, so a
    micro-batch asks the store by bucket, not by relationship. With ``ttl_ms`` a number is a value of its own that is
    forgotten after that time without alerts, and the relationship starts anew. Each micro-batch reports how many alerts it took and stored (see ``replay``).
    """
    id_type = alerts.schema["alert_id"].dataType.simpleString()
    when = [F.unix_micros(c).alias(f"at_{c}") if alerts.schema[c].dataType.typeName() == "timestamp" else F.col(c).alias(f"at_{c}") for c in order]
    slim, by = alerts.select("alert_id", key, "severity", "attack", *when), tuple(f"at_{c}" for c in order)
    shape = f"alert_id {id_type}, {key} string, severity int, attack boolean, seen long"
    if ttl_ms:
        counted = slim.groupBy(key).transformWithState(RelationshipCounter(key, by, ttl_ms), shape, "append", "ProcessingTime")
    else:
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
        counted = slim.select("*", bucket).groupBy("bucket").transformWithStateInPandas(RelationshipCounters(key, by), shape, "append", "None")
    decided = counted.withColumn("reason", decide(F.col("severity"), F.col("seen"), F.col("attack"), **limits))
    return decided.withColumn("store", stored(F.col("reason"))).observe(STATISTICS, F.count(F.lit(1)).alias("processed"), F.count_if(stored(F.col("reason"))).alias("stored"))


def stream_sessions(alerts: DataFrame, key: str, gap: str = "120 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of an entity as they close: a watermark drops alerts later than ``late``, and an alert within the gap extends a session."""
    return alerts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("alerts"), F.max("severity").alias("max_severity")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "alerts", "max_severity")


def replay(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", timed: bool = False) -> DataFrame:
    """Runs a stream over what is there and ends: into Parquet at ``path``, or through ``each`` batch (STR-03, SNK-06).

    Returns (batch, rows, processed, stored, seconds): what each micro-batch read and reported, and how long it took. Started
    again with the same checkpoint, a stream goes on after the last batch that it finished. A stream whose state is
    ``timed`` (a time to live) never ends by itself and is stopped when all that was there is done.
    """
    spark, (name, store) = stream.sparkSession, STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime="0 seconds") if timed else writer.trigger(availableNow=True)
        query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)).start()
    finally:
        spark.conf.set(name, before)
    if timed:
        # such a stream keeps on running batches without rows; the first of a run may be one that was planned before it, so two count
        while query.isActive and not (len(last := query.recentProgress[-2:]) == 2 and all(p.numInputRows == 0 for p in last)):
            time.sleep(0.2)
        query.stop()
    else:
        query.awaitTermination()
    return statistics(spark, query)


def statistics(spark: SparkSession, query) -> DataFrame:
    """The progress that Spark keeps of a query's last micro-batches, a row each."""
    rows = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(STATISTICS)
        if p.numInputRows:
            rows.append((p.batchId, p.numInputRows, seen and seen["processed"], seen and seen["stored"], p.batchDuration / 1000))
    return spark.createDataFrame(rows, "batch long, rows long, processed long, stored long, seconds double")


def rate_alerts(spark, per_second: int = 1_000, interesting: int = 10) -> DataFrame:
    """An endless mock stream, one alert in ``interesting`` severe (SRC-29, STR-04)."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    hot = F.col("value") % interesting == 0
    return rows.select(F.col("value").alias("alert_id"), F.concat(F.lit("host:h"), (F.col("value") % 97).cast("string")).alias("rel_key"), F.col("timestamp").alias("ts"), F.when(hot, 9).otherwise(1).alias("severity"), F.lit(False).alias("attack"))
