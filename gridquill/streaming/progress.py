"""Progress events and continuous ingestion, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..schemas import schema

STAGES = ["started", "reading", "classifying", "screenshot", "classifying-vl", "parsing", "embedding", "indexing", "done", "error"]
TERMINAL = ("done", "error")


def latest(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Current state per document: its last event, ties by stage."""
    last = events.groupBy(key).agg(F.max(F.struct("ts", "stage")).alias("x"), F.count("*").alias("n_events"))
    return last.select(key, F.col("x.ts").alias("ts"), F.col("x.stage").alias("stage"), F.col("x.stage").isin(*TERMINAL).alias("finished"), "n_events")


def until_terminal(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Events up to and including the first terminal one of each document."""
    end = events.where(F.col("stage").isin(*TERMINAL)).groupBy(key).agg(F.min("ts").alias("end"))
    return events.join(end, key, "left").where(F.col("end").isNull() | (F.col("ts") <= F.col("end"))).drop("end")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schema("progress")).json(path)


def windows(events: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Extension: events per stage and event-time window; with a watermark when streaming."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        e = e.withWatermark("ts", delay)
    return e.groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


class _Ending(StatefulProcessor):
    """Per document the events that the watermark has not passed, and the time of the first terminal event."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, stage string")
        self.end = handle.getValueState("end", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for ts in part["ts"].unique():
                self.handle.registerTimer(int(pd.Timestamp(ts).value // 1_000_000))
            self.waiting.appendList([(ts.to_pydatetime(), stage) for ts, stage in zip(part["ts"], part["stage"], strict=True)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").to_pydatetime()
        events = sorted(set(self.waiting.get()), key=lambda x: (x[0], x[1]))  # repeated events count once
        due, later = [x for x in events if x[0] <= now], [x for x in events if x[0] > now]
        end = self.end.get()[0] if self.end.exists() else next((ts for ts, stage in due if stage in TERMINAL), None)
        if end is not None and not self.end.exists():
            self.end.update((end,))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        out = [(key[0], *x) for x in due if end is None or x[0] <= end]
        if out:
            yield pd.DataFrame(out, columns=["document_id", "ts", "stage"])

    def close(self) -> None:
        pass


def until_terminal_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``until_terminal`` of a stream (document_id, ts, stage), each event once: a timer per event holds it until the
    watermark says that no earlier one can come, so the result does not depend on the order of arrival within
    ``delay``. Needs the RocksDB state store."""
    e = events.select("document_id", "ts", "stage").withWatermark("ts", delay)
    return e.groupBy("document_id").transformWithStateInPandas(_Ending(), "document_id long, ts timestamp, stage string", "append", "eventTime")


def ingest_stream(spark: SparkSession, landing: str, checkpoint: str, publish: Callable[[DataFrame, int], None]):
    """Watches a landing folder of workbooks; every micro-batch is handed to ``publish`` once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xlsx").load(landing)
    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
