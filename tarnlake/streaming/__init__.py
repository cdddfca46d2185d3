"""Streams into tables: a record writer for the driver, Structured Streaming sinks, and windowed queries."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnlake.errors import Unsupported


class StreamingWriter:
    """Buffers records and appends them by number or age; a buffer that failed to append is kept."""

    def __init__(self, lake: Any, table: str, batch_size: int = 1000, flush_interval_seconds: float = 60):
        self.lake, self.table, self.batch_size, self.interval = lake, table, batch_size, flush_interval_seconds
        self.buffer: list[dict] = []
        self.last, self.flushes, self.every = time.monotonic(), 0, 0

    def enable_auto_compaction(self, every_n_flushes: int = 10) -> None:
        self.every = every_n_flushes

    def write(self, record: dict) -> None:
        self.buffer.append(record)
        if len(self.buffer) >= self.batch_size or time.monotonic() - self.last >= self.interval:
            self.flush()

    def flush(self) -> None:
        self.last = time.monotonic()
        if not self.buffer:
            return
        self.lake.append(self.table, self.buffer)
        self.buffer = []
        self.flushes += 1
        if self.every and self.flushes % self.every == 0:
            self.lake.open(self.table).compact()

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> StreamingWriter:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def append_stream(lake: Any, stream: DataFrame, table: str, checkpoint: str, compact_every: int = 0, **trigger: Any) -> StreamingQuery:
    """Append each micro-batch exactly once: its number is in the snapshot's summary, and one already there is skipped."""

    def append(batch: DataFrame, number: int) -> None:
        store = lake.open(table)
        if any(s.summary.get("stream") == checkpoint and s.summary.get("batch") == number for s in store.snapshots()):
            return
        store.append(batch, summary={"stream": checkpoint, "batch": number})
        if compact_every and number % compact_every == compact_every - 1:
            store.compact()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def kafka_stream(spark: SparkSession, topic: str, config: dict, schema: T.StructType | str) -> DataFrame:
    """JSON values of a topic as rows."""
    try:
        raw = spark.readStream.format("kafka").options(**{"subscribe": topic} | config).load()
    except Exception as e:
        raise Unsupported("Kafka needs spark-sql-kafka on spark.jars.packages") from e
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def tumbling(df: DataFrame, ts: str, width: str, *aggregates: Any, slide: str | None = None, late: str | None = None, by: tuple = ()) -> DataFrame:
    """Aggregates of fixed (or, with ``slide``, overlapping) windows; ``late`` sets the watermark of a stream."""
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    made = df.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(*aggregates)
    return made.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in made.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, *aggregates: Any, late: str | None = None, by: tuple = ()) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    made = df.groupBy(F.session_window(ts, gap), *by).agg(*aggregates)
    return made.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in made.columns if c != "session_window"])


def deduplicated(df: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def drain(stream: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give its result as a table in memory (small results: tests, reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
