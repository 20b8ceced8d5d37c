"""Streaming writes, stateful deduplication, enrichment and progress."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from stratum.operators.table import VersionedTable

TRIGGERS = {"availableNow": {"availableNow": True}, "once": {"once": True}}


def trigger_of(kind: str) -> dict[str, object]:
    """``availableNow``, ``once``, or a processing time such as ``5 seconds``."""
    return TRIGGERS.get(kind, {"processingTime": kind})


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, *, kind: str = "json", max_files: int | None = None, **options: object) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema).options(**{k: str(v) for k, v in options.items()})
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is appended to a Parquet folder."""
    return spark.readStream.schema(schema).parquet(path)


def follow(source: VersionedTable, target: VersionedTable, name: str, transform: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Append to ``target`` what was appended to ``source`` since the last call; the versions taken.

    Each version is a batch; its number is in the target's own commit, so a
    rerun or a crash takes none twice. Rewrites of the source add no rows.
    """
    done = target.commit_of().batches.get(name, -1) if target.exists() else -1
    taken = []
    for version, rows in source.appended(done):
        target.append(transform(rows), merge_schema=True, batch=(name, version))
        taken.append(version)
    return taken


def append_to(df: DataFrame, path: str, checkpoint: str, *, trigger: str = "availableNow", wait: bool = True) -> object:
    """Append to a Parquet folder under a checkpoint: a rerun takes only what is new."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger_of(trigger)).start()
    if wait:
        q.awaitTermination()
    return q


def upsert_each_batch(df: DataFrame, merge: Callable[[DataFrame], object], checkpoint: str, *, trigger: str = "availableNow") -> object:
    """Hand each batch to ``merge``, which must bear a replay."""
    q = df.writeStream.foreachBatch(lambda batch, _: merge(batch) and None).option("checkpointLocation", checkpoint).trigger(**trigger_of(trigger)).start()
    q.awaitTermination()
    return q


def deduplicate(df: DataFrame, keys: list[str], *, event_time: str, delay: str = "1 day", bounded: bool = True) -> DataFrame:
    """Drop events seen before and events later than the watermark.

    A key is forgotten when the watermark passes it, so state is bounded by the
    delay; the same key may then come out again. Without ``bounded`` a key is
    remembered for ever, and state grows with the keys.
    """
    if dict(df.dtypes)[event_time] == "timestamp_ntz":
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    marked = df.withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark(keys) if bounded else marked.dropDuplicates(keys)


def enrich(stream: DataFrame, static: DataFrame, key: str, *, matched: str = "reference_matched") -> DataFrame:
    """Stream-static left join, with a flag that tells whether there was a partner."""
    ref = static.withColumn("_hit", F.lit(True))
    return stream.join(ref, key, "left").withColumn(matched, F.coalesce("_hit", F.lit(False))).drop("_hit")


def windowed_counts(df: DataFrame, *, event_time: str, by: list[str], size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts of a stream."""
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return df.withWatermark(event_time, delay).groupBy(w, *by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events")


PROGRESS = "query_name string, batch_id long, input_rows long, input_rate double, processed_rate double, trigger_ms long, files_outstanding long, bytes_outstanding long"


def progress_rows(spark: SparkSession, query: object, name: str) -> DataFrame:
    """Progress of a query's recent batches as typed rows."""
    out = []
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        metrics = (p.get("sources") or [{}])[0].get("metrics") or {}
        number = lambda v: None if v is None else float(v)
        whole = lambda v: None if v is None else int(v)
        out.append((name, p["batchId"], p["numInputRows"], number(p.get("inputRowsPerSecond")), number(p.get("processedRowsPerSecond")), whole(p.get("durationMs", {}).get("triggerExecution")), whole(metrics.get("numFilesOutstanding")), whole(metrics.get("numBytesOutstanding"))))
    return spark.createDataFrame(out, PROGRESS)


def benchmark(run: Callable[[int], object], grid: list[int], spark: SparkSession) -> DataFrame:
    """Batches, rows and time of a stream for each number of files per trigger."""
    out = []
    for n in grid:
        q = run(n)
        steps = [p if isinstance(p, dict) else json.loads(p.json) for p in q.recentProgress]
        steps = [p for p in steps if p["numInputRows"]]
        out.append((n, len(steps), sum(p["numInputRows"] for p in steps), sum(p["durationMs"]["triggerExecution"] for p in steps)))
    return spark.createDataFrame(out, "max_files int, batches long, rows long, total_ms long")


def status(query: object) -> dict[str, object]:
    return {"active": query.isActive, "message": query.status["message"], "last": query.lastProgress}


def stop(query: object) -> None:
    if query.isActive:
        query.stop()
