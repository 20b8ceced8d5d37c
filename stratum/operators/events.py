"""Message events: bronze envelopes, silver rows and the classifier of bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import blank

#: The event's JSON, and the source that is expected.
EVENT_SCHEMA = (
    "`$schema` string, meta struct<id:string, dt:string, domain:string, stream:string, topic:string, uri:string, request_id:string>, id bigint, type string, namespace bigint, title string, title_url string, comment string, "
    "timestamp bigint, user string, bot boolean, minor boolean, patrolled boolean, server_name string, server_script_path string, server_url string, wiki string, _producer_id string, _source_system string, _ingested_at_utc string"
)
SOURCE = "wikimedia_recentchange"


def bronze(messages: DataFrame, *, producer: str) -> DataFrame:
    """Raw text and the message's own columns; nothing is parsed yet."""
    return messages.select(
        F.col("value").cast("string").alias("raw_event"),
        F.col("key").cast("string").alias("message_key"),
        F.col("topic").alias("eventhub_name"),
        F.col("partition").alias("eventhub_partition"),
        F.col("offset").alias("eventhub_offset"),
        F.col("timestamp").alias("eventhub_enqueued_at"),
        F.col("timestampType").alias("timestamp_type"),
        F.current_timestamp().alias("bronze_ingested_at"),
        F.lit(producer).alias("expected_producer_id"),
    )


def _seconds(c: str) -> Column:
    return F.timestamp_seconds(F.col(c)).cast("timestamp")


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("e", F.from_json("raw_event", EVENT_SCHEMA))


def _when() -> Column:
    """The event's own time, else its epoch."""
    return F.coalesce(F.try_to_timestamp("e.meta.dt"), _seconds("e.timestamp"))


def silver(rows: DataFrame) -> DataFrame:
    """Typed events: texts trimmed, title and user null if blank, flags false if missing."""
    carried = [c for c in ("eventhub_name", "eventhub_partition", "eventhub_offset", "eventhub_enqueued_at", "bronze_ingested_at", "raw_event") if c in rows.columns]
    filled = lambda c: F.when(~blank(F.col(c)), F.trim(c))
    columns = {
        "event_id": F.col("e.meta.id"),
        "event_timestamp": _when(),
        "domain": F.col("e.meta.domain"),
        "source_stream": F.col("e.meta.stream"),
        "revision_id": F.col("e.id"),
        "change_type": F.trim("e.type"),
        "wiki_namespace": F.col("e.namespace"),
        "title": filled("e.title"),
        "title_url": F.col("e.title_url"),
        "comment": F.trim("e.comment"),
        "event_epoch_seconds": F.col("e.timestamp"),
        "user_name": filled("e.user"),
        "is_bot": F.coalesce("e.bot", F.lit(False)),
        "is_minor": F.coalesce("e.minor", F.lit(False)),
        "is_patrolled": F.col("e.patrolled"),
        "wiki": F.trim("e.wiki"),
        "producer_id": F.trim("e._producer_id"),
        "source_system": F.trim("e._source_system"),
        "producer_ingested_at": F.try_to_timestamp("e._ingested_at_utc"),
    }
    return _parsed(rows).select(*[c.alias(n) for n, c in columns.items()], *carried)


def valid_events(rows: DataFrame, *, source_system: str = SOURCE) -> DataFrame:
    """Silver rows with id, time, type, wiki and title from the expected source."""
    sound = F.col("source_system") == source_system
    for c in ("event_id", "event_timestamp", "change_type", "wiki", "title"):
        sound = sound & F.col(c).isNotNull()
    return rows.filter(sound)


def silver_stream(rows: DataFrame, *, source_system: str = SOURCE, delay: str = "1 day") -> DataFrame:
    """Valid events, each id once within the watermark."""
    return valid_events(silver(rows), source_system=source_system).withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])


def classify(rows: DataFrame, *, source_system: str = SOURCE) -> DataFrame:
    """Bronze rows with ``validation_result``, the first of eight labels that applies.

    Lenient parsing turns malformed text into a row of nulls, so such rows come
    out as ``missing_event_id``; ``invalid_json`` is left to text that is null.
    Blank titles count as titles here, as only null ones are missing; an event
    that names no source is not held against it.
    """
    missing = {"missing_event_id": F.col("e.meta.id"), "missing_event_timestamp": _when(), "missing_change_type": F.col("e.type"), "missing_wiki": F.col("e.wiki"), "missing_title": F.col("e.title")}
    label = F.when(F.col("e").isNull(), "invalid_json")
    for name, value in missing.items():
        label = label.when(value.isNull(), name)
    return _parsed(rows).withColumn("validation_result", label.when(F.trim("e._source_system") != source_system, "unexpected_source").otherwise("valid")).drop("e")
