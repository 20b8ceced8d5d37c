"""Batch readers, one for each way the layers take files in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.scalar import normal_id


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; casts come later."""
    return spark.read.csv(path, header=True, inferSchema=False)


def csv_strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, header: bool = False) -> DataFrame:
    """A fixed schema; a malformed row fails the read. ``path`` may be a glob."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def csv_partitioned(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Text columns, and the partition columns of the path below ``base``."""
    return spark.read.option("header", True).option("basePath", base).csv(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Nested documents that span lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rows(spark: SparkSession, data: list[tuple], schema: T.StructType | str | list[str]) -> DataFrame:
    return spark.createDataFrame(data, schema)


def excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet, the first if there is none of the name; needs openpyxl."""
    import pandas as pd

    book = pd.read_excel(path, sheet_name=None)
    frame = book.get(sheet) if sheet in book else next(iter(book.values()))
    frame.columns = [str(c).strip() for c in frame.columns]
    return spark.createDataFrame(frame)


def normalise_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Identifier columns as text (see :func:`normal_id`)."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: normal_id(F.col(c), kinds[c]) for c in columns})


def parallel_arrays(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """A row for each place of arrays that run in parallel; ``arrays``: name to path."""
    zipped = F.explode(F.arrays_zip(*[F.col(p).alias(n) for n, p in arrays.items()])).alias("_z")
    return df.select(zipped).select(*[F.col("_z")[n].alias(n) for n in arrays])


def file_metadata(prefix: str = "_input_file") -> list[Column]:
    """Path, name, size and time of a row's file, as columns."""
    return [F.col(f"_metadata.{a}").alias(f"{prefix}_{b}") for a, b in (("file_path", "path"), ("file_name", "name"), ("file_size", "size"), ("file_modification_time", "modified_at"))]


def with_file_metadata(df: DataFrame, prefix: str = "_input_file") -> DataFrame:
    return df.select("*", *file_metadata(prefix))


#: Columns of a message stream.
MESSAGE_SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"


def messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A message stream: Kafka, if the connector is there.

    ``options`` are Kafka's; reading begins at the earliest offset and goes on
    if data is gone, unless they say otherwise.
    """
    full = {"startingOffsets": "earliest", "failOnDataLoss": "false"} | options
    return spark.readStream.format("kafka").options(**full).load()


def messages_from_files(spark: SparkSession, path: str, *, topic: str = "replay", max_files: int | None = None) -> DataFrame:
    """The columns of a message stream from JSON lines of ``key``, ``value``, and
    optionally ``partition``, ``offset`` and ``timestamp``."""
    reader = spark.readStream.schema("key string, value string, partition int, offset long, timestamp timestamp")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.json(path)
    return df.select(F.col("key").cast("binary"), F.col("value").cast("binary"), F.lit(topic).alias("topic"), F.coalesce("partition", F.lit(0)).alias("partition"), "offset", "timestamp", F.lit(0).alias("timestampType"))


def add_lineage(df: DataFrame, *, batch_id: str, source_system: str) -> DataFrame:
    """Bronze lineage: batch, source, load day and time."""
    return df.withColumns({"_batch_id": F.lit(batch_id), "_source_system": F.lit(source_system), "_ingested_at": F.current_timestamp(), "_ingest_date": F.current_date()})
