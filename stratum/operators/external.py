"""External tables: a name bound to a location, checked both ways."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stratum.session import normal_location, quote_ident, quote_lit


class LocationMismatch(RuntimeError):
    """A name is registered at another location."""


def location_of(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.sql(f"DESCRIBE FORMATTED {quote_ident(table)}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def _same(a: str, b: str) -> bool:
    plain = lambda x: re.sub(r"^file:/+", "/", normal_location(x))
    return plain(a) == plain(b)


def register(spark: SparkSession, table: str, location: str, *, kind: str = "parquet") -> str:
    """Bind a name to a location; ``registered`` or, if it was, ``present``."""
    have = location_of(spark, table)
    if have is not None:
        if not _same(have, location):
            raise LocationMismatch(f"{table} is at {have}, not {location}")
        return "present"
    spark.sql(f"CREATE TABLE {quote_ident(table)} USING {kind} LOCATION {quote_lit(location)}")
    return "registered"


def overwrite(spark: SparkSession, df: DataFrame, table: str, location: str) -> str:
    """Write a location and bind the name; a name bound elsewhere stops it first."""
    have = location_of(spark, table)
    if have is not None and not _same(have, location):
        raise LocationMismatch(f"{table} is at {have}, not {location}")
    df.write.mode("overwrite").parquet(location)
    out = register(spark, table, location)
    spark.catalog.refreshTable(table)
    return out


def register_all(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table, location, status, message) of each; one failure does not stop the rest."""
    out = []
    for t, loc in tables.items():
        try:
            out.append((t, loc, register(spark, t, loc), None))
        except Exception as e:  # noqa: BLE001 - reported by row
            out.append((t, loc, "failed", str(e)[:300]))
    return spark.createDataFrame(out, "table string, location string, status string, message string")


def seed_empty(df: DataFrame, path: str) -> None:
    """An empty table of a frame's columns; fails if something is there."""
    df.limit(0).write.mode("error").parquet(path)
