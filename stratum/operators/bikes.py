"""Bike share: station status and information feeds, enrichment and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import bands, guarded_ratio, round_scaled

#: Schemas of the feeds.
_STATION = (
    "struct<station_id:string, num_bikes_available:bigint, num_bikes_disabled:bigint, num_docks_available:bigint, num_docks_disabled:bigint, num_ebikes_available:bigint, "
    "num_scooters_available:bigint, num_scooters_unavailable:bigint, is_installed:boolean, is_renting:boolean, is_returning:boolean, last_reported:bigint, "
    "vehicle_types_available:array<struct<vehicle_type_id:string, count:bigint>>>"
)
STATUS_SCHEMA = f"last_updated bigint, ttl bigint, version string, data struct<stations: array<{_STATION}>>"
INFORMATION_SCHEMA = "last_updated bigint, ttl bigint, version string, data struct<stations: array<struct<station_id:string, name:string, short_name:string, lat:double, lon:double, region_id:string, capacity:bigint>>>"


def status(documents: DataFrame) -> DataFrame:
    """A row for each station of each snapshot; empty documents give none.

    The record id joins station, report time and snapshot time; a missing part
    is skipped.
    """
    rows = documents.select(F.timestamp_seconds("last_updated").alias("snapshot_at"), F.col("last_updated").alias("snapshot_epoch"), F.explode("data.stations").alias("s"))
    cols = ["station_id", "num_bikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled", "num_ebikes_available", "num_scooters_available", "num_scooters_unavailable", "is_installed", "is_renting", "is_returning", "last_reported", "vehicle_types_available"]
    flat = rows.select("snapshot_at", "snapshot_epoch", *[F.col(f"s.{c}").alias(c) for c in cols])
    key = F.sha2(F.concat_ws("||", "station_id", F.col("last_reported").cast("string"), F.col("snapshot_epoch").cast("string")), 256)
    return flat.withColumns({"last_reported_at": F.timestamp_seconds("last_reported"), "status_record_id": key})


def information(documents: DataFrame) -> DataFrame:
    """The latest description of each station."""
    rows = documents.select("last_updated", F.explode("data.stations").alias("s"))
    flat = rows.select(F.col("s.station_id").alias("station_id"), "last_updated", F.trim("s.name").alias("station_name"), F.col("s.short_name").alias("short_name"), F.col("s.lat").alias("latitude"), F.col("s.lon").alias("longitude"), F.col("s.region_id").alias("region_id"), F.col("s.capacity").alias("capacity"))
    rest = [c for c in flat.columns if c not in ("station_id", "last_updated")]
    return flat.groupBy("station_id").agg(F.max(F.struct("last_updated", *rest)).alias("r")).select("station_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def _pct(part: str) -> Column:
    return round_scaled(guarded_ratio(F.col(part), F.when(F.col("capacity") > 0, F.col("capacity"))) * 100, 2)


def enriched(statuses: DataFrame, stations: DataFrame) -> DataFrame:
    """Status with the station's description, for streams and tables alike."""
    ref = stations.select("station_id", "station_name", "short_name", "latitude", "longitude", "region_id", "capacity", F.lit(True).alias("_hit"))
    out = statuses.join(ref, "station_id", "left").withColumn("station_reference_matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return out.withColumns({"bike_availability_pct": _pct("num_bikes_available"), "dock_availability_pct": _pct("num_docks_available")})


def summary(rows: DataFrame) -> DataFrame:
    """One row per station. Utilisation follows from the rounded average."""
    avg = lambda c, n: round_scaled(F.avg(c), 2).alias(n)
    out = rows.groupBy("station_id", "station_name", "short_name", "latitude", "longitude", "region_id", "capacity").agg(
        F.count("*").alias("observation_count"),
        F.min("last_reported_at").alias("first_reported_at"),
        F.max("last_reported_at").alias("latest_reported_at"),
        avg("num_bikes_available", "avg_bikes_available"),
        F.min("num_bikes_available").alias("min_bikes_available"),
        F.max("num_bikes_available").alias("max_bikes_available"),
        avg("num_docks_available", "avg_docks_available"),
        F.min("num_docks_available").alias("min_docks_available"),
        F.max("num_docks_available").alias("max_docks_available"),
        avg("bike_availability_pct", "avg_bike_availability_pct"),
        avg("dock_availability_pct", "avg_dock_availability_pct"),
        avg("num_ebikes_available", "avg_ebikes_available"),
        F.count_if(~F.col("is_renting")).alias("not_renting_observations"),
        F.count_if(~F.col("is_returning")).alias("not_returning_observations"),
        F.count_if(~F.col("station_reference_matched")).alias("unmatched_reference_observations"),
    )
    used = F.when(F.col("capacity") > 0, round_scaled(F.col("avg_bikes_available") / F.col("capacity") * 100, 2))
    band = bands(F.col("avg_bike_availability_pct"), [(10, "VERY_LOW"), (30, "LOW"), (70, "BALANCED"), (90, "HIGH")], "VERY_HIGH", null="UNKNOWN")
    return out.withColumns({"avg_station_utilization_pct": used, "availability_band": band})


def source_profile(rows: DataFrame) -> DataFrame:
    """One row: rows, stations, null ids, negative counts, repeated records."""
    per = rows.groupBy("station_id", "last_reported", "snapshot_epoch").agg(F.count("*").alias("n"), F.count_if((F.col("num_bikes_available") < 0) | (F.col("num_docks_available") < 0)).alias("neg"))
    return per.agg(F.sum("n").alias("row_count"), F.countDistinct("station_id").alias("station_count"), F.sum(F.when(F.col("station_id").isNull(), F.col("n")).otherwise(0)).alias("null_station_ids"), F.sum("neg").alias("negative_counts"), F.sum(F.col("n") - 1).alias("repeated_rows"))


def key_coverage(statuses: DataFrame, stations: DataFrame) -> DataFrame:
    """One row: stations of either feed that the other lacks."""
    a, b = statuses.select("station_id").filter("station_id IS NOT NULL").distinct(), stations.select("station_id").filter("station_id IS NOT NULL").distinct()
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("station_id").agg(F.sum("s").alias("s"))
    return both.agg(F.count_if(F.col("s") == 1).alias("status_only"), F.count_if(F.col("s") == 2).alias("information_only"), F.count_if(F.col("s") == 3).alias("matched"))
