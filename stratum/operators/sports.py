"""Football statistics and weather: the small bronze-to-gold layers; taxi variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import bands
from stratum.sources.readers import parallel_arrays


#: What missing measures count as.
FOOTBALL_BLANKS = {
    **dict.fromkeys(["goals", "assists", "shots", "shots_on_target", "minutes_played", "market_value_eur"], 0),
    **dict.fromkeys(["expected_goals_xg", "expected_assists_xa", "pass_accuracy", "player_rating", "performance_score"], 0.0),
    **dict.fromkeys(["region", "position_group"], "Unknown"),
}


def football_silver(stats: DataFrame, teams: DataFrame, positions: DataFrame) -> DataFrame:
    """A row for each player and match, with region, position group, zeros for what is
    missing, and what follows: contribution, accuracy, goals beyond expectation, bands.

    Of repeated rows the largest by all columns stays, so the choice is determined.
    """
    rest = [c for c in stats.columns if c not in ("player_id", "match_id")]
    once = stats.groupBy("player_id", "match_id").agg(F.max(F.struct(*rest)).alias("r")).select("player_id", "match_id", *[F.col(f"r.{c}").alias(c) for c in rest])
    joined = once.join(teams, "team", "left").join(positions, "position", "left")
    filled = joined.fillna({c: v for c, v in FOOTBALL_BLANKS.items() if c in joined.columns})
    return filled.withColumns(
        {
            "goal_contribution": F.col("goals") + F.col("assists"),
            "shots_accuracy_pct": F.when(F.col("shots") > 0, F.round(F.col("shots_on_target") / F.col("shots") * 100, 2)).otherwise(0.0),
            "xg_overperformance": F.round(F.col("goals") - F.col("expected_goals_xg"), 2),
            "minutes_category": bands(F.col("minutes_played"), [(30, "Low minutes"), (75, "Medium minutes")], "High minutes", null="Low minutes"),
            "performance_band": bands(F.col("player_rating"), [(6.0, "Needs improvement"), (7.0, "Average"), (8.0, "Good")], "Excellent", null="Needs improvement"),
        }
    )


def football_gold(silver: DataFrame) -> dict[str, DataFrame]:
    """Five summaries: of teams, positions, players, tournament stages, and value."""
    mean = lambda c, n=None: F.round(F.avg(c), 2).alias(n or f"avg_{c}")
    total = lambda c, n: F.sum(c).alias(n)
    rows, players, matches = F.count("*").alias("player_match_records"), F.countDistinct("player_id").alias("total_players"), F.countDistinct("match_id")
    scored = [total("goals", "total_goals"), total("assists", "total_assists")]
    given, rating = total("goal_contribution", "total_goal_contributions"), [mean("player_rating"), mean("performance_score")]
    value = F.max("market_value_eur")
    plans = {
        "team": (["team", "nationality", "region"], [rows, players, matches.alias("total_matches"), *scored, given, *rating, mean("pass_accuracy"), mean("shots_accuracy_pct"), value.alias("highest_market_value_eur"), mean("market_value_eur")], "total_goal_contributions"),
        "position": (["position", "position_group"], [rows, players, *scored, given, *rating, mean("minutes_played")], "avg_performance_score"),
        "players": (["player_id", "player_name", "team", "nationality", "position", "position_group"], [matches.alias("matches_played"), total("minutes_played", "total_minutes_played"), *scored, given, *rating, value.alias("market_value_eur")], "total_goal_contributions"),
        "stage": (["tournament_stage"], [rows, matches.alias("total_matches"), *scored, *rating, F.max("top_speed_kmh").alias("max_top_speed_kmh"), mean("distance_covered_km")], "total_goals"),
        "value": (["player_id", "player_name", "team", "position"], [value.alias("market_value_eur"), *rating, given, total("minutes_played", "total_minutes_played")], "avg_performance_score"),
    }
    out = {name: silver.groupBy(*keys).agg(*aggs).orderBy(F.desc(by), *keys) for name, (keys, aggs, by) in plans.items()}
    worth = bands(F.col("market_value_eur"), [(10_000_000, "Lower value"), (40_000_000, "Medium value"), (80_000_000, "High value")], "Elite value", null="Lower value")
    return out | {"value": out["value"].withColumn("value_band", worth)}


#: Measures of an hour of weather.
WEATHER = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"]


def weather_hours(documents: DataFrame, *, source: str = "Open-Meteo") -> DataFrame:
    """A row for each hour of documents with parallel hourly arrays, with date and lineage."""
    hours = parallel_arrays(documents, {"weather_time": "hourly.time"} | {c: f"hourly.{c}" for c in WEATHER})
    return hours.withColumns({"weather_date": F.to_date(F.try_to_timestamp("weather_time")), "source_api": F.lit(source), "ingestion_timestamp": F.current_timestamp(), "load_date": F.current_date()})


def weather_daily(hours: DataFrame) -> DataFrame:
    """Each day's mean temperature, humidity and wind, and its coldest and warmest hour."""
    means = [F.round(F.avg(c), 2).alias(f"avg_{c}") for c in WEATHER]
    return hours.groupBy("weather_date").agg(means[0], F.min(WEATHER[0]).alias(f"min_{WEATHER[0]}"), F.max(WEATHER[0]).alias(f"max_{WEATHER[0]}"), *means[1:]).orderBy("weather_date")


def taxi_variants(trips: DataFrame, *, key: str) -> dict[str, DataFrame]:
    """Four variants by hash of the row: 80, 10, 5 and 5 of a hundred."""
    at = F.pmod(F.xxhash64(key), F.lit(100))
    return {
        "initial": trips.filter(at < 80),
        "evolved": trips.filter(at.between(80, 89)).withColumn("source_system", F.lit("taxi")),
        "renamed": trips.filter(at.between(90, 94)).withColumnRenamed("fare_amount", "base_fare_amount"),
        "malformed": trips.filter(at >= 95).withColumn("passenger_count", F.concat(F.lit("invalid_"), F.col("passenger_count").cast("string"))).withColumn("unexpected_field", F.lit("unexpected")),
    }


def unify_renamed(df: DataFrame, name: str, old: str) -> DataFrame:
    """One column from a field that was renamed on the way."""
    if old not in df.columns:
        return df
    return (df.withColumn(name, F.coalesce(name, old)) if name in df.columns else df.withColumnRenamed(old, name)).drop(*[old] if name in df.columns else [])
