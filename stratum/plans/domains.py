"""The domain layers over the test tables: each query goes through its layer's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions import contracts, quality
from stratum.operators import bikes, crypto, events, retail, sports, star
from stratum.plans.metrics import ENCOUNTERS

from .catalogue import query, table

# -- healthcare: orders as encounters ------------------------------------------

_ENC = """e AS (SELECT o_orderkey AS encounter_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(o_orderdate AS DATE) AS encounter_date, o_custkey AS patient_key, o_custkey % 40 AS organization_key, o_custkey % 7 AS provider_key, o_custkey % 6 AS payer_key,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'Emergency' ELSE 'outpatient' END AS encounter_class, CAST(o_orderkey % 120 AS DOUBLE) AS duration_minutes, CAST(o_totalprice AS DECIMAL(18,2)) AS total_claim_cost,
 CASE WHEN o_custkey % 6 = 5 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS payer_coverage FROM orders)"""


def encounters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    price = c("o_totalprice").cast("decimal(18,2)")
    covered = F.when(c("o_custkey") % 6 == 5, F.lit(0).cast("decimal(18,2)")).otherwise(price)
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("encounter_key"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"),
        F.to_date("o_orderdate").alias("encounter_date"),
        c("o_custkey").alias("patient_key"),
        (c("o_custkey") % 40).alias("organization_key"),
        (c("o_custkey") % 7).alias("provider_key"),
        (c("o_custkey") % 6).alias("payer_key"),
        F.when(c("o_orderpriority") == "1-URGENT", "Emergency").otherwise("outpatient").alias("encounter_class"),
        (c("o_orderkey") % 120).cast("double").alias("duration_minutes"),
        price.alias("base_encounter_cost"),
        price.alias("total_claim_cost"),
        covered.alias("payer_coverage"),
        (price - covered).cast("decimal(18,2)").alias("patient_responsibility"),
    )


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


@query(
    f"""WITH {_ENC} SELECT date_key, encounter_date, count(*) AS encounter_count, count(DISTINCT patient_key) AS unique_patients, count(DISTINCT organization_key) AS organizations_active, count(DISTINCT provider_key) AS providers_active, round(avg(duration_minutes), 2) AS avg_duration_minutes,
 CAST(sum(total_claim_cost) AS DOUBLE) AS base_encounter_cost, CAST(sum(total_claim_cost) AS DOUBLE) AS total_claim_cost, CAST(sum(payer_coverage) AS DOUBLE) AS payer_coverage, CAST(sum(total_claim_cost - payer_coverage) AS DOUBLE) AS patient_responsibility,
 count(*) FILTER (WHERE lower(encounter_class) = 'emergency') AS emergency_encounters, round(CAST(count(*) FILTER (WHERE lower(encounter_class) = 'emergency') AS DOUBLE) / count(*) * 100.0, 2) AS emergency_encounter_pct FROM e GROUP BY ALL"""
)
def health_daily_encounters(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(star.daily_encounters(encounters(spark, d)))


@query(
    f"""WITH {_ENC} SELECT organization_key, 'O' || organization_key AS organization_id, 'Organization ' || organization_key AS organization_name, 'C' AS city, 'S' AS state, count(*) AS encounter_count, count(DISTINCT patient_key) AS unique_patients, count(DISTINCT provider_key) AS unique_providers,
 round(avg(duration_minutes), 2) AS avg_duration_minutes, CAST(sum(total_claim_cost) AS DOUBLE) AS total_claim_cost, round(CAST(sum(total_claim_cost) AS DOUBLE) / count(*), 2) AS avg_claim_cost, CAST(sum(payer_coverage) AS DOUBLE) AS payer_coverage, CAST(sum(total_claim_cost - payer_coverage) AS DOUBLE) AS patient_responsibility,
 min(encounter_date) AS first_encounter_date, max(encounter_date) AS last_encounter_date FROM e GROUP BY 1"""
)
def health_organization_performance(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.range(40).select(F.col("id").alias("organization_key"), F.concat(F.lit("O"), "id").alias("organization_id"), F.concat(F.lit("Organization "), "id").alias("organization_name"), F.lit("C").alias("city"), F.lit("S").alias("state"))
    return _doubles(star.organization_performance(encounters(spark, d), dim))


_PAYER = """SELECT payer_key, 'P' || payer_key AS payer_id, 'Payer ' || payer_key AS payer_name, count(*) AS encounter_count, count(DISTINCT patient_key) AS unique_patients, CAST(sum(total_claim_cost) AS DOUBLE) AS total_claim_cost, CAST(sum(payer_coverage) AS DOUBLE) AS payer_coverage,
 CAST(sum(total_claim_cost - payer_coverage) AS DOUBLE) AS patient_responsibility, round(CAST(sum(total_claim_cost) AS DOUBLE) / count(*), 2) AS avg_claim_cost, {more} round(CAST(sum(payer_coverage) AS DOUBLE) / CAST(sum(total_claim_cost) AS DOUBLE) * 100, 2) AS coverage_pct FROM e GROUP BY 1"""


def _payers(spark: SparkSession) -> DataFrame:
    return spark.range(6).select(F.col("id").alias("payer_key"), F.concat(F.lit("P"), "id").alias("payer_id"), F.concat(F.lit("Payer "), "id").alias("payer_name"))


@query(f"WITH {_ENC} " + _PAYER.format(more="round(CAST(sum(payer_coverage) AS DOUBLE) / count(*), 2) AS avg_payer_coverage,"))
def health_payer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(star.payer_coverage(encounters(spark, d), _payers(spark)))


@query(f"WITH {_ENC} " + _PAYER.format(more=""))
def health_payer_coverage_external(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(star.payer_coverage(encounters(spark, d), _payers(spark), external=True))


_COND = "c AS (SELECT l_partkey % 30 AS condition_key, l_suppkey AS patient_key, l_orderkey AS encounter_key, CAST(l_shipdate AS DATE) AS starts, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS days FROM lineitem)"


def _conditions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    days = F.when(c("l_returnflag") != "N", c("l_linenumber"))
    fact = table(spark, d, "lineitem").select((c("l_partkey") % 30).alias("condition_key"), c("l_suppkey").alias("patient_key"), c("l_orderkey").alias("encounter_key"), F.to_date("l_shipdate").alias("condition_start_date"), days.alias("condition_duration_days"), days.isNull().alias("is_active_condition"))
    return fact, spark.range(30).select(F.col("id").alias("condition_key"), F.concat(F.lit("Condition "), "id").alias("condition_description"))


@query(f"WITH {_COND} SELECT condition_key, 'Condition ' || condition_key AS condition_description, count(*) AS condition_event_count, count(DISTINCT patient_key) AS unique_patients, count(*) FILTER (WHERE days IS NULL) AS active_condition_events, round(avg(days), 2) AS avg_condition_duration_days, min(starts) AS first_recorded_date, max(starts) AS last_recorded_date, count(DISTINCT encounter_key) AS linked_encounters, round(CAST(count(*) FILTER (WHERE days IS NULL) AS DOUBLE) / count(*) * 100, 2) AS active_condition_pct FROM c GROUP BY 1")
def health_condition_summary(spark: SparkSession, d: str) -> DataFrame:
    return star.condition_summary(*_conditions(spark, d))


@query(f"WITH {_COND} SELECT condition_key, 'Condition ' || condition_key AS condition_description, count(*) AS condition_events, count(DISTINCT patient_key) AS unique_patients, count(*) FILTER (WHERE days IS NULL) AS active_condition_events, round(avg(days), 2) AS avg_duration_days, min(starts) AS first_observed_date, max(starts) AS last_observed_date FROM c GROUP BY 1")
def health_condition_summary_external(spark: SparkSession, d: str) -> DataFrame:
    return star.condition_summary(*_conditions(spark, d), external=True)


@query(f"WITH {_ENC} SELECT CAST(date_trunc('month', encounter_date) AS DATE) AS month, count(*) AS encounters, count(DISTINCT patient_key) AS patients, round(100.0 * count(*) FILTER (WHERE encounter_class = 'Emergency') / count(*), 2) AS emergency_pct FROM e GROUP BY 1")
def health_metric_view_monthly(spark: SparkSession, d: str) -> DataFrame:
    return ENCOUNTERS.query(encounters(spark, d), by=["month"], measures=["encounters", "patients", "emergency_pct"]).withColumn("emergency_pct", F.col("emergency_pct").cast("double"))


# -- markets: events as ticks, and their days as candles ------------------------

_KLINES = """k AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume, count(*) AS trades FROM events GROUP BY 1, 2)"""


def klines(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"), F.count("*").alias("number_of_trades"))
    at = F.col("day").cast("timestamp")
    return days.withColumn("open_time", at).withColumn("close_time", at + F.expr("INTERVAL 1 DAY")).withColumn("ingested_at", at).drop("day")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("symbol"), F.col("value").alias("price_usd"), at.alias("event_time"), F.lit("p").alias("producer_id"), F.lit("s").alias("source_system"), F.lit(0).alias("eventhub_partition"), F.col("event_id").alias("eventhub_offset"), at.alias("eventhub_enqueued_at"), (at + F.expr("INTERVAL 2 SECONDS")).alias("ingested_at"))
    rows = rows.withColumn("change_pct_24h", F.when(F.col("eventhub_offset") % 4 == 0, F.col("price_usd") / 100))
    return crypto.silver_ticks(rows.unionByName(rows))


@query(f"WITH {_KLINES} SELECT symbol, day AS trade_date, close - open AS price_change, CASE WHEN open <> 0 THEN (close - open) / open * 100 END AS price_change_pct, high - low AS candle_range, CASE WHEN close - open > 0 THEN 'BULLISH' WHEN close - open < 0 THEN 'BEARISH' ELSE 'NEUTRAL' END AS candle_direction FROM k WHERE high >= low AND volume >= 0")
def market_silver_candles(spark: SparkSession, d: str) -> DataFrame:
    return crypto.silver_klines(klines(spark, d)).select("symbol", "trade_date", "price_change", "price_change_pct", "candle_range", "candle_direction")


#: Ticks of the feed that count: a price above zero. The last of a symbol by time, then by id as the ingestion follows the time.
_TICKS = "t AS (SELECT event_type AS symbol, event_id, ts, value AS price, CASE WHEN event_id % 4 = 0 THEN value / 100 END AS change FROM events WHERE value > 0)"
_LATEST = "l AS (SELECT symbol, max(ts) AS at FROM t GROUP BY 1), p AS (SELECT l.symbol, l.at, max(t.price) AS price FROM l JOIN t ON t.symbol = l.symbol AND t.ts = l.at GROUP BY 1, 2), c AS (SELECT symbol, max(day) AS day, arg_max(close, day) AS close, arg_max(CASE WHEN open <> 0 THEN (close - open) / open * 100 END, day) AS pct FROM k GROUP BY 1)"


@query(
    f"""WITH {_KLINES}, {_TICKS}, {_LATEST}, h AS (SELECT symbol, min(day) AS historical_start_date, max(day) AS historical_end_date, arg_min(open, day) AS first_open_price, arg_max(close, day) AS last_close_price, min(low) AS period_minimum_low, max(high) AS period_maximum_high, count(*) FILTER (WHERE close > open) AS bullish_days, CAST(sum(trades) AS BIGINT) AS period_total_trades FROM k GROUP BY 1)
SELECT h.*, (last_close_price - first_open_price) / first_open_price * 100 AS historical_return_pct, n AS streaming_event_count, lo AS streaming_minimum_price, CAST(2 AS DOUBLE) AS average_ingestion_delay_seconds, evolved AS evolved_event_count, period_maximum_high - period_minimum_low AS historical_price_range,
 (p.price - period_maximum_high) / period_maximum_high * 100 AS latest_vs_period_high_pct FROM h LEFT JOIN (SELECT symbol, count(*) AS n, min(price) AS lo, count(change) AS evolved FROM t GROUP BY 1) USING (symbol) LEFT JOIN p USING (symbol)"""
)
def market_summary(spark: SparkSession, d: str) -> DataFrame:
    cols = ["symbol", "historical_start_date", "historical_end_date", "first_open_price", "last_close_price", "period_minimum_low", "period_maximum_high", "bullish_days", "period_total_trades", "historical_return_pct", "streaming_event_count", "streaming_minimum_price", "average_ingestion_delay_seconds", "evolved_event_count", "historical_price_range", "latest_vs_period_high_pct"]
    return crypto.market_summary(crypto.silver_klines(klines(spark, d)), ticks(spark, d)).select(*cols)


@query(f"WITH {_KLINES}, {_TICKS}, {_LATEST} SELECT symbol, price AS latest_live_price, day AS latest_historical_date, close AS latest_historical_close, pct AS latest_historical_change_pct, price - close AS price_difference, CASE WHEN close <> 0 THEN (price - close) / close * 100 END AS price_difference_pct FROM p LEFT JOIN c USING (symbol)")
def market_latest_prices(spark: SparkSession, d: str) -> DataFrame:
    return crypto.latest_prices(crypto.silver_klines(klines(spark, d)), ticks(spark, d)).select("symbol", "latest_live_price", "latest_historical_date", "latest_historical_close", "latest_historical_change_pct", "price_difference", "price_difference_pct")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS symbol, value AS price_usd, CAST(ts AS DATE) AS event_date, CAST(2 AS BIGINT) AS ingestion_delay_seconds FROM events WHERE value > 0")
def market_silver_ticks(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).select("event_id", "symbol", "price_usd", "event_date", "ingestion_delay_seconds")


# -- messages ------------------------------------------------------------------


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as bronze messages in the feed's fields, some broken one way or another."""
    c, n = F.col, F.col("event_id")
    at = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    unless = lambda m, value: F.when(n % m != 0, value)
    body = F.struct(
        F.struct(unless(11, F.concat(F.lit("m"), n)).alias("id"), unless(13, at).alias("dt"), F.lit("d").alias("domain"), F.lit("s").alias("stream")).alias("meta"),
        n.alias("id"),
        unless(17, c("event_type")).alias("type"),
        F.concat(F.lit(" t"), n).alias("title"),
        F.when(n % 13 != 0, F.unix_timestamp(c("ts").cast("timestamp"))).alias("timestamp"),
        F.lit(" u ").alias("user"),
        F.when(n % 2 == 0, F.lit(True)).alias("bot"),
        unless(19, F.lit("w")).alias("wiki"),
        F.when(n % 5 == 0, "other").otherwise(events.SOURCE).alias("_source_system"),
    )
    text = F.when(n % 23 == 0, "{broken").when(n % 29 == 0, F.lit(None)).otherwise(F.to_json(body))
    return table(spark, d, "events").select(text.alias("raw_event"), F.lit("hub").alias("eventhub_name"), F.lit(0).alias("eventhub_partition"), n.alias("eventhub_offset"))


_LABEL = """CASE WHEN event_id % 23 <> 0 AND event_id % 29 = 0 THEN 'invalid_json' WHEN event_id % 23 = 0 OR event_id % 11 = 0 THEN 'missing_event_id' WHEN event_id % 13 = 0 THEN 'missing_event_timestamp' WHEN event_id % 17 = 0 THEN 'missing_change_type'
 WHEN event_id % 19 = 0 THEN 'missing_wiki' WHEN event_id % 5 = 0 THEN 'unexpected_source' ELSE 'valid' END"""


@query(f"SELECT {_LABEL} AS validation_result, count(*) AS rows FROM events GROUP BY 1")
def event_classification(spark: SparkSession, d: str) -> DataFrame:
    return events.classify(messages(spark, d)).groupBy("validation_result").agg(F.count("*").alias("rows"))


@query(f"SELECT 'm' || event_id AS event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS at, event_type AS change_type, 't' || event_id AS title, 'u' AS user_name, event_id % 2 = 0 AS is_bot, false AS is_minor, event_id AS revision_id, event_id AS eventhub_offset FROM events WHERE {_LABEL} = 'valid'")
def event_silver(spark: SparkSession, d: str) -> DataFrame:
    rows = events.valid_events(events.silver(messages(spark, d)))
    return rows.select("event_id", F.unix_timestamp("event_timestamp").alias("at"), "change_type", "title", "user_name", "is_bot", "is_minor", "revision_id", "eventhub_offset")


# -- bikes: lines as status reports of suppliers --------------------------------

_BIKES = "b AS (SELECT l_suppkey AS station_id, l_linenumber AS bikes, CAST(l_quantity AS BIGINT) AS docks, l_returnflag <> 'A' AS is_renting, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 5 * 20 END AS capacity, l_suppkey % 10 <> 3 AS matched FROM lineitem)"


@query(
    f"""WITH {_BIKES}, x AS (SELECT station_id, CASE WHEN matched THEN capacity END AS capacity, count(*) AS observation_count, round(avg(bikes), 2) AS avg_bikes_available, min(docks) AS min_docks_available, max(docks) AS max_docks_available, count(*) FILTER (WHERE NOT is_renting) AS not_renting_observations,
 count(*) FILTER (WHERE NOT matched) AS unmatched_reference_observations FROM b GROUP BY ALL)
SELECT station_id, capacity, observation_count, avg_bikes_available, min_docks_available, max_docks_available, not_renting_observations, unmatched_reference_observations, CASE WHEN capacity > 0 THEN round(avg_bikes_available / capacity * 100, 2) END AS avg_station_utilization_pct FROM x"""
)
def bike_station_summary(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "lineitem").select(c("l_suppkey").alias("station_id"), c("l_linenumber").alias("num_bikes_available"), c("l_quantity").cast("bigint").alias("num_docks_available"), F.lit(0).alias("num_ebikes_available"), (c("l_returnflag") != "A").alias("is_renting"), F.lit(True).alias("is_returning"), c("l_shipdate").alias("last_reported_at"))
    stations = table(spark, d, "supplier").filter("s_suppkey % 10 <> 3").select(c("s_suppkey").alias("station_id"), c("s_name").alias("station_name"), F.lit("s").alias("short_name"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit("r").alias("region_id"), F.when(c("s_suppkey") % 9 != 0, c("s_suppkey") % 5 * 20).alias("capacity"))
    out = bikes.summary(bikes.enriched(quality.expect_all_or_drop(rows, quality.STATUS_DROP), stations))
    return out.select("station_id", "capacity", "observation_count", "avg_bikes_available", "min_docks_available", "max_docks_available", "not_renting_observations", "unmatched_reference_observations", "avg_station_utilization_pct")


# -- retail --------------------------------------------------------------------


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS stock_code, CAST(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS DOUBLE) AS latest_observed_price FROM (SELECT DISTINCT * FROM lineitem) WHERE l_quantity > 40 GROUP BY 1"""
)
def retail_product_snapshot(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.format_string("%012d-%04d", "l_orderkey", "l_linenumber").alias("InvoiceNo"), c("l_partkey").cast("string").alias("StockCode"), F.lit("d").alias("Description"), c("l_quantity").cast("bigint").alias("Quantity"), c("l_shipdate").alias("InvoiceDate"), c("l_extendedprice").alias("UnitPrice"), F.lit("1").alias("CustomerID"), F.lit("UK").alias("Country"))
    return retail.product_snapshot(retail.silver_candidate(rows)).select("stock_code", c("latest_observed_price").cast("double").alias("latest_observed_price"))


# -- football: lines as matches of their orders' players ------------------------

_FOOTBALL = """s AS (SELECT l_orderkey AS player_id, 'P' || l_orderkey AS player_name, l_linenumber AS match_id, 'T' || (l_orderkey % 5) AS team, 'N' || (l_orderkey % 3) AS nationality, 'p' || (l_orderkey % 4) AS position, 'S' || (l_linenumber % 3) AS tournament_stage,
 CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END AS goals, 1 AS assists, CASE WHEN l_linenumber > 1 THEN round(CAST(l_linenumber - 1 AS DOUBLE) / (l_linenumber) * 100, 2) ELSE 0.0 END AS accuracy, CAST(l_quantity AS BIGINT) * 2 AS minutes, CAST(l_quantity AS BIGINT) % 10 AS rating,
 CAST(l_partkey % 7 AS DOUBLE) AS score, l_suppkey * 1000000 AS worth, 30.5 AS speed, CASE WHEN l_orderkey % 5 = 4 THEN 'Unknown' ELSE 'EU' END AS region, CASE WHEN l_orderkey % 4 = 3 THEN 'Unknown' ELSE 'G' END AS position_group FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1))"""


def football(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    lines = table(spark, d, "lineitem")
    alone = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    stats = lines.join(alone, ["l_orderkey", "l_linenumber"]).select(
        c("l_orderkey").alias("player_id"), F.concat(F.lit("P"), "l_orderkey").alias("player_name"), c("l_linenumber").alias("match_id"), F.concat(F.lit("T"), c("l_orderkey") % 5).alias("team"), F.concat(F.lit("N"), c("l_orderkey") % 3).alias("nationality"), F.concat(F.lit("p"), c("l_orderkey") % 4).alias("position"),
        F.concat(F.lit("S"), c("l_linenumber") % 3).alias("tournament_stage"), F.when(c("l_linenumber") % 3 != 0, c("l_linenumber")).alias("goals"), F.lit(1).alias("assists"), F.when(c("l_linenumber") > 1, c("l_linenumber")).alias("shots"), (c("l_linenumber") - 1).alias("shots_on_target"), (c("l_quantity").cast("bigint") * 2).alias("minutes_played"),
        F.lit(0.25).alias("expected_goals_xg"), F.lit(80.0).alias("pass_accuracy"), (c("l_quantity").cast("bigint") % 10).cast("double").alias("player_rating"), (c("l_partkey") % 7).cast("double").alias("performance_score"), (c("l_suppkey") * 1000000).alias("market_value_eur"), F.lit(30.5).alias("top_speed_kmh"), F.lit(9.0).alias("distance_covered_km"),
    )
    teams = spark.range(4).select(F.concat(F.lit("T"), "id").alias("team"), F.lit("EU").alias("region"))
    positions = spark.range(3).select(F.concat(F.lit("p"), "id").alias("position"), F.lit("G").alias("position_group"))
    return sports.football_silver(stats.unionByName(stats), teams, positions)


@query(f"""WITH {_FOOTBALL} SELECT player_id, match_id, region, position_group, goals + assists AS goal_contribution, accuracy AS shots_accuracy_pct, round(goals - 0.25, 2) AS xg_overperformance, CASE WHEN minutes >= 75 THEN 'High minutes' WHEN minutes >= 30 THEN 'Medium minutes' ELSE 'Low minutes' END AS minutes_category,
 CASE WHEN rating >= 8 THEN 'Excellent' WHEN rating >= 7 THEN 'Good' WHEN rating >= 6 THEN 'Average' ELSE 'Needs improvement' END AS performance_band FROM s""")
def football_silver(spark: SparkSession, d: str) -> DataFrame:
    return football(spark, d).select("player_id", "match_id", "region", "position_group", F.col("goal_contribution").cast("bigint").alias("goal_contribution"), "shots_accuracy_pct", F.col("xg_overperformance").cast("double").alias("xg_overperformance"), "minutes_category", "performance_band")


@query(f"WITH {_FOOTBALL} SELECT team, nationality, region, count(*) AS player_match_records, count(DISTINCT player_id) AS total_players, count(DISTINCT match_id) AS total_matches, CAST(sum(goals) AS BIGINT) AS total_goals, round(avg(rating), 2) AS avg_player_rating, max(worth) AS highest_market_value_eur FROM s GROUP BY ALL")
def football_team_summary(spark: SparkSession, d: str) -> DataFrame:
    return sports.football_gold(football(spark, d))["team"].select("team", "nationality", "region", "player_match_records", "total_players", "total_matches", "total_goals", "avg_player_rating", "highest_market_value_eur")


@query(f"WITH {_FOOTBALL} SELECT position, position_group, count(*) AS player_match_records, CAST(sum(goals + assists) AS BIGINT) AS total_goal_contributions, round(avg(score), 2) AS avg_performance_score, round(avg(minutes), 2) AS avg_minutes_played FROM s GROUP BY ALL")
def football_position_summary(spark: SparkSession, d: str) -> DataFrame:
    return sports.football_gold(football(spark, d))["position"].select("position", "position_group", "player_match_records", "total_goal_contributions", "avg_performance_score", "avg_minutes_played")


@query(f"WITH {_FOOTBALL} SELECT player_id, player_name, team, nationality, position, position_group, count(DISTINCT match_id) AS matches_played, CAST(sum(minutes) AS BIGINT) AS total_minutes_played, CAST(sum(goals) AS BIGINT) AS total_goals, max(worth) AS market_value_eur FROM s GROUP BY ALL")
def football_top_players(spark: SparkSession, d: str) -> DataFrame:
    return sports.football_gold(football(spark, d))["players"].select("player_id", "player_name", "team", "nationality", "position", "position_group", "matches_played", "total_minutes_played", "total_goals", "market_value_eur")


@query(f"WITH {_FOOTBALL} SELECT tournament_stage, count(*) AS player_match_records, count(DISTINCT match_id) AS total_matches, CAST(sum(assists) AS BIGINT) AS total_assists, CAST(max(speed) AS DOUBLE) AS max_top_speed_kmh, CAST(9 AS DOUBLE) AS avg_distance_covered_km FROM s GROUP BY 1")
def football_stage_summary(spark: SparkSession, d: str) -> DataFrame:
    return sports.football_gold(football(spark, d))["stage"].select("tournament_stage", "player_match_records", "total_matches", "total_assists", "max_top_speed_kmh", "avg_distance_covered_km")


@query(f"WITH {_FOOTBALL} SELECT player_id, max(worth) AS market_value_eur, CAST(sum(minutes) AS BIGINT) AS total_minutes_played, CASE WHEN max(worth) >= 80000000 THEN 'Elite value' WHEN max(worth) >= 40000000 THEN 'High value' WHEN max(worth) >= 10000000 THEN 'Medium value' ELSE 'Lower value' END AS value_band FROM s GROUP BY player_id, player_name, team, position")
def football_value_summary(spark: SparkSession, d: str) -> DataFrame:
    return sports.football_gold(football(spark, d))["value"].select("player_id", "market_value_eur", "total_minutes_played", "value_band")


# -- contracts -----------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, '{' || CASE WHEN c_custkey % 4 = 0 THEN '"c_nationkey":"bad",' ELSE '' END || '"c_mktsegment":"' || c_mktsegment || '"}' AS _rescued_data FROM customer""")
def contract_rescue(spark: SparkSession, d: str) -> DataFrame:
    """A source with an unknown column and broken numbers, read under a contract."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "bad").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"), "c_mktsegment")
    return contracts.rescue(rows, T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType())]))
