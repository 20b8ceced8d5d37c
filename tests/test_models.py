import datetime as dt
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.functions.scalar import round_scaled
from stratum.operators import bikes, crypto, events, external, governance, retail, sports, star
from stratum.plans import catalogue, metrics
from stratum.plans.pipeline import Pipeline
from stratum.session import EngineConfig, parse_bool, quote_ident, quote_lit, required, safe_ident

ENCOUNTER = "Id string, START string, STOP string, PATIENT string, ORGANIZATION string, PROVIDER string, PAYER string, ENCOUNTERCLASS string, CODE string, DESCRIPTION string, BASE_ENCOUNTER_COST string, TOTAL_CLAIM_COST string, PAYER_COVERAGE string, REASONCODE string, REASONDESCRIPTION string"


def encounters(spark):
    row = lambda i, day, c, claim, cover, p="p1": (i, f"{day}T10:00:00Z", f"{day}T11:30:00Z", p, "o1", "d1", "y1", c, "1", "x", "80.00", claim, cover, None, None)
    return spark.createDataFrame([row("e1", "2026-08-21", "emergency", "160.00", "100.00"), row("e2", "2026-08-21", "outpatient", "200.00", "150.00", "p2")], ENCOUNTER)


def test_date_dimension(spark):
    rows = star.date_dimension(spark, "2026-08-21", "2026-08-23").orderBy("date_key").collect()
    assert [(r.date_key, r.is_weekend, r.day_of_week) for r in rows] == [(20260821, False, 5), (20260822, True, 6), (20260823, True, 7)]
    assert len(rows[0]) == 12


def test_prepare_encounters(spark):
    r = star.prepare_encounters(encounters(spark)).filter("encounter_id = 'e1'").first()
    assert r.duration_minutes == 90.0 and r.patient_responsibility == Decimal("60.00") and r.encounter_date == dt.date(2026, 8, 21)
    bad = star.prepare_encounters(encounters(spark).withColumn("START", F.lit("nope")).withColumn("TOTAL_CLAIM_COST", F.lit("x")))
    q = star.source_quality(bad).first()
    assert (q.bad_start_timestamps, q.bad_claim_costs) == (2, 2)


def dims(spark):
    one = lambda name, ids: spark.createDataFrame([(i + 1, v) for i, v in enumerate(ids)], f"{name}_key long, {name}_id string")
    return {"date": star.date_dimension(spark, "2026-08-01", "2026-08-31"), "patient": one("patient", ["p1", "p2"]), "organization": one("organization", ["o1"]), "provider": one("provider", ["d1"]), "payer": one("payer", ["y1"])}


def test_fact_and_aggregates(spark):
    fact = star.fact_encounters(star.prepare_encounters(encounters(spark)), dims(spark))
    star.foreign_key_gate(fact, ["date_key", "patient_key", "organization_key", "provider_key", "payer_key"])
    r = star.daily_encounters(fact).first()
    assert (r.encounter_count, r.unique_patients, r.organizations_active, r.emergency_encounter_pct, r.total_claim_cost, r.payer_coverage) == (2, 2, 1, 50.0, Decimal("360.00"), Decimal("250.00"))
    org = spark.createDataFrame([(1, "o1", "Org", "C", "S")], "organization_key long, organization_id string, organization_name string, city string, state string")
    assert star.organization_performance(fact, org).first().unique_patients == 2
    payer = spark.createDataFrame([(1, "y1", "Payer")], "payer_key long, payer_id string, payer_name string")
    assert star.payer_coverage(fact, payer).first().coverage_pct == Decimal("69.44") or float(star.payer_coverage(fact, payer).first().coverage_pct) == 69.44
    zero = fact.withColumn("total_claim_cost", F.lit(0).cast("decimal(18,2)"))
    assert star.payer_coverage(zero, payer).first().coverage_pct is None
    assert float(star.payer_coverage(zero, payer, external=True).first().coverage_pct) == 0.0
    sets = metrics.dashboard(fact, star.payer_coverage(fact, payer), spark.createDataFrame([("c", 1, 1, 1)], "condition_description string, condition_event_count long, unique_patients long, active_condition_events long"), classes=["EMERGENCY"])
    assert len(sets) == 7 and sets["overview"].first().total_encounters == 1 and sets["overview"].first().organizations == 1
    with pytest.raises(ValueError):
        star.foreign_key_gate(fact.withColumn("payer_key", F.lit(None)), ["payer_key"])


def test_dimensions(spark):
    src = spark.createDataFrame([("a", "N1", "x"), ("a", "N1", "x"), (None, "N2", "y")], "Id string, NAME string, STATE string")
    for c in ("CITY", "ZIP", "REVENUE", "UTILIZATION", "AMOUNT_COVERED", "AMOUNT_UNCOVERED"):
        src = src.withColumn(c, F.lit("1"))
    assert star.organizations(src).count() == 1
    assert "state" in star.payers(src, external=True).columns


def test_conditions(spark):
    src = spark.createDataFrame([("2026-08-01", "2026-08-11", "p1", "e1", "7", "flu")] * 2 + [("2026-08-02", None, "p2", "e2", "7", "flu")], "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string, DESCRIPTION string")
    d = dims(spark) | {"condition": star.conditions_dimension(src)}
    fact = star.fact_conditions(src, d, spark.createDataFrame([(1, "e1"), (2, "e2")], "encounter_key long, encounter_id string"))
    assert fact.count() == 2
    r = star.condition_summary(fact, d["condition"]).first()
    assert (r.condition_event_count, r.active_condition_events, r.avg_condition_duration_days, r.active_condition_pct) == (2, 1, 10.0, 50.0)
    assert "condition_events" in star.condition_summary(fact, d["condition"], external=True).columns


def test_volume_alert(spark):
    days = [(dt.date(2024, m, 1),) for m, n in ((1, 100), (2, 300), (3, 326), (4, 352), (5, 9)) for _ in range(n)]
    r = star.volume_alert(spark.createDataFrame(days, "encounter_date date")).first()
    assert (r.baseline_volume, r.observed_volume, r.drop_pct, r.alert_triggered, r.test_month) == (326, 65, 80.06, 1, dt.date(2024, 6, 1))
    assert star.volume_alert(spark.createDataFrame(days, "encounter_date date"), external=True).first().test_month == dt.date(2024, 5, 1)
    assert star.volume_alert(spark.createDataFrame(days[:1], "encounter_date date")).count() == 0


def test_month_loader(spark, tmp_path):
    assert star.load_by_month(encounters(spark), f"file://{tmp_path}/m") == {"rows": 2, "months": 1}
    with pytest.raises(ValueError):
        star.load_by_month(encounters(spark).unionByName(encounters(spark)), f"file://{tmp_path}/n")


def test_measures_of_measures(spark):
    v = metrics.MetricView({}, {"a": "count(*)", "b": "MEASURE(a) + 1", "x": "MEASURE(y)", "y": "MEASURE(x)"})
    assert v.query(spark.range(3), measures=["b"]).first().b == 4
    with pytest.raises(ValueError):
        v.expression("x")
    with pytest.raises(KeyError):
        v.expression("z")


def test_pipeline(spark):
    p = Pipeline()

    @p.dataset(expect={"small": "id < 3"}, expect_or_drop={"not_one": "id <> 1"})
    def middle(raw):
        return raw

    @p.dataset()
    def last(middle):
        return middle.agg(F.sum("id").alias("s"))

    out, counts = p.run(spark, {"raw": spark.range(5)})
    assert out["last"].first().s == 9
    assert {(r.expectation, r.failed) for r in counts.collect()} == {("small", 2), ("not_one", 1)}
    strict = Pipeline()
    strict.dataset("x", expect_or_fail={"none": "id < 0"})(lambda raw: raw)
    with pytest.raises(ValueError):
        strict.run(spark, {"raw": spark.range(1)})


def test_bikes(spark):
    s = '{"last_updated": 100, "data": {"stations": [{"station_id": "a", "num_bikes_available": 5, "num_docks_available": 5, "num_ebikes_available": 1, "is_renting": false, "is_returning": true, "last_reported": 90}, {"station_id": "b", "num_bikes_available": 1, "num_docks_available": 0, "last_reported": 90}]}}'
    i = '{"last_updated": 100, "data": {"stations": [{"station_id": "a", "name": " A ", "lat": 1.0, "lon": 2.0, "capacity": 10}]}}'
    read = lambda text, schema: spark.createDataFrame([(text,)], "v string").select(F.from_json("v", schema).alias("d")).select("d.*")
    status, info = bikes.status(read(s, bikes.STATUS_SCHEMA)), bikes.information(read(i, bikes.INFORMATION_SCHEMA))
    got = {r.station_id: r for r in bikes.summary(bikes.enriched(status, info)).collect()}
    assert (got["a"].availability_band, got["a"].avg_station_utilization_pct, got["a"].not_renting_observations) == ("BALANCED", 50.0, 1)
    assert (got["b"].availability_band, got["b"].unmatched_reference_observations) == ("UNKNOWN", 1)
    assert tuple(bikes.key_coverage(status, info).first()) == (1, 0, 1)
    assert bikes.source_profile(status).first().row_count == 2


def test_bike_summary_rounds_ties_as_its_sql(spark, tmp_path):
    """829 / 200 is 4.145 and 3.83 / 40 * 100 is 9.575: both are just below the tie once multiplied by 100."""
    line = lambda station, n, rows: f"SELECT CAST({station} AS BIGINT) AS l_suppkey, CAST({n} AS INTEGER) AS l_linenumber, 1.0::DOUBLE AS l_quantity, 'N' AS l_returnflag, TIMESTAMP '2024-01-01' AS l_shipdate FROM range({rows})"
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem AS " + " UNION ALL ".join([line(403, 5, 29), line(403, 4, 171), line(442, 4, 83), line(442, 3, 17)]))
    con.sql("CREATE TABLE supplier AS SELECT CAST(i AS BIGINT) AS s_suppkey, 's' || i AS s_name FROM (VALUES (403), (442)) v(i)")
    for name in ("lineitem", "supplier"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = catalogue.queries()["bike_station_summary"](spark, str(tmp_path))
    want = con.sql(catalogue.oracle_sql()["bike_station_summary"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_round_scaled(spark):
    values = [None, 0.0, -0.0, 1.005, -1.005, 2.675, 0.125, -0.125, 0.005, 4.145, 9.575, 1e20, 1e307, float("inf"), 0.49999999999999994, 45035996273704.955] + [i / 1000 for i in range(-3000, 3000)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", *[round_scaled(F.col("v"), n).alias(f"r{n}") for n in (0, 2, 3)]).orderBy("i").collect()
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(values)), "v": pa.array(values, pa.float64())}))
    assert [tuple(r) for r in got] == con.sql("SELECT i, round(v, 0), round(v, 2), round(v, 3) FROM t ORDER BY i").fetchall()
    nan = spark.range(1).select(round_scaled(F.lit(float("nan")), 2)).first()[0]
    assert nan != nan


#: A message as the feed sends it.
MESSAGE = {
    "$schema": "/mediawiki/recentchange/1.0.0",
    "meta": {"id": "0a1b", "dt": "2026-07-01T10:00:00Z", "domain": "en.wikipedia.org", "stream": "mediawiki.recentchange", "topic": "t", "uri": "u", "request_id": "r"},
    "id": 17, "type": "edit", "namespace": 0, "title": " Spark ", "title_url": "https://en.wikipedia.org/wiki/Spark", "comment": " typo ", "timestamp": 1782900000, "user": "Ann", "bot": True, "minor": True, "patrolled": False,
    "server_name": "en.wikipedia.org", "wiki": "enwiki", "_producer_id": "p1", "_source_system": "wikimedia_recentchange", "_ingested_at_utc": "2026-07-01T10:00:05+00:00",
}


def test_events(spark):
    import json

    change = lambda **k: json.dumps(MESSAGE | k)
    texts = [change(), change(meta={"id": "x"}), change(meta=None), change(type=None), change(wiki=None), change(title=None), change(title=" "), change(_source_system="other"), "{broken", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, raw_event string")
    got = [r.validation_result for r in events.classify(rows).orderBy("n").collect()]
    assert got == ["valid", "valid", "missing_event_id", "missing_change_type", "missing_wiki", "missing_title", "valid", "unexpected_source", "missing_event_id", "invalid_json"]
    silver = events.silver(rows.filter("n = 0")).first()
    assert (silver.event_id, silver.title, silver.comment, silver.user_name, silver.is_bot, silver.is_minor, silver.is_patrolled, silver.wiki_namespace, silver.revision_id) == ("0a1b", "Spark", "typo", "Ann", True, True, False, 0, 17)
    assert silver.event_timestamp == dt.datetime(2026, 7, 1, 10) and silver.producer_ingested_at == dt.datetime(2026, 7, 1, 10, 0, 5) and silver.source_stream == "mediawiki.recentchange"
    # The epoch stands in for a missing time; a blank title is null in silver.
    assert events.valid_events(events.silver(rows)).count() == 2


def test_crypto(spark, tmp_path):
    (tmp_path / "BTCUSDT-1d-2026.csv").write_text("".join(f"{t}000000,{o},{h},{lo},{c},1,{t + 9}000000,1,2,1,1,0\n" for t, o, h, lo, c in ((100, 1, 3, 1, 2), (100, 1, 3, 1, 2), (90000, 2, 1, 3, 2), (180000, 2, 4, 1, 1))))
    raw = spark.read.schema(crypto.KLINE_SCHEMA).option("mode", "FAILFAST").csv(f"file://{tmp_path}")
    bronze = crypto.bronze_klines(raw)
    import hashlib

    first = bronze.filter("open_time_raw = 100000000").first()
    assert first.record_id == hashlib.sha256(b"BTCUSDT|100000000").hexdigest() and first.source_file_path.endswith("BTCUSDT-1d-2026.csv") and first.open_time == dt.datetime(1970, 1, 1, 0, 1, 40)
    silver = crypto.silver_klines(bronze)
    assert [(r.symbol, r.candle_direction) for r in silver.orderBy("open_time").collect()] == [("BTCUSDT", "BULLISH"), ("BTCUSDT", "BEARISH")]
    tick = '{"event_id": "%s", "symbol": "BTCUSDT", "price_usd": %s, "event_time": "2026-01-01T00:00:%02dZ", "producer_id": "p", "source_system": "coingecko"%s}'
    at = dt.datetime(2026, 1, 1, 0, 0, 3)
    msg = spark.createDataFrame([(tick % ("1", 5, 1, ""), 0, 1, at), (tick % ("2", 0, 2, ""), 0, 2, at), ("x", 0, 3, at), (tick % ("4", 7, 2, ', "change_pct_24h": 1.5, "high_price_24h": 8, "low_price_24h": 4, "volume_24h": 9'), 0, 4, at)], "value string, partition int, offset long, timestamp timestamp")
    good, bad = crypto.parse_ticks(msg)
    assert (good.count(), bad.count()) == (2, 2) and "price_usd" in good.columns
    assert crypto.silver_ticks(good).filter("change_pct_24h IS NOT NULL").count() == 0
    evolved, _ = crypto.parse_ticks(msg, evolved=True)
    ticks = crypto.silver_ticks(evolved.withColumn("ingested_at", F.col("eventhub_enqueued_at")))
    assert ticks.orderBy("event_id").first().ingestion_delay_seconds == 2 and ticks.first().event_date == dt.date(2026, 1, 1)
    p = crypto.latest_prices(silver, ticks).first()
    assert (p.latest_live_price, p.latest_historical_close, p.price_difference, p.price_difference_pct, p.high_price_24h) == (7.0, 1.0, 6.0, 600.0, 8.0)
    r = crypto.market_summary(silver, ticks).first()
    assert (r.first_open_price, r.last_close_price, r.historical_return_pct, r.streaming_event_count, r.evolved_event_count) == (1.0, 1.0, 0.0, 2, 1)
    assert (r.historical_price_range, r.latest_vs_period_low_pct, r.streaming_maximum_price) == (3.0, 600.0, 7.0)
    assert crypto.ohlc_violations(bronze).first().high_below_low == 1
    assert len(crypto.dashboard(silver, crypto.market_summary(silver, ticks), crypto.latest_prices(silver, ticks))) == 10


PLAYER = "player_id int, player_name string, match_id int, team string, nationality string, position string, tournament_stage string, goals int, assists int, shots int, shots_on_target int, minutes_played int, expected_goals_xg double, pass_accuracy double, player_rating double, performance_score double, market_value_eur long, top_speed_kmh double, distance_covered_km double"


def test_football_weather_taxi(spark):
    row = lambda i, m, goals, minutes, rating, value: (i, f"P{i}", m, "t", "n", "f", "Final", goals, 1, 3, 2, minutes, 0.25, 80.0, rating, 5.0, value, 30.0, 9.0)
    stats = spark.createDataFrame([row(1, 1, None, 90, 8.0, 80_000_000), row(1, 1, None, 90, 8.0, 80_000_000), row(1, 2, 2, 74, 7.99, 80_000_000), row(2, 1, 1, 29, None, 5)], PLAYER)
    s = sports.football_silver(stats, spark.createDataFrame([("t", "EU")], "team string, region string"), spark.createDataFrame([("g", "GK")], "position string, position_group string"))
    got = {(r.player_id, r.match_id): r for r in s.collect()}
    a, b, c = got[1, 1], got[1, 2], got[2, 1]
    assert (a.goal_contribution, a.shots_accuracy_pct, a.xg_overperformance, a.minutes_category, a.performance_band, a.position_group) == (1, 66.67, -0.25, "High minutes", "Excellent", "Unknown")
    assert (b.minutes_category, b.performance_band, c.minutes_category, c.performance_band, c.player_rating) == ("Medium minutes", "Good", "Low minutes", "Needs improvement", 0.0)
    gold = sports.football_gold(s)
    assert set(gold) == {"team", "position", "players", "stage", "value"}
    t = gold["team"].first()
    assert (t.player_match_records, t.total_players, t.total_matches, t.total_goals, t.total_goal_contributions, t.highest_market_value_eur) == (3, 2, 2, 3, 6, 80_000_000)
    assert {r.player_id: r.value_band for r in gold["value"].collect()} == {1: "Elite value", 2: "Lower value"}
    doc = spark.createDataFrame([('{"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.0, 3.0], "relative_humidity_2m": [50, 61], "wind_speed_10m": [5.0, 6.0]}',)], "v string").select(F.from_json("v", "time array<string>, temperature_2m array<double>, relative_humidity_2m array<double>, wind_speed_10m array<double>").alias("hourly"))
    w = sports.weather_daily(sports.weather_hours(doc)).first()
    assert tuple(w) == (dt.date(2024, 1, 1), 2.0, 1.0, 3.0, 55.5, 5.5)
    trips = spark.range(1000).select("id", F.lit(1).alias("passenger_count"), F.lit(2.0).alias("fare_amount"))
    v = sports.taxi_variants(trips, key="id")
    assert sum(x.count() for x in v.values()) == 1000
    both = v["initial"].unionByName(v["renamed"], allowMissingColumns=True)
    assert sports.unify_renamed(both, "fare_amount", "base_fare_amount").filter("fare_amount IS NULL").count() == 0


def test_retail(spark):
    rows = spark.range(100).select(F.col("id").alias("_source_row_number"), F.col("id").cast("string").alias("InvoiceNo"), F.lit(" a1 ").alias("StockCode"), F.concat(F.lit("d"), F.col("id") % 3).alias("Description"), (F.col("id") + 1).cast("int").alias("Quantity"), F.lit("2011-01-01").cast("timestamp").alias("InvoiceDate"), F.lit(2.5).alias("UnitPrice"), F.lit("1").alias("CustomerID"), F.lit("UK").alias("Country"))
    b = retail.controlled_batches(rows)
    assert len(b) == 7 and b["initial"].count() + b["incremental"].count() == 100
    assert {"SalesChannel", "PromotionCode"} <= set(b["evolved"].columns) and {r.PromotionCode for r in b["evolved"].collect()} <= {"WELCOME10", None}
    assert {(r.UnitPrice, r.Country, r.Description) for r in b["invalid"].collect()} == {(-1.0, "", None)} and dict(b["schema_mismatch"].dtypes)["Quantity"] == "string"
    assert tuple(b["scd_changes"].first())[1:4] == ("d0 - UPDATED", 2.63, dt.datetime(2012, 1, 1))
    snap = retail.product_snapshot(retail.silver_candidate(rows)).first()
    assert (snap.stock_code, snap.latest_observed_price) == ("A1", Decimal("2.5000"))


def test_quarantine_store_bears_a_replay(spark, tmp_path):
    from stratum.functions import quality
    from stratum.operators.table import VersionedTable

    t = VersionedTable(spark, f"file://{tmp_path}/q")
    rows = spark.createDataFrame([(1, "v1", "x"), (2, "v1", "y")], "_bronze_record_id long, _quality_contract_version string, why string")
    for _ in range(2):
        quality.store_quarantine(t, rows)
    quality.store_quarantine(t, rows.withColumn("_quality_contract_version", F.lit("v2")))
    assert t.read().count() == 4 and t.read().select("_quarantine_record_id").distinct().count() == 4
    with pytest.raises(ValueError, match="differ"):
        quality.store_quarantine(t, rows.withColumn("more", F.lit(1)))


def test_governance(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", "s")], "k int, org string, secret string")
    m = spark.createDataFrame([("ann", "x"), ("bob", "*")], "user_name string, allowed_value string")
    seen = lambda u: governance.filter_rows(df, m, user=u, column="org").count()
    assert (seen("ann"), seen("bob"), seen("eve")) == (1, 2, 0)
    assert [r.secret for r in governance.mask_columns(df, ["secret"], privileged=False).orderBy("k").collect()] == [None, "***MASKED***"]
    assert governance.round_trip(df, m, user="ann", column="org", value="x") == {"all": 2, "of_value": 1, "restricted": 1, "restored": 2}
    df.createOrReplaceTempView("gov_base")
    me = spark.sql("SELECT session_user()").first()[0]
    spark.createDataFrame([(me, "y")], "user_name string, allowed_value string").createOrReplaceTempView("gov_map")
    governance.secure_view(spark, "gov_view", "gov_base", mapping="gov_map", column="org", masked=["secret"])
    assert [tuple(r) for r in spark.table("gov_view").collect()] == [(2, "y", "***MASKED***")]
    plan = spark.table("gov_view")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    spark.createDataFrame([(me, "*")], "user_name string, allowed_value string").createOrReplaceTempView("gov_map")
    assert spark.table("gov_view").count() == 2
    governance.scalar_function(spark, "org_allowed", "org STRING", "EXISTS (SELECT 1 FROM gov_map m WHERE m.user_name = session_user() AND (m.allowed_value = org OR m.allowed_value = '*'))")
    assert spark.sql("SELECT org_allowed('anything')").first()[0] is True


def test_external(spark, tmp_path):
    df = spark.range(3)
    assert external.overwrite(spark, df, "ext_a", f"file://{tmp_path}/a") == "registered"
    assert external.overwrite(spark, df, "ext_a", f"file://{tmp_path}/a/") == "present"
    with pytest.raises(external.LocationMismatch):
        external.register(spark, "ext_a", f"file://{tmp_path}/b")
    got = external.register_all(spark, {"ext_a": f"file://{tmp_path}/a", "ext_b": f"file://{tmp_path}/missing-not"})
    assert got.filter("table = 'ext_a'").first().status == "present"
    spark.sql("DROP TABLE ext_a")
    spark.sql("DROP TABLE IF EXISTS ext_b")


def test_settings():
    assert parse_bool("Yes") and not parse_bool("0")
    with pytest.raises(ValueError):
        parse_bool("maybe")
    assert quote_ident("a.b`c") == "`a`.`b``c`" and quote_lit("it's") == "'it\\'s'"
    with pytest.raises(ValueError):
        safe_ident("a; drop")
    with pytest.raises(ValueError, match="b"):
        required({"a": "x", "b": " "}, "a", "b")
    assert EngineConfig("/r", "s").path("gold", "t") == "/r/gold/t"


def test_distinct_counts_beside_other_aggregates(spark):
    from stratum.functions.scalar import with_distinct_counts

    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 2), (None, "b", 3), (None, "c", 3), (2, None, None)], "k int, x string, y int")
    got = with_distinct_counts(df.groupBy("k").count(), df, ["k"], {"xs": "x", "ys": "y"})
    assert {tuple(r) for r in got.collect()} == {(1, 3, 1, 2), (None, 2, 2, 1), (2, 1, 0, 0)}
    assert with_distinct_counts(df.limit(0).groupBy("k").count(), df.limit(0), ["k"], {"xs": "x"}).count() == 0
