"""Queries over the layers: quality, change, metrics, alerts, governance, tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import checks, quality, scalar
from stratum.operators import change, governance, star
from stratum.operators.table import VersionedTable
from stratum.plans.metrics import MetricView
from stratum.sources.shared import workspace
from stratum.streaming import queries as streams

from .catalogue import query, table

# -- quality -------------------------------------------------------------------

#: Lines of orders in the columns of a retail row; some broken by rule.
_RETAIL_SQL = """retail AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END AS stock,
 CAST(l_quantity AS BIGINT) - 3 AS quantity, l_extendedprice AS price, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS customer, l_shipdate AS shipped, l_returnflag AS country FROM lineitem),
judged AS (SELECT *, list_filter([CASE WHEN trim(stock) = '' THEN 'MISSING_STOCK_CODE' END, CASE WHEN quantity <= 0 THEN 'NON_POSITIVE_QUANTITY' END, CASE WHEN customer IS NULL THEN 'MISSING_CUSTOMER_ID' END,
 CASE WHEN upper(trim(invoice)) LIKE 'C%' THEN 'CANCELLED_INVOICE' END, CASE WHEN row_number() OVER (PARTITION BY invoice, stock, quantity, price, customer, shipped, country) > 1 THEN 'DUPLICATE_BUSINESS_ROW' END], lambda x: x IS NOT NULL) AS reasons FROM retail)"""


def retail_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        F.concat(F.when(c("l_orderkey") % 11 == 0, "C").otherwise(""), c("l_orderkey").cast("string")).alias("InvoiceNo"),
        F.when(c("l_partkey") % 13 == 0, " ").otherwise(c("l_partkey").cast("string")).alias("StockCode"),
        F.lit("item").alias("Description"),
        (c("l_quantity").cast("bigint") - 3).alias("Quantity"),
        c("l_shipdate").alias("InvoiceDate"),
        c("l_extendedprice").alias("UnitPrice"),
        F.when(c("l_suppkey") % 7 != 0, c("l_suppkey").cast("string")).alias("CustomerID"),
        c("l_returnflag").alias("Country"),
    )


def judged_rows(spark: SparkSession, d: str) -> DataFrame:
    return quality.apply_quality_rules(retail_rows(spark, d))


@query(f"WITH {_RETAIL_SQL} SELECT CASE WHEN len(reasons) = 0 THEN 'VALID' ELSE 'REJECTED' END AS status, CAST(len(reasons) AS INTEGER) AS rule_count, count(*) AS rows FROM judged GROUP BY ALL")
def quality_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return judged_rows(spark, d).groupBy(F.col("_quality_status").alias("status"), F.col("_quality_rule_count").alias("rule_count")).agg(F.count("*").alias("rows"))


@query(f"WITH {_RETAIL_SQL} SELECT unnest(reasons) AS quality_rule, count(*) AS failed_rows FROM judged GROUP BY 1")
def rule_failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.rule_failure_summary(judged_rows(spark, d))


@query(
    f"""WITH {_RETAIL_SQL} SELECT count(*) AS input_rows, count(*) FILTER (WHERE len(reasons) = 0) AS valid_rows, count(*) FILTER (WHERE len(reasons) > 0) AS rejected_rows, count(*) FILTER (WHERE list_contains(reasons, 'CANCELLED_INVOICE')) AS cancelled_rows,
 count(*) FILTER (WHERE list_contains(reasons, 'MISSING_CUSTOMER_ID')) AS missing_customer_rows, count(*) FILTER (WHERE list_contains(reasons, 'DUPLICATE_BUSINESS_ROW')) AS duplicate_rows FROM judged"""
)
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_metrics(judged_rows(spark, d))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS duplicate_rank, l_partkey, l_extendedprice FROM lineitem")
def duplicate_rank(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_duplicate_rank(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", F.col("_duplicate_rank").alias("duplicate_rank"), "l_partkey", "l_extendedprice")


@query(
    """SELECT 'balance_not_negative' AS expectation, count(*) FILTER (WHERE c_acctbal >= 0) AS passed, count(*) - count(*) FILTER (WHERE c_acctbal >= 0) AS failed FROM customer
UNION ALL SELECT 'segment_known', count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY'), count(*) - count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') FROM customer"""
)
def expectation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.expectation_metrics(table(spark, d, "customer"), {"balance_not_negative": "c_acctbal >= 0", "segment_known": "c_mktsegment <> 'MACHINERY'"})


# -- change --------------------------------------------------------------------

#: A target without a tenth of the customers, and a source in which another tenth moved.
_SLICES = """target AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0), source AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 1 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 10 <> 2)"""


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    h = lambda df: change.add_record_hash(df, ["c_name", "c_nationkey"])
    moved = base.filter("c_custkey % 10 <> 2").withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 1, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")))
    return h(moved), h(base.filter("c_custkey % 10 <> 0"))


@query(f"WITH {_SLICES} SELECT s.c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'INSERT' WHEN s.c_nationkey <> t.c_nationkey THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM source s LEFT JOIN target t USING (c_custkey)")
def merge_classify(spark: SparkSession, d: str) -> DataFrame:
    s, t = _slices(spark, d)
    return change.classify(s, t, keys=["c_custkey"], hash_column="_record_hash").select("c_custkey", F.col("_action").alias("action"))


@query(f"WITH {_SLICES} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_nationkey, t.c_nationkey) AS c_nationkey FROM target t FULL JOIN source s USING (c_custkey)")
def merge_upsert_result(spark: SparkSession, d: str) -> DataFrame:
    s, t = _slices(spark, d)
    return change.upsert(s, t, keys=["c_custkey"], hash_column="_record_hash").select("c_custkey", "c_name", "c_nationkey")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("created_at", "updated_at")})


@query(
    f"""WITH {_SLICES} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_nationkey, t.c_nationkey) AS c_nationkey, CASE WHEN t.c_custkey IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS created,
 CASE WHEN t.c_custkey IS NULL OR s.c_nationkey <> t.c_nationkey THEN '2024-02-01' ELSE '2024-01-01' END AS updated FROM target t FULL JOIN source s USING (c_custkey)"""
)
def scd1_result(spark: SparkSession, d: str) -> DataFrame:
    s, t = _slices(spark, d)
    rows = change.scd1(s, _stamped(t), key="c_custkey", mutable=["c_name", "c_nationkey"], hash_column="_record_hash", at="2024-02-01 00:00:00")
    return rows.select("c_custkey", "c_nationkey", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def _dimension(spark: SparkSession, d: str) -> DataFrame:
    """A type 2 dimension of the target slice after the source slice."""
    s, t = _slices(spark, d)
    first = t.withColumns({"version_number": F.lit(1), "effective_from": F.lit("2024-01-01").cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})
    return change.scd2(s, first, key="c_custkey", attributes=["c_name", "c_nationkey"], hash_column="_record_hash", effective_at="timestamp'2024-02-01 00:00:00'")


_SCD2 = f"""{_SLICES}, dim AS (SELECT t.c_custkey, t.c_nationkey, 1 AS version_number, '2024-01-01' AS starts, CASE WHEN s.c_nationkey <> t.c_nationkey THEN '2024-02-01' END AS ends, s.c_nationkey IS NULL OR s.c_nationkey = t.c_nationkey AS is_current FROM target t LEFT JOIN source s USING (c_custkey)
 UNION ALL SELECT s.c_custkey, s.c_nationkey, CASE WHEN t.c_custkey IS NULL THEN 1 ELSE 2 END, '2024-02-01', NULL, true FROM source s LEFT JOIN target t USING (c_custkey) WHERE t.c_custkey IS NULL OR s.c_nationkey <> t.c_nationkey)"""


@query(f"WITH {_SCD2} SELECT * FROM dim")
def scd2_result(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return _dimension(spark, d).select("c_custkey", "c_nationkey", "version_number", text("effective_from", "starts"), text("effective_to", "ends"), "is_current")


@query(f"WITH {_SCD2} SELECT c_custkey, c_nationkey, version_number FROM dim WHERE starts <= '2024-01-15' AND (ends IS NULL OR ends > '2024-01-15')")
def scd2_as_of(spark: SparkSession, d: str) -> DataFrame:
    return change.as_of(_dimension(spark, d), "timestamp'2024-01-15 00:00:00'").select("c_custkey", "c_nationkey", "version_number")


@query("SELECT CAST(0 AS BIGINT) AS keys_without_one_current, CAST(0 AS BIGINT) AS keys_with_repeated_versions, CAST(0 AS BIGINT) AS interval_gaps, CAST(0 AS BIGINT) AS backward_intervals, CAST(0 AS BIGINT) AS open_end_mismatches, CAST(0 AS BIGINT) AS version_skips")
def scd2_invariants(spark: SparkSession, d: str) -> DataFrame:
    return change.scd2_invariants(_dimension(spark, d), "c_custkey")


# -- metrics and alerts --------------------------------------------------------

ORDERS = MetricView(
    {"status": "o_orderstatus", "month": "trunc(o_orderdate, 'month')"},
    {"orders": "count(*)", "urgent": "count_if(o_orderpriority = '1-URGENT')", "urgent_pct": "round(cast(100 as double) * MEASURE(urgent) / MEASURE(orders), 2)", "not_urgent_pct": "round(100 - MEASURE(urgent_pct), 2)"},
)


@query("SELECT o_orderstatus AS status, count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2) AS urgent_pct, round(100 - round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2), 2) AS not_urgent_pct FROM orders GROUP BY 1")
def metric_emergency_pct(spark: SparkSession, d: str) -> DataFrame:
    return ORDERS.query(table(spark, d, "orders"), by=["status"])


@query("SELECT round(avg(p), 4) AS mean_urgent_pct FROM (SELECT round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2) AS p FROM orders GROUP BY o_orderstatus)")
def metric_avg_of_pct(spark: SparkSession, d: str) -> DataFrame:
    per = ORDERS.query(table(spark, d, "orders"), by=["status"], measures=["urgent_pct"])
    return MetricView({}, {"mean_urgent_pct": "round(avg(urgent_pct), 4)"}).query(per)


@query(
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 4),
b AS (SELECT max(month) AS latest_month, CAST(round_even(sum(CASE WHEN month <> (SELECT max(month) FROM m) THEN n END) / 3.0, 0) AS BIGINT) AS baseline_volume FROM m)
SELECT latest_month, CAST(latest_month + INTERVAL 1 MONTH AS DATE) AS test_month, baseline_volume, CAST(round_even(baseline_volume * 0.2, 0) AS BIGINT) AS observed_volume,
 CAST(round_even(100.0 * (baseline_volume - CAST(round_even(baseline_volume * 0.2, 0) AS BIGINT)) / baseline_volume, 2) AS DOUBLE) AS drop_pct, CAST(30.0 AS DOUBLE) AS threshold_pct, 1 AS alert_triggered FROM b"""
)
def volume_alert(spark: SparkSession, d: str) -> DataFrame:
    return star.volume_alert(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("encounter_date")))


# -- governance ----------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***MASKED***' END AS c_name, CASE WHEN c_mktsegment IS NOT NULL THEN '***MASKED***' END AS c_mktsegment FROM customer")
def masked_customers(spark: SparkSession, d: str) -> DataFrame:
    return governance.mask_columns(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], privileged=False)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filtered_orders(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("ann", "F"), ("ann", "P"), ("bob", "*")], "user_name string, allowed_value string")
    return governance.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), mapping, user="ann", column="o_orderstatus")


# -- checks --------------------------------------------------------------------


@query("SELECT 'lines' AS measure, CAST(count(*) AS DOUBLE) AS left_value, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) AS DOUBLE) AS right_value, CAST(0 AS DOUBLE) AS difference FROM lineitem")
def reconcile_supplier_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    per = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return checks.reconcile(lines, per, {"lines": ("count(*)", "sum(n)")}).select("measure", *[F.col(c).cast("double").alias(c) for c in ("left_value", "right_value", "difference")])


@query("SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS distinct_key_count, count(*) - count(o_custkey) AS null_key_count FROM orders")
def key_profile(spark: SparkSession, d: str) -> DataFrame:
    return checks.key_metrics(table(spark, d, "orders"), "o_custkey")


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1 AS INTEGER) AS expected_days FROM orders")
def calendar_completeness(spark: SparkSession, d: str) -> DataFrame:
    return checks.calendar_gaps(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


# -- tables --------------------------------------------------------------------


@query("SELECT count(*) AS rows, true AS unchanged FROM customer")
def compact_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A table's rows before and after compaction."""
    t = VersionedTable(spark, f"{workspace(spark)}/{uuid.uuid4().hex}")
    t.overwrite(table(spark, d, "customer"))
    before = t.fingerprint()
    t.compact(2, cluster=["c_nationkey"])
    return t.read().agg(F.count("*").alias("rows")).withColumn("unchanged", F.lit(before == t.fingerprint()))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN 'GOLD' END AS tier FROM customer")
def schema_evolve_result(spark: SparkSession, d: str) -> DataFrame:
    """A table to which a wider type and a new column were appended."""
    t = VersionedTable(spark, f"{workspace(spark)}/{uuid.uuid4().hex}")
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    t.overwrite(base.filter("c_custkey % 2 = 0"))
    t.append(base.filter("c_custkey % 2 = 1").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), F.lit("GOLD").alias("tier")), merge_schema=True)
    return t.read()


@query(f"WITH {_SLICES} SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_nationkey, t.c_nationkey) AS c_nationkey FROM target t FULL JOIN source s USING (c_custkey)")
def table_merge_replayed(spark: SparkSession, d: str) -> DataFrame:
    """A table after a merge and its replay."""
    s, target = _slices(spark, d)
    t = VersionedTable(spark, f"{workspace(spark)}/{uuid.uuid4().hex}")
    t.overwrite(target)
    for _ in range(2):
        t.merge(s, keys=["c_custkey"], hash_column="_record_hash")
    return t.read().select("c_custkey", "c_nationkey")


# -- streams -------------------------------------------------------------------


def _landed(spark: SparkSession, d: str) -> tuple[str, str, object]:
    """Events as a folder of files, a folder for outputs, and the schema."""
    base = f"{workspace(spark)}/{uuid.uuid4().hex}"
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    return base, f"{base}/in", events.schema


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append_events(spark: SparkSession, d: str) -> DataFrame:
    base, path, schema = _landed(spark, d)
    rows = streams.file_stream(spark, path, schema, kind="parquet", max_files=2).select("event_id", "user_id", "event_type")
    streams.append_to(rows, f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    base, path, schema = _landed(spark, d)
    twice = streams.file_stream(spark, path, schema, kind="parquet")
    rows = streams.deduplicate(twice.unionByName(streams.file_stream(spark, path, schema, kind="parquet")), ["event_id"], event_time="ts", delay="60 days").select("event_id")
    streams.append_to(rows, f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out")


@query("SELECT event_id, user_id, c_name, c_name IS NOT NULL AS reference_matched FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_static_enrich(spark: SparkSession, d: str) -> DataFrame:
    base, path, schema = _landed(spark, d)
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows = streams.enrich(streams.file_stream(spark, path, schema, kind="parquet").select("event_id", "user_id"), static, "user_id")
    streams.append_to(rows, f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out").select("event_id", "user_id", "c_name", "reference_matched")


@query("SELECT 1 AS run, count(*) AS rows FROM events UNION ALL SELECT 2, count(*) FROM events UNION ALL SELECT 3, 2 * count(*) FROM events")
def stream_resume_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows after a run, after a rerun without new files, and with as many again."""
    base, path, schema = _landed(spark, d)
    counts = []
    for run in (1, 2, 3):
        if run == 3:
            spark.read.schema(schema).parquet(path).write.mode("append").parquet(path)
        streams.append_to(streams.file_stream(spark, path, schema, kind="parquet"), f"{base}/out", f"{base}/cp")
        counts.append((run, spark.read.parquet(f"{base}/out").count()))
    return spark.createDataFrame(counts, "run int, rows long")


@query("SELECT count(*) AS rows, true AS unchanged FROM events")
def fingerprint_order_independent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    a = rows.agg(F.count("*").alias("rows"), scalar.fingerprint(rows).alias("a"))
    b = rows.orderBy(F.desc("event_id")).agg(F.count("*").alias("rows"), scalar.fingerprint(rows).alias("b"))
    return a.join(b, "rows").select("rows", (F.col("a") == F.col("b")).alias("unchanged"))
