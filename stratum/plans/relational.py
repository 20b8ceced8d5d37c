"""Relational queries: scans, joins, aggregates, windows, sorts and scalar functions.

Money is summed as decimal, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratum.functions import scalar
from stratum.operators import change, retail, star
from stratum.operators.star import lookup

from .catalogue import query, table

MONEY = "decimal(18,2)"


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def day(c: str) -> Column:
    return F.to_date(c)


# -- scan and shape ------------------------------------------------------------


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def scan_project_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey", day("o_orderdate").alias("order_date"), "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 10) OR NOT (l_discount < 0.09 OR l_tax IS NULL)")
def filter_multi_predicate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").filter((c("l_returnflag").isin("A", "R") & c("l_quantity").between(5, 10)) | ~((c("l_discount") < 0.09) | c("l_tax").isNull())).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'UNKNOWN' WHEN o_totalprice < 50000 THEN 'LOW' WHEN o_totalprice < 200000 THEN 'MEDIUM' WHEN o_totalprice < 400000 THEN 'HIGH' ELSE 'TOP' END AS price_band FROM orders")
def case_bands_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", scalar.bands(F.col("o_totalprice"), [(50000, "LOW"), (200000, "MEDIUM"), (400000, "HIGH")], "TOP", null="UNKNOWN").alias("price_band"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS tax_ratio, CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE 0.0 END AS tax_ratio_or_zero FROM lineitem")
def guarded_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = lambda default: scalar.guarded_ratio(F.col("l_tax"), F.col("l_discount"), default=default)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(None).alias("tax_ratio"), r(0.0).alias("tax_ratio_or_zero"))


@query("SELECT c_custkey, coalesce(n, 0) AS order_count, coalesce(status, 'NONE') AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS status FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def fillna_left_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("order_count"), F.min("o_orderstatus").alias("status"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna({"order_count": 0, "status": "NONE"})


@query("SELECT count(*) AS rows, count(*) - count(c_name) AS c_name_nulls, count(*) - count(c_acctbal) AS c_acctbal_nulls, count(*) - count(c_mktsegment) AS c_mktsegment_nulls FROM customer")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return scalar.null_profile(table(spark, d, "customer"), ["c_name", "c_acctbal", "c_mktsegment"])


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, p_brand) AS label FROM part")
def coalesce_renamed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.col("p_brand")).alias("label"))


@query("SELECT user_id, event_id, CAST(value AS INTEGER) AS whole_value, event_type AS kind, 'events' AS origin FROM events")
def cast_contract_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.bround("value").cast("int").alias("whole_value"), F.col("event_type").alias("kind"), F.lit("events").alias("origin"))


# -- joins ---------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, c_name, p_name, s_name, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""
)
def fact_lookup_star(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n, *c: table(spark, d, n).select(*c)
    # The fact is joined with orders by shuffle; dimensions are looked up behind a size check.
    return (
        t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(t("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
        .join(lookup(t("customer", F.col("c_custkey").alias("o_custkey"), "c_name")), "o_custkey", "left")
        .join(lookup(t("part", F.col("p_partkey").alias("l_partkey"), "p_name")), "l_partkey", "left")
        .join(lookup(t("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")), "l_suppkey", "left")
        .join(lookup(t("nation", F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey", "left")
        .select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "p_name", "s_name", "n_name")
    )


@query("SELECT p_brand, p_type, n, CAST(total AS DOUBLE) AS total FROM (SELECT DISTINCT p_brand, p_type FROM part) LEFT JOIN (SELECT p_brand AS b, p_type AS t, count(*) AS n, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS total FROM part WHERE p_size > 20 GROUP BY ALL) ON p_brand = b AND p_type = t")
def left_composite_key(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    sums = part.filter("p_size > 20").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(money("p_retailprice")).cast("double").alias("total"))
    return part.select("p_brand", "p_type").distinct().join(sums, ["p_brand", "p_type"], "left")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) AS latest FROM orders GROUP BY 1) ON o_custkey = k AND o_orderdate = latest")
def inner_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return orders.join(orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate")), ["o_custkey", "o_orderdate"]).drop("o_orderdate")


@query("SELECT l_orderkey, count(*) AS line_count FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') GROUP BY 1")
def anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    parent = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(parent, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("line_count"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT n_name, customers, CAST(balance AS DOUBLE) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS balance FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def agg_then_join_nation(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("balance"))
    return table(spark, d, "nation").join(sums, "n_nationkey", "left").select("n_name", "customers", "balance")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')")
def row_filter_exists(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(allowed, "o_custkey", "left_semi")


# -- aggregates ----------------------------------------------------------------


@query(
    """SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, CAST(o_orderdate AS DATE) AS order_date, count(*) AS order_count,
  count(DISTINCT o_custkey) AS customer_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_price,
  round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2) AS urgent_pct FROM orders GROUP BY ALL"""
)
def agg_daily_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders per day: counts, distinct customers, value, share of urgent ones."""
    total = F.sum(money("o_totalprice")).cast("double")
    rows = table(spark, d, "orders").groupBy(day("o_orderdate").alias("order_date")).agg(
        F.count("*").alias("order_count"),
        F.countDistinct("o_custkey").alias("customer_count"),
        total.alias("total_price"),
        F.round(total / F.count("*"), 2).alias("avg_price"),
        F.round(F.lit(100.0).cast("double") * F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*"), 2).alias("urgent_pct"),
    )
    return rows.withColumn("date_key", F.date_format("order_date", "yyyyMMdd").cast("int"))


@query(
    """SELECT l_suppkey, s_name, count(*) AS line_count, count(DISTINCT l_orderkey) AS order_count, count(DISTINCT l_partkey) AS part_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  CAST(min(l_shipdate) AS DATE) AS first_ship_date, CAST(max(l_shipdate) AS DATE) AS last_ship_date FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def agg_supplier_performance(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    rows = lines.groupBy("l_suppkey").agg(F.count("*").alias("line_count"), F.countDistinct("l_orderkey").alias("order_count"), F.sum(money("l_extendedprice")).cast("double").alias("revenue"), F.to_date(F.min("l_shipdate")).alias("first_ship_date"), F.to_date(F.max("l_shipdate")).alias("last_ship_date"))
    rows = scalar.with_distinct_counts(rows, lines, ["l_suppkey"], {"part_count": "l_partkey"})
    return rows.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")


@query(
    """SELECT c_mktsegment, count(*) AS order_count, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS finished_price,
  round(100 * CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS coverage_pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def agg_segment_performance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    total, done = F.sum(money("o_totalprice")).cast("double"), F.sum(F.when(F.col("o_orderstatus") == "F", money("o_totalprice")).otherwise(F.lit(0).cast(MONEY))).cast("double")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("order_count"), F.countDistinct("o_custkey").alias("customers"), total.alias("total_price"), done.alias("finished_price"), F.round(100 * done / total, 2).alias("coverage_pct"))


@query("SELECT l_partkey, count(*) AS events, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 2) AS returned_pct, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem GROUP BY 1")
def agg_part_summary(spark: SparkSession, d: str) -> DataFrame:
    back = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("events"), F.countDistinct("l_orderkey").alias("orders"), back.alias("returned"), F.round(F.lit(100.0).cast("double") * back / F.count("*"), 2).alias("returned_pct"), F.min(day("l_shipdate")).alias("first_date"), F.max(day("l_shipdate")).alias("last_date"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def multi_distinct(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    rows = lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"))
    return scalar.with_distinct_counts(rows, lines, ["l_returnflag"], {"parts": "l_partkey", "suppliers": "l_suppkey"})


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS above, count(CASE WHEN value <= 50 THEN 1 END) AS up_to, CAST(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even_users FROM events GROUP BY 1")
def conditional_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("above"), F.count(F.when(F.col("value") <= 50, 1)).alias("up_to"), F.sum((F.col("user_id") % 2 == 0).cast("long")).alias("even_users"))


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def first_last_by_order(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS order_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price FROM orders GROUP BY 1")
def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month_start")).agg(F.count("*").alias("order_count"), F.sum(money("o_totalprice")).cast("double").alias("total_price"))


@query("SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders")
def overview_kpis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.sum(money("o_totalprice")).cast("double").alias("total_price"), F.min(day("o_orderdate")).alias("first_date"), F.max(day("o_orderdate")).alias("last_date"))


@query("SELECT lower(o_orderpriority) AS priority, count(*) AS order_count, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.lower("o_orderpriority").alias("priority")).agg(F.count("*").alias("order_count"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT event_type, count(*) AS rows, count(CASE WHEN value > 20 THEN value END) AS with_value FROM events GROUP BY 1")
def count_nonnull(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count(F.when(F.col("value") > 20, F.col("value"))).alias("with_value"))


# -- windows -------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return change.latest_by(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """WITH a AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, event_type FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2"""
)
def chained_dedup_events(spark: SparkSession, d: str) -> DataFrame:
    once = change.latest_by(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return once.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS price_rank FROM orders QUALIFY price_rank <= 2")
def top2_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("price_rank", F.row_number().over(w)).filter("price_rank <= 2").select("o_custkey", "o_orderkey", "price_rank")


@query("SELECT event_id, user_id, epoch(lead(date_trunc('second', ts)) OVER w) - epoch(date_trunc('second', ts)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lead_gap_check(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").withColumn("_s", sec).select("event_id", "user_id", (F.lead("_s").over(w) - F.col("_s")).cast("double").alias("gap"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS row_number FROM orders QUALIFY row_number BETWEEN 11 AND 60")
def row_range_sample(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("by"))
    return retail.row_range(ranked, ["by", "o_orderkey"], 11, 60).select("o_orderkey", "row_number")


# -- sort and set --------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def topk_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey AS nationkey, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_name, 'supplier' FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey")))


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def key_set_difference(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).distinct()
    return keys.join(table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")), "nationkey", "left_anti")


# -- scalar functions ----------------------------------------------------------


@query(
    """SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, CAST(x AS DATE) AS calendar_date, CAST(year(x) AS INTEGER) AS year, CAST(quarter(x) AS INTEGER) AS quarter, CAST(month(x) AS INTEGER) AS month, strftime(x, '%B') AS month_name, strftime(x, '%Y-%m') AS year_month,
  CAST(weekofyear(x) AS INTEGER) AS week_of_year, CAST(day(x) AS INTEGER) AS day_of_month, CAST(isodow(x) AS INTEGER) AS day_of_week, strftime(x, '%A') AS day_name, isodow(x) >= 6 AS is_weekend
  FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS x)"""
)
def date_dimension(spark: SparkSession, d: str) -> DataFrame:
    return star.date_dimension(spark, "1995-01-01", "2002-12-31")


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, isodow(o_orderdate) >= 6 AS weekend FROM orders")
def iso_weekday(spark: SparkSession, d: str) -> DataFrame:
    w = scalar.iso_weekday(day("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", w.alias("weekday"), (w >= 6).alias("weekend"))


@query("SELECT c_custkey, sha256(coalesce(c_name, '<NULL>') || '||' || coalesce(CAST(c_nationkey AS VARCHAR), '<NULL>') || '||' || coalesce(c_mktsegment, '<NULL>')) AS record_hash FROM customer")
def record_hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    return change.add_record_hash(table(spark, d, "customer"), ["c_name", "c_nationkey", "c_mktsegment"], output_column="record_hash").select("c_custkey", "record_hash")


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '#(\\d+)$', 1) AS INTEGER) AS brand_number, regexp_replace(p_name, '(ring|widget)$', 'thing') AS thing, upper(trim(p_type)) AS type, concat(p_brand, ' ', p_type) AS label, CAST(length(p_name) AS INTEGER) AS name_length FROM part")
def regex_extract_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)$", 1).cast("int").alias("brand_number"), F.regexp_replace("p_name", "(ring|widget)$", "thing").alias("thing"), F.upper(F.trim("p_type")).alias("type"), F.concat("p_brand", F.lit(" "), "p_type").alias("label"), F.length("p_name").alias("name_length"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_seconds, date_trunc('minute', ts) AS minute, date_trunc('second', ts) AS back FROM events")
def epoch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", ts.cast("long").alias("epoch_seconds"), F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute"), F.timestamp_seconds(ts.cast("long")).cast("timestamp_ntz").alias("back"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS in_three_months, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate + INTERVAL 365 DAY AS DATE) AS in_365_days FROM orders")
def date_diff_add_months(spark: SparkSession, d: str) -> DataFrame:
    o = day("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.datediff(o, F.lit("1995-01-01").cast("date")).alias("days"), F.add_months(o, 3).alias("in_three_months"), F.trunc(o, "month").alias("month_start"), F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("in_365_days"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < 10 THEN 'SMALL' END, CASE WHEN l_discount > 0.05 THEN 'DISCOUNTED' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END], lambda x: x IS NOT NULL), ',') AS reasons, CAST(len(list_filter([l_quantity < 10, l_discount > 0.05, l_returnflag = 'R'], lambda x: x)) AS INTEGER) AS reason_count FROM lineitem")
def array_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    found = F.filter(F.array(F.when(c("l_quantity") < 10, "SMALL"), F.when(c("l_discount") > 0.05, "DISCOUNTED"), F.when(c("l_returnflag") == "R", "RETURNED")), lambda x: x.isNotNull())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", found).alias("reasons"), F.size(found).alias("reason_count"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def explode_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
