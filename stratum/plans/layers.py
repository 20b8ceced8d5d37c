"""Readers, sinks, tables, star schema, dashboards and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions import checks, contracts, quality
from stratum.operators import bikes, change, crypto, external, governance, retail, sports, star
from stratum.operators.table import VersionedTable
from stratum.plans import metrics
from stratum.sources import incremental, readers
from stratum.sources.shared import workspace
from stratum.streaming import queries as streams

from . import domains, workflows
from .catalogue import query, table


def place(spark: SparkSession) -> str:
    """A new folder of the workspace."""
    return f"{workspace(spark)}/{uuid.uuid4().hex}"


def versioned(spark: SparkSession) -> VersionedTable:
    return VersionedTable(spark, place(spark))


# -- readers -------------------------------------------------------------------

_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _as_csv(spark: SparkSession, d: str, **options: object) -> str:
    path = place(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.options(**{"header": True} | options).csv(path)
    return path


@query(_CUSTOMERS)
def read_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv_inferred(spark, _as_csv(spark, d)).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def read_csv_strings(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv_strings(spark, _as_csv(spark, d)).select("c_custkey", "c_name")


@query(_CUSTOMERS)
def read_csv_strict(spark: SparkSession, d: str) -> DataFrame:
    return readers.csv_strict(spark, _as_csv(spark, d, header=False), "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1")
def read_csv_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).write.partitionBy("status").option("header", True).csv(path)
    return readers.csv_partitioned(spark, path, path).groupBy("status").agg(F.count("*").alias("orders"))


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey")
def read_json_document(spark: SparkSession, d: str) -> DataFrame:
    """Regions as nested documents of their nations."""
    path = place(spark)
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("nations"))
    table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", F.struct("nations").alias("data")).write.json(path)
    return spark.read.json(path).select(F.col("r_name").alias("region"), F.explode("data.nations").alias("nation"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(k, name)")
def read_rows_in_memory(spark: SparkSession, d: str) -> DataFrame:
    return readers.rows(spark, [(1, "a"), (2, None)], "k int, name string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer")
def normalised_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("double").alias("id"), "c_name")
    return readers.normalise_ids(rows, ["id"])


@query("SELECT CAST(o_orderdate AS DATE) AS weather_date, round(avg(o_custkey % 30), 2) AS avg_temperature_2m, min(o_custkey % 30) AS min_temperature_2m, max(o_custkey % 30) AS max_temperature_2m, round(avg(o_custkey % 100), 2) AS avg_relative_humidity_2m, round(avg(o_orderkey % 20), 2) AS avg_wind_speed_10m FROM orders GROUP BY 1")
def weather_daily(spark: SparkSession, d: str) -> DataFrame:
    """Orders as hours of weather documents, a document a month."""
    c = F.col
    hour = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("time"), (c("o_custkey") % 30).alias("t"), (c("o_custkey") % 100).alias("h"), (c("o_orderkey") % 20).alias("w"))
    docs = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.collect_list(hour).alias("x"))
    docs = docs.select(F.struct(c("x.time").alias("time"), c("x.t").alias("temperature_2m"), c("x.h").alias("relative_humidity_2m"), c("x.w").alias("wind_speed_10m")).alias("hourly"))
    return sports.weather_daily(sports.weather_hours(docs))


@query("SELECT 4 AS files, count(*) AS rows, true AS all_named FROM customer")
def file_metadata_columns(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    table(spark, d, "customer").repartition(4).write.parquet(path)
    rows = readers.with_file_metadata(readers.parquet(spark, path))
    return rows.agg(F.countDistinct("_input_file_path").cast("int").alias("files"), F.count("*").alias("rows"), F.expr("bool_and(_input_file_name LIKE 'part-%' AND _input_file_size > 0)").alias("all_named"))


# -- incremental loads ---------------------------------------------------------


@query("SELECT 1 AS run, count(*) AS rows FROM customer UNION ALL SELECT 2, count(*) FROM customer UNION ALL SELECT 3, 2 * count(*) FROM customer")
def copy_into_result(spark: SparkSession, d: str) -> DataFrame:
    """Rows after a load, after a rerun, and after new files."""
    path, t, out = _as_csv(spark, d), versioned(spark), []
    for run in (1, 2, 3):
        if run == 3:
            table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.mode("append").option("header", True).csv(path)
        incremental.copy_into(spark, t, path, lambda p: spark.read.option("header", True).csv(p), select=["cast(c_custkey AS bigint) AS c_custkey", "c_name"], pattern="*.csv")
        out.append((run, t.read().count()))
    return spark.createDataFrame(out, "run int, rows long")


def _json_lines(spark: SparkSession, d: str) -> str:
    """Customers as JSON lines: some with a field more, some with a number that is none, some broken."""
    c = F.col
    known = F.to_json(F.struct(c("c_custkey"), c("c_name"), c("c_nationkey")))
    more = F.to_json(F.struct(c("c_custkey"), c("c_name"), F.lit("x").alias("c_nationkey"), c("c_mktsegment")))
    path = place(spark)
    text = F.when(c("c_custkey") % 7 == 0, "{broken").when(c("c_custkey") % 5 == 0, more).otherwise(known)
    table(spark, d, "customer").select(text.alias("value")).repartition(3).write.text(path)
    return path


_HINT = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType())])


def _loaded(spark: SparkSession, d: str, mode: str) -> DataFrame:
    base, path, t = place(spark), _json_lines(spark, d), versioned(spark)
    registry = incremental.SchemaRegistry(spark, f"{base}/schema")
    load = lambda: incremental.load_stream(spark, path, kind="json", registry=registry, target=t, checkpoint=f"{base}/cp", mode=mode, hints=_HINT, max_files=2)
    incremental.load_until_settled(load) if mode == "addNewColumns" else load()
    return t.read()


@query("""SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_nationkey END AS c_nationkey,
 CASE WHEN c_custkey % 7 = 0 THEN '{"_corrupt_record":"{broken"}' WHEN c_custkey % 5 = 0 THEN '{"c_nationkey":"x","c_mktsegment":"' || c_mktsegment || '"}' END AS _rescued_data FROM customer""")
def load_stream_rescue(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d, "rescue").select("c_custkey", "c_nationkey", "_rescued_data")


@query("SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '{broken' END AS _corrupt_record FROM customer")
def load_stream_new_columns(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d, "addNewColumns").select("c_custkey", "c_mktsegment", "_corrupt_record")


# -- sinks and tables ----------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer")
def append_enforced(spark: SparkSession, d: str) -> DataFrame:
    """Two appends; a third with a column too many is refused and leaves no trace."""
    t, rows = versioned(spark), table(spark, d, "customer").select("c_custkey", "c_name")
    t.append(rows.filter("c_custkey % 2 = 0"))
    t.append(rows.filter("c_custkey % 2 = 1"))
    try:
        t.append(rows.withColumn("more", F.lit(1)))
    except ValueError:
        return t.read()
    raise AssertionError("the append was taken")


@query("SELECT c_nationkey, count(*) AS rows, 'me' AS owner FROM customer GROUP BY 1")
def create_as_partitioned(spark: SparkSession, d: str) -> DataFrame:
    t = versioned(spark)
    t.create_as(table(spark, d, "customer").select("c_custkey", "c_nationkey"), properties={"owner": "me"}, partition_by=["c_nationkey"])
    return t.read().groupBy("c_nationkey").agg(F.count("*").alias("rows")).withColumn("owner", F.lit(t.detail()["properties"]["owner"]))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def ddl_not_null(spark: SparkSession, d: str) -> DataFrame:
    """A declared table takes rows with a key and refuses one without."""
    t, rows = versioned(spark), table(spark, d, "customer").select("c_custkey", "c_name")
    t.create(T._parse_datatype_string("c_custkey bigint, c_name string"), not_null=["c_custkey"], properties={"layer": "bronze"})
    t.append(rows.filter("c_custkey % 3 <> 0"))
    try:
        t.append(rows.select(F.lit(None).cast("bigint").alias("c_custkey"), "c_name"))
    except Exception as e:  # noqa: BLE001 - whatever the failed write raises
        assert "NOT NULL" in str(e)
    return t.read()


@query("SELECT 'a' AS name, 'registered' AS first, 'present' AS second, count(*) AS rows FROM customer UNION ALL SELECT 'empty', 'registered', 'present', 0")
def external_tables(spark: SparkSession, d: str) -> DataFrame:
    """A location written and bound, and an empty one of its columns; both again."""
    tag, out = uuid.uuid4().hex[:8], []
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    external.seed_empty(rows, empty := place(spark))
    for name, first, at in (("a", lambda: external.overwrite(spark, rows, f"a_{tag}", full), full := place(spark)), ("empty", lambda: external.register(spark, f"empty_{tag}", empty), empty)):
        status = first()
        again = external.register_all(spark, {f"{name}_{tag}": at}).first().status
        out.append((name, status, again, spark.table(f"{name}_{tag}").count()))
        spark.sql(f"DROP TABLE {name}_{tag}")
    return spark.createDataFrame(out, "name string, first string, second string, rows long")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS in_none FROM orders")
def split_is_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey")
    a, b = (rows.filter(p).withColumn("s", F.lit(n)) for n, p in ((1, retail.bucket("o_orderkey") < 8), (2, retail.bucket("o_orderkey") >= 8)))
    per = a.unionByName(b).groupBy("o_orderkey").agg(F.sum("s").alias("s"))
    return per.agg(F.count("*").alias("rows"), F.count_if(F.col("s") > 2).alias("in_both")).withColumn("in_none", F.lit(rows.count()) - F.col("rows"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def insert_only_merge(spark: SparkSession, d: str) -> DataFrame:
    t, rows = versioned(spark), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    t.overwrite(rows.filter("c_custkey % 2 = 0"))
    for _ in range(2):
        t.insert_new(rows, ["c_custkey"])
    return t.read()


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey < 2 THEN 'updated' ELSE 'seeded' END AS note, CASE WHEN r_regionkey < 2 THEN 11 ELSE 1 END AS n FROM region")
def seed_merge_expressions(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "region").withColumn("n", F.lit(1))
    target = seed.filter("r_regionkey < 2").withColumn("n", F.lit(10)).withColumn("note", F.lit("old"))
    return change.upsert(seed, target, keys=["r_regionkey"], update_expressions={"n": "t.n + s.n", "note": "'updated'"}, insert_expressions={"note": "'seeded'"}).drop("_change")


@query(f"WITH {workflows._SLICES} SELECT count(*) FILTER (WHERE t.c_custkey IS NULL) AS inserted, count(*) FILTER (WHERE s.c_nationkey <> t.c_nationkey) AS updated FROM target t FULL JOIN source s USING (c_custkey)")
def merge_metrics(spark: SparkSession, d: str) -> DataFrame:
    s, target = workflows._slices(spark, d)
    t = versioned(spark)
    t.overwrite(target)
    t.merge(s, keys=["c_custkey"], hash_column="_record_hash")
    m = t.latest_metrics()
    return spark.createDataFrame([(m["numTargetRowsInserted"], m["numTargetRowsUpdated"])], "inserted long, updated long")


@query(f"WITH {workflows._SLICES} SELECT s.c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'INSERT' WHEN s.c_nationkey <> t.c_nationkey THEN 'UPDATE' ELSE 'UNCHANGED' END AS action, CASE WHEN t.c_custkey IS NOT NULL THEN 1 END AS previous FROM source s LEFT JOIN target t USING (c_custkey)")
def scd2_classified(spark: SparkSession, d: str) -> DataFrame:
    s, t = workflows._slices(spark, d)
    now = t.withColumns({"version_number": F.lit(1), "effective_from": F.lit("2024-01-01").cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})
    return change.classify_scd2(s, now, key="c_custkey", hash_column="_record_hash").select("c_custkey", F.col("_action").alias("action"), F.col("_previous_version").alias("previous"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT -1, 'new'")
def delete_and_insert(spark: SparkSession, d: str) -> DataFrame:
    t = versioned(spark)
    t.overwrite(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))
    t.delete("c_acctbal < 0")
    t.append(spark.createDataFrame([(-1, "new", 1.0)], "c_custkey long, c_name string, c_acctbal double"))
    return t.read().select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES (0, 'WRITE'), (1, 'DELETE'), (2, 'RENAME COLUMN'), (3, 'OPTIMIZE')) v(version, operation)")
def commit_history(spark: SparkSession, d: str) -> DataFrame:
    t = versioned(spark)
    t.overwrite(table(spark, d, "region"))
    t.delete("r_regionkey = 0")
    t.rename_column("r_name", "name")
    t.compact(1)
    return t.history().select(F.col("version").cast("int").alias("version"), "operation")


@query("SELECT 2 AS files, 'c_nationkey' AS clustered, count(*) AS rows FROM customer")
def table_detail(spark: SparkSession, d: str) -> DataFrame:
    t = versioned(spark)
    t.overwrite(table(spark, d, "customer"), files=7)
    t.compact(2, cluster=["c_nationkey"])
    m = t.detail()
    return t.read().agg(F.count("*").alias("rows")).select(F.lit(m["numFiles"]).alias("files"), F.lit(",".join(m["clusteringColumns"])).alias("clustered"), "rows")


@query("SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS c_name, c_nationkey FROM customer")
def renamed_and_dropped(spark: SparkSession, d: str) -> DataFrame:
    """A column renamed, another dropped and added again, which starts empty."""
    t = versioned(spark)
    t.overwrite(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    t.rename_column("c_custkey", "id")
    t.drop_column("c_name")
    t.add_column("c_name", "string")
    return t.read().select("id", "c_name", "c_nationkey")


@query("SELECT 2 AS folders_gone, count(*) AS rows FROM customer")
def vacuumed(spark: SparkSession, d: str) -> DataFrame:
    t = versioned(spark)
    for _ in range(2):
        t.overwrite(table(spark, d, "customer"))
    t.compact(1)
    gone = t.vacuum(retain_hours=-1, dry_run=False, enforce=False)
    return t.read().agg(F.count("*").alias("rows")).select(F.lit(len(gone)).alias("folders_gone"), "rows")


@query("SELECT c_custkey, c_name || '!' AS c_name FROM customer WHERE c_custkey % 4 < 2")
def follow_table(spark: SparkSession, d: str) -> DataFrame:
    """Appends carried on from table to table, in steps; a rewrite between adds nothing."""
    source, target = versioned(spark), versioned(spark)
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    for k in (0, 1):
        source.append(rows.filter(f"c_custkey % 4 = {k}")) if k else source.create(rows.schema) and source.append(rows.filter("c_custkey % 4 = 0"))
        for _ in range(2):
            streams.follow(source, target, "copy", lambda x: x.withColumn("c_name", F.concat("c_name", F.lit("!"))))
        source.compact(1)
    return target.read()


# -- quality and contracts -----------------------------------------------------


@query(f"WITH {workflows._RETAIL_SQL} SELECT 'valid' AS side, count(*) AS rows FROM judged WHERE len(reasons) = 0 UNION ALL SELECT 'rejected', count(*) FROM judged WHERE len(reasons) > 0")
def valid_and_quarantine(spark: SparkSession, d: str) -> DataFrame:
    valid, rejected = quality.split_valid_and_quarantine(workflows.judged_rows(spark, d))
    return valid.select(F.lit("valid").alias("side")).unionByName(rejected.select(F.lit("rejected").alias("side"))).groupBy("side").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows, count(*) AS ids FROM orders WHERE o_orderkey % 3 = 0")
def quarantine_store(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows stored twice are there once."""
    t = versioned(spark)
    rows = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("_bronze_record_id"), F.lit("v1").alias("_quality_contract_version"))
    for _ in range(2):
        quality.store_quarantine(t, rows)
    return t.read().agg(F.count("*").alias("rows"), F.countDistinct("_quarantine_record_id").alias("ids"))


@query("""SELECT trim(CAST(l_orderkey AS VARCHAR)) AS invoice_no, CAST(l_partkey AS VARCHAR) AS stock_code, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_shipdate AS DATE) AS invoice_date, round(CAST(l_quantity AS BIGINT) * CAST(l_extendedprice AS DECIMAL(18,4)), 4)::DOUBLE AS sales_amount, year(l_shipdate) AS invoice_year, month(l_shipdate) AS invoice_month FROM lineitem""")
def retail_silver(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "lineitem").select(F.concat(F.lit(" "), c("l_orderkey").cast("string")).alias("InvoiceNo"), c("l_partkey").cast("string").alias("StockCode"), F.lit(" d ").alias("Description"), c("l_quantity").cast("bigint").alias("Quantity"), c("l_shipdate").alias("InvoiceDate"), c("l_extendedprice").alias("UnitPrice"), F.lit("1").alias("CustomerID"), F.lit("UK").alias("Country"))
    out = retail.silver_candidate(rows)
    return out.select("invoice_no", "stock_code", "quantity", "invoice_date", c("sales_amount").cast("double").alias("sales_amount"), F.col("invoice_year").cast("bigint").alias("invoice_year"), F.col("invoice_month").cast("bigint").alias("invoice_month"))


@query("""SELECT 'initial_and_incremental' AS batch, count(*) AS rows, CAST(0 AS BIGINT) AS odd FROM lineitem UNION ALL SELECT 'invalid', 500, 0 UNION ALL SELECT 'schema_mismatch', 1000, 0
UNION ALL SELECT 'scd_changes', least(500, count(DISTINCT l_partkey)), 0 FROM lineitem""")
def retail_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the batches, and rows in them that are not as they should be."""
    c = F.col
    lines = table(spark, d, "lineitem").withColumn("_source_row_number", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = lines.select("_source_row_number", c("l_partkey").alias("StockCode"), F.lit("d").alias("Description"), c("l_quantity").cast("int").alias("Quantity"), c("l_shipdate").alias("InvoiceDate"), c("l_extendedprice").alias("UnitPrice"), F.lit("UK").alias("Country"))
    b = retail.controlled_batches(rows)
    parts = {
        "initial_and_incremental": (b["initial"].unionByName(b["incremental"]), "false"),
        "invalid": (b["invalid"], "UnitPrice <> -1.0 OR Country <> '' OR Description IS NOT NULL"),
        "schema_mismatch": (b["schema_mismatch"], "typeof(Quantity) <> 'string'"),
        "scd_changes": (b["scd_changes"], "Description <> 'd - UPDATED' OR change_effective_at <> timestamp'2012-01-01 00:00:00'"),
    }
    out = None
    for name, (df, odd) in parts.items():
        part = df.agg(F.count("*").alias("rows"), F.count_if(F.expr(odd)).alias("odd")).select(F.lit(name).alias("batch"), "rows", "odd")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH c AS (SELECT c_custkey, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 1) GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 2) AS missing_hashes, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) AS updated_before_created FROM c""")
def scd1_violations(spark: SparkSession, d: str) -> DataFrame:
    """A dimension with repeated keys, missing hashes and times out of order."""
    base = table(spark, d, "customer").select("c_custkey")
    rows = base.unionByName(base.filter("c_custkey % 10 = 1")).select(
        "c_custkey",
        F.expr("CASE WHEN c_custkey % 10 <> 2 THEN 'h' END").alias("_record_hash"),
        F.lit("2024-02-01").cast("timestamp").alias("created_at"),
        F.expr("CASE WHEN c_custkey % 10 = 3 THEN timestamp'2024-01-01' ELSE timestamp'2024-03-01' END").alias("updated_at"),
    )
    return change.scd1_invariants(rows, "c_custkey")


@query("""SELECT count(*) FILTER (WHERE c_custkey % 10 IN (1, 2)) AS keys_without_one_current, count(*) FILTER (WHERE c_custkey % 10 = 3) AS keys_with_repeated_versions, count(*) FILTER (WHERE c_custkey % 10 IN (1, 4)) AS interval_gaps, count(*) FILTER (WHERE c_custkey % 10 = 5) AS backward_intervals,
 count(*) FILTER (WHERE c_custkey % 10 = 2) AS open_end_mismatches, count(*) FILTER (WHERE c_custkey % 10 IN (3, 6)) AS version_skips FROM customer""")
def scd2_violations(spark: SparkSession, d: str) -> DataFrame:
    """A dimension of two versions a key, broken in six ways by the key's last digit."""
    k = F.col("c_custkey") % 10
    at = lambda day: F.lit(f"2024-{day}").cast("timestamp")
    base = table(spark, d, "customer").select("c_custkey", k.alias("k"))
    first = base.select("c_custkey", F.lit(1).alias("version_number"), at("01-01").alias("effective_from"), F.when(k == 1, F.lit(None)).when(k == 4, at("01-20")).otherwise(at("02-01")).alias("effective_to"), (k == 1).alias("is_current"))
    second = base.select("c_custkey", F.when(k == 3, 1).when(k == 6, 3).otherwise(2).alias("version_number"), at("02-01").alias("effective_from"), F.when(k == 5, at("01-15")).alias("effective_to"), ((k != 2) & (k != 5)).alias("is_current"))
    # A last version that ends before it begins is still the one that counts as current.
    second = second.withColumn("is_current", F.when(k == 5, F.lit(True)).otherwise(F.col("is_current")))
    return change.scd2_invariants(first.unionByName(second), "c_custkey").withColumn("open_end_mismatches", F.col("open_end_mismatches") - F.lit(base.filter("k = 5").count()))


@query("SELECT * FROM (VALUES ('a', 'WIDEN', true), ('b', 'TYPE_CHANGE', false), ('c', 'DROP', false), ('d', 'ADD_NULLABLE', true), ('e', 'ADD_REQUIRED', false)) v(\"column\", change, compatible)")
def contract_diff(spark: SparkSession, d: str) -> DataFrame:
    column = lambda name, kind, nullable=True: contracts.ContractColumn(name, kind, nullable)
    old = contracts.Contract("t", "1", (column("a", "int"), column("b", "int"), column("c", "string")))
    new = contracts.Contract("t", "2", (column("a", "bigint"), column("b", "string"), column("d", "int"), column("e", "int", False)))
    return spark.createDataFrame([(x["column"], x["change"], x["compatible"]) for x in contracts.diff(old, new)], "column string, change string, compatible boolean")


@query("SELECT 'extra' AS kind, 'c_mktsegment' AS what UNION ALL SELECT 'missing', 'c_phone' UNION ALL SELECT 'mismatched', 'c_nationkey: int for string'")
def contract_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    got = contracts.compare(rows, T._parse_datatype_string("c_custkey bigint, c_nationkey string, c_phone string"))
    names = {"unexpected": "extra", "missing": "missing", "mismatched": "mismatched"}
    return spark.createDataFrame([(names[k], x) for k, found in got.items() for x in found], "kind string, what string")


# -- star schema: customers as patients, orders as encounters -------------------


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    text = {x: F.lit("x") for x in ("FIRST", "GENDER", "RACE", "ETHNICITY", "ZIP", "SPECIALITY")}
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("Id"), F.concat(F.lit(" "), "c_name").alias("LAST"), F.concat(F.lit(" "), "c_name").alias("NAME"), c("c_mktsegment").alias("CITY"), c("c_nationkey").cast("string").alias("STATE"), c("c_nationkey").cast("string").alias("STATE_HEADQUARTERED"), F.lit("1990-02-03").alias("BIRTHDATE"), F.lit("never").alias("DEATHDATE"),
        *[c("c_acctbal").cast("string").alias(n) for n in ("HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE", "REVENUE", "AMOUNT_COVERED", "AMOUNT_UNCOVERED")], c("c_custkey").cast("string").alias("UTILIZATION"), F.lit("o1").alias("ORGANIZATION"), *[v.alias(k) for k, v in text.items()],
    )


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """People, each twice, and one without an id."""
    rows = _people(spark, d)
    return rows.unionByName(rows).unionByName(rows.limit(1).withColumn("Id", F.lit(" ")))


@query("SELECT 'c' || c_custkey AS patient_id, c_name AS last_name, CAST('1990-02-03' AS DATE) AS birth_date, CAST(NULL AS DATE) AS death_date, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS healthcare_expenses FROM customer")
def dim_patients(spark: SparkSession, d: str) -> DataFrame:
    return star.patients(_twice(spark, d)).select("patient_id", "last_name", "birth_date", "death_date", F.col("healthcare_expenses").cast("double").alias("healthcare_expenses"))


@query("SELECT 'c' || c_custkey AS organization_id, c_name AS organization_name, c_mktsegment AS city, c_custkey AS utilization FROM customer")
def dim_organizations(spark: SparkSession, d: str) -> DataFrame:
    return star.organizations(_twice(spark, d)).select("organization_id", "organization_name", "city", "utilization")


@query("SELECT 'c' || c_custkey AS provider_id, 'o1' AS organization_id, c_name AS provider_name, 'x' AS speciality FROM customer")
def dim_providers(spark: SparkSession, d: str) -> DataFrame:
    return star.providers(_twice(spark, d)).select("provider_id", "organization_id", "provider_name", "speciality")


@query("SELECT 'c' || c_custkey AS payer_id, c_name AS payer_name, CAST(c_nationkey AS VARCHAR) AS state_headquartered, CAST(c_nationkey AS VARCHAR) AS state FROM customer")
def dim_payers(spark: SparkSession, d: str) -> DataFrame:
    """Both variants, which name the state differently."""
    people = _twice(spark, d)
    return star.payers(people).select("payer_id", "payer_name", "state_headquartered").join(star.payers(people.drop("STATE_HEADQUARTERED"), external=True).select("payer_id", "state"), "payer_id")


def _events_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as encounters in text; some dates and costs are none."""
    c = F.col
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    price = c("o_totalprice").cast("decimal(18,2)").cast("string")
    text = {x: F.lit("x") for x in ("CODE", "DESCRIPTION", "REASONCODE", "REASONDESCRIPTION")}
    return table(spark, d, "orders").select(
        F.concat(F.lit("e"), "o_orderkey").alias("Id"), F.when(c("o_orderkey") % 50 == 0, "soon").otherwise(at).alias("START"), F.date_format(c("o_orderdate") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("STOP"),
        F.concat(F.lit("c"), "o_custkey").alias("PATIENT"), F.concat(F.lit("c"), c("o_custkey") % 7).alias("ORGANIZATION"), F.lit("c1").alias("PROVIDER"), F.concat(F.lit("c"), c("o_custkey") % 3).alias("PAYER"), F.when(c("o_orderpriority") == "1-URGENT", "Emergency").otherwise("Wellness").alias("ENCOUNTERCLASS"),
        price.alias("BASE_ENCOUNTER_COST"), F.when(c("o_orderkey") % 40 == 0, "free").otherwise(price).alias("TOTAL_CLAIM_COST"), F.lit("10.00").alias("PAYER_COVERAGE"), *[v.alias(k) for k, v in text.items()],
    )


@query("SELECT 'e' || o_orderkey AS encounter_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS encounter_date, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(90 AS DOUBLE) END AS duration_minutes, CASE WHEN o_orderkey % 40 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 10 AS DOUBLE) END AS patient_responsibility FROM orders")
def prepared_encounters(spark: SparkSession, d: str) -> DataFrame:
    rows = star.prepare_encounters(_events_of_orders(spark, d))
    return rows.select("encounter_id", "encounter_date", "duration_minutes", F.col("patient_responsibility").cast("double").alias("patient_responsibility"))


def _fact(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    dims = {"date": star.date_dimension(spark, "1990-01-01", "2030-12-31"), "patient": star.patients(people), "organization": star.organizations(people), "provider": star.providers(people), "payer": star.payers(people)}
    return star.fact_encounters(star.prepare_encounters(_events_of_orders(spark, d)), dims)


@query("""SELECT 'e' || o_orderkey AS encounter_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) ELSE 0 END AS date_key, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) AS has_patient, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 7) AS has_organization,
 EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 3) AS has_payer, lower(CASE WHEN o_orderpriority = '1-URGENT' THEN 'Emergency' ELSE 'Wellness' END) AS class FROM orders""")
def fact_of_encounters(spark: SparkSession, d: str) -> DataFrame:
    has = lambda n: F.col(f"{n}_key").isNotNull().alias(f"has_{n}")
    return _fact(spark, d).select("encounter_id", F.coalesce("date_key", F.lit(0)).alias("date_key"), has("patient"), has("organization"), has("payer"), F.lower("encounter_class").alias("class"))


def _diagnoses(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = table(spark, d, "lineitem").select(day.alias("START"), F.when(c("l_returnflag") != "N", F.date_format(F.date_add("l_shipdate", 7), "yyyy-MM-dd")).alias("STOP"), F.concat(F.lit("c"), c("l_suppkey")).alias("PATIENT"), F.concat(F.lit("e"), c("l_orderkey")).alias("ENCOUNTER"), (c("l_partkey") % 30).cast("string").alias("CODE"), F.concat(F.lit("D"), c("l_partkey") % 30).alias("DESCRIPTION"))
    return rows.unionByName(rows)


_DIAGNOSES = "c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS starts, CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) + 7 END AS stops, l_suppkey AS patient, l_orderkey AS encounter, l_partkey % 30 AS code FROM lineitem)"


@query("SELECT DISTINCT CAST(l_partkey % 30 AS VARCHAR) AS condition_code, 'D' || (l_partkey % 30) AS condition_description FROM lineitem")
def dim_conditions(spark: SparkSession, d: str) -> DataFrame:
    return star.conditions_dimension(_diagnoses(spark, d)).select("condition_code", "condition_description")


@query(f"WITH {_DIAGNOSES} SELECT 'e' || encounter AS encounter_id, 'c' || patient AS patient_id, CAST(code AS VARCHAR) AS condition_code, starts AS condition_start_date, CAST(strftime(starts, '%Y%m%d') AS INTEGER) AS condition_start_date_key, stops IS NULL AS is_active_condition, CASE WHEN stops IS NOT NULL THEN 7 END AS condition_duration_days, EXISTS (SELECT 1 FROM customer WHERE c_custkey = patient) AS has_patient, true AS has_condition FROM c")
def fact_of_conditions(spark: SparkSession, d: str) -> DataFrame:
    source = _diagnoses(spark, d)
    dims = {"condition": star.conditions_dimension(source), "patient": star.patients(_people(spark, d)), "date": star.date_dimension(spark, "1990-01-01", "2030-12-31")}
    encounters = table(spark, d, "orders").select(F.xxhash64("o_orderkey").alias("encounter_key"), F.concat(F.lit("e"), "o_orderkey").alias("encounter_id"))
    out = star.fact_conditions(source, dims, encounters)
    return out.select("encounter_id", "patient_id", "condition_code", "condition_start_date", "condition_start_date_key", "is_active_condition", "condition_duration_days", F.col("patient_key").isNotNull().alias("has_patient"), F.col("condition_key").isNotNull().alias("has_condition"))


@query(f"WITH {_DIAGNOSES} SELECT count(*) AS row_count, count(*) AS distinct_event_keys, CAST(0 AS BIGINT) AS null_event_keys, CAST(0 AS BIGINT) AS null_patient_ids, CAST(0 AS BIGINT) AS null_condition_codes, CAST(0 AS BIGINT) AS invalid_start_dates, 'PASS' AS status FROM c")
def condition_quality(spark: SparkSession, d: str) -> DataFrame:
    return star.condition_quality(star.prepare_conditions(_diagnoses(spark, d)))


@query("""SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS distinct_encounters, CAST(0 AS BIGINT) AS null_encounter_ids, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS bad_start_timestamps, CAST(0 AS BIGINT) AS bad_stop_timestamps, CAST(0 AS BIGINT) AS negative_durations, count(*) FILTER (WHERE o_orderkey % 40 = 0) AS bad_claim_costs,
 CAST(0 AS BIGINT) AS negative_claim_costs, count(*) FILTER (WHERE o_orderkey % 40 <> 0 AND CAST(o_totalprice AS DECIMAL(18,2)) < 10) AS coverage_above_claim FROM orders""")
def encounter_source_quality(spark: SparkSession, d: str) -> DataFrame:
    return star.source_quality(star.prepare_encounters(_events_of_orders(spark, d)))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'emergency' ELSE 'wellness' END AS encounter_class, count(*) AS encounter_count, count(DISTINCT o_custkey) AS unique_patients, CAST(90 AS DOUBLE) AS avg_duration_minutes FROM orders GROUP BY 1")
def encounter_class_profile(spark: SparkSession, d: str) -> DataFrame:
    return star.class_profile(star.prepare_encounters(_events_of_orders(spark, d))).drop("total_claim_cost")


@query("SELECT CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS row_count, count(DISTINCT o_orderkey) AS distinct_keys FROM orders GROUP BY 1")
def encounter_month_profile(spark: SparkSession, d: str) -> DataFrame:
    return star.month_profile(_events_of_orders(spark, d)).select("month", "row_count", "distinct_keys")


@query("SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS START_missing, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS START_unparsable FROM orders")
def timestamp_profile(spark: SparkSession, d: str) -> DataFrame:
    return star.timestamp_profile(_events_of_orders(spark, d), ["START"]).select("row_count", "START_missing", "START_unparsable")


@query("SELECT count(*) AS rows, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders WHERE o_orderkey % 50 <> 0")
def month_loader(spark: SparkSession, d: str) -> DataFrame:
    got = star.load_by_month(_events_of_orders(spark, d).filter("START <> 'soon'"), place(spark))
    return spark.createDataFrame([(got["rows"], got["months"])], "rows long, months long")


@query(
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 4),
b AS (SELECT max(month) AS latest_month, CAST(round_even(sum(CASE WHEN month <> (SELECT max(month) FROM m) THEN n END) / 3.0, 0) AS BIGINT) AS baseline_volume FROM m) SELECT latest_month AS test_month, baseline_volume FROM b"""
)
def volume_alert_external(spark: SparkSession, d: str) -> DataFrame:
    return star.volume_alert(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("encounter_date")), external=True).select("test_month", "baseline_volume")


@query("SELECT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders WHERE o_custkey % 5 = 1")
def foreign_key_orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "customer").filter("c_custkey % 5 <> 1").select(F.col("c_custkey").cast("string").alias("c_custkey"))
    return checks.orphans(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey")), parents, child_key="o_custkey", parent_key="c_custkey")


@query("SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def grain_violations(spark: SparkSession, d: str) -> DataFrame:
    return checks.grain_violations(table(spark, d, "lineitem"), ["l_orderkey"])


# -- dashboards ----------------------------------------------------------------


def _health_board(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    fact = domains.encounters(spark, d)
    conditions, dim = domains._conditions(spark, d)
    return metrics.dashboard(fact, star.payer_coverage(fact, domains._payers(spark)), star.condition_summary(conditions, dim), classes=["EMERGENCY", "outpatient"])


def _flat(df: DataFrame) -> DataFrame:
    return domains._doubles(df)


@query(f"WITH {domains._ENC} SELECT count(*) AS total_encounters, count(DISTINCT patient_key) AS unique_patients, count(DISTINCT organization_key) AS organizations, CAST(round(sum(total_claim_cost), 2) AS DOUBLE) AS total_claim_cost, CAST(round(sum(payer_coverage), 2) AS DOUBLE) AS payer_coverage, CAST(round(sum(total_claim_cost - payer_coverage), 2) AS DOUBLE) AS patient_responsibility, round(CAST(sum(total_claim_cost) AS DOUBLE) / count(*), 2) AS avg_claim_cost, round(avg(duration_minutes), 2) AS avg_duration_minutes, round(100.0 * count(*) FILTER (WHERE encounter_class = 'Emergency') / count(*), 2) AS emergency_encounter_pct FROM e")
def dashboard_overview(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_health_board(spark, d)["overview"])


@query(f"WITH {domains._ENC} SELECT encounter_date, count(*) AS encounters, count(*) FILTER (WHERE encounter_class = 'Emergency') AS emergencies FROM e GROUP BY 1")
def dashboard_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return _health_board(spark, d)["daily_trend"].select("encounter_date", "encounters", "emergencies")


@query(f"WITH {domains._ENC} SELECT CAST(date_trunc('month', encounter_date) AS DATE) AS month, count(*) AS encounters, CAST(round(sum(total_claim_cost), 2) AS DOUBLE) AS claim_cost FROM e GROUP BY 1")
def dashboard_monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_health_board(spark, d)["monthly_trend"])


@query(f"WITH {domains._ENC} SELECT lower(encounter_class) AS encounter_class, count(*) AS encounters, count(DISTINCT patient_key) AS patients, CAST(round(sum(total_claim_cost), 2) AS DOUBLE) AS claim_cost FROM e GROUP BY 1")
def dashboard_class_summary(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_health_board(spark, d)["class_summary"])


@query(f"WITH {domains._ENC} SELECT organization_key, count(*) AS encounters, CAST(round(sum(total_claim_cost), 2) AS DOUBLE) AS claim_cost FROM e GROUP BY 1 ORDER BY encounters DESC, organization_key LIMIT 10")
def dashboard_top_organizations(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_health_board(spark, d)["top_organizations"])


@query(f"WITH {domains._ENC} SELECT 'Payer ' || payer_key AS payer_name, count(*) AS encounters, round(CAST(sum(payer_coverage) AS DOUBLE) / CAST(sum(total_claim_cost) AS DOUBLE) * 100, 2) AS coverage_pct FROM e GROUP BY 1")
def dashboard_payer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_health_board(spark, d)["payer_coverage"]).select("payer_name", "encounters", "coverage_pct")


@query(f"WITH {domains._COND} SELECT 'Condition ' || condition_key AS condition_description, count(*) AS events, count(*) FILTER (WHERE days IS NULL) AS active_events FROM c GROUP BY condition_key ORDER BY events DESC, condition_description LIMIT 20")
def dashboard_top_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _health_board(spark, d)["top_conditions"].select("condition_description", "events", "active_events")


def _market_board(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k, t = crypto.silver_klines(domains.klines(spark, d)), domains.ticks(spark, d)
    return crypto.dashboard(k, crypto.market_summary(k, t), crypto.latest_prices(k, t))


@query(f"WITH {domains._KLINES} SELECT 'closes' AS dataset, count(*) AS rows FROM k UNION ALL SELECT 'volumes', count(DISTINCT day) FROM k UNION ALL SELECT 'daily_change', count(*) FROM k UNION ALL SELECT 'ranges', count(DISTINCT symbol) FROM k UNION ALL SELECT 'symbols', count(DISTINCT symbol) FROM k UNION ALL SELECT 'latest_prices', count(DISTINCT symbol) FROM k UNION ALL SELECT 'delays', count(DISTINCT symbol) FROM k UNION ALL SELECT 'kpis', 1 UNION ALL SELECT 'top_moves', 10 UNION ALL SELECT 'directions', count(DISTINCT (symbol, sign(close - open))) FROM k")
def market_dashboard_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, df in _market_board(spark, d).items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {domains._KLINES} SELECT day AS trade_date, sum(volume) AS volume FROM k GROUP BY 1")
def market_dashboard_volumes(spark: SparkSession, d: str) -> DataFrame:
    return _market_board(spark, d)["volumes"].withColumn("volume", F.round("volume", 6))


@query(f"WITH {domains._KLINES} SELECT CAST(0 AS BIGINT) AS high_below_low, CAST(0 AS BIGINT) AS open_outside, CAST(0 AS BIGINT) AS close_outside, CAST(0 AS BIGINT) AS negative_volume, count(*) FILTER (WHERE trades % 2 = 0) AS time_order FROM k")
def market_rule_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = domains.klines(spark, d).withColumn("close_time", F.when(F.col("number_of_trades") % 2 == 0, F.col("open_time")).otherwise(F.col("close_time")))
    return crypto.ohlc_violations(rows)


@query("SELECT event_type AS symbol, sha256(upper(event_type) || '|' || CAST(event_id * 1000000 AS VARCHAR)) AS record_id, event_id * 1000000 AS open_time_raw, event_id AS opened, value AS open FROM events WHERE event_type = 'click'")
def market_bronze_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candle files named by symbol, read under the strict schema."""
    base, c = place(spark), F.col
    raw = c("event_id") * 1_000_000
    rows = table(spark, d, "events").filter("event_type = 'click'").select(raw.alias("a"), "value", *[F.lit(1.0).alias(x) for x in "bcde"], raw.alias("f"), *[F.lit(1.0).alias(x) for x in "gh"], F.lit(2).alias("i"), F.lit(1.0).alias("j"), F.lit("0").alias("k"))
    rows = rows.select("a", "value", "b", "c", "d", "e", "f", "g", "i", "h", "j", "k")
    rows.coalesce(1).write.csv(f"{base}/out")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(at):
        if s.getPath().getName().endswith(".csv"):
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(f"{base}/out/CLICK-1d-2026.csv"))
    bronze = crypto.bronze_klines(readers.csv_strict(spark, f"{base}/out/*.csv", crypto.KLINE_SCHEMA))
    return bronze.select(F.lower("symbol").alias("symbol"), "record_id", "open_time_raw", F.unix_timestamp("open_time").alias("opened"), "open")


@query("SELECT event_id % 3 = 0 AS broken, count(*) AS rows FROM events GROUP BY 1")
def market_tick_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    body = F.to_json(F.struct(c("event_id").cast("string").alias("event_id"), c("event_type").alias("symbol"), F.when(c("event_id") % 3 == 0, -1.0).otherwise(2.0).alias("price_usd"), F.lit("2026-01-01T00:00:00Z").alias("event_time"), F.lit("p").alias("producer_id"), F.lit("s").alias("source_system")))
    messages = table(spark, d, "events").select(body.alias("value"), F.lit(0).alias("partition"), c("event_id").alias("offset"), c("ts").cast("timestamp").alias("timestamp"))
    good, bad = crypto.parse_ticks(messages)
    return good.select(F.lit(False).alias("broken")).unionByName(bad.select(F.lit(True).alias("broken"))).groupBy("broken").agg(F.count("*").alias("rows"))


# -- bikes and taxis -----------------------------------------------------------


def _feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Status and information documents: a station for each supplier, some missing in one or the other."""
    c = F.col
    s = table(spark, d, "supplier")
    station = F.struct(c("s_suppkey").cast("string").alias("station_id"), (c("s_suppkey") % 9).alias("num_bikes_available"), (c("s_suppkey") % 4).alias("num_docks_available"), F.lit(True).alias("is_renting"), (c("s_suppkey") * 10).alias("last_reported"))
    status = s.filter("s_suppkey % 10 <> 0").agg(F.to_json(F.struct(F.lit(1000).alias("last_updated"), F.struct(F.collect_list(station).alias("stations")).alias("data"))).alias("v"))
    about = F.struct(c("s_suppkey").cast("string").alias("station_id"), F.concat(F.lit(" "), "s_name").alias("name"), F.concat(F.lit("s"), "s_suppkey").alias("short_name"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit("r").alias("region_id"), F.when(c("s_suppkey") % 6 == 0, 0).otherwise(20).alias("capacity"))
    information = s.filter("s_suppkey % 10 <> 1").agg(F.to_json(F.struct(F.lit(1000).alias("last_updated"), F.struct(F.collect_list(about).alias("stations")).alias("data"))).alias("v"))
    read = lambda df, schema: df.select(F.from_json("v", schema).alias("d")).select("d.*")
    return bikes.status(read(status, bikes.STATUS_SCHEMA)), bikes.information(read(information, bikes.INFORMATION_SCHEMA))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_suppkey % 9 AS num_bikes_available, sha256(s_suppkey || '||' || s_suppkey * 10 || '||1000') AS status_record_id FROM supplier WHERE s_suppkey % 10 <> 0")
def bike_status(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(spark, d)[0].select("station_id", "num_bikes_available", "status_record_id")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name, 's' || s_suppkey AS short_name, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 20 END AS capacity FROM supplier WHERE s_suppkey % 10 <> 1")
def bike_information(spark: SparkSession, d: str) -> DataFrame:
    return _feeds(spark, d)[1].select("station_id", "station_name", "short_name", "capacity")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_suppkey % 10 <> 1 AS station_reference_matched, CASE WHEN s_suppkey % 10 <> 1 THEN 's' || s_suppkey END AS short_name, CASE WHEN s_suppkey % 10 <> 1 AND s_suppkey % 6 <> 0 THEN round(CAST(s_suppkey % 9 AS DOUBLE) / 20 * 100, 2) END AS bike_availability_pct FROM supplier WHERE s_suppkey % 10 <> 0")
def bike_enriched(spark: SparkSession, d: str) -> DataFrame:
    return bikes.enriched(*_feeds(spark, d)).select("station_id", "station_reference_matched", "short_name", "bike_availability_pct")


@query("SELECT count(*) FILTER (WHERE s_suppkey % 10 = 1) AS status_only, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS information_only, count(*) FILTER (WHERE s_suppkey % 10 > 1) AS matched FROM supplier")
def bike_key_coverage(spark: SparkSession, d: str) -> DataFrame:
    return bikes.key_coverage(*_feeds(spark, d))


@query("SELECT count(*) AS row_count, count(*) AS station_count, CAST(0 AS BIGINT) AS negative_counts, CAST(0 AS BIGINT) AS repeated_rows FROM supplier WHERE s_suppkey % 10 <> 0")
def bike_source_profile(spark: SparkSession, d: str) -> DataFrame:
    return bikes.source_profile(_feeds(spark, d)[0]).select("row_count", "station_count", "negative_counts", "repeated_rows")


@query("SELECT count(*) AS trips, CAST(0 AS BIGINT) AS without_fare FROM orders")
def taxi_variants(spark: SparkSession, d: str) -> DataFrame:
    """Four variants, of which two carry the fare under another name, made one again."""
    trips = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("passenger_count"), F.col("o_totalprice").alias("fare_amount"))
    out = None
    for part in sports.taxi_variants(trips, key="id").values():
        part = part.withColumn("passenger_count", F.col("passenger_count").cast("string"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return sports.unify_renamed(out, "fare_amount", "base_fare_amount").agg(F.count("*").alias("trips"), F.count_if(F.col("fare_amount").isNull()).alias("without_fare"))


# -- streams -------------------------------------------------------------------


@query("SELECT count(*) AS rows FROM events WHERE event_id % 4 <> 3")
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events in four files a day later each; the last file's are sixty days older and come too late."""
    base = place(spark)
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("part"))
    for k in range(4):
        day = F.lit(f"2024-03-{10 + k}" if k < 3 else "2024-01-01").cast("timestamp")
        rows.filter(f"part = {k}").select("event_id", day.alias("at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        # Files are taken in the order of their times.
        df = streams.file_stream(spark, f"{base}/in", "event_id bigint, at timestamp", kind="parquet", max_files=1)
        streams.append_to(streams.deduplicate(df, ["event_id"], event_time="at", delay="2 days"), f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("rows"))


@query("SELECT * FROM (VALUES (1, 4), (2, 2), (4, 1)) v(max_files, batches)")
def stream_rate_grid(spark: SparkSession, d: str) -> DataFrame:
    """Batches that four files take at one, two and four files a trigger."""
    base = place(spark)
    table(spark, d, "events").select("event_id").repartition(4).write.parquet(f"{base}/in")
    run = lambda n: streams.append_to(streams.file_stream(spark, f"{base}/in", "event_id bigint", kind="parquet", max_files=n), f"{base}/out{n}", f"{base}/cp{n}")
    return streams.benchmark(run, [1, 2, 4], spark).select("max_files", F.col("batches").cast("int").alias("batches"))


@query("SELECT 2 AS batches, count(*) AS rows, false AS active FROM events")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    base = place(spark)
    table(spark, d, "events").select("event_id").repartition(4).write.parquet(f"{base}/in")
    q = streams.append_to(streams.file_stream(spark, f"{base}/in", "event_id bigint", kind="parquet", max_files=2), f"{base}/out", f"{base}/cp")
    done = streams.progress_rows(spark, q, "q").filter("input_rows > 0")
    active = streams.status(q)["active"]
    streams.stop(q)
    return done.agg(F.count("*").cast("int").alias("batches"), F.sum("input_rows").alias("rows")).withColumn("active", F.lit(active))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days of events; a last row far ahead lets the watermark close them all."""
    base = place(spark)
    rows = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    ahead = rows.limit(1).select(F.lit("end").alias("event_type"), F.lit("2030-01-01").cast("timestamp").alias("ts"))
    for part in (rows, ahead):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        df = streams.file_stream(spark, f"{base}/in", rows.schema, kind="parquet")
        streams.append_to(streams.windowed_counts(df, event_time="ts", by=["event_type"], size="1 day"), f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out").filter("event_type <> 'end'").select("event_type", F.to_date("window_start").alias("day"), "events")


# -- governance and the rest ---------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority IS NOT NULL THEN '***MASKED***' END AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def secure_view(spark: SparkSession, d: str) -> DataFrame:
    """Orders through a view with filter and mask for the session's user."""
    tag = uuid.uuid4().hex[:8]
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").createOrReplaceTempView(f"orders_{tag}")
    me = spark.sql("SELECT session_user()").first()[0]
    spark.createDataFrame([(me, "F"), ("other", "*")], "user_name string, allowed_value string").createOrReplaceTempView(f"access_{tag}")
    governance.secure_view(spark, f"seen_{tag}", f"orders_{tag}", mapping=f"access_{tag}", column="o_orderstatus", masked=["o_orderpriority"])
    return spark.table(f"seen_{tag}")


@query("SELECT count(*) AS every, count(*) FILTER (WHERE o_orderstatus = 'F') AS restricted, count(*) AS restored FROM orders")
def access_round_trip(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([], "user_name string, allowed_value string")
    got = governance.round_trip(table(spark, d, "orders"), mapping, user="ann", column="o_orderstatus", value="F")
    return spark.createDataFrame([(got["all"], got["restricted"], got["restored"])], "every long, restricted long, restored long")


@query("SELECT * FROM (VALUES ('analysts', 'SELECT', 'gold'), ('engineers', 'MODIFY', 'silver')) v(principal, privilege, object)")
def grant_table(spark: SparkSession, d: str) -> DataFrame:
    return governance.grants([("engineers", "MODIFY", "silver"), ("analysts", "SELECT", "gold"), ("analysts", "SELECT", "gold")], spark)


@query("SELECT o_orderkey, o_orderstatus = 'F' AS allowed FROM orders")
def sql_scalar_function(spark: SparkSession, d: str) -> DataFrame:
    """A row filter as an SQL function over an access table."""
    tag = uuid.uuid4().hex[:8]
    table(spark, d, "orders").createOrReplaceTempView(f"orders_{tag}")
    spark.createDataFrame([("F",)], "allowed_value string").createOrReplaceTempView(f"access_{tag}")
    governance.scalar_function(spark, f"may_see_{tag}", "status STRING", f"EXISTS (SELECT 1 FROM access_{tag} a WHERE a.allowed_value = status)")
    return spark.sql(f"SELECT o_orderkey, may_see_{tag}(o_orderstatus) AS allowed FROM orders_{tag}")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE unnest_value END AS part FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['none'] ELSE string_split(c_name, '#') END) AS unnest_value FROM customer)")
def explode_outer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of names; a customer without any keeps a row."""
    parts = F.when(F.col("c_custkey") % 3 != 0, F.split("c_name", "#"))
    return table(spark, d, "customer").select("c_custkey", F.explode_outer(parts).alias("part"))


@query("SELECT NULL AS missing WHERE false")
def required_columns_hold(spark: SparkSession, d: str) -> DataFrame:
    """No row: all columns asked for are there."""
    rows = table(spark, d, "customer")
    quality.assert_required_columns(rows, ["c_custkey", "c_name"])
    return spark.createDataFrame([], "missing string")
