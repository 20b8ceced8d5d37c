"""Retail: silver candidates, product snapshots and controlled batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .change import add_record_hash, latest_by


def silver_candidate(valid: DataFrame) -> DataFrame:
    """Valid rows in silver's columns: trimmed, typed, with amount and date parts."""
    price, quantity = F.col("UnitPrice").cast("decimal(18,4)"), F.col("Quantity").cast("bigint")
    day = F.to_date("InvoiceDate")
    extra = [c for c in valid.columns if c.startswith("_") and not c.startswith("_quality") and c != "_duplicate_rank"]
    return valid.select(
        F.trim("InvoiceNo").alias("invoice_no"),
        F.upper(F.trim("StockCode")).alias("stock_code"),
        F.trim("Description").alias("description"),
        quantity.alias("quantity"),
        F.col("InvoiceDate").cast("timestamp").alias("invoice_timestamp"),
        day.alias("invoice_date"),
        price.alias("unit_price"),
        (quantity * price).cast("decimal(20,4)").alias("sales_amount"),
        F.trim(F.col("CustomerID").cast("string")).alias("customer_id"),
        F.trim("Country").alias("country"),
        F.year(day).alias("invoice_year"),
        F.month(day).alias("invoice_month"),
        *extra,
    )


def product_snapshot(silver: DataFrame) -> DataFrame:
    """The latest description and price of each product, with its record hash."""
    rows = silver.select("stock_code", "description", F.col("unit_price").alias("latest_observed_price"), "invoice_timestamp", "invoice_no")
    latest = latest_by(rows, ["stock_code"], ["invoice_timestamp", "invoice_no"])
    return add_record_hash(latest, ["description", "latest_observed_price"]).withColumn("product_sk", F.sha2(F.col("stock_code"), 256))


def bucket(column: str, ways: int = 10) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ways))


def strip_suffix(column: str, suffix: str) -> Column:
    """The column without a trailing suffix."""
    return F.regexp_replace(column, f"{suffix}$", "")


#: Rows of the batches that are samples.
EVOLVED, INVALID, MISMATCHED, PRODUCTS = 5000, 500, 1000, 500


def controlled_batches(source: DataFrame, *, number: str = "_source_row_number", effective_at: str = "2012-01-01 00:00:00") -> dict[str, DataFrame]:
    """Seven batches for exercising a pipeline.

    ``initial`` holds eight tenths by hash of the row number and ``incremental``
    the rest. Of the rest's first rows are made ``evolved`` and
    ``schema_evolution`` (two columns more), ``invalid`` (price, country and
    description broken) and ``schema_mismatch`` (a number as text).
    ``scd_changes`` renames and reprices the first products, each by its latest row.
    """
    initial, rest = source.filter(bucket(number) < 8), source.filter(bucket(number) >= 8)
    first = lambda n: rest.orderBy(number).limit(n)
    more = {"SalesChannel": F.lit("online"), "PromotionCode": F.when(bucket(number, 2) == 0, "WELCOME10")}
    evolved = first(EVOLVED).withColumns(more)
    broken = {"Description": F.lit(None).cast("string"), "UnitPrice": F.lit(-1.0), "Country": F.lit(""), "_test_scenario": F.lit("deliberate_quality_violation")}
    # The latest row of a product; of several the first by description, null last.
    late = F.struct(F.col("InvoiceDate").isNull().alias("undated"), (-F.unix_timestamp("InvoiceDate")).alias("at"), F.col("Description").isNull().alias("unnamed"), "Description", "UnitPrice")
    products = source.filter(F.col("StockCode").isNotNull()).groupBy("StockCode").agg(F.min(late).alias("p")).orderBy("StockCode").limit(PRODUCTS)
    changes = products.select(
        "StockCode",
        F.concat(F.coalesce("p.Description", F.lit("Unknown product")), F.lit(" - UPDATED")).alias("Description"),
        F.round(F.coalesce("p.UnitPrice", F.lit(0.0)) * 1.05, 2).alias("UnitPrice"),
        F.lit(effective_at).cast("timestamp").alias("change_effective_at"),
        F.lit("Lab 4 controlled product update").alias("change_reason"),
    )
    return {
        "initial": initial,
        "incremental": rest,
        "evolved": evolved,
        "invalid": first(INVALID).withColumns(broken),
        "schema_mismatch": first(MISMATCHED).withColumn("Quantity", F.col("Quantity").cast("string")),
        "schema_evolution": evolved,
        "scd_changes": changes,
    }


def row_range(df: DataFrame, order: list[str], low: int, high: int) -> DataFrame:
    """Rows of global rank ``low`` to ``high`` in an order.

    A global rank needs one sort of all rows; the limit keeps what is ranked in
    one task to ``high`` rows.
    """
    top = df.orderBy(*order).limit(high)
    return top.withColumn("row_number", F.row_number().over(Window.orderBy(*order))).filter(F.col("row_number").between(low, high))
