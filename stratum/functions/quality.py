"""Row rules with reasons, expectations, and the summaries over them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scalar import blank

if TYPE_CHECKING:
    from stratum.operators.table import VersionedTable

VALID, REJECTED = "VALID", "REJECTED"
#: Columns of a retail source row, which also identify duplicates.
RETAIL_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
METADATA = ["_quality_reasons", "_quality_rule_count", "_quality_status"]


def assert_required_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")


@dataclass(frozen=True)
class Rule:
    """A reason and the condition under which a row fails for it."""

    reason: str
    fails: Column


def retail_rules() -> list[Rule]:
    """The rules in force for retail rows, in the order of their reasons."""
    not_positive = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    cancelled = F.upper(F.trim(F.col("InvoiceNo").cast("string"))).startswith("C")
    return [
        Rule("MISSING_INVOICE_NO", blank(F.col("InvoiceNo"))),
        Rule("MISSING_STOCK_CODE", blank(F.col("StockCode"))),
        Rule("MISSING_DESCRIPTION", blank(F.col("Description"))),
        Rule("NON_POSITIVE_QUANTITY", not_positive("Quantity")),
        Rule("MISSING_INVOICE_DATE", F.col("InvoiceDate").isNull()),
        Rule("NON_POSITIVE_UNIT_PRICE", not_positive("UnitPrice")),
        Rule("MISSING_CUSTOMER_ID", blank(F.col("CustomerID"))),
        Rule("MISSING_COUNTRY", blank(F.col("Country"))),
        Rule("CANCELLED_INVOICE", cancelled),
        Rule("DUPLICATE_BUSINESS_ROW", F.col("_duplicate_rank") > 1),
    ]


def with_duplicate_rank(df: DataFrame, business: list[str], order: list[str]) -> DataFrame:
    """``_duplicate_rank`` among rows equal in the business columns.

    Without a row identifier the survivor is one of several equal rows.
    """
    by = [F.col(c).asc_nulls_last() for c in order if c in df.columns] or [F.xxhash64(*[F.col(c) for c in business])]
    return df.withColumn("_duplicate_rank", F.row_number().over(Window.partitionBy(*business).orderBy(*by)))


def apply_rules(df: DataFrame, rules: list[Rule], *, contract_version: str) -> DataFrame:
    """``df`` with reasons, their count, status, contract version and check time."""
    reasons = F.filter(F.array(*[F.when(r.fails, r.reason) for r in rules]), lambda x: x.isNotNull())
    tagged = df.withColumn("_quality_reasons", reasons)
    return tagged.withColumns(
        {
            "_quality_rule_count": F.size("_quality_reasons"),
            "_quality_status": F.when(F.size("_quality_reasons") == 0, VALID).otherwise(REJECTED),
            "_quality_contract_version": F.lit(contract_version),
            "_quality_checked_at": F.current_timestamp(),
        }
    )


def apply_quality_rules(df: DataFrame, *, contract_version: str = "v1", business: list[str] | None = None) -> DataFrame:
    """The retail rules, with duplicates ranked by source row number."""
    business = business or RETAIL_COLUMNS
    assert_required_columns(df, business)
    ranked = with_duplicate_rank(df, business, ["_source_row_number", "_bronze_record_id", "_record_hash"])
    return apply_rules(ranked, retail_rules(), contract_version=contract_version)


def split_valid_and_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    assert_required_columns(df, METADATA)
    return df.filter(F.col("_quality_status") == VALID), df.filter(F.col("_quality_status") == REJECTED)


def rule_failure_summary(df: DataFrame) -> DataFrame:
    """Rows that failed each rule, most first."""
    return df.select(F.explode("_quality_reasons").alias("quality_rule")).groupBy("quality_rule").agg(F.count("*").alias("failed_rows")).orderBy(F.desc("failed_rows"), "quality_rule")


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: input, valid and rejected rows, and three reasons' counts."""
    has = lambda reason: F.count_if(F.array_contains("_quality_reasons", reason))
    return df.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.col("_quality_status") == VALID).alias("valid_rows"),
        F.count_if(F.col("_quality_status") == REJECTED).alias("rejected_rows"),
        has("CANCELLED_INVOICE").alias("cancelled_rows"),
        has("MISSING_CUSTOMER_ID").alias("missing_customer_rows"),
        has("DUPLICATE_BUSINESS_ROW").alias("duplicate_rows"),
    )


def store_quarantine(table: VersionedTable, rejected: DataFrame, *, record_id: str = "_bronze_record_id") -> dict[str, int]:
    """Upsert rejected rows by their id, so that storing them again adds none; the commit's counts.

    Columns other than the store's raise before anything is written.
    """
    rows = quarantine_rows(rejected, record_id=record_id).withColumn("_quarantined_at", F.current_timestamp())
    if not table.exists():
        return table.overwrite(rows, operation="MERGE").metrics
    if odd := sorted(set(rows.columns) ^ set(table.schema().names)):
        raise ValueError(f"columns differ from the store's: {odd}")
    return table.merge(rows, keys=["_quarantine_record_id"]).metrics


def quarantine_rows(rejected: DataFrame, *, record_id: str = "_bronze_record_id") -> DataFrame:
    """Rejected rows under an id of record and contract: storing them again adds none."""
    return rejected.withColumn("_quarantine_record_id", F.sha2(F.concat_ws("||", F.col(record_id).cast("string"), "_quality_contract_version"), 256))


# -- expectations ------------------------------------------------------------

#: Expectations on bike feeds, by what their failure does.
STATUS_MONITOR = {"status_last_reported_present": "last_reported IS NOT NULL", "status_renting_flag_present": "is_renting IS NOT NULL", "status_returning_flag_present": "is_returning IS NOT NULL"}
STATUS_DROP = {"status_station_id_present": "station_id IS NOT NULL", "status_bikes_non_negative": "num_bikes_available IS NULL OR num_bikes_available >= 0", "status_docks_non_negative": "num_docks_available IS NULL OR num_docks_available >= 0"}
STATUS_FAIL = {"status_station_id_required_strict": "station_id IS NOT NULL"}
INFORMATION_MONITOR = {"information_name_present": "station_name IS NOT NULL", "information_capacity_present": "capacity IS NOT NULL"}
INFORMATION_DROP = {
    "information_station_id_present": "station_id IS NOT NULL",
    "information_latitude_valid": "latitude IS NULL OR (latitude >= -90 AND latitude <= 90)",
    "information_longitude_valid": "longitude IS NULL OR (longitude >= -180 AND longitude <= 180)",
    "information_capacity_non_negative": "capacity IS NULL OR capacity >= 0",
}


def validate_expectations(rules: dict[str, str]) -> dict[str, str]:
    if not rules:
        raise ValueError("no expectations")
    for name, predicate in rules.items():
        if not isinstance(name, str) or not name.strip() or not isinstance(predicate, str) or not predicate.strip():
            raise ValueError(f"blank name or predicate: {name!r}")
    return rules


def holds(predicate: str) -> Column:
    """Whether an expectation is met; a null outcome is a failure."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def expectation_metrics(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(expectation, passed, failed) of all rules in one pass."""
    validate_expectations(rules)
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(holds(p)).alias(f"_p{i}") for i, p in enumerate(rules.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("expectation"), F.col(f"_p{i}").alias("passed"), (F.col("_n") - F.col(f"_p{i}")).alias("failed")) for i, n in enumerate(rules)]))
    return counts.select(pairs.alias("m")).select("m.*")


def expect_all(df: DataFrame, rules: dict[str, str], observation: object | None = None) -> DataFrame:
    """All rows; failures are counted in ``observation`` as the rows pass by."""
    validate_expectations(rules)
    return df if observation is None else df.observe(observation, *[F.count_if(~holds(p)).alias(n) for n, p in rules.items()])


def expect_all_or_drop(df: DataFrame, rules: dict[str, str], observation: object | None = None) -> DataFrame:
    """The rows that meet every expectation."""
    out = expect_all(df, rules, observation)
    for p in rules.values():
        out = out.filter(holds(p))
    return out


def expect_all_or_fail(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """All rows; reading one that fails an expectation raises."""
    validate_expectations(rules)
    ok = F.lit(True)
    for n, p in rules.items():
        ok = ok & F.when(holds(p), True).otherwise(F.raise_error(F.lit(f"expectation failed: {n}")).cast("boolean"))
    return df.filter(ok)
