import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions import checks, contracts, quality, scalar

SCHEMA = "InvoiceNo string, StockCode string, Description string, Quantity bigint, InvoiceDate timestamp, UnitPrice double, CustomerID string, Country string, _source_row_number bigint"
GOOD = ("536365", "85123A", "WHITE HOLDER", 6, dt.datetime(2010, 12, 1, 8, 26), 2.55, "17850", "United Kingdom", 1)


def judge(spark, *rows):
    return quality.apply_quality_rules(spark.createDataFrame(list(rows), SCHEMA))


def test_valid_row(spark):
    r = judge(spark, GOOD).first()
    assert (r._quality_status, r._quality_reasons, r._quality_rule_count) == ("VALID", [], 0)


def test_all_reasons_are_kept(spark):
    r = judge(spark, ("C536366", "1", " ", -1, GOOD[4], 0.0, "", "UK", 1)).first()
    assert r._quality_reasons == ["MISSING_DESCRIPTION", "NON_POSITIVE_QUANTITY", "NON_POSITIVE_UNIT_PRICE", "MISSING_CUSTOMER_ID", "CANCELLED_INVOICE"]


def test_second_equal_row_is_a_duplicate(spark):
    got = judge(spark, GOOD, (*GOOD[:-1], 2)).orderBy("_source_row_number").collect()
    assert [r._quality_reasons for r in got] == [[], ["DUPLICATE_BUSINESS_ROW"]]


def test_missing_columns_and_metadata(spark):
    df = spark.createDataFrame([GOOD], SCHEMA)
    with pytest.raises(ValueError, match="Country.*StockCode"):
        quality.apply_quality_rules(df.drop("StockCode", "Country"))
    with pytest.raises(ValueError):
        quality.split_valid_and_quarantine(df)


def test_split_summary_and_metrics(spark):
    rows = judge(spark, GOOD, (*GOOD[:-1], 2), ("C1", "1", "d", 1, GOOD[4], 1.0, None, "UK", 3))
    ok, bad = quality.split_valid_and_quarantine(rows)
    assert (ok.count(), bad.count()) == (1, 2)
    assert quality.rule_failure_summary(rows).count() == 3
    m = quality.quality_metrics(rows).first()
    assert (m.input_rows, m.valid_rows, m.rejected_rows, m.cancelled_rows, m.missing_customer_rows, m.duplicate_rows) == (3, 1, 2, 1, 1, 1)


def test_expectations(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), (None, None)], "id string, n int")
    rules = {"id_set": "id IS NOT NULL", "n_ok": "n >= 0"}
    got = {r.expectation: (r.passed, r.failed) for r in quality.expectation_metrics(df, rules).collect()}
    assert got == {"id_set": (2, 1), "n_ok": (1, 2)}
    assert quality.expect_all_or_drop(df, rules).count() == 1
    seen = Observation("x")
    quality.expect_all(df, rules, seen).collect()
    assert seen.get == {"id_set": 1, "n_ok": 2}
    with pytest.raises(Exception, match="expectation failed"):
        quality.expect_all_or_fail(df, rules).collect()
    for bad in ({}, {" ": "x"}, {"a": " "}):
        with pytest.raises(ValueError):
            quality.validate_expectations(bad)
    for rules in (quality.STATUS_MONITOR, quality.STATUS_DROP, quality.STATUS_FAIL, quality.INFORMATION_MONITOR, quality.INFORMATION_DROP):
        quality.validate_expectations(rules)


V1 = """
name: retail
version: 1
columns:
  - {name: InvoiceNo, type: string, nullable: false}
  - {name: Quantity, type: integer}
keys: [InvoiceNo]
"""
V2 = """
name: retail
version: 2
supersedes: 1
columns:
  - {name: InvoiceNo, type: string, nullable: false}
  - {name: Quantity, type: long}
  - {name: loyalty_tier, type: string, allowed_values: [STANDARD, SILVER, GOLD]}
rules:
  - {name: QUANTITY_NOT_ZERO, expression: Quantity <> 0}
  - {name: BIG, expression: Quantity < 100, severity: warning}
"""


def test_contract_versions_and_diff(spark):
    a, b = contracts.Contract.parse(V1, "1"), contracts.Contract.parse(V2, "2")
    assert b.supersedes == a.version
    with pytest.raises(ValueError):
        contracts.Contract.parse(V1, "2")
    assert [(d["column"], d["change"], d["compatible"]) for d in contracts.diff(a, b)] == [("Quantity", "WIDEN", True), ("loyalty_tier", "ADD_NULLABLE", True)]
    assert {d["change"] for d in contracts.diff(b, a)} == {"TYPE_CHANGE", "DROP"}
    df = spark.createDataFrame([("1", 0, "GOLD"), (None, 5, "TIN"), ("2", 500, None)], b.schema().fieldNames() and "InvoiceNo string, Quantity bigint, loyalty_tier string")
    got = quality.apply_rules(df, b.row_rules(), contract_version="2").select("_quality_reasons").collect()
    assert [r[0] for r in got] == [["QUANTITY_NOT_ZERO"], ["NULL_INVOICENO", "VALUE_LOYALTY_TIER"], []]


def test_compare_and_rescue(spark):
    schema = T._parse_datatype_string("InvoiceNo string, Quantity int, Country string")
    df = spark.createDataFrame([("1", "7", None), ("2", "bad", "q\"x")], "InvoiceNo string, Quantity string, extra string")
    assert contracts.compare(df, schema) == {"missing": ["Country"], "unexpected": ["extra"], "mismatched": ["Quantity: string for int"]}
    rows = contracts.rescue(df, schema).collect()
    assert rows[0].Quantity == 7 and rows[0]._rescued_data is None
    assert json.loads(rows[1]._rescued_data) == {"Quantity": "bad", "extra": 'q"x'} and rows[1].Quantity is None


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, 12.0, 1_700_000_000_999_999), (1.0, 4.0, float("nan"), 5)], "a double, b double, i double, us bigint")
    got = df.select(scalar.guarded_ratio(F.col("a"), F.col("b")).alias("r"), scalar.normal_id(F.col("i"), "double").alias("i"), F.unix_timestamp(scalar.from_epoch_micros(F.col("us"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [(None, "12", 1_700_000_000), (0.25, None, 0)]
    b = scalar.bands(F.col("x"), [(10, "VERY_LOW"), (30, "LOW")], "HIGH", null="UNKNOWN")
    assert [r[0] for r in spark.createDataFrame([(None,), (9.9,), (10.0,), (30.0,)], "x double").select(b).collect()] == ["UNKNOWN", "VERY_LOW", "LOW", "HIGH"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert tuple(checks.key_metrics(df, "k").first()) == (4, 2, 1)
    assert [tuple(r) for r in checks.grain_violations(df, ["k"]).collect()] == [(1, 2)]
    s = checks.CheckSuite()
    s.measure(df, "keys", {"rows": (F.count("*"), 4), "distinct": (F.countDistinct("k"), 3)})
    assert s.summary(spark).first().failed == 1
    with pytest.raises(checks.ValidationError, match="distinct"):
        s.raise_on_error()
    parent = spark.createDataFrame([(1,)], "id int")
    assert checks.orphans(df, parent, child_key="k", parent_key="id").count() == 1
    assert checks.reconcile(df, df, {"n": ("count(*)", "count(k)")}).first().difference == 1
