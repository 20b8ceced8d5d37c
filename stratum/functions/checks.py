"""Validation suites: all checks on a table in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "category string, rule string, expected string, actual string, passed boolean, severity string"


class ValidationError(AssertionError):
    """At least one check of severity ERROR failed."""


@dataclass
class CheckSuite:
    """Results of checks, gathered over several tables."""

    results: list[tuple[str, str, str, str, bool, str]] = field(default_factory=list)

    def add(self, category: str, rule: str, expected: object, actual: object, *, passed: bool | None = None, severity: str = "ERROR") -> None:
        ok = expected == actual if passed is None else passed
        self.results.append((category, rule, str(expected), str(actual), bool(ok), severity))

    def measure(self, df: DataFrame, category: str, checks: dict[str, tuple[Column, object]], *, severity: str = "ERROR") -> None:
        """Evaluate aggregate expressions against expected values in one pass."""
        row = df.agg(*[c.alias(f"c{i}") for i, (c, _) in enumerate(checks.values())]).first()
        for i, (rule, (_, expected)) in enumerate(checks.items()):
            self.add(category, rule, expected, row[i], severity=severity)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.results, SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        return self.to_df(spark).groupBy("category").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))

    def raise_on_error(self) -> None:
        bad = [f"{c}/{r}: expected {e}, got {a}" for c, r, e, a, ok, s in self.results if not ok and s == "ERROR"]
        if bad:
            raise ValidationError("; ".join(bad))


def key_metrics(df: DataFrame, key: str) -> DataFrame:
    """row_count, distinct_key_count and null_key_count of a key."""
    return df.agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("distinct_key_count"), F.count_if(F.col(key).isNull()).alias("null_key_count"))


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def reconcile(left: DataFrame, right: DataFrame, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """(measure, left_value, right_value, difference): a pass over each side."""
    def side(df: DataFrame, at: int, name: str) -> DataFrame:
        sums = df.agg(*[F.expr(x[at]).cast("decimal(38,4)").alias(m) for m, x in measures.items()])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias(name)) for m in measures])).alias("r")).select("r.*")

    both = side(left, 0, "left_value").join(side(right, 1, "right_value"), "measure")
    return both.withColumn("difference", F.coalesce("left_value", F.lit(0)) - F.coalesce("right_value", F.lit(0)))


def orphans(child: DataFrame, parent: DataFrame, *, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set, not blank and without a parent."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.filter(F.col(child_key).isNotNull() & (F.trim(F.col(child_key).cast("string")) != "")).join(keys, F.col(child_key) == F.col("_p"), "left_anti")


def replay_is_idempotent(before: tuple[int, int], after: tuple[int, int]) -> bool:
    """Whether a second run left row count and fingerprint as they were."""
    return before == after


def calendar_gaps(dates: DataFrame, column: str) -> DataFrame:
    """One row: first and last day, days there are and days there should be."""
    d = F.col(column)
    return dates.agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.countDistinct(d).alias("days"), (F.datediff(F.max(d), F.min(d)) + 1).alias("expected_days"))
