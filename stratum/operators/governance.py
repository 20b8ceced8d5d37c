"""Row filters and column masks as secure views; grants as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.session import quote_ident, quote_lit

MASK = "***MASKED***"


def filter_rows(df: DataFrame, mapping: DataFrame, *, user: str, column: str, user_column: str = "user_name", value_column: str = "allowed_value") -> DataFrame:
    """Rows whose ``column`` the user may see; ``'*'`` in the mapping allows all.

    The mapping of one user is asked for ``'*'`` first, so the common cases are
    a plain scan or a semi join, never a join on a disjunction.
    """
    mine = mapping.filter(F.col(user_column) == user).select(F.col(value_column).cast("string").alias("_v")).distinct()
    if mine.filter("_v = '*'").limit(1).count():
        return df
    return df.join(mine, F.col(column).cast("string") == F.col("_v"), "left_semi")


def mask_columns(df: DataFrame, columns: list[str], *, privileged: bool, mask: str = MASK) -> DataFrame:
    """Values for the privileged; otherwise a mask, with null left null."""
    if privileged:
        return df
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mask)) for c in columns})


def secure_view(spark: SparkSession, name: str, table: str, *, mapping: str | None = None, column: str | None = None, masked: list[str] | None = None, privileged: list[str] | None = None) -> None:
    """A temporary view that applies filter and masks for the session's user.

    The filter is IN, an existence join on equality; whether the user may see all
    is a scalar asked once, so there is no join on a disjunction.
    """
    allowed = "false" if not privileged else f"session_user() IN ({', '.join(map(quote_lit, privileged))})"
    cols = [f"CASE WHEN t.{quote_ident(c)} IS NULL THEN NULL WHEN {allowed} THEN CAST(t.{quote_ident(c)} AS STRING) ELSE {quote_lit(MASK)} END AS {quote_ident(c)}" if c in (masked or []) else f"t.{quote_ident(c)}" for c in spark.table(table).columns]
    where = ""
    if mapping and column:
        mine = f"SELECT CAST(m.allowed_value AS STRING) FROM {quote_ident(mapping)} m WHERE m.user_name = session_user()"
        every = f"(SELECT count(*) FROM {quote_ident(mapping)} m WHERE m.user_name = session_user() AND m.allowed_value = '*') > 0"
        where = f" WHERE {every} OR CAST(t.{quote_ident(column)} AS STRING) IN ({mine})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quote_ident(name)} AS SELECT {', '.join(cols)} FROM {quote_ident(table)} t{where}")


def scalar_function(spark: SparkSession, name: str, parameters: str, body: str) -> None:
    """A temporary SQL function, ``CREATE FUNCTION name (parameters) RETURN body``, inlined where it is used."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quote_ident(name)} ({parameters}) RETURN {body}")


def round_trip(df: DataFrame, mapping: DataFrame, *, user: str, column: str, value: str) -> dict[str, int]:
    """Counts that show a filter at work: all rows, one value's, and those seen under it."""
    spark = df.sparkSession
    one = spark.createDataFrame([(user, value)], "user_name string, allowed_value string")
    every = spark.createDataFrame([(user, "*")], "user_name string, allowed_value string")
    return {"all": df.count(), "of_value": df.filter(F.col(column).cast("string") == value).count(), "restricted": filter_rows(df, one, user=user, column=column).count(), "restored": filter_rows(df, every, user=user, column=column).count()}


def grants(rows: list[tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    """(principal, privilege, object), each once."""
    return spark.createDataFrame(sorted(set(rows)), "principal string, privilege string, object string")
