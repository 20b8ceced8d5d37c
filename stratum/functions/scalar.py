"""Column expressions that several layers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_ratio(top: Column, bottom: Column, *, default: float | None = None) -> Column:
    """top / bottom; ``default`` (null by default) where bottom is 0 or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default).cast("double"))


def round_scaled(value: Column, digits: int) -> Column:
    """A double rounded as DuckDB's ``round`` does: times 10**digits, half away from zero, divided again.

    Spark's ``round`` takes the shortest decimal text instead: 4.145 gives 4.15
    there and 4.14 here, as 4.145 * 100 is 414.49999999999994.
    """
    scaled = value * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**digits)).otherwise(value)


def bands(value: Column, limits: list[tuple[float, str]], top: str, *, null: str | None = None) -> Column:
    """The label of the first half-open band ``value < limit``; ``top`` above all."""
    out = F.when(value.isNull(), F.lit(null)) if null is not None else None
    for limit, label in limits:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.otherwise(top)


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.pmod(F.dayofweek(day) + 5, F.lit(7)) + 1


def blank(col: Column) -> Column:
    """Null or only spaces; tabs are not blank, as for ``trim``."""
    return col.isNull() | (F.length(F.trim(col.cast("string"))) == 0)


def normal_id(col: Column, kind: str) -> Column:
    """An identifier as text: NaN and blank give null, 12.0 gives 12, blanks go."""
    if kind in ("double", "float"):
        whole = F.when(col == F.floor(col), F.format_string("%.0f", col.cast("double"))).otherwise(col.cast("string"))
        return F.when(col.isNull() | F.isnan(col), F.lit(None)).otherwise(whole)
    text = F.trim(col.cast("string"))
    return F.when(F.length(text) > 0, text)


def from_epoch_micros(col: Column) -> Column:
    """Timestamp of whole seconds; the rest is cut off."""
    return F.timestamp_seconds(F.floor(col / F.lit(1_000_000)))


def record_hash(*cols: Column, delimiter: str = "||", null: str = "<NULL>") -> Column:
    """SHA-256 of the columns as text, nulls as a sentinel.

    A text equal to the sentinel cannot be told from null: kept for parity.
    """
    return F.sha2(F.concat_ws(delimiter, *[F.coalesce(c.cast("string"), F.lit(null)) for c in cols]), 256)


def fingerprint(df: DataFrame) -> Column:
    """Order-independent digest of a table's rows; for one aggregate."""
    return F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null counts of all columns in one pass."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns or df.columns])


def with_distinct_counts(rows: DataFrame, df: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """``rows`` (one for each group of ``keys``) with distinct counts of ``df``'s columns.

    Several of them in one aggregate copy every row once for each; an aggregate
    of its own reads two columns and reduces them before the shuffle. ``df`` is
    read once for each count, so it should be a stored table.
    """
    for name, column in counts.items():
        per = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.countDistinct(column).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        rows = rows.join(per, same, "left").drop(*[f"_key_{k}" for k in keys])
    return rows
