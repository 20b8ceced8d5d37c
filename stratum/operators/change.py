"""Change detection, upserts and slowly changing dimensions.

All functions are DataFrame to DataFrame. A join of target and source decides
each row's fate once; the result is the whole new target, which
:class:`stratum.operators.table.VersionedTable` commits in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratum.functions.scalar import record_hash

INSERT, UPDATE, UNCHANGED = "INSERT", "UPDATE", "UNCHANGED"


class MergeError(ValueError):
    """A merge that would be ambiguous or lose its keys."""


def _need(df: DataFrame, *names: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")


def add_record_hash(df: DataFrame, tracked: list[str], *, output_column: str = "_record_hash") -> DataFrame:
    """``df`` with the hash of the tracked columns, in the order given."""
    if not tracked:
        raise ValueError("no columns to track")
    _need(df, *tracked)
    return df.withColumn(output_column, record_hash(*[F.col(c) for c in tracked]))


def deduplicate_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; nulls in ``order`` come first in time."""
    if not keys or not order:
        raise ValueError("keys and order must not be empty")
    _need(df, *keys, *order)
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As :func:`deduplicate_latest`, by one aggregate with partial aggregation.

    Rows of a hot key are reduced before the shuffle. Ties on ``order`` are
    broken by the remaining columns, so the survivor is determined.
    """
    _need(df, *keys, *order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_best.{k}").alias(k) for k in df.columns])


def classify(source: DataFrame, target: DataFrame, *, keys: list[str], hash_column: str) -> DataFrame:
    """``source`` with ``_action``: INSERT, UPDATE or UNCHANGED against ``target``.

    Keys join by plain equality, so a row with a null key is an INSERT.
    """
    _need(source, *keys, hash_column)
    _need(target, *keys, hash_column)
    old = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(hash_column).alias("_t_hash"))
    joined = source.join(old, [F.col(k) == F.col(f"_t_{k}") for k in keys], "left")
    action = F.when(F.col(f"_t_{keys[0]}").isNull(), INSERT).when(~F.col(hash_column).eqNullSafe(F.col("_t_hash")), UPDATE).otherwise(UNCHANGED)
    return joined.withColumn("_action", action).drop(*old.columns)


def check_source(source: DataFrame, keys: list[str]) -> None:
    """Raise if the source has null keys or several rows of a key: one pass."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    bad = source.groupBy(*keys).agg(F.count("*").alias("_n")).filter(null | (F.col("_n") > 1)).limit(1).collect()
    if bad:
        raise MergeError(f"null or repeated key in the source: {bad[0].asDict()}")


def upsert(
    source: DataFrame,
    target: DataFrame,
    *,
    keys: list[str],
    update_columns: list[str] | None = None,
    insert_columns: list[str] | None = None,
    hash_column: str | None = None,
    update_expressions: dict[str, str] | None = None,
    insert_expressions: dict[str, str] | None = None,
    when_matched: bool = True,
    when_not_matched: bool = True,
) -> DataFrame:
    """The target after a merge, with ``_change`` (INSERT, UPDATE or UNCHANGED).

    Matched rows change if their hash differs (always, without ``hash_column``):
    ``update_columns`` from the source and ``update_expressions`` (SQL over the
    aliases ``s`` and ``t``). New keys give rows of ``insert_columns`` and
    ``insert_expressions``; other columns are null.
    """
    update = update_columns if update_columns is not None else [c for c in source.columns if c in target.columns and c not in keys]
    insert = insert_columns if insert_columns is not None else [c for c in source.columns if c in target.columns]
    _need(source, *keys, *update, *insert)
    _need(target, *keys)
    check_source(source, keys)
    s = source.withColumn("_in", F.lit(1)).alias("s")
    t = target.withColumn("_was", F.lit(1)).alias("t")
    same = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    both = F.col("s._in").isNotNull() & F.col("t._was").isNotNull()
    if not when_matched:
        hit = F.lit(False)
    elif hash_column:
        hit = both & ~F.col(f"s.{hash_column}").eqNullSafe(F.col(f"t.{hash_column}"))
    else:
        hit = both
    fresh = F.col("t._was").isNull()
    sets = {c: F.col(f"s.{c}") for c in update} | {c: F.expr(e) for c, e in (update_expressions or {}).items()}
    gives = {c: F.col(f"s.{c}") for c in insert} | {c: F.expr(e) for c, e in (insert_expressions or {}).items()}
    types = dict(target.dtypes)

    def value(c: str) -> Column:
        old, kind = F.col(f"t.{c}"), types[c]
        kept = F.when(hit, sets[c].cast(kind)).otherwise(old) if c in sets else old
        return F.when(fresh, (gives[c] if c in gives else F.lit(None)).cast(kind)).otherwise(kept).alias(c) if when_not_matched else kept.alias(c)

    joined = t.join(s, same, "full" if when_not_matched else "left")
    return joined.select(*map(value, target.columns), F.when(fresh, INSERT).when(hit, UPDATE).otherwise(UNCHANGED).alias("_change"))


def insert_only(source: DataFrame, target: DataFrame, *, keys: list[str]) -> DataFrame:
    """The source rows whose key the target lacks, once each: a replay gives none."""
    _need(source, *keys)
    return source.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti").select(*source.columns)


def scd1(source: DataFrame, target: DataFrame, *, key: str, mutable: list[str], hash_column: str, at: str) -> DataFrame:
    """Type 1: change in place. ``updated_at`` follows changes, ``created_at`` stays."""
    when = f"timestamp'{at}'"
    return upsert(source, target, keys=[key], update_columns=[*mutable, hash_column], insert_columns=[key, *mutable, hash_column], hash_column=hash_column, update_expressions={"updated_at": when}, insert_expressions={"created_at": when, "updated_at": when})


#: Columns that a type 2 dimension has besides its own.
SCD2_COLUMNS = ["version_number", "effective_from", "effective_to", "is_current"]


def classify_scd2(source: DataFrame, target: DataFrame, *, key: str, hash_column: str) -> DataFrame:
    """The source with ``_action``, and version and start of the current row."""
    now = target.filter("is_current").select(F.col(key).alias("_k"), F.col(hash_column).alias("_h"), F.col("version_number").alias("_previous_version"), F.col("effective_from").alias("_previous_from"))
    out = source.join(now, F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), INSERT).when(~F.col(hash_column).eqNullSafe(F.col("_h")), UPDATE).otherwise(UNCHANGED)
    return out.withColumn("_action", action).drop("_k", "_h")


def scd2(source: DataFrame, target: DataFrame, *, key: str, attributes: list[str], hash_column: str, effective_at: str) -> DataFrame:
    """Type 2: the whole new dimension, with ``_change`` (CLOSED, INSERTED or null).

    Current rows whose hash differs end at ``effective_at`` (an SQL expression
    over the source, aliased ``s``); a new version begins there. Closing and
    inserting come from one plan, so a failure cannot leave half of a change.
    """
    _need(source, key, *attributes, hash_column)
    _need(target, key, *attributes, hash_column, *SCD2_COLUMNS)
    check_source(source, [key])
    s = source.withColumn("_at", F.expr(effective_at).cast("timestamp")).select(F.col(key).alias("_k"), F.col(hash_column).alias("_h"), *[F.col(a).alias(f"_s_{a}") for a in attributes], "_at")
    joined = target.withColumn("_was", F.lit(True)).join(s.withColumn("_in", F.lit(True)), (F.col(key) == F.col("_k")) & F.col("is_current"), "full")
    known, given = F.col("_was").isNotNull(), F.col("_in").isNotNull()
    moved = given & (~known | ~F.col(hash_column).eqNullSafe(F.col("_h")))
    types = dict(target.dtypes)
    over = {"effective_to": F.when(moved, F.col("_at").cast(types["effective_to"])).otherwise(F.col("effective_to")), "is_current": F.when(moved, F.lit(False)).otherwise(F.col("is_current"))}
    values = {key: F.col("_k"), hash_column: F.col("_h"), "version_number": F.coalesce("version_number", F.lit(0)) + 1, "effective_from": F.col("_at"), "effective_to": F.lit(None), "is_current": F.lit(True)} | {a: F.col(f"_s_{a}") for a in attributes}
    old = F.struct(*[(over[c] if c in over else F.col(c)).cast(types[c]).alias(c) for c in target.columns], F.when(moved, "CLOSED").alias("_change"))
    new = F.struct(*[(values[c] if c in values else F.lit(None)).cast(types[c]).alias(c) for c in target.columns], F.lit("INSERTED").alias("_change"))
    rows = joined.select(F.explode(F.array_compact(F.array(F.when(known, old), F.when(moved, new)))).alias("_row"))
    return rows.select("_row.*")


def as_of(dimension: DataFrame, at: str) -> DataFrame:
    """The rows valid at an instant, in half-open intervals."""
    t = F.expr(at)
    return dimension.filter((F.col("effective_from") <= t) & (F.col("effective_to").isNull() | (F.col("effective_to") > t)))


def scd1_invariants(dimension: DataFrame, key: str) -> DataFrame:
    """One row of violation counts: null keys, repeated keys, blank hashes, time order."""
    per = dimension.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("_record_hash").isNull()).alias("no_hash"), F.count_if(F.col("updated_at") < F.col("created_at")).alias("early"))
    return per.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"), F.coalesce(F.sum("no_hash"), F.lit(0)).alias("missing_hashes"), F.coalesce(F.sum("early"), F.lit(0)).alias("updated_before_created"))


def scd2_invariants(dimension: DataFrame, key: str) -> DataFrame:
    """One row of violation counts; an open row that is superseded counts as a gap.

    Versions of the same number follow each other by their intervals, an open
    one last, so that the counts do not depend on the order of the rows.
    """
    w = Window.partitionBy(key).orderBy("version_number", "effective_from", F.col("effective_to").asc_nulls_last())
    rows = dimension.withColumn("_next", F.lead("effective_from").over(w)).withColumn("_prior", F.lag("version_number").over(w))
    per = rows.groupBy(key).agg(
        F.count_if("is_current").alias("current"),
        F.count("*").alias("n"),
        F.countDistinct("version_number").alias("versions"),
        F.count_if(F.col("_next").isNotNull() & ~F.col("effective_to").eqNullSafe(F.col("_next"))).alias("gaps"),
        F.count_if(F.col("effective_to") <= F.col("effective_from")).alias("backward"),
        F.count_if(F.col("is_current") != F.col("effective_to").isNull()).alias("open_mismatch"),
        F.count_if(F.col("version_number") != F.coalesce(F.col("_prior"), F.lit(0)) + 1).alias("skips"),
    )
    return per.agg(
        F.count_if(F.col("current") != 1).alias("keys_without_one_current"),
        F.count_if(F.col("n") != F.col("versions")).alias("keys_with_repeated_versions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("gaps", "interval_gaps"), ("backward", "backward_intervals"), ("open_mismatch", "open_end_mismatches"), ("skips", "version_skips"))],
    )
