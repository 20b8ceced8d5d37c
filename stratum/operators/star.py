"""Healthcare star schema: dimensions, facts, aggregates and the volume alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.scalar import guarded_ratio, iso_weekday, with_distinct_counts

MONEY = "decimal(18,2)"
#: Bytes of a dimension's lookup side up to which it is broadcast.
LOOKUP_BYTES = 64 << 20


def lookup(df: DataFrame) -> DataFrame:
    """A dimension as a join side: broadcast if the optimiser's estimate of its bytes allows
    it, which costs no job; else as it is, for the optimiser to choose."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= LOOKUP_BYTES else df


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """A row for each day from ``start`` to ``end``, both included; 12 columns."""
    day = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)")).alias("calendar_date"))
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.weekofyear(day).alias("week_of_year"),
        F.dayofmonth(day).alias("day_of_month"),
        iso_weekday(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        (iso_weekday(day) >= 6).alias("is_weekend"),
    )


def surrogate(*cols: Column) -> Column:
    """64-bit key; it skips nulls, so coalesce what may be missing."""
    return F.xxhash64(*cols)


def dimension(source: DataFrame, *, key: str, natural: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """A dimension with a surrogate key over its natural key.

    ``columns``: output name to (source column, type); casts are lenient. Rows
    without a natural key are left out, repeated ones reduced to one.
    """
    cols = [F.trim(F.col(src)).try_cast(kind).alias(out) if kind != "string" else F.trim(F.col(src)).alias(out) for out, (src, kind) in columns.items()]
    rows = source.filter(F.col(natural).isNotNull() & (F.trim(F.col(natural)) != "")).select(surrogate(F.trim(F.col(natural))).alias(key), *cols)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


#: Source columns and types of the dimensions.
PATIENT = {"patient_id": ("Id", "string"), "birth_date": ("BIRTHDATE", "date"), "death_date": ("DEATHDATE", "date"), "first_name": ("FIRST", "string"), "last_name": ("LAST", "string"), "gender": ("GENDER", "string"), "race": ("RACE", "string"), "ethnicity": ("ETHNICITY", "string"), "city": ("CITY", "string"), "state": ("STATE", "string"), "healthcare_expenses": ("HEALTHCARE_EXPENSES", MONEY), "healthcare_coverage": ("HEALTHCARE_COVERAGE", MONEY)}
ORGANIZATION = {"organization_id": ("Id", "string"), "organization_name": ("NAME", "string"), "city": ("CITY", "string"), "state": ("STATE", "string"), "zip": ("ZIP", "string"), "revenue": ("REVENUE", MONEY), "utilization": ("UTILIZATION", "bigint")}
PROVIDER = {"provider_id": ("Id", "string"), "organization_id": ("ORGANIZATION", "string"), "provider_name": ("NAME", "string"), "gender": ("GENDER", "string"), "speciality": ("SPECIALITY", "string"), "city": ("CITY", "string"), "state": ("STATE", "string"), "utilization": ("UTILIZATION", "bigint")}
PAYER = {"payer_id": ("Id", "string"), "payer_name": ("NAME", "string"), "city": ("CITY", "string"), "state_headquartered": ("STATE_HEADQUARTERED", "string"), "amount_covered": ("AMOUNT_COVERED", MONEY), "amount_uncovered": ("AMOUNT_UNCOVERED", MONEY), "revenue": ("REVENUE", MONEY)}


def patients(source: DataFrame) -> DataFrame:
    return dimension(source, key="patient_key", natural="Id", columns=PATIENT)


def organizations(source: DataFrame) -> DataFrame:
    return dimension(source, key="organization_key", natural="Id", columns=ORGANIZATION)


def providers(source: DataFrame) -> DataFrame:
    return dimension(source, key="provider_key", natural="Id", columns=PROVIDER)


def payers(source: DataFrame, *, external: bool = False) -> DataFrame:
    """The external variant calls the column ``state`` and takes STATE if it must."""
    columns = dict(PAYER)
    if external:
        columns["state"] = columns.pop("state_headquartered")
        if "STATE_HEADQUARTERED" not in source.columns:
            columns["state"] = ("STATE", "string")
    return dimension(source, key="payer_key", natural="Id", columns=columns)


def conditions_dimension(source: DataFrame) -> DataFrame:
    """One row for each distinct (code, description)."""
    pairs = source.select(F.trim("CODE").alias("condition_code"), F.trim("DESCRIPTION").alias("condition_description")).filter("condition_code IS NOT NULL").dropDuplicates()
    return pairs.select(surrogate(F.col("condition_code"), F.coalesce("condition_description", F.lit(""))).alias("condition_key"), "*")


def prepare_encounters(source: DataFrame) -> DataFrame:
    """Encounters with types, date, duration in minutes and the patient's share.

    Text that is no timestamp or number gives null, to be counted later.
    """
    money = {"base_encounter_cost": "BASE_ENCOUNTER_COST", "total_claim_cost": "TOTAL_CLAIM_COST", "payer_coverage": "PAYER_COVERAGE"}
    text = {"encounter_id": "Id", "patient_id": "PATIENT", "organization_id": "ORGANIZATION", "provider_id": "PROVIDER", "payer_id": "PAYER", "encounter_class": "ENCOUNTERCLASS", "encounter_code": "CODE", "encounter_description": "DESCRIPTION", "reason_code": "REASONCODE", "reason_description": "REASONDESCRIPTION"}
    typed = source.select(
        *[F.col(s).alias(n) for n, s in text.items()],
        F.try_to_timestamp("START").alias("encounter_start_ts"),
        F.try_to_timestamp("STOP").alias("encounter_stop_ts"),
        *[F.col(s).try_cast(MONEY).alias(n) for n, s in money.items()],
    )
    return typed.withColumns(
        {
            "encounter_date": F.to_date("encounter_start_ts"),
            "duration_minutes": (F.unix_timestamp("encounter_stop_ts") - F.unix_timestamp("encounter_start_ts")) / F.lit(60.0),
            "patient_responsibility": (F.col("total_claim_cost") - F.col("payer_coverage")).cast(MONEY),
        }
    )


def fact_encounters(prepared: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Keys of five dimensions for each encounter, null where there is none.

    ``dims``: date, patient, organization, provider and payer.
    """
    out = prepared.join(lookup(dims["date"].select("date_key", F.col("calendar_date").alias("encounter_date"))), "encounter_date", "left")
    for name in ("patient", "organization", "provider", "payer"):
        out = out.join(lookup(dims[name].select(f"{name}_key", f"{name}_id")), f"{name}_id", "left")
    out = out.withColumn("encounter_key", surrogate(F.col("encounter_id")))
    first = ["encounter_key", "encounter_id", "date_key", "patient_key", "organization_key", "provider_key", "payer_key"]
    return out.select(*first, *[c for c in prepared.columns if c != "encounter_id"])


def prepare_conditions(source: DataFrame) -> DataFrame:
    """Condition events, each distinct one once, under a key of all its parts."""
    days = {"condition_start_date": "START", "condition_stop_date": "STOP"}
    text = {"patient_id": "PATIENT", "encounter_id": "ENCOUNTER", "condition_code": "CODE", "condition_description": "DESCRIPTION"}
    events = source.select(*[F.to_date(F.try_to_timestamp(s)).alias(n) for n, s in days.items()], *[F.col(s).alias(n) for n, s in text.items()]).distinct()
    return events.withColumn("condition_event_key", surrogate(*map(F.col, text), F.col("condition_start_date").cast("string"), F.coalesce(F.col("condition_stop_date").cast("string"), F.lit(""))))


def condition_quality(prepared: DataFrame) -> DataFrame:
    """One row on the condition events before they are loaded."""
    none = lambda c: F.count_if(F.col(c).isNull())
    out = prepared.agg(F.count("*").alias("row_count"), F.countDistinct("condition_event_key").alias("distinct_event_keys"), none("condition_event_key").alias("null_event_keys"), none("patient_id").alias("null_patient_ids"), none("condition_code").alias("null_condition_codes"), none("condition_start_date").alias("invalid_start_dates"))
    bad = (F.col("row_count") != F.col("distinct_event_keys")) | (F.col("null_event_keys") + F.col("null_patient_ids") + F.col("null_condition_codes") + F.col("invalid_start_dates") > 0)
    return out.withColumn("status", F.when(bad, "FAIL").otherwise("PASS"))


def fact_conditions(source: DataFrame, dims: dict[str, DataFrame], encounters: DataFrame) -> DataFrame:
    """Condition events with their keys looked up, activity and duration.

    The condition is looked up by code and description together.
    """
    out = prepare_conditions(source).join(lookup(dims["condition"].select("condition_key", "condition_code", "condition_description")), ["condition_code", "condition_description"], "left")
    out = out.join(lookup(dims["patient"].select("patient_key", "patient_id")), "patient_id", "left")
    out = out.join(encounters.select("encounter_key", "encounter_id"), "encounter_id", "left")
    out = out.join(lookup(dims["date"].select(F.col("date_key").alias("condition_start_date_key"), F.col("calendar_date").alias("condition_start_date"))), "condition_start_date", "left")
    out = out.withColumns({"is_active_condition": F.col("condition_stop_date").isNull(), "condition_duration_days": F.datediff("condition_stop_date", "condition_start_date")})
    return out.select("condition_event_key", "patient_key", "condition_key", "condition_start_date_key", "encounter_key", "patient_id", "encounter_id", "condition_code", "condition_description", "condition_start_date", "condition_stop_date", "is_active_condition", "condition_duration_days")


def foreign_key_gate(fact: DataFrame, keys: list[str]) -> None:
    """Raise if a key is null anywhere: one pass over the fact."""
    row = fact.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first().asDict()
    if bad := {k: n for k, n in row.items() if n}:
        raise ValueError(f"rows without a dimension: {bad}")


def source_quality(prepared: DataFrame) -> DataFrame:
    """One row on the encounters before they are loaded."""
    c = F.col
    return prepared.agg(
        F.count("*").alias("row_count"),
        F.countDistinct("encounter_id").alias("distinct_encounters"),
        F.count_if(c("encounter_id").isNull()).alias("null_encounter_ids"),
        F.count_if(c("encounter_start_ts").isNull()).alias("bad_start_timestamps"),
        F.count_if(c("encounter_stop_ts").isNull()).alias("bad_stop_timestamps"),
        F.count_if(c("encounter_stop_ts") < c("encounter_start_ts")).alias("negative_durations"),
        F.count_if(c("total_claim_cost").isNull()).alias("bad_claim_costs"),
        F.count_if(c("total_claim_cost") < 0).alias("negative_claim_costs"),
        F.count_if(c("payer_coverage") > c("total_claim_cost")).alias("coverage_above_claim"),
    )


def _sum(name: str) -> Column:
    return F.round(F.sum(name), 2).alias(name)


def daily_encounters(fact: DataFrame) -> DataFrame:
    """One row per day, with the share of emergencies."""
    emergencies = F.count_if(F.lower("encounter_class") == "emergency")
    rows = fact.groupBy("date_key", "encounter_date").agg(
        F.count("*").alias("encounter_count"),
        F.countDistinct("patient_key").alias("unique_patients"),
        F.round(F.avg("duration_minutes"), 2).alias("avg_duration_minutes"),
        _sum("base_encounter_cost"),
        _sum("total_claim_cost"),
        _sum("payer_coverage"),
        _sum("patient_responsibility"),
        emergencies.alias("emergency_encounters"),
        F.round(emergencies / F.count("*") * 100.0, 2).alias("emergency_encounter_pct"),
    )
    return with_distinct_counts(rows, fact, ["date_key", "encounter_date"], {"organizations_active": "organization_key", "providers_active": "provider_key"})


def organization_performance(fact: DataFrame, dim: DataFrame) -> DataFrame:
    rows = fact.groupBy("organization_key").agg(
        F.count("*").alias("encounter_count"),
        F.countDistinct("patient_key").alias("unique_patients"),
        F.round(F.avg("duration_minutes"), 2).alias("avg_duration_minutes"),
        _sum("total_claim_cost"),
        F.round(F.avg("total_claim_cost"), 2).alias("avg_claim_cost"),
        _sum("payer_coverage"),
        _sum("patient_responsibility"),
        F.min("encounter_date").alias("first_encounter_date"),
        F.max("encounter_date").alias("last_encounter_date"),
    )
    rows = with_distinct_counts(rows, fact, ["organization_key"], {"unique_providers": "provider_key"})
    return rows.join(lookup(dim.select("organization_key", "organization_id", "organization_name", "city", "state")), "organization_key", "left")


def payer_coverage(fact: DataFrame, dim: DataFrame, *, external: bool = False) -> DataFrame:
    """Coverage by payer. Without claims the share is null, externally 0.0."""
    more = [] if external else [F.round(F.avg("payer_coverage"), 2).alias("avg_payer_coverage")]
    rows = fact.groupBy("payer_key").agg(F.count("*").alias("encounter_count"), F.countDistinct("patient_key").alias("unique_patients"), _sum("total_claim_cost"), _sum("payer_coverage"), _sum("patient_responsibility"), F.round(F.avg("total_claim_cost"), 2).alias("avg_claim_cost"), *more)
    share = F.round(guarded_ratio(F.col("payer_coverage"), F.col("total_claim_cost"), default=0.0 if external else None) * 100, 2)
    return rows.withColumn("coverage_pct", share).join(lookup(dim.select("payer_key", "payer_id", "payer_name")), "payer_key", "left")


def condition_summary(fact: DataFrame, dim: DataFrame, *, external: bool = False) -> DataFrame:
    """Condition events by condition; the two variants name columns differently."""
    n, duration, first, last = ("condition_events", "avg_duration_days", "first_observed_date", "last_observed_date") if external else ("condition_event_count", "avg_condition_duration_days", "first_recorded_date", "last_recorded_date")
    active = F.count_if("is_active_condition")
    more = [] if external else [F.countDistinct("encounter_key").alias("linked_encounters"), F.round(active / F.count("*") * 100, 2).alias("active_condition_pct")]
    rows = fact.groupBy("condition_key").agg(F.count("*").alias(n), F.countDistinct("patient_key").alias("unique_patients"), active.alias("active_condition_events"), F.round(F.avg("condition_duration_days"), 2).alias(duration), F.min("condition_start_date").alias(first), F.max("condition_start_date").alias(last), *more)
    return rows.join(lookup(dim), "condition_key", "left")


def monthly_volumes(fact: DataFrame, date: str = "encounter_date") -> DataFrame:
    return fact.filter(F.col(date).isNotNull()).groupBy(F.trunc(date, "month").alias("month_start")).agg(F.count("*").alias("encounter_count"))


def volume_alert(fact: DataFrame, *, date: str = "encounter_date", observed_pct: float = 20.0, threshold_pct: float = 30.0, external: bool = False) -> DataFrame:
    """One row: a simulated month against the three before the latest.

    Baseline and observation are rounded half to even. The tested month is the
    one after the latest, externally the latest itself. Fewer than four months
    give no row, which an alert takes for an error.
    """
    last = monthly_volumes(fact, date).orderBy(F.desc("month_start")).limit(4)
    agg = last.agg(F.max("month_start").alias("latest_month"), F.collect_list(F.struct("month_start", "encounter_count")).alias("m")).filter(F.size("m") == 4)
    before = F.slice(F.reverse(F.array_sort("m")), 2, 3)
    baseline = F.bround(F.aggregate(before, F.lit(0.0), lambda a, x: a + x["encounter_count"]) / 3, 0).cast("long")
    rows = agg.select("latest_month", (F.col("latest_month") if external else F.add_months("latest_month", 1)).alias("test_month"), baseline.alias("baseline_volume"))
    rows = rows.withColumn("observed_volume", F.bround(F.col("baseline_volume") * observed_pct / 100, 0).cast("long"))
    drop = F.bround(guarded_ratio((F.col("baseline_volume") - F.col("observed_volume")).cast("double"), F.col("baseline_volume")) * 100, 2)
    return rows.withColumn("drop_pct", drop).withColumn("threshold_pct", F.lit(threshold_pct)).withColumn("alert_triggered", F.when(F.col("drop_pct") >= threshold_pct, 1).otherwise(0))


def load_by_month(source: DataFrame, path: str, *, start: str = "START", key: str = "Id") -> dict[str, int]:
    """Write a partition for each month of ``start``; {rows, months}.

    Refuses rows without a date or with a repeated key, and reconciles what was
    written with what came.
    """
    rows = source.withColumn("encounter_month", F.date_format(F.try_to_timestamp(start), "yyyy-MM"))
    bad = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("encounter_month").isNull()).alias("undated")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("undated"), F.lit(0)).alias("undated"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if bad["repeated"] or bad["undated"]:
        raise ValueError(f"{bad['repeated']} repeated keys, {bad['undated']} rows without a date")
    rows.repartition("encounter_month").write.mode("overwrite").partitionBy("encounter_month").option("header", True).csv(path)
    back = source.sparkSession.read.option("header", True).option("basePath", path).csv(path).agg(F.count("*"), F.countDistinct("encounter_month")).first() if bad["rows"] else (0, 0)
    if back[0] != bad["rows"]:
        raise ValueError(f"{bad['rows']} rows came, {back[0]} were written")
    return {"rows": back[0], "months": back[1]}


def month_profile(source: DataFrame, *, start: str = "START", key: str = "Id") -> DataFrame:
    """Rows, distinct keys, first and last start of each month."""
    return source.groupBy(F.date_format(F.try_to_timestamp(start), "yyyy-MM").alias("month")).agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("distinct_keys"), F.min(start).alias("first_start"), F.max(start).alias("last_start"))


def timestamp_profile(source: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls, blanks and unparsable values of timestamp columns."""
    out = []
    for c in columns:
        empty = F.col(c).isNull() | (F.trim(c) == "")
        out += [F.count_if(empty).alias(f"{c}_missing"), F.count_if(~empty & F.try_to_timestamp(c).isNull()).alias(f"{c}_unparsable"), F.min(F.try_to_timestamp(c)).alias(f"{c}_min"), F.max(F.try_to_timestamp(c)).alias(f"{c}_max")]
    return source.agg(F.count("*").alias("row_count"), *out)


def class_profile(prepared: DataFrame) -> DataFrame:
    """Encounters by class: count, distinct patients, cost."""
    return prepared.groupBy(F.lower("encounter_class").alias("encounter_class")).agg(F.count("*").alias("encounter_count"), F.countDistinct("patient_id").alias("unique_patients"), F.round(F.avg("duration_minutes"), 2).alias("avg_duration_minutes"), _sum("total_claim_cost"))
