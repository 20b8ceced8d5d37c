"""A semantic layer: named dimensions and measures, compiled to one aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REF = re.compile(r"measure\(\s*`?([A-Za-z_]\w*)`?\s*\)", re.IGNORECASE)


@dataclass(frozen=True)
class MetricView:
    """Dimensions and measures as SQL over a source.

    A measure may use others as ``MEASURE(name)``; they are put in by their
    expression, so any grouping computes them from rows, not from aggregates.
    """

    dimensions: dict[str, str]
    measures: dict[str, str]
    filter: str | None = None

    def expression(self, name: str, seen: tuple[str, ...] = ()) -> str:
        if name not in self.measures:
            raise KeyError(f"no measure {name}")
        if name in seen:
            raise ValueError(f"measures refer to each other: {' -> '.join([*seen, name])}")
        return _REF.sub(lambda m: f"({self.expression(m[1], (*seen, name))})", self.measures[name])

    def query(self, source: DataFrame, *, by: list[str] | None = None, measures: list[str] | None = None, where: str | Column | None = None, order_by: list[Column] | None = None, limit: int | None = None) -> DataFrame:
        """The measures by the dimensions; ``where`` filters rows of the source."""
        df = source.filter(self.filter) if self.filter else source
        if where is not None:
            df = df.filter(where)
        keys = [F.expr(self.dimensions[d]).alias(d) for d in by or []]
        values = [F.expr(self.expression(m)).alias(m) for m in measures or self.measures]
        out = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
        if order_by:
            out = out.orderBy(*order_by)
        return out.limit(limit) if limit else out


#: Encounters, as the dashboards see them.
ENCOUNTERS = MetricView(
    {"encounter_date": "encounter_date", "month": "trunc(encounter_date, 'month')", "encounter_class": "lower(encounter_class)", "organization_key": "organization_key", "payer_key": "payer_key"},
    {
        "encounters": "count(*)",
        "patients": "count(DISTINCT patient_key)",
        "claim_cost": "round(sum(total_claim_cost), 2)",
        "coverage": "round(sum(payer_coverage), 2)",
        "responsibility": "round(sum(patient_responsibility), 2)",
        "organizations": "count(DISTINCT organization_key)",
        "avg_claim_cost": "round(avg(total_claim_cost), 2)",
        "avg_duration_minutes": "round(avg(duration_minutes), 2)",
        "emergencies": "count_if(lower(encounter_class) = 'emergency')",
        "emergency_pct": "round(100.0 * MEASURE(emergencies) / MEASURE(encounters), 2)",
        "coverage_pct": "round(100.0 * sum(payer_coverage) / nullif(sum(total_claim_cost), 0), 2)",
    },
)
#: Over the payer aggregate: the mean of shares, which is not the share of sums.
PAYERS = MetricView({"payer_name": "payer_name"}, {"encounters": "sum(encounter_count)", "mean_coverage_pct": "round(avg(coverage_pct), 2)", "coverage_pct": "round(100.0 * sum(payer_coverage) / nullif(sum(total_claim_cost), 0), 2)"})
#: Over the condition aggregate: patients of several conditions count several times.
CONDITIONS = MetricView({"condition_description": "condition_description"}, {"events": "sum(condition_event_count)", "patients_by_condition": "sum(unique_patients)", "active_events": "sum(active_condition_events)"})


def dashboard(fact: DataFrame, payers: DataFrame, conditions: DataFrame, *, start: str | None = None, end: str | None = None, classes: list[str] | None = None) -> dict[str, DataFrame]:
    """The seven datasets of the operations dashboard, under its filters."""
    where = F.lit(True)
    if start:
        where = where & (F.col("encounter_date") >= F.lit(start).cast("date"))
    if end:
        where = where & (F.col("encounter_date") <= F.lit(end).cast("date"))
    if classes:
        where = where & F.lower("encounter_class").isin(*[c.lower() for c in classes])
    q = lambda **k: ENCOUNTERS.query(fact, where=where, **k)
    return {
        "overview": q(measures=["encounters", "patients", "organizations", "claim_cost", "coverage", "responsibility", "avg_claim_cost", "avg_duration_minutes", "emergency_pct"]).toDF("total_encounters", "unique_patients", "organizations", "total_claim_cost", "payer_coverage", "patient_responsibility", "avg_claim_cost", "avg_duration_minutes", "emergency_encounter_pct"),
        "daily_trend": q(by=["encounter_date"], measures=["encounters", "emergencies", "emergency_pct"], order_by=[F.col("encounter_date")]),
        "monthly_trend": q(by=["month"], measures=["encounters", "claim_cost"], order_by=[F.col("month")]),
        "class_summary": q(by=["encounter_class"], measures=["encounters", "patients", "claim_cost"], order_by=[F.desc("encounters")]),
        "top_organizations": q(by=["organization_key"], measures=["encounters", "claim_cost"], order_by=[F.desc("encounters"), F.col("organization_key")], limit=10),
        "payer_coverage": PAYERS.query(payers, by=["payer_name"], order_by=[F.desc("encounters")]),
        "top_conditions": CONDITIONS.query(conditions, by=["condition_description"], order_by=[F.desc("events"), F.col("condition_description")], limit=20),
    }
