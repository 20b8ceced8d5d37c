"""Declared datasets: a registry that sorts itself and checks expectations."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from stratum.functions import quality


@dataclass
class Dataset:
    build: Callable[..., DataFrame]
    needs: list[str]
    monitor: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    fail: dict[str, str] = field(default_factory=dict)


@dataclass
class Pipeline:
    """Datasets by name. A dataset's parameters name those that it reads."""

    datasets: dict[str, Dataset] = field(default_factory=dict)

    def dataset(self, name: str | None = None, *, expect: dict[str, str] | None = None, expect_or_drop: dict[str, str] | None = None, expect_or_fail: dict[str, str] | None = None) -> Callable:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            key = name or f.__name__
            if key in self.datasets:
                raise ValueError(f"dataset {key} is declared twice")
            self.datasets[key] = Dataset(f, [p for p in inspect.signature(f).parameters if p != "spark"], expect or {}, expect_or_drop or {}, expect_or_fail or {})
            return f

        return add

    def order(self) -> list[str]:
        graph = {n: {x for x in d.needs if x in self.datasets} for n, d in self.datasets.items()}
        return list(TopologicalSorter(graph).static_order())

    def run(self, spark: SparkSession, inputs: dict[str, DataFrame], *, write: Callable[[str, DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
        """All datasets, and (dataset, expectation, action, passed, failed).

        ``write`` stores a dataset and returns what later ones read; without it
        plans stay lazy and are computed by whoever reads them.
        """
        have, counts = dict(inputs), []
        for n in self.order():
            d = self.datasets[n]
            if missing := [x for x in d.needs if x not in have]:
                raise KeyError(f"dataset {n} needs {missing}")
            kw = {x: have[x] for x in d.needs}
            df = d.build(spark, **kw) if "spark" in inspect.signature(d.build).parameters else d.build(**kw)
            rules = [(r, p, a) for a, rs in (("monitor", d.monitor), ("drop", d.drop), ("fail", d.fail)) for r, p in rs.items()]
            if rules:
                got = {r["expectation"]: r for r in quality.expectation_metrics(df, {r: p for r, p, _ in rules}).collect()}
                counts += [(n, r, a, got[r]["passed"], got[r]["failed"]) for r, _, a in rules]
                if bad := [r for r, _, a in rules if a == "fail" and got[r]["failed"]]:
                    raise ValueError(f"dataset {n} fails {bad}")
            if d.drop:
                df = quality.expect_all_or_drop(df, d.drop)
            have[n] = write(n, df) if write else df
        return {n: have[n] for n in self.datasets}, spark.createDataFrame(counts, "dataset string, expectation string, action string, passed long, failed long")
