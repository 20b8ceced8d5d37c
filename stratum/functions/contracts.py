"""Data contracts: what a table's columns and rows have to be, and how it may change."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import Rule

#: Contract type names to Spark's.
TYPES = {"string": "string", "integer": "int", "int": "int", "long": "bigint", "bigint": "bigint", "double": "double", "float": "float", "timestamp": "timestamp", "date": "date", "boolean": "boolean"}
WIDER = {("int", "bigint"), ("float", "double"), ("int", "double")}


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str
    nullable: bool = True
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    """A version of a contract. Rules are SQL predicates that a row must meet;
    severity ``warning`` counts a failure without rejecting the row."""

    name: str
    version: str
    columns: tuple[ContractColumn, ...]
    rules: tuple[tuple[str, str, str], ...] = ()  # name, predicate, severity
    keys: tuple[str, ...] = ()
    supersedes: str | None = None
    policy: dict[str, object] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str, version: str | None = None) -> Contract:
        """From YAML; the declared version must be the one asked for."""
        import yaml

        d = yaml.safe_load(text)
        for k in ("name", "version", "columns"):
            if not d.get(k):
                raise ValueError(f"the contract lacks {k}")
        if version is not None and str(d["version"]) != str(version):
            raise ValueError(f"asked for version {version}, the contract declares {d['version']}")
        cols = []
        for c in d["columns"]:
            if c["type"] not in TYPES and not c["type"].startswith("decimal("):
                raise ValueError(f"unknown type {c['type']!r}")
            cols.append(ContractColumn(c["name"], TYPES.get(c["type"], c["type"]), bool(c.get("nullable", True)), tuple(map(str, c.get("allowed_values", ())))))
        if len({c.name for c in cols}) != len(cols):
            raise ValueError("a column is declared twice")
        rules = tuple((r["name"], r["expression"], r.get("severity", "error")) for r in d.get("rules", ()))
        return cls(d["name"], str(d["version"]), tuple(cols), rules, tuple(d.get("keys", ())), None if d.get("supersedes") is None else str(d["supersedes"]), d.get("evolution", {}))

    @classmethod
    def load(cls, path: str | Path, version: str | None = None) -> Contract:
        return cls.parse(Path(path).read_text(), version)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type), c.nullable) for c in self.columns])

    def row_rules(self, *, warnings: bool = False) -> list[Rule]:
        """The contract's own rules as row rules: nulls, allowed values, predicates."""
        out = [Rule(f"NULL_{c.name.upper()}", F.col(c.name).isNull()) for c in self.columns if not c.nullable]
        out += [Rule(f"VALUE_{c.name.upper()}", F.col(c.name).isNotNull() & ~F.col(c.name).cast("string").isin(*c.allowed)) for c in self.columns if c.allowed]
        return out + [Rule(n, ~F.coalesce(F.expr(p), F.lit(False))) for n, p, s in self.rules if warnings or s == "error"]

    def project(self, df: DataFrame) -> DataFrame:
        """The contract's columns and types; what cannot be cast is null, as is a missing column."""
        have = set(df.columns)
        return df.select(*[(F.col(c.name).try_cast(c.type) if c.name in have else F.lit(None).cast(c.type)).alias(c.name) for c in self.columns])


def diff(old: Contract, new: Contract) -> list[dict[str, object]]:
    """Changes between versions, each with whether old readers and writers go on."""
    a, b, out = {c.name: c for c in old.columns}, {c.name: c for c in new.columns}, []
    for n, c in b.items():
        if n not in a:
            out.append({"column": n, "change": "ADD_NULLABLE" if c.nullable else "ADD_REQUIRED", "old": None, "new": c.type, "compatible": c.nullable})
        elif c.type != a[n].type:
            wide = (a[n].type, c.type) in WIDER
            out.append({"column": n, "change": "WIDEN" if wide else "TYPE_CHANGE", "old": a[n].type, "new": c.type, "compatible": wide})
    out += [{"column": n, "change": "DROP", "old": c.type, "new": None, "compatible": False} for n, c in a.items() if n not in b]
    return sorted(out, key=lambda d: d["column"])


def compare(df: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Missing and unexpected columns, and columns of another type."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in schema}
    return {"missing": sorted(set(want) - set(have)), "unexpected": sorted(set(have) - set(want)), "mismatched": sorted(f"{c}: {have[c]} for {want[c]}" for c in set(have) & set(want) if have[c] != want[c])}


def rescue(df: DataFrame, schema: T.StructType, *, column: str = "_rescued_data") -> DataFrame:
    """Columns of ``schema`` by lenient casts, and the rest as JSON.

    ``column`` is null if nothing had to be rescued: no unknown field with a
    value, no value that its type cannot hold.
    """
    want = {f.name: f.dataType for f in schema}
    lost: list[Column] = []
    for c, kind in df.dtypes:
        if c not in want:
            lost.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"))))
        elif kind != want[c].simpleString():
            bad = F.col(c).isNotNull() & F.col(c).try_cast(want[c]).isNull()
            lost.append(F.when(bad, F.struct(F.lit(c).alias("k"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"))))
    cols = [(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    if not lost:
        return df.select(*cols, F.lit(None).cast("string").alias(column))
    found = F.filter(F.array(*lost), lambda x: x.isNotNull())
    # {"k":"...","v":...}: the value as it stands in its own JSON object
    parts = F.transform(found, lambda x: F.concat(F.to_json(F.struct(x["k"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["k"].alias("k")))) - 6), F.lit(":"), x["v"].substr(F.lit(6), F.length(x["v"]) - 6)))
    return df.select(*cols, F.when(F.size(found) > 0, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).alias(column))
