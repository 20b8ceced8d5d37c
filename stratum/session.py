"""Session factory and settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

TRUE, FALSE = {"true", "1", "yes", "y"}, {"false", "0", "no", "n"}


def session(name: str = "stratum", *, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays on.

    Shuffle partitions are left to the cluster's setting, of which adaptive
    execution joins small ones.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def parse_bool(value: str | bool) -> bool:
    """true/1/yes/y and false/0/no/n in any case; anything else raises."""
    if isinstance(value, bool):
        return value
    word = str(value).strip().lower()
    if word in TRUE or word in FALSE:
        return word in TRUE
    raise ValueError(f"not a boolean: {value!r}")


def required(params: dict[str, str | None], *names: str) -> dict[str, str]:
    """The named parameters, stripped; raises with all that are missing or blank."""
    found = {n: (params.get(n) or "").strip() for n in names}
    if missing := sorted(n for n, v in found.items() if not v):
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return found


def quote_ident(name: str) -> str:
    """A back-quoted identifier; each part of a dotted name by itself."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def quote_lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def safe_ident(name: str) -> str:
    """``name`` if it is a plain identifier; else raises."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


def normal_location(path: str) -> str:
    return path.strip().rstrip("/").lower()


@dataclass(frozen=True)
class EngineConfig:
    """Where a deployment keeps its layers; table names and paths follow from it."""

    root: str
    schema: str = "default"
    layers: tuple[str, ...] = field(default=("bronze", "silver", "gold"))

    def __post_init__(self) -> None:
        if not self.root.strip():
            raise ValueError("root is blank")
        safe_ident(self.schema)

    def path(self, layer: str, table: str) -> str:
        if layer not in self.layers:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.root.rstrip('/')}/{layer}/{safe_ident(table)}"

    def checkpoint(self, query: str) -> str:
        return f"{self.root.rstrip('/')}/_checkpoints/{safe_ident(query)}"

    def table(self, name: str) -> str:
        return f"{self.schema}.{safe_ident(name)}"

    @classmethod
    def from_spark(cls, spark: SparkSession, prefix: str = "stratum") -> EngineConfig:
        """From Spark settings ``<prefix>.root`` and ``<prefix>.schema``."""
        got = required({k: spark.conf.get(f"{prefix}.{k}", None) for k in ("root", "schema")}, "root", "schema")
        return cls(got["root"], got["schema"])
