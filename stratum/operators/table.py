"""A versioned table of Parquet files with atomic commits.

A commit writes its data to a folder of its own and then publishes the next log
entry. Every method that writes takes one commit as its base, reads that
version and publishes the one after it; if another writer did so meanwhile, it
raises and nothing is lost. An entry is written aside and then linked or renamed
to its name, so it is there whole or not at all: on a local file system by a
hard link, elsewhere by a rename that does not replace, which HDFS and its like
do in one step. Object stores without such a rename are not safe for several
writers.

An entry holds the folders that a commit added; every tenth, and each that
replaces rows, holds all of them. A merge, delete or type 2 change writes anew
only the files with a row it may change: of a folder with such files, later
versions list the other files one by one.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import change

#: Type changes that keep every value.
WIDENINGS = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double")}


class SchemaMismatch(ValueError):
    """A write whose columns or types the table does not take."""


class ConcurrentCommit(RuntimeError):
    """Another writer committed first."""


@dataclass
class Commit:
    version: int
    timestamp_ms: int
    operation: str
    schema: str
    #: Folders, and files of folders of which some files were replaced.
    folders: list[str]
    metrics: dict[str, int] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    #: Logical column to the name in the files, where they differ.
    physical: dict[str, str] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    #: Folders this commit appended; None if it replaced the data.
    added: list[str] | None = None
    #: The last batch of each application that appends in numbered batches.
    batches: dict[str, int] = field(default_factory=dict)
    #: Folders with the paths of source files that were loaded.
    ledger: list[str] = field(default_factory=list)


#: Entries after which the folders are listed in full again.
CHECKPOINT = 10
#: End of the name of a folder that holds partitions by column.
_PARTITIONED = "-p"
#: A file of the table in a path that Spark reports, and the column that tells it.
_FILE = re.compile(rf"/(data-[0-9a-f]{{32}}(?:{_PARTITIONED})?/.*)$")
_AT = "__file"


class VersionedTable:
    """A table at a path. Methods that write return the commit they made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    # -- log ---------------------------------------------------------------
    def _log_path(self, version: int) -> object:
        return self._Path(f"{self.path}/_log/{version:020d}.json")

    def _listed(self) -> list[int]:
        at = self._Path(f"{self.path}/_log")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _entry(self, version: int) -> dict | None:
        """A log entry; None if it is torn, as no commit of ours can be."""
        stream = self._fs.open(self._log_path(version))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def versions(self) -> list[int]:
        return [v for v in self._listed() if self._entry(v) is not None]

    def exists(self) -> bool:
        return any(self._entry(v) is not None for v in reversed(self._listed()))

    def commit_of(self, version: int | None = None) -> Commit:
        """A commit, the latest by default, with all folders of its version."""
        have = self._listed()
        wanted = reversed(have) if version is None else [version] if version in have else []
        entry = next((e for v in wanted if (e := self._entry(v)) is not None), None)
        if entry is None:
            if version is not None and have:
                raise ValueError(f"no version {version}; there are {have[0]} to {have[-1]}")
            raise FileNotFoundError(f"no table at {self.path}")
        entry["properties"] = dict(entry["properties"])
        tail, at, later = [], entry, entry["version"]
        while at["folders"] is None:  # at most CHECKPOINT entries back
            tail = [*at["added"], *tail]
            later = at["base"]
            at = self._entry(later)
        entry["folders"] = [*at["folders"], *tail]
        entry.pop("base", None)
        return Commit(**entry)

    def _base(self) -> Commit | None:
        return self.commit_of() if self.exists() else None

    def _write_log(self, commit: Commit, base: Commit | None) -> Commit:
        # A torn entry keeps its number.
        torn = [v for v in self._listed() if v >= commit.version and self._entry(v) is None]
        if torn:
            commit.version = torn[-1] + 1
        entry = asdict(commit) | {"base": base.version if base else None}
        if commit.added is not None and commit.version % CHECKPOINT:
            entry["folders"] = None
        self._publish(json.dumps(entry).encode(), self._log_path(commit.version), commit.version)
        return commit

    def _publish(self, data: bytes, where: object, version: int) -> None:
        taken = ConcurrentCommit(f"version {version} was committed by another writer")
        name = f"{self.path}/_log/.{uuid.uuid4().hex}.tmp"
        if self._fs.getScheme() == "file":
            aside, place = (self._Path(x).toUri().getPath() for x in (name, where.toString()))
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(aside, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(aside, place)
            except FileExistsError as e:
                raise taken from e
            finally:
                os.unlink(aside)
            return
        out = self._fs.create(self._Path(name), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._Path(name), where, none)
        except Exception as e:
            self._fs.delete(self._Path(name), False)
            if "exist" in str(e):
                raise taken from e
            raise

    def _next(self, operation: str, base: Commit | None, *, schema: T.StructType, folders: list[str], metrics: dict[str, int], **changes: object) -> Commit:
        names = ("properties", "physical", "not_null", "batches", "ledger")
        keep = {n: getattr(base, n) for n in names} if base else {}
        return self._write_log(Commit(base.version + 1 if base else 0, int(time.time() * 1000), operation, schema.json(), folders, metrics, **(keep | changes)), base)

    def _folder(self, df: DataFrame, *, cluster: list[str] | None = None, files: int | None = None, partition_by: list[str] | None = None) -> str:
        name = f"data-{uuid.uuid4().hex}{_PARTITIONED if partition_by else ''}"
        if cluster:
            df = (df.repartitionByRange(files, *cluster) if files else df.repartitionByRange(*cluster)).sortWithinPartitions(*cluster)
        elif files:
            df = df.repartition(files)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return name

    # -- reading -----------------------------------------------------------
    @staticmethod
    def _schema(commit: Commit) -> T.StructType:
        return T.StructType.fromJson(json.loads(commit.schema))

    def schema(self, version: int | None = None) -> T.StructType:
        return self._schema(self.commit_of(version))

    def _rows(self, commit: Commit, folders: list[str] | None = None, *, located: bool = False) -> DataFrame:
        """The rows of a commit's folders by its stored schema: one scan, and one more for each
        partitioned folder. Columns that older files lack are null, narrower ones widened.
        ``located`` adds the path of each row's file."""
        schema = self._schema(commit)
        stored = T.StructType([T.StructField(commit.physical.get(f.name, f.name), f.dataType) for f in schema])
        out, scans = None, {}
        for f in commit.folders if folders is None else folders:
            top = f.split("/")[0]
            scans.setdefault(top if top.endswith(_PARTITIONED) else None, []).append(f"{self.path}/{f}")
        for top, paths in scans.items():
            reader = self.spark.read.schema(stored)
            if top:
                reader = reader.option("basePath", f"{self.path}/{top}")
            extra = [F.col("_metadata.file_path").alias(_AT)] if located else []
            part = reader.parquet(*paths).select(*[F.col(f"`{p.name}`").alias(f.name) for p, f in zip(stored, schema, strict=True)], *extra)
            out = part if out is None else out.unionByName(part)
        if out is not None:
            return out
        none = [T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(_AT, T.StringType())] * located
        return self.spark.createDataFrame([], T.StructType(none))

    def _files(self, entry: str) -> Iterator[tuple[str, object]]:
        """(name within the table, status) of the data files of a folder or file."""
        it = self._fs.listFiles(self._Path(f"{self.path}/{entry}"), True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().endswith(".parquet"):
                yield _FILE.search(s.getPath().toString())[1], s

    def _part(self, base: Commit, hit: DataFrame) -> tuple[list[str], list[str]]:
        """(files that hold one of the located rows ``hit``, all else of the version)."""
        found = {_FILE.search(unquote(r[0]))[1] for r in hit.select(_AT).distinct().collect()}
        tops, rest = {f.split("/")[0] for f in found}, []
        for f in base.folders:
            rest += [f] if f.split("/")[0] not in tops else [name for name, _ in self._files(f) if name not in found]
        return sorted(found), rest

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest by default."""
        return self._rows(self.commit_of(version))

    def appended(self, after: int) -> list[tuple[int, DataFrame]]:
        """(version, rows) of the appends later than a version; a rewrite adds no rows."""
        commits = [self.commit_of(v) for v in self._listed() if v > after and self._entry(v) is not None]
        return [(c.version, self._rows(c, c.added)) for c in commits if c.added]

    def loaded(self, commit: Commit | None = None) -> DataFrame:
        """(path) of the source files that were loaded."""
        commit = commit or self._base()
        if not commit or not commit.ledger:
            return self.spark.createDataFrame([], "path string")
        return self.spark.read.schema("path string").parquet(*[f"{self.path}/{f}" for f in commit.ledger])

    def as_of(self, timestamp_ms: int) -> DataFrame:
        """The table as it was at an instant."""
        at = [v for v in self.versions() if self.commit_of(v).timestamp_ms <= timestamp_ms]
        if not at:
            raise ValueError("the table is younger than that")
        return self.read(at[-1])

    def history(self) -> DataFrame:
        """version, timestamp, operation, metrics and properties, newest first."""
        rows = [(c.version, c.timestamp_ms, c.operation, c.metrics, c.properties) for c in (self.commit_of(v) for v in reversed(self.versions()))]
        df = self.spark.createDataFrame(rows, "version long, ms long, operation string, operationMetrics map<string,long>, properties map<string,string>")
        return df.select("version", F.timestamp_millis("ms").alias("timestamp"), "operation", "operationMetrics", "properties")

    def latest_metrics(self) -> dict[str, object]:
        c = self.commit_of()
        return {"version": c.version, "operation": c.operation, **c.metrics}

    def detail(self, commit: Commit | None = None) -> dict[str, object]:
        """Files, bytes, columns and properties of the current version."""
        c = commit or self.commit_of()
        files = size = 0
        for folder in c.folders:
            for _, s in self._files(folder):
                files, size = files + 1, size + s.getLen()
        return {"location": self.path, "version": c.version, "numFiles": files, "sizeInBytes": size, "properties": c.properties, "clusteringColumns": [x for x in c.properties.get("clusterBy", "").split(",") if x]}

    # -- writing -----------------------------------------------------------
    def create(self, schema: T.StructType, *, not_null: list[str] | None = None, properties: dict[str, str] | None = None) -> Commit:
        """An empty table; raises if there is one."""
        if self.exists():
            raise FileExistsError(self.path)
        required = sorted({*(not_null or []), *(f.name for f in schema if not f.nullable)})
        return self._next("CREATE TABLE", None, schema=schema, folders=[], metrics={}, properties=properties or {}, not_null=required)

    def _check_nulls(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Rows as they are; a null where none may be fails the write that reads them."""
        for n in names:
            if n in df.columns:
                df = df.withColumn(n, F.when(F.col(n).isNull(), F.raise_error(F.lit(f"NOT NULL constraint violated by {n}")).cast(df.schema[n].dataType)).otherwise(F.col(n)))
        return df

    def _stats(self, folder: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{folder}").count()

    def _ours(self, df: DataFrame, commit: Commit) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(commit.physical.get(c, c)) for c in df.columns])

    def overwrite(
        self,
        df: DataFrame,
        *,
        overwrite_schema: bool = False,
        operation: str = "WRITE",
        metrics: dict[str, int] | None = None,
        partition_by: list[str] | None = None,
        cluster: list[str] | None = None,
        files: int | None = None,
        properties: dict[str, str] | None = None,
        **changes: object,
    ) -> Commit:
        """Replace all rows, or create the table; other columns need ``overwrite_schema``."""
        base = self._base()
        schema, physical, required = df.schema, {}, []
        if base and not overwrite_schema:
            schema, physical, required = self._schema(base), base.physical, base.not_null
            df = self._conform(df, schema)
        df = self._check_nulls(df, required)
        names = df.select(*[F.col(f"`{c}`").alias(physical.get(c, c)) for c in df.columns])
        folder = self._folder(names, partition_by=partition_by, cluster=cluster, files=files)
        counts = metrics or {"numOutputRows": self._stats(folder)}
        if properties:
            changes["properties"] = (base.properties if base else {}) | properties
        return self._next(operation, base, schema=schema, folders=[folder], metrics=counts, physical=physical, not_null=required, **changes)

    def create_as(self, df: DataFrame, *, properties: dict[str, str] | None = None, partition_by: list[str] | None = None, cluster: list[str] | None = None) -> Commit:
        """A new table with the rows of a query; raises if there is one."""
        if self.exists():
            raise FileExistsError(self.path)
        return self.overwrite(df, operation="CREATE TABLE AS SELECT", properties=properties, partition_by=partition_by, cluster=cluster)

    def _conform(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """``df`` in the table's columns and types; raises if it has others."""
        have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in schema}
        if extra := sorted(set(have) - set(want)):
            raise SchemaMismatch(f"columns the table lacks: {extra}")
        if wrong := sorted(f"{c}: {have[c]} for {want[c]}" for c in have if have[c] != want[c] and (have[c], want[c]) not in WIDENINGS):
            raise SchemaMismatch(f"types differ: {wrong}")
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, df: DataFrame, *, merge_schema: bool = False, batch: tuple[str, int] | None = None, ledger: DataFrame | None = None, base: Commit | None = None) -> Commit:
        """Add rows. Extra columns and other types are refused before anything is
        written, unless ``merge_schema`` adds the column or widens the type.

        ``batch`` (application, number) is kept in the same commit; a number that
        was committed before adds nothing. So are the paths in ``ledger``.
        """
        base = base or self._base()
        done = {}
        if batch:
            if base and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            done["batches"] = (base.batches if base else {}) | {batch[0]: batch[1]}
        if ledger is not None:
            name = f"ledger-{uuid.uuid4().hex}"
            ledger.select("path").write.parquet(f"{self.path}/{name}")
            done["ledger"] = [*(base.ledger if base else []), name]
        if base is None:
            return self.overwrite(df, operation="WRITE", **done)
        schema, physical = self._schema(base), dict(base.physical)
        if merge_schema:
            old, schema = set(schema.names), merged_schema(schema, df.schema)
            for name in set(schema.names) - old:
                if name in self._taken(base):
                    physical[name] = f"{name}_{uuid.uuid4().hex[:8]}"
        df = self._check_nulls(self._conform(df, schema), base.not_null)
        names = df.select(*[F.col(f"`{c}`").alias(physical.get(c, c)) for c in df.columns])
        folder = self._folder(names)
        return self._next("WRITE", base, schema=schema, folders=[*base.folders, folder], added=[folder], metrics={"numOutputRows": self._stats(folder)}, physical=physical, **done)

    @staticmethod
    def _taken(commit: Commit) -> set[str]:
        """Names in the files that belong to renamed or dropped columns."""
        return {v for k, v in commit.physical.items() if k != v} | set(commit.properties.get("droppedColumns", "").split(","))

    def _replace(self, base: Commit, rest: list[str], rows: DataFrame, operation: str, counted: dict[str, str], column: str) -> Commit:
        """Commit rows that tell in ``column`` what happened to them, beside the files
        that stay; counts come from the written files, so the plan runs once."""
        data = self._check_nulls(rows, base.not_null)
        tagged = data.select(*[F.col(f"`{c}`").alias(base.physical.get(c, c)) for c in data.columns])
        folder = self._folder(tagged)
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        got = {r[0]: r[1] for r in written.groupBy(column).count().collect()}
        metrics = {name: got.get(value, 0) for value, name in counted.items()} | {"numOutputRows": sum(got.values())}
        return self._next(operation, base, schema=self._schema(base), folders=[*rest, folder], metrics=metrics)

    def merge(self, source: DataFrame, **how: object) -> Commit:
        """Upsert by :func:`stratum.operators.change.upsert`, as one commit.

        Files with a key of the source are written anew, the others stay. The
        source is computed for its keys first and again for its rows, so its keys
        must be the same each time.
        """
        base, keys = self.commit_of(), how["keys"]
        found, rest = self._part(base, self._rows(base, located=True).join(source.select(*keys), keys, "left_semi"))
        rows = change.upsert(source, self._rows(base, found), **how)
        return self._replace(base, rest, rows, "MERGE", {change.INSERT: "numTargetRowsInserted", change.UPDATE: "numTargetRowsUpdated"}, "_change")

    def insert_new(self, source: DataFrame, keys: list[str]) -> Commit:
        """Append the rows whose key is new: replaying a load adds none."""
        base = self.commit_of()
        return self.append(change.insert_only(source, self._rows(base), keys=keys), base=base)

    def scd2(self, source: DataFrame, **how: object) -> dict[str, int]:
        """Apply type 2 changes in one commit; {closed_rows, inserted_rows}.

        Files with the current row of a key of the source are written anew.
        """
        base, key = self.commit_of(), how["key"]
        found, rest = self._part(base, self._rows(base, located=True).filter("is_current").join(source.select(key), key, "left_semi"))
        rows = change.scd2(source, self._rows(base, found), **how)
        m = self._replace(base, rest, rows, "MERGE", {"CLOSED": "numTargetRowsUpdated", "INSERTED": "numTargetRowsInserted"}, "_change").metrics
        return {"closed_rows": m["numTargetRowsUpdated"], "inserted_rows": m["numTargetRowsInserted"]}

    def delete(self, predicate: str) -> Commit:
        """Delete rows for which the predicate is true; null keeps a row.

        Only files with such a row are written anew; numOutputRows counts their
        other rows.
        """
        base = self.commit_of()
        gone = F.coalesce(F.expr(predicate), F.lit(False))
        found, rest = self._part(base, self._rows(base, located=True).filter(gone))
        old = self._rows(base, found)
        folder = self._folder(self._ours(old.filter(~gone), base))
        after = self._stats(folder)
        return self._next("DELETE", base, schema=self._schema(base), folders=[*rest, folder], metrics={"numDeletedRows": old.count() - after, "numOutputRows": after})

    # -- schema ------------------------------------------------------------
    def rename_column(self, old: str, new: str) -> Commit:
        """Rename without rewriting: files keep the name they have."""
        base = self.commit_of()
        schema = self._schema(base)
        if old not in schema.names or new in schema.names:
            raise SchemaMismatch(f"cannot rename {old} to {new}")
        fields = [T.StructField(new, f.dataType, f.nullable) if f.name == old else f for f in schema]
        physical = {k: v for k, v in base.physical.items() if k != old} | {new: base.physical.get(old, old)}
        return self._next("RENAME COLUMN", base, schema=T.StructType(fields), folders=base.folders, metrics={}, physical=physical, not_null=[new if c == old else c for c in base.not_null])

    def drop_column(self, name: str) -> Commit:
        """Drop without rewriting; a later column of the name starts empty."""
        base = self.commit_of()
        schema = self._schema(base)
        if name not in schema.names:
            raise SchemaMismatch(f"no column {name}")
        hidden = {k: v for k, v in base.physical.items() if k != name}
        dropped = ",".join(sorted({*filter(None, base.properties.get("droppedColumns", "").split(",")), base.physical.get(name, name)}))
        return self._next("DROP COLUMN", base, schema=T.StructType([f for f in schema if f.name != name]), folders=base.folders, metrics={}, physical=hidden, properties=base.properties | {"droppedColumns": dropped}, not_null=[c for c in base.not_null if c != name])

    def add_column(self, name: str, kind: str) -> Commit:
        base = self.commit_of()
        schema = self._schema(base)
        if name in schema.names:
            raise SchemaMismatch(f"there is a column {name}")
        field_ = T.StructField(name, T._parse_datatype_string(kind))
        return self._next("ADD COLUMN", base, schema=T.StructType([*schema.fields, field_]), folders=base.folders, metrics={}, physical=base.physical | {name: f"{name}_{uuid.uuid4().hex[:8]}"})

    def set_properties(self, **properties: str) -> Commit:
        base = self.commit_of()
        return self._next("SET TBLPROPERTIES", base, schema=self._schema(base), folders=base.folders, metrics={}, properties=base.properties | properties)

    # -- maintenance -------------------------------------------------------
    def fingerprint(self, version: int | None = None) -> tuple[int, int]:
        from stratum.functions.scalar import fingerprint

        df = self.read(version)
        r = df.agg(F.count("*"), F.coalesce(fingerprint(df), F.lit(0).cast("decimal(38,0)"))).first()
        return r[0], int(r[1])

    def compact(self, files: int, *, cluster: list[str] | None = None) -> Commit:
        """Rewrite into about ``files`` files, in the order of ``cluster`` if given."""
        base = self.commit_of()
        before = self.detail(base)["numFiles"]
        physical = [base.physical.get(c, c) for c in cluster or []]
        folder = self._folder(self._ours(self._rows(base), base), cluster=physical or None, files=files)
        props = base.properties | ({"clusterBy": ",".join(cluster)} if cluster else {})
        return self._next("OPTIMIZE", base, schema=self._schema(base), folders=[folder], metrics={"numRemovedFiles": before, "numOutputRows": self._stats(folder)}, properties=props)

    def vacuum(self, *, retain_hours: float = 168, dry_run: bool = True, enforce: bool = True) -> list[str]:
        """Folders, and files of folders, that no version of the retention time
        needs; deleted unless dry."""
        if enforce and retain_hours < 168:
            raise ValueError("retention below 168 hours")
        now, have = time.time() * 1000, self.versions()
        since = now - retain_hours * 3_600_000
        commits = [self.commit_of(v) for v in have]
        live = {f for i, c in enumerate(commits) if i == len(commits) - 1 or commits[i + 1].timestamp_ms >= since for f in [*c.folders, *c.ledger]}
        partly = {f.split("/")[0] for f in live} - live
        gone = []
        for s in self._fs.listStatus(self._Path(self.path)):
            name = s.getPath().getName()
            if name in partly:
                gone += [(f, x.getPath()) for f, x in self._files(name) if f not in live and x.getModificationTime() <= since]
            elif name.startswith(("data-", "ledger-")) and name not in live and s.getModificationTime() <= since:
                gone.append((name, s.getPath()))
        if not dry_run:
            for name, path in gone:
                self._fs.delete(path, True)
        return sorted(name for name, _ in gone)


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns, widened where the new type is wider, then the added ones."""
    given, fields = {f.name: f for f in new}, []
    for f in old:
        g = given.get(f.name)
        if g and (f.dataType.simpleString(), g.dataType.simpleString()) in WIDENINGS:
            f = T.StructField(f.name, g.dataType, f.nullable)
        fields.append(f)
    return T.StructType([*fields, *[T.StructField(f.name, f.dataType, True) for f in new if f.name not in old.names]])
