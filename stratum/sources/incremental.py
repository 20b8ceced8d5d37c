"""Incremental loading of files: by a ledger, or as a stream with a schema that evolves."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.table import VersionedTable

MODES = ("addNewColumns", "rescue", "failOnNewColumns", "none")


class UnknownFields(RuntimeError):
    """New fields were met. In mode addNewColumns they are now recorded: run again."""

    def __init__(self, fields: list[str]):
        super().__init__(f"new fields: {fields}")
        self.fields = fields


#: Files that one commit loads at most, and distinct field names of a batch.
MAX_FILES, MAX_FIELDS = 1000, 10_000
#: Text that no schema holds.
CORRUPT = "_corrupt_record"


def copy_into(spark: SparkSession, target: VersionedTable, path: str, read: Callable[[list[str]], DataFrame], *, select: list[str] | None = None, force: bool = False, pattern: str | None = None, max_files: int = MAX_FILES) -> dict[str, int]:
    """Load the files under ``path`` that were not loaded before; {files, rows}.

    Files are listed without being read; those in the target's own list of
    loaded paths are left out by an anti join. ``read`` is given the paths of at
    most ``max_files`` new files at a time; their rows and paths are one commit,
    so a crash loads nothing twice. ``select`` are SQL expressions over them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (found.option("pathGlobFilter", pattern) if pattern else found).load(path).select("path")
    if not force:
        found = found.join(target.loaded(), "path", "left_anti")
    files = rows = 0
    held: list[str] = []

    def load() -> int:
        df = read(held)
        df = df.select(*map(F.expr, select)) if select else df
        return target.append(df, ledger=spark.createDataFrame([(p,) for p in held], "path string")).metrics["numOutputRows"]

    for r in found.orderBy("path").toLocalIterator():
        held.append(r.path)
        if len(held) >= max_files:
            files, rows, held = files + len(held), rows + load(), []
    if held:
        files, rows = files + len(held), rows + load()
    return {"files": files, "rows": rows}


class SchemaRegistry:
    """The schema a stream has learned so far, in a versioned log of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def get(self) -> T.StructType | None:
        if not self.table.exists():
            return None
        return T.StructType.fromJson(json.loads(self.table.commit_of().properties["schema"]))

    def put(self, schema: T.StructType) -> None:
        if not self.table.exists():
            self.table.create(T.StructType([]), properties={"schema": schema.json()})
        else:
            self.table.set_properties(schema=schema.json())


def load_stream(
    spark: SparkSession,
    path: str,
    *,
    kind: str,
    registry: SchemaRegistry,
    target: VersionedTable,
    checkpoint: str,
    mode: str = "addNewColumns",
    hints: T.StructType | None = None,
    max_files: int | None = None,
    options: dict[str, str] | None = None,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    once: bool = False,
) -> object:
    """Load new JSON or CSV files into a table and end; the query that ran.

    The schema is ``hints`` or is inferred on the first run, then kept in the
    registry. Fields beyond it: ``addNewColumns`` stops, records them as text
    and expects to be run again; ``rescue`` puts them, and values of a wrong
    type, into ``_rescued_data``; ``failOnNewColumns`` stops; ``none`` ignores
    them. Text that cannot be parsed is never lost: it is in ``_rescued_data``
    under ``_corrupt_record`` when rescuing, else in a column of that name.

    Files are streamed by name and read by Spark's own readers, CSV files of
    equal headers together, so quoted line breaks hold. A batch's rows and its
    number are one commit; a batch that was committed is not loaded again.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if kind not in ("json", "csv"):
        raise ValueError(f"kind {kind!r} is neither json nor csv")
    schema = registry.get()
    if schema is None:
        reader = spark.read.options(**(options or {}))
        schema = hints or (reader.json(path).schema if kind == "json" else reader.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path).schema)
        registry.put(schema)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if not once:
        stream = stream.option("maxFilesPerTrigger", max_files or MAX_FILES)
    names = stream.load(path).select("path")

    def write(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # a trigger's files, which the source lists too
        if not paths:
            return
        raw = _json_rows(spark, paths) if kind == "json" else _csv_rows(spark, paths, options or {})
        known = {f.name for f in schema}
        if mode in ("addNewColumns", "failOnNewColumns"):
            found = raw.select(F.explode(F.map_keys("_all")).alias("k")).distinct().filter(~F.col("k").isin(*known)).limit(MAX_FIELDS + 1)
            fresh = sorted(r["k"] for r in found.collect())
            if len(fresh) > MAX_FIELDS:
                raise ValueError(f"more than {MAX_FIELDS} new fields: keys that are data, not names?")
            if fresh:
                if mode == "addNewColumns":
                    registry.put(T.StructType([*schema.fields, *[T.StructField(n, T.StringType()) for n in fresh]]))
                raise UnknownFields(fresh)
        kept = _rescued(schema).alias("_rescued_data") if mode == "rescue" else F.col("_bad").alias(CORRUPT)
        rows = raw.select(*[_typed(F.col("_all")[f.name], f.dataType).alias(f.name) for f in schema], "_file", kept)
        target.append(enrich(rows) if enrich else rows, merge_schema=True, batch=(checkpoint, number))

    trigger = {"once": True} if once else {"availableNow": True}
    query = names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    query.awaitTermination()
    return query


def _json_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Each object as a map from field to its JSON text; ``_bad`` is a line that is no object."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    parsed = F.from_json(F.col("value"), "map<string,string>")
    # An object that breaks off is parsed in part: only the strict parser tells.
    whole = F.col("_all").isNotNull() & F.expr("try_parse_json(value)").isNotNull()
    rows = lines.withColumn("_all", parsed).withColumn("_whole", whole)
    nothing = F.create_map().cast("map<string,string>")
    return rows.select(F.when(F.col("_whole"), F.col("_all")).otherwise(nothing).alias("_all"), F.when(~F.col("_whole"), F.col("value")).alias("_bad"), "_file")


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The names in the first record of a CSV file, which is all that is read of it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        text = ""
        while (line := lines.readLine()) is not None:
            text += ("\n" if text else "") + line
            if text.strip() and text.count('"') % 2 == 0:
                break
    finally:
        stream.close()
    return [n.strip() for n in next(csv.reader(io.StringIO(text.removeprefix("\ufeff")), delimiter=sep), [])]


def _csv_rows(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """Rows as maps from header to text; ``_bad`` is a record of other than the header's fields."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        names = _header(spark, p, options.get("sep", ","))
        if len(set(names)) < len(names):
            raise ValueError(f"repeated names in the header of {p}")
        by_header.setdefault(tuple(names), []).append(p)
    out = None
    for names, some in by_header.items():
        cells = [f"_c{k}" for k in range(len(names))]
        fixed = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_bad"]])
        rows = spark.read.schema(schema).options(**({k: str(v) for k, v in fixed.items()} | options)).csv(some).select("*", F.col("_metadata.file_path").alias("_file"))
        pairs = [x for c, n in zip(cells, names, strict=True) for x in (F.lit(n), F.col(c))]
        part = rows.select((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("_all"), "_bad", "_file")
        out = part if out is None else out.unionByName(part)
    return out


def _typed(text: object, kind: T.DataType) -> object:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(text, kind)
    return text.try_cast(kind)


def _rescued(schema: T.StructType) -> object:
    """JSON of the entries of ``_all`` that the schema does not hold, and of text that
    could not be parsed; null if none."""
    types = {f.name: f.dataType for f in schema}
    keep = F.map_filter("_all", lambda k, v: v.isNotNull() & _misfit(k, v, types))
    bad = F.map_filter(F.create_map(F.lit(CORRUPT), F.col("_bad")), lambda k, v: v.isNotNull())
    every = F.map_concat(F.map_filter(keep, lambda k, v: k != CORRUPT), bad)
    return F.when(F.size(every) > 0, F.to_json(every))


def _misfit(key: object, value: object, types: dict[str, T.DataType]) -> object:
    out = ~key.isin(*types) if types else F.lit(True)
    for name, kind in types.items():
        if not isinstance(kind, T.StringType):
            out = out | ((key == name) & _typed(value, kind).isNull())
    return out


def load_until_settled(load: Callable[[], object], *, retries: int | None = None) -> object:
    """Run a load; on new columns, which are then recorded, run it again: until there
    are no more, or up to ``retries`` times."""
    attempt, last = 0, None
    while True:
        try:
            return load()
        except Exception as e:  # noqa: BLE001 - the stream wraps what its batch raised
            found = re.search(r"new fields: \[.*?\]", str(e), re.S)
            # The same fields twice: recording them did not help.
            if attempt == retries or not found or found[0] == last:
                raise
            attempt, last = attempt + 1, found[0]
