"""Sharding by histogram sort.

Rows are ordered by (hash of text, hash of doc_id), so equal texts stand
together. To find the keys that cut this order into shards of equal bytes, the
bytes below candidate keys are counted exactly across all partitions; around
each target the probes are refined, 256 at a time, until a splitter is within
tolerance. Then rows move once. Only DataFrame functions are used.

Groups are equal texts. A splitter goes to the nearest border of a group; only
a group too large for that is cut, between two of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch

#: Bytes that every row has besides its text.
ROW_BYTES = 16
#: Deviation of a splitter from its target, in shards, that ends refinement.
TOLERANCE = 0.0005
#: Size of a group of equal texts, in shards, from which it may be cut: a smaller one
#: moves a splitter by half of that at most.
LARGE_GROUP = 0.1
#: Bytes of rows that a file of a shard holds, about.
FILE_BYTES = 128 << 20
_BITS = 8
_LOW = -(1 << 63)


@dataclass
class _Open:
    """A target of which the key is known to lie in one bucket so far."""

    splitter: int
    target: float
    below: int
    first: int | None  # the text hash, once the search is on the second hash
    prefix: int | None  # of the bucket, by its high bits
    bits: int  # of the prefix


def _bucket(col: str, bits: int) -> Column:
    return F.shiftright(F.col(col), 64 - bits)


def find_splitters(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """The least (k1, k2) of shards 1 to n-1, from ``k1, k2, size``.

    Each round is one aggregation; the driver gets at most 256 counts for each
    splitter that is still open.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    end = (1 << 63, _LOW)
    out = [end] * (shards - 1)
    if not total:
        return out
    share = total / shards
    todo = [_Open(i, (i + 1) * share, 0, None, None, 0) for i in range(shards - 1)]
    while todo:
        later: list[_Open] = []
        for on_second in (False, True):
            some = [o for o in todo if (o.first is not None) == on_second]
            for bits in sorted({o.bits for o in some}):
                later += _refine(keys, [o for o in some if o.bits == bits], bits, on_second, share, out)
        todo = later
    return out


def _refine(keys: DataFrame, some: list[_Open], bits: int, on_second: bool, share: float, out: list) -> list[_Open]:
    col, more = ("k2", bits + _BITS) if on_second else ("k1", bits + _BITS)
    part = keys.filter(F.col("k1").isin(sorted({o.first for o in some}))) if on_second else keys
    if bits:
        part = part.filter(_bucket(col, bits).isin(sorted({o.prefix for o in some})))
    by = [F.col("k1").alias("first")] if on_second else []
    rows = part.groupBy(*by, _bucket(col, more).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: r["b"]):
        found.setdefault((r["first"] if on_second else None, r["b"] >> _BITS if bits else None), []).append(r)
    later = []
    for o in some:
        below, buckets = o.below, found[o.first, o.prefix]
        for r in buckets:
            if below + r["size"] >= o.target or r is buckets[-1]:
                break
            below += r["size"]
        before, after = o.target - below, below + r["size"] - o.target
        near = min(before, after)
        start = (o.first, r["b"] << (64 - more)) if on_second else (r["b"] << (64 - more), _LOW)
        stop = (o.first, (r["b"] + 1) << (64 - more)) if on_second else ((r["b"] + 1) << (64 - more), _LOW)
        one_text = r["lo"] == r["hi"]
        small = one_text and not on_second and near <= LARGE_GROUP / 2 * share
        # A bucket's border cuts no group: buckets are by the text's hash, or within a group to be cut.
        if near <= TOLERANCE * share or r["n"] == 1 or small or (one_text and r["lo2"] == r["hi2"]) or (on_second and more >= 64):
            out[o.splitter] = start if before <= after else stop
        elif on_second:
            later.append(_Open(o.splitter, o.target, below, o.first, r["b"], more))
        elif one_text or more >= 64:
            later.append(_Open(o.splitter, o.target, below, r["lo"], None, 0))
        else:
            later.append(_Open(o.splitter, o.target, below, None, r["b"], more))
    return later


def _shard_of(splitters: list[tuple[int, int]], k1: Column, k2: Column) -> Column:
    out = F.lit(0)
    for a, b in splitters:
        if a < 1 << 63:
            # a second key past the largest: the next text hash
            at = k1 > a if b >= 1 << 63 else (k1 > a) | ((k1 == a) & (k2 >= b))
            out = out + F.when(at, 1).otherwise(0)
    return out


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a row's (k1, k2)."""
    return _shard_of(splitters, F.col("k1"), F.col("k2"))


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _splitters(scratch: Scratch, docs: DataFrame, shards: int, text: str, doc_id: str) -> list[tuple[int, int]]:
    keys = docs.select(F.xxhash64(docs[text]).alias("k1"), F.xxhash64(docs[doc_id]).alias("k2"), _size(docs[text]).alias("size"))
    keys = scratch.save(keys, "keys")
    return find_splitters(keys, shards)


def _slots(scratch: Scratch, keys: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and a gapless ``slot`` in it, from k1 and k2 besides."""
    # Slots are dealt in sections of a shard, so that no task holds a whole one.
    sections = max(64, keys.count() // (shards * 50_000))
    placed = keys.withColumn("section", F.pmod(F.xxhash64("k1", "k2", "size"), F.lit(sections)))
    counts = placed.groupBy("shard", "section").agg(F.count("*").alias("n"))
    before = counts.select("shard", "section", (F.sum("n").over(Window.partitionBy("shard").orderBy("section")) - F.col("n")).alias("before"))
    before = scratch.save(before, "before")  # at most shards x sections rows
    row = F.row_number().over(Window.partitionBy("shard", "section").orderBy("k1", "k2", "doc_id", "size"))
    numbered = placed.withColumn("row", row).join(F.broadcast(before) if shards * sections <= 500_000 else before, ["shard", "section"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("row") - 1).alias("slot"))


def _keyed(docs: DataFrame, text: str, doc_id: str, *more: Column) -> DataFrame:
    crc = F.coalesce(F.crc32(docs[text]), F.lit(0)).cast("long")
    return docs.select(docs[doc_id].alias("doc_id"), _size(docs[text]).alias("size"), crc.alias("text_crc32"), F.xxhash64(docs[text]).alias("k1"), F.xxhash64(docs[doc_id]).alias("k2"), *more)


def assign(docs: DataFrame, shards: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row: law ``bytes``.

    Sizes of shards differ from the mean by about the tolerance, half of the
    largest row or half of LARGE_GROUP shards, whichever is most. Equal texts
    stay in one shard unless they are larger than LARGE_GROUP shards and a
    border falls well inside them (:func:`cut_groups` counts those). Slots are gapless
    from 0. A null text has no bytes and crc32 0. Rows equal in text and doc_id
    share a key and stay together. An empty table gives no rows. Other columns
    are ignored; texts count whole.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    keys = scratch.save(_keyed(docs, text, doc_id), "rows")
    placed = keys.withColumn("shard", shard_of(find_splitters(keys, shards)))
    return _slots(scratch, placed, shards)


def cut_groups(docs: DataFrame, shards: int, *, text: str = "text", doc_id: str = "doc_id") -> int:
    """How many groups of equal texts are in more than one shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    keys = docs.select(F.xxhash64(docs[text]).alias("k1"), F.xxhash64(docs[doc_id]).alias("k2"))
    placed = keys.withColumn("shard", shard_of(_splitters(scratch, docs, shards, text, doc_id)))
    return placed.groupBy("k1").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).filter("a < b").count()


#: What :func:`write_shards` calls the folder of a shard.
FOLDER = "_shard"


def write_shards(docs: DataFrame, shards: int, path: str, *, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write whole rows as Parquet, a folder ``_shard=N`` for each shard that has rows.

    Rows move once, to files of about FILE_BYTES. All columns are kept; one
    called ``_shard`` raises. An empty table writes no rows.
    """
    if clash := {FOLDER, "_file"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    splitters = _splitters(scratch, docs, shards, text, doc_id)
    total = spark.read.parquet(f"{scratch.root}/keys").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    files = max(1, -(-total // (shards * FILE_BYTES)))
    # The keys are worked out in a struct, so that no column of the input is in their way.
    keys = F.transform(F.array(F.struct(F.xxhash64(docs[text]).alias("k1"), F.xxhash64(docs[doc_id]).alias("k2"))), lambda k: _shard_of(splitters, k["k1"], k["k2"]))
    placed = docs.withColumns({FOLDER: F.get(keys, 0), "_file": F.pmod(F.xxhash64(docs[text], docs[doc_id]), F.lit(files))})
    placed.repartition(shards * files, FOLDER, "_file").drop("_file").write.partitionBy(FOLDER).parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The rows that :func:`write_shards` wrote of ``docs``, with ``_shard int`` added."""
    return docs.sparkSession.read.schema(T.StructType([*docs.schema.fields, T.StructField(FOLDER, T.IntegerType())])).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved into shards 0 to 39 of near equal bytes, and what the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "shard-rows")
    write_shards(docs, 40, f"{scratch.root}/shards")
    rows = read_shards(docs, f"{scratch.root}/shards")
    keys = scratch.save(_keyed(rows, "text", "doc_id", rows[FOLDER].alias("shard")), "keys")
    out = _slots(scratch, keys, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
