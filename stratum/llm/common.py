"""Shared plumbing of the training-data operators: scratch tables, Arrow
grouping and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) a temporary folder is
    made and set; on a cluster its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratum-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: a lost executor costs at most the stage
    that was running. ``drop`` removes tables that no later plan reads; the
    rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, where: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")


#: Bytes of an Arrow batch between the JVM and Python, where the session says nothing.
BATCH_BYTES = 8 << 20


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system.

    Workers live on for other tasks; what one operator held would count
    against the next one's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, as rows may hold very long
    texts, and workers that shrink when a task ends."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split key-sorted Arrow batches into one table per key."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            col = table.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(change)
        first = tuple(table.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        bounds = [0, *starts.tolist(), table.num_rows]
        for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
            held.append(table.slice(a, b - a))
            yield pa.concat_tables(held)
            held = []
        held.append(table.slice(bounds[-2], bounds[-1] - bounds[-2]))
        last = tuple(table.column(k)[table.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.concat_tables(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning-forest edges (indices) of the given pairs: never more than n-1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node on an edge ``a``-``b``; root is the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Every
    round is written to the shared folder. The joins read written tables on
    both sides, so adaptive execution can split a hub's rows.
    """
    spark = scratch.spark
    tidy = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(tidy(edges), f"{name}-0")
    state, k = None, 0
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0:
            break
        if state == tuple(seen):
            break
        state = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-l{k}")
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        mid = scratch.save(tidy(large), f"{name}-m{k}")
        low2 = scratch.save(mid.groupBy("a").agg(F.min("b").alias("m")), f"{name}-s{k}")
        small = mid.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        k += 1
        after = scratch.save(tidy(small), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-l{k - 1}", f"{name}-m{k - 1}", f"{name}-s{k - 1}")
        now = after
    if state is None:
        return spark.createDataFrame([], "node long, root long")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Bytes up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, width: int = 64, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, times ``width`` bytes allow it; else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def partitions(spark: SparkSession, size: int) -> int:
    """Partitions of about 64 MB of ``size``; the session's usual number at least.

    Named explicitly, as adaptive execution would merge small but slow ones.
    """
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // (64 << 20)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
