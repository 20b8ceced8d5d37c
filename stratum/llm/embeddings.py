"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label and length form a space, in which cosine c is the chord
sqrt(2 - 2c) of the unit sphere. The upper levels of the tree are cells, split
again and again by centres of their own until a cell is one block; a cell's
covering radius is the largest distance of a member to its centre. Pairs of
cells are walked level by level, and those farther apart than both radii plus
the chord are left out. A task gets the vectors of one surviving pair of
leaf cells, builds the lower levels, of nested centres with halving radii, and
walks on in the same way; what is left is compared exactly. Pairs of nodes that
lie whole within the chord are counted without comparing their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, connected_components, forest, groups, partitions, small_side

THRESHOLD = 0.98
#: Vectors of a block, and the most children that a cell is split into at a time.
BLOCK, FAN = 2048, 64
#: Rows of a cell that one task deals to the cell's children.
DEAL = 50_000
#: Levels of cells, after which a cell that cannot be split is dealt in blocks.
LEVELS = 12
#: Members below which a node of the tree is not divided.
LEAF = 8
#: Slack of distances for rounding.
SLACK = 1e-7


def unpack(raw: list[bytes], wide: list[bool]) -> np.ndarray:
    """Rows of doubles, each scaled by a power of two so that squares stay finite."""
    rows = np.stack([np.frombuffer(b, np.float64 if w else np.float32).astype(np.float64) for b, w in zip(raw, wide, strict=True)])
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chords between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, who, near): points more than ``radius`` apart that cover all; the
    first point is one. ``who`` is each point's nearest centre, ``near`` its distance."""
    centres, who, near = [0], np.zeros(len(points), dtype=np.int64), distances(points, points[:1])[:, 0]
    while len(far := np.flatnonzero(near > radius)):
        some = far[:256]
        apart, taken = distances(points[some], points[some]), []
        for k in range(len(some)):
            if not taken or apart[k, taken].min() > radius:
                taken.append(k)
        d = distances(points, points[some[taken]])
        best = d.argmin(axis=1)
        d = d[np.arange(len(points)), best]
        closer = d < near
        near[closer], who[closer] = d[closer], best[closer] + len(centres)
        centres += some[taken].tolist()
    return np.array(centres), who, near


class CoverTree:
    """Nested levels of centres with halving radii, over rows of unit vectors.

    ``order`` lists the rows so that a node's members are ``first`` to ``last``
    of it; the first of them is its centre, which its first child shares.
    """

    def __init__(self, unit: np.ndarray, members: np.ndarray):
        self.order = members.copy()
        self.first, self.last, self.radius, self.children = [0], [len(members)], [0.0], [None]
        todo = [(0, 2.0)]
        while todo:
            node, reach = todo.pop()
            a, b = self.first[node], self.last[node]
            own = self.order[a:b]
            points = unit[own]
            far = distances(points, points[:1])[:, 0]
            far[0] = 0.0
            self.radius[node] = float(far.max()) + SLACK
            if b - a <= LEAF or far.max() <= SLACK:
                continue
            while reach / 2 >= far.max():
                reach /= 2
            centres, who, near = net(points, reach / 2)
            near[centres] = -1.0  # a centre stands first
            sort = np.lexsort((near, who))
            self.order[a:b] = own[sort]
            edges = a + np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(centres)))))
            kids = range(len(self.first), len(self.first) + len(centres))
            self.children[node] = kids
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self.first.append(x), self.last.append(y), self.radius.append(0.0), self.children.append(None)
            todo += [(k, reach / 2) for k in kids]
        self.start, self.stop = np.array(self.first), np.array(self.last)
        self.reach = np.array(self.radius)
        self.centre = unit[self.order[self.start]] if len(members) else unit[:0]


class Links:
    """What a dual traversal found: links by row, edges that join them, and how
    many pairs it did not have to compare."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links, self.left, self.right = weight, np.zeros(len(weight), dtype=np.int64), [], []
        self.compared = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.weight[j])
        np.add.at(self.links, j, self.weight[i])
        if len(i):
            edges = forest(len(self.weight), i, j)
            self.left += [a for a, _ in edges]
            self.right += [b for _, b in edges]

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All rows of ``a`` link with all of ``b``, or with each other."""
        if b is None:
            self.links[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.links[a] += self.weight[b].sum()
            self.links[b] += self.weight[a].sum()
        every = a if b is None else np.concatenate((a, b))
        self.left += [int(every[0])] * (len(every) - 1)
        self.right += every[1:].tolist()


def dual_traversal(unit: np.ndarray, rows: np.ndarray, norms: np.ndarray, weight: np.ndarray, a: CoverTree, b: CoverTree, threshold: float) -> Links:
    """Links of cosine >= threshold between the rows of two trees, or within one."""
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    out, leaves, todo = Links(weight), [], [(0, 0)]

    def meet(xs: np.ndarray, ys: np.ndarray, upper: bool) -> None:
        """Pairs of nodes that are near enough, of which ``upper`` takes each once."""
        for at in range(0, len(xs), 512):
            some = xs[at : at + 512]
            i, j = np.nonzero(distances(a.centre[some], b.centre[ys]) <= a.reach[some][:, None] + b.reach[ys] + chord + SLACK)
            if upper:
                i, j = i[j >= i + at], j[j >= i + at]
            x, y = some[i], ys[j]
            flat = (a.stop[x] - a.start[x] <= LEAF) & (b.stop[y] - b.start[y] <= LEAF)
            leaves.append((x[flat], y[flat]))
            todo.extend(zip(x[~flat].tolist(), y[~flat].tolist(), strict=True))

    while todo:
        x, y = todo.pop()
        same = a is b and x == y
        p, q = a.order[a.start[x] : a.stop[x]], b.order[b.start[y] : b.stop[y]]
        apart = 0.0 if same else float(distances(a.centre[x : x + 1], b.centre[y : y + 1])[0, 0])
        if apart + (2 * a.reach[x] if same else a.reach[x] + b.reach[y]) <= chord - SLACK:
            out.whole(p, None if same else q)
            continue
        xs, ys = a.children[x], b.children[y]
        if xs is None and ys is None:
            leaves.append((np.array([x]), np.array([y])))
        else:
            meet(np.array(xs if xs is not None else [x]), np.array(ys if ys is not None else [y]), same)
    if not leaves:
        return out
    x, y = (np.concatenate(z) for z in zip(*leaves, strict=True))
    for at in range(0, len(x), 20_000):
        xs, ys = x[at : at + 20_000], y[at : at + 20_000]
        nx, ny = a.stop[xs] - a.start[xs], b.stop[ys] - b.start[ys]
        which = np.repeat(np.arange(len(xs)), nx * ny)
        place = np.arange(len(which)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
        s, t = a.start[xs][which] + place // ny[which], b.start[ys][which] + place % ny[which]
        if a is b:
            once = (xs[which] != ys[which]) | (s < t)
            s, t = s[once], t[once]
        i, j = a.order[s], b.order[t]
        out.compared += len(i)
        cos = np.concatenate([np.einsum("ij,ij->i", rows[i[k : k + 50_000]], rows[j[k : k + 50_000]]) for k in range(0, len(i), 50_000)] or [np.empty(0)]) / (norms[i] * norms[j])
        ok = cos >= threshold
        out.add(i[ok], j[ok])
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = batch.column("vec").type.value_type == pa.float64()
        out: list[tuple] = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("vec"), strict=True):
            raw = None
            if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy()
                x = x + x.dtype.type(0)  # minus zero is zero
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
            space = None if raw is None else f"{len(v.values)}:{label}"
            digest = None if raw is None else xxhash.xxh3_128_digest(space.encode() + b"\0" + raw)
            out.append((space, digest, raw, wide))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["vec_id", "space", "digest", "raw", "wide"])


#: Columns that travel with a vector.
_ROW = ["node", "weight", "space", "raw", "wide"]
_KINDS = "node long, weight long, space string, raw binary, wide boolean"


def _unit(raw: list[bytes], wide: list[bool]) -> np.ndarray:
    rows = unpack(raw, wide)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of split cells to their nearest centres; a group's centres come first."""
    for t in groups(batches, ["cell", "salt"]):
        kind, node = t.column("kind").to_numpy(), t.column("node").to_numpy()
        unit = _unit(t.column("raw").to_pylist(), t.column("wide").to_pylist())
        centres, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        place = {n: k for k, n in enumerate(node[centres].tolist())}
        level = t.column("level")[0].as_py()
        for at in range(0, len(own), 4096):
            some = own[at : at + 4096]
            d = distances(unit[some], unit[centres])
            for k, n in enumerate(node[some].tolist()):
                if n in place:  # a centre is its own, whatever rounding says
                    d[k, place[n]] = -1.0
            best = d.argmin(axis=1)
            near = np.maximum(d[np.arange(len(some)), best], 0)
            names = node[centres][best]
            part = t.take(pa.array(some)).select([*_ROW, "cell"]).rename_columns([*_ROW, "parent"])
            part = part.append_column("cell", pa.array([f"{level}:{n}" for n in names.tolist()], pa.string()))
            yield from part.append_column("centre", pa.array(names, pa.int64())).append_column("near", pa.array(near)).combine_chunks().to_batches()


def _near(chord: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of cells that can hold links, by centres and covering radii."""
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = []
            if x:
                u, v = (_unit(batch.column(f"raw_{c}").to_pylist(), batch.column(f"wide_{c}").to_pylist()) for c in "xy")
                d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", u, v), 0))
                reach = batch.column("radius_x").to_numpy() + batch.column("radius_y").to_numpy() + chord + SLACK
                keep = [k for k in range(len(x)) if x[k] == y[k] or d[k] <= reach[k]]
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(x[k], y[k]) for k in keep], pa.string()), "b": pa.array([max(x[k], y[k]) for k in keep], pa.string())})

    return run


def _cells(scratch: Scratch, classes: DataFrame, chord: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cells, pairs): vectors with their leaf ``cell``, the leaf cells, and
    the pairs (a, b) of them that may hold links, a cell with itself among them."""
    spark = scratch.spark

    def describe(rows: DataFrame, name: str) -> DataFrame:
        facts = rows.groupBy("cell").agg(F.count("*").alias("n"), (F.max("near") + SLACK).alias("radius"))
        middle = rows.filter("node = centre").select("cell", "parent", F.col("node").alias("middle"), "raw", "wide")
        return scratch.save(facts.join(middle, "cell"), name)

    # The top cell of a space: any member serves as its centre, all lie within 2.
    first = scratch.save(classes.groupBy("space").agg(F.min("node").alias("centre")), "first")
    top = F.concat(F.lit("0:"), F.col("space"))
    now = classes.join(small_side(first), "space").select(*_ROW, top.alias("parent"), top.alias("cell"), "centre", F.lit(2.0).alias("near"))
    cells = describe(now, "cells-0")
    pairs = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    leaves, level = [], 0
    while True:
        level += 1
        big = (F.col("n") > BLOCK) & (F.col("radius") * 2 > chord - SLACK) & F.lit(level <= LEVELS)
        split = small_side(cells.filter(big).select("cell", "n", "middle"), 80)
        if not cells.filter(big).limit(1).count():
            rows = now.select(*_ROW, "cell")
            for leaf in leaves:
                rows = rows.unionByName(leaf)
            return rows, cells, pairs
        leaves.append(now.join(split.select("cell"), "cell", "left_anti").select(*_ROW, "cell"))
        fan = F.least(F.lit(float(FAN)), F.ceil(F.col("n") / BLOCK) + 1)
        rows = now.drop("parent", "centre", "near").join(split, "cell").withColumn("salts", F.ceil(F.col("n") / DEAL).cast("int"))
        chosen = (F.col("node") == F.col("middle")) | (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40)) < (F.lit(float(1 << 40)) * fan / F.col("n")).cast("long"))
        centres = rows.filter(chosen).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(0))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).withColumn("kind", F.lit(1)).unionByName(centres)
        dealt = dealt.select("cell", "salt", "kind", F.lit(level).alias("level"), *_ROW)
        dealt = dealt.repartition(partitions(spark, 0), "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        now = scratch.save(arrow_map(dealt, _deal, f"{_KINDS}, parent string, cell string, centre long, near double"), f"rows-{level}")
        # A cell's children, or itself: the pairs a level down are of these.
        stay = cells.filter(~big).withColumn("parent", F.col("cell"))
        down = scratch.save(stay.unionByName(describe(now, f"new-{level}")), f"cells-{level}")
        sides = {c: down.select(F.col("parent").alias(p), F.col("cell").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("radius", "raw", "wide")]) for p, c in (("a", "x"), ("b", "y"))}
        both = pairs.join(sides["x"], "a").join(sides["y"], "b").filter("a <> b OR x <= y").drop("a", "b")
        pairs = scratch.save(arrow_map(both, _near(chord), "a string, b string"), f"pairs-{level}")
        cells = down


def similar(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, stats: dict[str, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Only vectors of equal, non-null label and equal length are compared, by
    cosine in double precision. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing. A vector is a distinct (vec_id,
    label, components): repeated rows count once. A null vec_id links with
    nothing and has null component and kept. An empty table gives no rows.
    Other columns are ignored. ``stats``, if given, gets ``pairs`` (of different
    vectors of equal label) and ``compared`` (of those, compared one by one).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    source = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[embedding].alias("vec"))
    coded = scratch.save(arrow_map(source, _encode, "vec_id long, space string, digest binary, raw binary, wide boolean"), "coded")
    valid = coded.filter("digest IS NOT NULL AND vec_id IS NOT NULL")
    members = valid.select("vec_id", "digest").distinct()
    # Classes are numbered when they are written: no two share a number.
    named = members.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id())
    named = scratch.save(named, "classes")
    own = valid.join(named, [valid["digest"] == named["digest"], valid["vec_id"] == named["rep"]]).select("node", "weight", "space", "raw", "wide")
    classes = scratch.save(own.dropDuplicates(["node"]), "nodes")
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, cells, pairs = _cells(scratch, classes, chord)

    # Cells within the chord link whole; the rest is dealt as pairs of blocks.
    dense = (F.col("radius") * 2 <= chord - SLACK)
    blocks = scratch.save(cells.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"), dense.alias("dense"), "middle", "n"), "blocks")
    side = lambda c, g: blocks.select(F.col("cell").alias(c), F.col("g").alias(g), F.col("dense").alias(f"dense_{c}"))
    tasks = pairs.join(side("a", "ga"), "a").join(side("b", "gb"), "b").filter("a <> b OR NOT dense_a")
    tasks = tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ga") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("gb") - 1))).filter("a <> b OR i <= j")
    tasks = scratch.save(tasks.select("a", "i", "b", "j", F.expr("a = b AND i = j").alias("single")).withColumn("task", F.monotonically_increasing_id()), "tasks")
    ends = tasks.select("task", "single", F.lit(True).alias("left"), F.col("a").alias("cell"), F.col("i").alias("block")).unionByName(tasks.filter("NOT single").select("task", "single", F.lit(False).alias("left"), F.col("b").alias("cell"), F.col("j").alias("block")))
    homes = scratch.save(rows.join(small_side(blocks.select("cell", "g", "dense", "middle"), 100), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")), "homes")
    visits = homes.select("cell", "block", "node", "weight", "raw", "wide").join(small_side(ends, 100), ["cell", "block"]).drop("cell", "block")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["task"]):
            left, single = t.column("left").to_numpy(zero_copy_only=False), t.column("single")[0].as_py()
            if t.num_rows < 2 or not single and (left.all() or not left.any()):
                continue
            node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
            vecs = unpack(t.column("raw").to_pylist(), t.column("wide").to_pylist())
            norms = np.sqrt((vecs * vecs).sum(axis=1))
            unit = vecs / norms[:, None]
            if single:
                a = b = CoverTree(unit, np.arange(len(vecs)))
            else:
                a, b = CoverTree(unit, np.flatnonzero(left)), CoverTree(unit, np.flatnonzero(~left))
            found = dual_traversal(unit, vecs, norms, weight, a, b, threshold)
            some = np.flatnonzero(found.links)
            kind = [0] * len(some) + [1] * len(found.left) + [2]
            x = [*node[some].tolist(), *node[found.left].tolist(), 0] if found.left else [*node[some].tolist(), 0]
            y = [*found.links[some].tolist(), *(node[found.right].tolist() if found.right else []), found.compared]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    width = 600  # of a row with a vector of common length, to size partitions by
    dealt = visits.repartition(partitions(spark, width * classes.count()), "task").sortWithinPartitions("task")
    linked = scratch.save(arrow_map(dealt, link, "kind int, a long, b long"), "linked")
    if stats is not None:
        spaces = classes.groupBy("space").agg(F.count("*").alias("n"))
        stats["pairs"] = spaces.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]
        stats["compared"] = linked.filter("kind = 2").agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    tight = homes.filter("dense").select("cell", "node", "weight", "middle")
    total = tight.groupBy("cell").agg(F.sum("weight").alias("all"))
    within = tight.join(total, "cell").select(F.col("node"), (F.col("all") - F.col("weight")).alias("links"))
    counts = linked.filter("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("links")).unionByName(within).groupBy("node").agg(F.sum("links").alias("links"))
    edges = linked.filter("kind = 1").select("a", "b").unionByName(tight.select(F.col("node").alias("a"), F.col("middle").alias("b")))
    roots = connected_components(scratch, edges, "link")
    # Components by node; their smallest vec_id names them.
    parts = named.join(counts, "node", "left").join(roots, "node", "left")
    parts = scratch.save(parts.select("digest", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "parts")
    least = scratch.save(parts.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    facts = scratch.save(parts.join(least, "root").select("digest", "component_id", "n_links"), "facts")
    linked_rows = members.join(facts, "digest").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = coded.filter("digest IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.when(F.col("vec_id").isNotNull(), F.lit(True)).alias("kept"))
    scratch.drop("homes", "linked", "parts", "nodes", "least", "classes")
    return linked_rows.unionByName(alone)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every embedding at cosine 0.98 within its label."""
    return similar(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = {
    "op9_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links,
  least(v.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id <= coalesce((SELECT min(y) FROM reach WHERE x = v.vec_id), v.vec_id) AS kept FROM v"""
}
