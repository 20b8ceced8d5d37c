"""Similarity join on word n-grams by Jaccard, with Bayesian candidate pruning.

1. Every text becomes a set of hashed five-word shingles and MinHash values.
   Texts with equal sets form a class, of which one representative goes on.
2. Bands of MinHash values give buckets. Within a bucket, values are compared
   a step at a time; a pair goes as soon as the posterior probability that its
   similarity reaches the threshold falls below a tolerance. What is left of a
   bucket is passed on as spanning-forest edges, never as pairs. Buckets above
   a size pass on a star instead, which loses nothing.
3. Within each component of these edges, every pair that shares a band is
   pruned in the same way and the rest verified exactly by the shingle sets.
   Large components are dealt to tasks as pairs of blocks. A task gives counts
   of links per text and again a spanning forest, so output stays linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, connected_components, forest, groups, partitions, small_side

WORDS, THRESHOLD = 5, 0.8
#: 25 bands of 4: a pair at 0.8 shares a band with probability 1 - 2e-6.
BANDS, ROWS = 25, 4
#: MinHash values compared at a time, and the posterior below which a pair goes.
STEP, TOLERANCE = 20, 1e-6
#: Buckets up to this size are compared by themselves.
BUCKET = 256
#: Rows and shingles of a block, and blocks that a component of middling size gets.
BLOCK_ROWS, BLOCK_SHINGLES, SPREAD = 512, 2_000_000, 32

_WORD = re.compile(r"\w+")
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULT = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str, hashes: dict[str, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` lower-cased words.

    A text of fewer words has one shingle, of all its words; one without words
    has none.
    """
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(w))
    h = np.zeros(len(w) - size + 1, dtype=np.uint64)
    for i in range(size):
        h += w[i : len(w) - size + 1 + i] * _MIX[2 + i]
    return np.unique(_stir(h + np.uint64(size)))


def signature(shingle: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set of shingles."""
    low = np.full(len(_MULT), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingle), 1024):
        np.minimum(low, (shingle[i : i + 1024, None] * _MULT + _PLUS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 bucket keys."""
    s = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for i in range(ROWS):
        h = _stir(h * _MIX[8] + s[:, :, i] * _MIX[9 + i])
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, fewest equal values among n) for which a pair is not dropped.

    With a uniform prior, m equal values of n leave the similarity distributed
    as Beta(m+1, n-m+1); its upper tail at the threshold is a binomial sum.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


_LEAST = least_matches()


def prune(sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of the pairs that outlast the incremental comparison."""
    alive, same, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, least in _LEAST:
        same = same + (sigs[left[alive], done:n] == sigs[right[alive], done:n]).sum(axis=1, dtype=np.int32)
        ok = same >= least
        alive, same, done = alive[ok], same[ok], n
    return alive


def _sharing(keys: np.ndarray, split: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a band, in slices; of two blocks if ``split``."""
    n = len(keys)
    rows = range(n) if split is None else range(split)
    for i in rows:
        rest = np.arange(i + 1, n) if split is None else np.arange(split, n)
        if len(rest):
            hit = rest[(keys[rest] == keys[i]).any(axis=1)]
            if len(hit):
                yield np.full(len(hit), i), hit


def _verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's Jaccard similarity, by the whole sets, reaches the threshold."""
    size = np.array([len(s) for s in sets])
    if len(left) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], dtype=np.int64)
    else:  # many pairs among few rows: count common shingles by matrix product
        who = np.repeat(np.arange(len(sets)), size)
        every, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = n > 1
        number = np.cumsum(common) - 1
        who, what = who[common[inverse]], number[inverse[common[inverse]]]
        product = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(common.sum()), 4096):
            part = (what >= at) & (what < at + 4096)
            m = np.zeros((len(sets), min(4096, int(common.sum()) - at)), dtype=np.float32)
            m[who[part], what[part] - at] = 1
            product += m @ m.T
        both = np.rint(product[left, right]).astype(np.int64)
    union = size[left] + size[right] - both
    # In integers at the scale of the threshold: 0.8 means 4 of 5.
    return both * 1_000_000 >= round(threshold * 1_000_000) * union


def _bucket_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of the pairs in each bucket that pruning leaves."""
    a, b = [], []
    for t in groups(batches, ["key"]):
        rep = t.column("rep").to_numpy()
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(rep), -1)
        left, right = np.triu_indices(len(rep), 1)
        ok = prune(sigs, left, right)
        for x, y in forest(len(rep), left[ok], right[ok]):
            a.append(int(rep[x]))
            b.append(int(rep[y]))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block_links(threshold: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, a, b = [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"edge": pa.array(kind, pa.bool_()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            kind.clear(), a.clear(), b.clear()
            return batch

        for t in groups(batches, ["comp", "i", "j"]):
            if t.num_rows < 2:
                continue
            block = t.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            rep, weight = t.column("rep").to_numpy()[order], t.column("weight").to_numpy()[order]
            split = None if t.column("i")[0].as_py() == t.column("j")[0].as_py() else int((block == block.min()).sum())
            if split == t.num_rows:
                continue
            raw = t.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in order.tolist()]
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(rep), -1)[order]
            links = np.zeros(len(rep), dtype=np.int64)
            lefts, rights = [], []
            for left, right in _sharing(band_keys(sigs), split):
                ok = prune(sigs, left, right)
                lefts.append(left[ok])
                rights.append(right[ok])
            if not lefts:
                continue
            left, right = np.concatenate(lefts), np.concatenate(rights)
            ok = _verified(sets, left, right, threshold)
            left, right = left[ok], right[ok]
            np.add.at(links, left, weight[right])
            np.add.at(links, right, weight[left])
            for k in np.flatnonzero(links).tolist():
                kind.append(False), a.append(int(rep[k])), b.append(int(links[k]))
            for x, y in forest(len(rep), left, right):
                kind.append(True), a.append(int(rep[x])), b.append(int(rep[y]))
            if len(a) > 50_000:
                yield out()
        yield out()

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last, the text, with the digest of its set and its MinHash values."""
    hashes = _Hashes()
    for batch in batches:
        digest, sig = [], []
        for t in batch.columns[-1]:
            s = shingles(t.as_py(), hashes)
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=[*batch.schema.names[:-1], "digest", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["key", "rep"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [x for t in batch.column(0).to_pylist() if len(x := shingles(t, hashes))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([signature(x).tobytes() for x in sets], pa.binary())],
            names=["digest", "n", "shingles", "sig"],
        )


def _classes(scratch: Scratch, source: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sketch, facts) of ``source``: doc_id, then other columns, then a text that is not null.

    ``sketch`` has the columns but the text, and ``digest``, null for a text
    without words. ``facts`` has a row for each digest: ``root``, equal for
    classes that hang together, ``class_id`` and ``n_links``.
    """
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is not between {THRESHOLD} and 1")
    spark, text = scratch.spark, source.columns[-1]
    # Finds the row of a text again; a collision only brings a row too many.
    spot = F.xxhash64("doc_id", text).alias("spot")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1])
    sketch = scratch.save(arrow_map(source.select(spot, *source.columns), _sketch, f"spot long, {fields}, digest binary, sig binary"), "sketch")
    mine = sketch.filter("digest IS NOT NULL")
    # Classes are numbered when they are written: no two share a number.
    members = mine.select("doc_id", "digest", "spot").distinct().groupBy("doc_id", "digest").agg(F.min("spot").alias("spot"))
    named = members.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "spot"))["spot"].alias("spot"), F.count("*").alias("weight"))
    named = scratch.save(named.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # Rows of a class's first text have the same values.
    first = mine.join(named.select("rep", "weight", F.col("digest").alias("d"), F.col("spot").alias("s")), (F.col("digest") == F.col("d")) & (F.col("spot") == F.col("s")))
    classes = scratch.save(first.select("rep", "weight", "sig").dropDuplicates(["rep"]), "signatures")

    bands = arrow_map(classes.select("rep", "sig"), _keys, "key long, rep long")
    buckets = scratch.save(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("who")).filter("n > 1"), "buckets")
    # Buckets of the same texts are one.
    once = scratch.save(buckets.groupBy("n", "lo", "who").agg(F.min("key").alias("key")).drop("who"), "once")
    found = scratch.save(bands.join(small_side(once, 32), "key").select("key", "n", "lo", "rep"), "members")
    star = found.filter(f"n > {BUCKET}").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    packed = found.filter(f"n <= {BUCKET}").join(classes.select("rep", "sig"), "rep").select("key", "rep", "sig")
    pruned = arrow_map(packed.repartition(partitions(spark, found.count() * 512), "key").sortWithinPartitions("key"), _bucket_forest, "a long, b long")
    comps = scratch.save(connected_components(scratch, star.unionByName(pruned), "near").withColumnRenamed("root", "comp"), "comps")

    dealt = scratch.save(comps.withColumnRenamed("node", "rep").join(named.select("rep", "digest", "spot", "weight"), "rep"), "dealt")
    owners = scratch.save(dealt.select(F.col("spot").alias("owner")).distinct(), "owners")
    texts = source.select(F.col(text).alias("text"), spot).join(small_side(owners, 16), F.col("spot") == F.col("owner"), "left_semi").select("text")
    sets = arrow_map(texts, _whole_sets, "digest binary, n long, shingles binary, sig binary")
    sets = sets.join(small_side(dealt.drop("spot"), 64), "digest").select("rep", "comp", "weight", "n", "shingles", "sig")
    sets = scratch.save(sets.dropDuplicates(["rep"]), "sets")
    per = sets.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    g = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES), F.least(F.ceil(F.col("rows") / 64), F.lit(SPREAD)))
    per = scratch.save(per.filter("rows > 1").select("comp", g.cast("int").alias("g"), "total"), "per")
    shipped = per.agg(F.coalesce(F.sum(F.col("g") * F.col("total") * 8), F.lit(0))).first()[0]
    # In a group of g blocks a row goes to g tasks: its own block, and once with each other.
    placed = sets.join(small_side(per.drop("total"), 16), "comp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    placed = placed.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "weight", "shingles", "sig")
    linked = arrow_map(placed.repartition(partitions(spark, shipped), "comp", "i", "j").sortWithinPartitions("comp", "i", "j"), _block_links(threshold), "edge boolean, a long, b long")
    linked = scratch.save(linked, "linked")
    counts = linked.filter("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = connected_components(scratch, linked.filter("edge").select("a", "b"), "link").withColumnRenamed("node", "rep")
    parts = named.join(counts, "rep", "left").join(roots, "rep", "left")
    parts = scratch.save(parts.select("digest", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "parts")
    # Classes are linked by their numbers; the smallest doc_id names what hangs together.
    names = scratch.save(parts.groupBy("root").agg(F.min("least").alias("class_id")), "names")
    facts = scratch.save(parts.join(names, "root").select("digest", "root", "class_id", "n_links"), "facts")
    scratch.drop("classes", "buckets", "members", "once", "dealt", "owners", "sets", "per", "linked", "signatures", "comps", "parts", "names")
    return sketch, facts


def similar(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    ``n_links`` counts the other documents of which the Jaccard similarity to
    this one is at least the threshold; ``class_id`` is the smallest doc_id
    reachable by such links, the document's own if there are none.

    Texts that are null, empty or without words link with nothing. A document
    is a distinct (doc_id, shingle set): rows repeated in both count once. Rows
    with a null doc_id link with nothing and have a null class_id. An empty
    table gives no rows. Other columns are ignored; texts count whole. Bands and
    pruning are laid out for THRESHOLD; a higher one may be asked for, a lower
    one not.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    sketch, facts = _classes(scratch, source.filter("doc_id IS NOT NULL AND text IS NOT NULL"), threshold)
    with_words = sketch.filter("digest IS NOT NULL").select("doc_id", "digest").distinct().join(facts, "digest").select("doc_id", "class_id", "n_links")
    alone = lambda df: df.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(alone(source.filter("doc_id IS NULL OR text IS NULL"))).unionByName(alone(sketch.filter("digest IS NULL")))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns: one of each group of similar texts.

    Rows, not ids, are grouped, so texts that share a doc_id or have none are
    told apart. Of a group the row with the smallest doc_id stays (null ids
    last, then by the text's digest; of rows equal in both the smallest by all
    columns). Texts without words are grouped where they are equal, null texts
    among them. An empty table gives no rows.
    """
    if clash := {"_doc", "_hash", "_key", "_gone", "_twice"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession, "one-of-each")
    key = F.md5(docs[text]).alias("key")
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), key, docs[text].alias("text"))
    sketch, facts = _classes(scratch, source.filter("text IS NOT NULL"), threshold)
    rows = sketch.groupBy("doc_id", "key", "digest").agg(F.count("*").alias("n"))
    null = source.filter("text IS NULL").groupBy("doc_id", "key").agg(F.count("*").alias("n")).withColumn("digest", F.lit(None).cast("binary"))
    rows = scratch.save(rows.unionByName(null).join(facts.select("digest", "root"), "digest", "left").select("doc_id", "key", "n", "root", F.when(F.col("root").isNull(), F.coalesce("key", F.lit(""))).alias("bare")), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", F.coalesce("key", F.lit("")).alias("key"))
    best = rows.groupBy("root", "bare").agg(F.min(rank).alias("best"))
    best = scratch.save(best.select(F.col("root").alias("r"), F.col("bare").alias("b"), F.col("best.doc_id").alias("d"), F.col("best.key").alias("k")), "best")
    # Each group has one row of (doc_id, key) in ``best``.
    ids = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    won = best.select(F.col("d"), F.col("k"))
    gone = scratch.save(rows.join(won, ids("doc_id", "d") & (F.coalesce("key", F.lit("")) == F.col("k")), "left_anti").select(F.col("doc_id").alias("_gone"), F.coalesce("key", F.lit("")).alias("_key")), "gone")
    twice = scratch.save(rows.filter("n > 1").join(won, ids("doc_id", "d") & (F.coalesce("key", F.lit("")) == F.col("k")), "left_semi").select(F.col("doc_id").alias("_twice"), F.coalesce("key", F.lit("")).alias("_key")), "twice")
    tagged = docs.withColumns({"_doc": docs[doc_id].cast("long"), "_hash": F.coalesce(F.md5(docs[text]), F.lit(""))})
    meets = lambda other: F.col("_doc").eqNullSafe(F.col(other)) & (F.col("_hash") == F.col("_key"))
    kept = tagged.join(small_side(gone, 80), meets("_gone"), "left_anti")
    if twice.count():  # rows repeated in doc_id and text: one of them
        again = kept.join(small_side(twice, 80), meets("_twice"), "left_semi").groupBy("_doc", "_hash").agg(F.min(F.struct(*docs.columns)).alias("_one")).select("_one.*")
        return kept.join(small_side(twice, 80), meets("_twice"), "left_anti").select(*docs.columns).unionByName(again)
    return kept.select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at five words and 0.8."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
