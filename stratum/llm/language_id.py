"""Language identification with hyperdimensional profiles.

Every letter owns a random bipolar vector. A trigram binds its three letters,
each permuted (rotated) by its place, by elementwise product; a text bundles
its trigrams by addition. A language's prototype bundles the texts labelled
with it, each text with weight one. A text is compared with the prototypes by
cosine.

Bundling is linear, so training needs only trigram weights per language: the
workers add up each text's trigram shares, Spark sums them, and the product
with the trigram vectors is taken once per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Dimensions of the vectors.
DIMENSIONS = 1024
#: Languages that are learned at most: a label is no free text.
MAX_LANGUAGES = 10_000
#: Trigram vectors a worker keeps (one byte a dimension), as a bound on memory.
KEPT_TRIGRAMS = 40_000
#: Share of 4 by which ``op10`` holds documents out of training.
HELD_OUT = 2
_SPACE = 32
_BLOCK = 64


def _letter(code: int, dims: int) -> np.ndarray:
    """The bipolar vector of a code point: a function of the code point alone."""
    return np.random.Generator(np.random.PCG64(0x5EED0000 + int(code))).integers(0, 2, dims, dtype=np.int8) * 2 - 1


class Trigrams:
    """Trigram keys of texts, and the vectors of keys."""

    def __init__(self, dims: int = DIMENSIONS):
        self.dims = dims
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.kept = np.empty((1024, dims), dtype=np.int8)
        codes = np.arange(0x3000)
        alpha = np.fromiter((chr(c).isalpha() for c in codes), dtype=bool, count=len(codes))
        self.table = np.where(alpha, codes, _SPACE).astype(np.int64)

    def keys(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram keys and counts; empty if the text has no letter.

        Letters are lower-cased; every run of other characters is one space.
        """
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if codes.max() < len(self.table):
            c = self.table[codes]
        else:
            c = np.fromiter((x if chr(x).isalpha() else _SPACE for x in codes.tolist()), dtype=np.int64, count=len(codes))
        c = np.concatenate(([_SPACE], c, [_SPACE]))
        c = c[np.concatenate(([True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)))]
        if len(c) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)

    def _letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            if len(self.letters) >= 20_000:
                self.letters.clear()
            v = self.letters[code] = _letter(code, self.dims)
        return v

    def vector(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of keys, kept up to the bound."""
        new = [k for k in keys.tolist() if k not in self.row]
        if len(self.row) + len(new) > KEPT_TRIGRAMS:
            self.row.clear()
            new = keys.tolist()
        if len(self.row) + len(new) > len(self.kept):
            grown = np.empty((max(len(self.row) + len(new), 2 * len(self.kept)), self.dims), dtype=np.int8)
            grown[: len(self.kept)] = self.kept
            self.kept = grown
        for k in new:
            self.kept[len(self.row)] = self.vector(k)
            self.row[k] = len(self.row)
        return self.kept[[self.row[k] for k in keys.tolist()]]

    def bundle(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the keys' vectors; weights may have several rows."""
        out = 0
        for i in range(0, len(keys), 4096):
            out = out + weights[..., i : i + 4096].astype(np.float32) @ self.vectors(keys[i : i + 4096]).astype(np.float32)
        return out


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototypes per language from all rows whose ``text`` and ``lang`` are set.

    Only trigram weights per language are summed; what reaches the driver is a
    vector per language, of which more than MAX_LANGUAGES raise. Rows without a
    letter teach nothing; repeated rows each count; very long texts count whole
    but as one text. An empty table teaches nothing. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri, sums = Trigrams(dims), {}
        schema = pa.schema([("lang", pa.string()), ("vec", pa.list_(pa.float64()))])
        total: dict[str, np.ndarray] = {}

        def flush() -> None:
            for name, d in sums.items():
                keys = np.fromiter(d.keys(), dtype=np.int64, count=len(d))
                w = np.fromiter(d.values(), dtype=np.float64, count=len(d))
                total[name] = total.get(name, 0) + tri.bundle(keys, w).astype(np.float64)
            sums.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = tri.keys(t)
                if len(keys):
                    d = sums.setdefault(name, {})
                    for k, v in zip(keys.tolist(), (n / n.sum()).tolist(), strict=True):
                        d[k] = d.get(k, 0.0) + v
                    if len(d) > 200_000:
                        flush()
        flush()
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "vec": [v.tolist() for v in total.values()]}, schema=schema)

    labelled = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("lang"), docs[text].alias("text"))
    parts = arrow_map(labelled, count, "lang string, vec array<double>")
    sums = parts.select("lang", F.posexplode("vec")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vec"))
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array([x["v"] for x in r["vec"]])
        out[r["lang"]] = v / max(np.linalg.norm(v), 1e-12)
    return out


def floor(dims: int = DIMENSIONS) -> float:
    """The cosine below which a text is like no language: three standard deviations of
    the cosine of unrelated vectors, 1 / sqrt(dims)."""
    return 3 / dims**0.5


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` plus ``lang_pred`` and ``score``, a row per input row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. ``score`` is the cosine, cut to [0, 1]. Equal cosines: the name
    that sorts first. Repeated rows are each judged, very long texts whole; an
    empty table gives no rows. A name in ``keep`` that is one of the added ones
    raises.
    """
    keep = keep or ["doc_id"]
    if clash := {"lang_pred", "score", "_text"} & {c.lower() for c in keep}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    dims = matrix.shape[1]
    # The text travels once.
    source = docs.select(*[docs[c] for c in keep], *([] if text in keep else [docs[text].alias("_text")]))
    place = keep.index(text) if text in keep else len(keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri = Trigrams(dims)
        for batch in batches:
            texts = batch.column(place)
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, _BLOCK) if names else ():
                found = [(at + i, *tri.keys(t)) for i, t in enumerate(texts.slice(at, _BLOCK).to_pylist()) if t]
                found = [x for x in found if len(x[1])]
                if not found:
                    continue
                keys, inverse = np.unique(np.concatenate([x[1] for x in found]), return_inverse=True)
                counts = np.zeros((len(found), len(keys)), dtype=np.float32)
                counts[np.repeat(np.arange(len(found)), [len(x[1]) for x in found]), inverse] = np.concatenate([x[2] for x in found])
                v = tri.bundle(keys, counts)
                cos = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                best = cos.argmax(axis=1)
                for (i, _, _), b, s in zip(found, best.tolist(), cos.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = names[b], min(1.0, max(0.0, s))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return arrow_map(source, judge, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learned from documents with crc32(doc_id as text) mod 4 other than 2. A
    null doc_id counts as held out false and is not learned from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
