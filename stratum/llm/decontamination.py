"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits. It is split into k+1
pieces: k edits leave one piece whole, so the exact piece hits of one automaton
find every occurrence. Around each hit, the item is looked for in the document
by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

#: Characters of an item for each edit allowed; items shorter than these have none
#: and are looked for whole, between word borders.
CHARS_PER_EDIT = 20
#: Bytes of items looked for in one pass over the documents.
PASS_BYTES = 16 << 20

_WORD = re.compile(r"\w+")
#: Letters of scripts written without spaces: every place beside one is a border.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    """Lower-cased words, one space between two."""
    return " ".join(_WORD.findall(text.lower()))


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of near equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def border(text: str, at: int) -> bool:
    """Whether a word may begin or end before the character ``at``."""
    if not 0 < at < len(text):
        return True
    pair = text[at - 1 : at + 1]
    return " " in pair or bool(_UNSPACED.search(pair))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(mask: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """(least distance of the pattern to a part of ``text``, end of that part).

    Bit-parallel over the m rows of a column (Myers, 1999); a distance above
    ``most`` is given as ``most`` + 1.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, most + 1, -1
    if m <= most:
        best, end = m, 0
    get = mask.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus = plus << 1 & full  # a match may begin anywhere: no carry into row 0
        minus = minus << 1 & full
        up = minus | ~(x | plus) & full
        down = plus & x
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return best, end


class Matcher:
    """Automaton over the pieces of a list of (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.edits = [budget(t) for _, t in items]
        self.masks = [masks(t) for _, t in items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.edits[k]):
                where[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """Item index to (least distance, end in the text) of the items that occur."""
        out: dict[int, tuple[int, int]] = {}
        if self.empty:
            return out
        seen: dict[int, tuple[int, int]] = {}  # the window that was looked at last
        for end, (size, spots) in self.automaton.iter(text):
            for k, offset in spots:
                if k in out and not out[k][0]:
                    continue
                pattern, edits = self.items[k][1], self.edits[k]
                start = end + 1 - size - offset
                if not edits:
                    if border(text, start) and border(text, end + 1):
                        out[k] = (0, end + 1)
                    continue
                low, high = max(0, start - edits), min(len(text), start + len(pattern) + edits)
                if k in seen and seen[k][0] <= low and high <= seen[k][1]:
                    continue
                seen[k] = (low, high)
                distance, stop = myers(self.masks[k], len(pattern), text[low:high], edits)
                if distance <= edits and distance < out.get(k, (edits + 1,))[0]:
                    out[k] = (distance, low + stop)
        return out


def _passes(items: DataFrame, text: str, item_id: str | None) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in lists of at most PASS_BYTES, streamed partition by partition.

    Without ``item_id`` every text counts once, under the number 0.
    """
    held, size = [], 0
    number = F.lit(0) if item_id is None else F.col(item_id)
    rows = items.filter(F.col(text).isNotNull() & number.isNotNull()).select(number.cast("long").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        if held and size + len(t) > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((r["i"], t))
        size += len(t)
    yield held


def matches(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, distance, error_budget: a row per document row and item found.

    Texts are compared as lower-cased words with single spaces. An item may have
    one edit for each CHARS_PER_EDIT characters; a shorter one must occur as it
    is, between word borders. Items that are null or without words, or have no
    item_id, are not looked for. Null and empty texts hold nothing; texts are
    searched whole. Repeated document rows each give their rows; repeated items
    count once, and of several texts of one item_id the nearest. Either table may
    be empty; other columns are ignored.

    Items are shipped to the workers in lists of bounded size, with a pass over
    the documents for each: a benchmark is small beside the corpus, and its
    lists are what the driver holds of it.
    """
    source = docs.filter(docs[text].isNotNull()).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    out = None
    for some in _passes(items, item_text, item_id):
        shipped = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shipped: object = shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                rows: list[tuple[int, int, int, int]] = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for k, (distance, _) in matcher.find(normal(t.as_py())).items():
                        i = matcher.items[k][0]
                        best[i] = min(best.get(i, (distance, matcher.edits[k])), (distance, matcher.edits[k]))
                    rows += [(d, i, *x) for i, x in best.items()]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "error_budget"])

        part = arrow_map(source, run, "doc_id long, item_id long, distance long, error_budget long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Rows of ``docs``, with all their columns, in which no item occurs.

    Items count by their texts, whether they have an ``item_id`` or not. Null
    texts stay; repeated rows are each judged; either table may be empty. Judged
    in the row itself, so nothing is shuffled.
    """
    place = docs.columns.index(text)
    out = docs
    for some in _passes(items, item_text, None):
        shipped = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shipped: object = shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value)
            for batch in batches:
                clean = [t.as_py() is None or not matcher.find(normal(t.as_py())) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = arrow_map(out, run, docs.schema)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the item occurs in the document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
