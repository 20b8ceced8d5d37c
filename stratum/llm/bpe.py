"""Byte-level BPE by automaton and backtracking.

Bytes are mapped to Latin-1 characters, so one pyahocorasick automaton over
the vocabulary finds every token that occurs in a piece. The encoder takes
the longest token at each place and checks it against the token before: two
adjacent tokens are compatible if no merge would have crossed their border.
Where no token fits it steps back and marks the place as dead, so each place
is left at most once and the work is linear. Compatibility is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_map

#: Pieces of up to this many characters are memoised, in two generations of so
#: many entries; pairs of tokens, in so many.
MEMO_CHARS, MEMO_ENTRIES, PAIR_ENTRIES = 32, 120_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def _unsettled() -> tuple[regex.Pattern, object]:
    """Code points on which the installed Unicode tables differ: those that
    Python's tables leave unassigned but the regex module calls letters or
    numbers. The tokenizer library itself says what they are."""
    import tiktoken

    ask = {k: tiktoken.Encoding(k, pat_str=rf"\p{{{k}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}) for k in "LN"}

    def stand_in(char: str) -> str:
        return "\u00aa" if ask["L"].encode_ordinary(char) else "\u00b2" if ask["N"].encode_ordinary(char) else "\u00a4"

    odd = "".join(c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c))
    return regex.compile(f"[{odd}]"), stand_in


class _Memo(dict):
    """Pieces to (ids, ids as text, ids decoded); two generations, so that what is in use stays."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        known = self.old.get(piece)
        if known is None:
            ids = tuple(self.bpe.encode_piece(piece.encode()))
            known = (ids, " ".join(map(str, ids)), self.bpe.decode(ids))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = known
        return known


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.findall = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes = dict(sorted((r, t) for t, r in ranks.items()))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.size = {r: len(t) for r, t in self.bytes.items()}
        #: The longest token that a token begins with.
        self.shorter: dict[int, int | None] = {}
        for rank, token in self.bytes.items():
            self.shorter[rank] = next((r for cut in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:cut])) is not None), None)
        self.memo = _Memo(self)
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, token in self.bytes.items():
            self.halves[rank] = (rank, rank)
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._fits(a, b):
                    self.halves[rank], self.joined[a, b] = (a, b), rank
                    break

    def split(self, text: str) -> list[str]:
        """The pattern's matches, by the tokenizer library's Unicode tables."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            odd, stand_in = _unsettled()
            if odd.search(text):
                out, at = [], 0
                for piece in self.findall(odd.sub(lambda m: stand_in(m[0]), text)):
                    out.append(text[at : at + len(piece)])
                    at += len(piece)
                return out
        return self.findall(text)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging would leave the border between two tokens alone.

        Undo the later of the two tokens' merges step by step; each time, a
        merge across the border that comes before the merge just undone would
        have been made first.
        """
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                order = (True, False)
            else:
                order = (False, True)
            for is_left in order:
                if is_left:
                    limit, half = left, self.halves[left][1]
                    if half != left:
                        left = half
                        break
                else:
                    limit, half = right + 1, self.halves[right][0]
                    if half != right:
                        right = half
                        break
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, as merging by lowest rank gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, pairs, shorter = len(piece), self.size, self.pairs, self.shorter
        longest: list[int | None] = [None] * n
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # longer tokens end later
        dead: set[int] = set()
        out: list[int] = []
        pos, rank, last = 0, longest[0], -1
        while True:
            while rank is not None:
                end = pos + sizes[rank]
                if end not in dead:
                    if last < 0:
                        break
                    key = last << 32 | rank
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIR_ENTRIES:
                            pairs.clear()
                        fits = pairs[key] = self._fits(last, rank)
                    if fits:
                        break
                rank = shorter[rank]
            if rank is not None:
                out.append(rank)
                if end == n:
                    return out
                last, pos, rank = rank, end, longest[end]
            elif not out:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                dead.add(pos)
                rank = shorter[out.pop()]
                pos -= sizes[last]
                last = out[-1] if out else -1

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """Ids, their decimal form and what they decode to, of every match of the pattern."""
        return list(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([x[0] for x in self.pieces(text)]))

    def forget(self) -> None:
        """Empty the memos, which outlive a task with the worker."""
        self.memo.clear()
        self.memo.old = {}
        self.pairs.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file, built once per Python worker."""
    return ByteBpe(read_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digest(docs: DataFrame, *, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (null text: empty).

    ``path`` must be readable on every executor. Ids are decoded from the
    vocabulary, not taken from the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for t in batch.column(1):
                found = bpe.pieces(t.as_py() or "")
                n.append(sum([len(x[0]) for x in found]))
                ids_hash.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(source, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, *, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The input with ``ids array<int>`` added: null text gives an empty array."""
    if "ids" in docs.columns:
        raise ValueError("the input already has a column ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])
        bpe.forget()

    return arrow_map(docs, run, schema)


def decode(rows: DataFrame, *, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input with binary ``out`` added; null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            raw = [None if x.as_py() is None else bpe.decode(x.as_py()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return arrow_map(rows, run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole document text."""
    path, pattern = default_vocabulary()
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path=path, pattern=pattern)
