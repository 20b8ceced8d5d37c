"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, compressed; record headers
are stored apart, byte for byte. Records are put together again by joining the
two. Reading verifies each payload against its address.

The two stores are Parquet tables, ``payloads`` and ``headers``, in a folder.
:func:`write_files` and :func:`read_files` exchange plain WARC files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, arrow_map, small_side

#: Payloads of fewer bytes are never turned into revisits.
MIN_REVISIT_BYTES = 0
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records of one payload that a task puts together; digests that a task remembers.
HOT, SEEN = 1000, 100_000
#: Compressed bytes of a WARC file, about.
FILE_BYTES = 16 << 20
#: A gzip member of no bytes, which closes a file.
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")


@dataclass(frozen=True)
class Record:
    """A parsed WARC record."""

    headers: dict[str, str]
    payload: bytes


def header_bytes(page_id: int | None, url: str | None, sha1: str, sha256: str, size: int, refers_to: int | None, revisit: bool, serial: int = 0) -> bytes:
    """Exact header block of a record, with the blank line that ends it.

    A url with line breaks, which would end the field, is written with them
    escaped and once more in Base64; others stand as they are. A record without
    page_id is told apart by ``serial``.
    """
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{f':{serial}' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:
            lines.append("X-Target-URI-Base64: " + base64.b64encode(url.encode()).decode())
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-SHA256: {sha256}", f"X-Payload-Length: {size}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    first, *lines = block.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC header: {first[:40]!r}")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines if line)}


def parse_stream(data: bytes) -> Iterator[Record]:
    """Records of the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError("a WARC header without end")
            return
        headers = parse_header(data[at : end + 4])
        size = int(headers["content-length"])
        yield Record(headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def page_of(field: str | None) -> int | None:
    """The page_id in ``<urn:page:ID>``; none in ``<urn:page::SERIAL>``."""
    text = (field or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(text) if text else None


def url_of(headers: dict[str, str]) -> str | None:
    if "x-target-uri-base64" in headers:
        return base64.b64decode(headers["x-target-uri-base64"]).decode()
    return headers.get("warc-target-uri")


#: Arrow columns of a header's fields.
_FIELDS = "page_id long, url string, record_type string, refers_to long"


def _fields(heads: list[dict[str, str]]) -> list[pa.Array]:
    return [
        pa.array([page_of(h["warc-record-id"]) for h in heads], pa.int64()),
        pa.array([url_of(h) for h in heads], pa.string()),
        pa.array([h["warc-type"] for h in heads], pa.string()),
        pa.array([page_of(h.get("warc-refers-to")) for h in heads], pa.int64()),
    ]


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archive a record for each row of ``pages`` under ``path``.

    The payload is the UTF-8 of ``html``, null as empty. Of records with equal
    payloads of at least ``min_bytes`` bytes, those with the largest page_id are
    responses (several if a row is repeated) and the others revisit them. Rows
    with a null page_id are kept; they are responses only if all rows of the
    payload are. Smaller payloads are all responses. An empty table gives an
    empty archive; other columns are ignored; long payloads are kept whole.

    A task sends each payload it meets once, compressed, to where it is stored;
    which page owns it is settled by digests alone.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    raw = F.coalesce(pages[html], F.lit("")).cast("binary")
    facts = scratch.save(pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.upper(F.sha1(raw)).alias("sha1"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("size")), "facts")
    owners = scratch.save(facts.groupBy("sha256").agg(F.max("page_id").alias("owner")), "owners")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            key, size, body = [], [], []
            for x in batch.column(0):
                b = x.as_py()
                digest = hashlib.sha256(b).hexdigest()
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    key.append(digest)
                    size.append(len(b))
                    body.append(squeeze(b))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(size, pa.int64()), pa.array(body, pa.binary())], names=["sha256", "size", "body"])

    bodies = arrow_map(pages.select(raw.alias("raw")), compress, "sha256 string, size long, body binary")
    bodies.dropDuplicates(["sha256"]).write.option("compression", "none").parquet(f"{path}/payloads")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                revisit = r["size"] >= min_bytes and r["owner"] is not None and r["page_id"] != r["owner"]
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                out.append(header_bytes(r["page_id"], r["url"], digest, r["sha256"], r["size"], r["owner"], revisit, r["serial"]))
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array(out, pa.binary())], names=["sha256", "header"])

    owned = facts.join(small_side(owners, 240), "sha256").select("page_id", "url", "sha1", "sha256", "size", "owner", F.monotonically_increasing_id().alias("serial"))
    arrow_map(owned, head, "sha256 string, header binary").write.parquet(f"{path}/headers")
    scratch.drop("facts", "owners")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record from its stored header alone, with the digest and size it states."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [parse_header(x) for x in batch.column(0).to_pylist()]
            stated = [pa.array([int(h["x-payload-length"]) for h in heads], pa.int64()), pa.array([h["warc-payload-digest"].removeprefix("sha1:") for h in heads], pa.string())]
            yield pa.RecordBatch.from_arrays([*_fields(heads), *stated], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return arrow_map(spark.read.parquet(f"{path}/headers").select("header"), parse, f"{_FIELDS}, payload_bytes long, payload_digest string")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, record, payload: the original records, byte for byte, by joins.

    ``record`` is the header and, for a response, its payload; ``payload`` is
    the full payload of revisits too. A payload that many records share goes to
    several tasks, each with a part of the records. A payload that does not
    match its address, or a header that states another digest, raises.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([*_fields(heads), pa.array(records, pa.binary()), pa.array(payloads, pa.binary())], names=["page_id", "url", "record_type", "refers_to", "record", "payload"])
            heads.clear(), records.clear(), payloads.clear()
            return batch

        heads: list[dict[str, str]] = []
        records: list[bytes] = []
        payloads: list[bytes] = []
        last, raw, sha1, held = None, b"", "", 0
        for batch in batches:
            for key, header, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != last:
                    raw = zstandard.ZstdDecompressor().decompress(body.as_py())
                    if hashlib.sha256(raw).hexdigest() != key:
                        raise ValueError(f"the payload stored as {key} has other bytes")
                    last, sha1 = key, base64.b32encode(hashlib.sha1(raw).digest()).decode()
                fields = parse_header(header)
                if fields["warc-payload-digest"] != f"sha1:{sha1}":
                    raise ValueError("a header states another payload digest")
                heads.append(fields)
                records.append(header + (raw if fields["warc-type"] == "response" else b""))
                payloads.append(raw)
                held += len(records[-1]) + len(raw)
                if held >= BATCH_BYTES:
                    yield out()
                    held = 0
        yield out()

    scratch = Scratch(spark, "warc-read")
    headers, payloads = spark.read.parquet(f"{path}/headers").select("sha256", "header"), spark.read.parquet(f"{path}/payloads").select("sha256", "body")
    hot = headers.groupBy("sha256").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = scratch.save(hot.select("sha256", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "hot")
    few = small_side(hot, 240)
    parts = F.coalesce("parts", F.lit(1))
    dealt = headers.join(few, "sha256", "left").select("sha256", "header", F.pmod(F.xxhash64("header"), parts).cast("int").alias("part"))
    spread = payloads.join(few, "sha256", "left").select("sha256", "body", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return arrow_map(dealt.join(spread, ["sha256", "part"]).select("sha256", "header", "body"), build, f"{_FIELDS}, record binary, payload binary")


def write_files(records: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Write ``record`` bytes as WARC files of about ``file_bytes``, a gzip member for
    each record; a member of no bytes closes a file. Null records are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                held.append(squeeze.compress(x.as_py() + b"\r\n\r\n") + squeeze.flush())
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    files = arrow_map(records.filter("record IS NOT NULL").select("record"), pack, "file binary")
    # The text writer writes bytes as they are, and its separator after each row.
    writer = files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).text(path)


def members(blob: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one at a time."""
    while blob:
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(blob)
        if not inflate.eof:
            raise ValueError("a gzip member without end")
        blob = inflate.unused_data
        if data:
            yield data


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload of the records in gzipped WARC files.

    A file is read whole, compressed, and inflated a member at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([*_fields([r.headers for r in found]), pa.array([r.payload for r in found], pa.binary())], names=["page_id", "url", "record_type", "refers_to", "payload"])
            found.clear()
            return batch

        found: list[Record] = []
        held = 0
        for batch in batches:
            for blob in batch.column(0):
                for data in members(blob.as_py()):
                    found += parse_stream(data)
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield out()
                        held = 0
        yield out()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_map(files, parse, f"{_FIELDS}, payload binary")


def base32_sha1(raw: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of bytes: 20 bits, or four digits, at a time."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(raw), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then put the records together again and describe them."""
    scratch = Scratch(spark, "warc-archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), scratch.root)
    records = reconstruct(spark, scratch.root)
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


ORACLE = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS size, sha1(raw) AS h, max(page_id) OVER (PARTITION BY sha1(raw)) AS owner FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: to_base(strpos('0123456789abcdef', substr(h, i, 1)) - 1, 2, 4)), '') AS bits FROM d)
SELECT page_id, size AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * CAST(pow(2, 5 - j) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to FROM b"""
}
