"""Removal of boilerplate lines by site-relative frequency.

A line is boilerplate on a host if the share of the host's pages that contain
it exceeds a ratio. Only DataFrame functions are used.

Every row is a page, copies too. Where copies are dealt with later and should
not turn a copied page into boilerplate, ``distinct_pages`` counts each text of
a host once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, small_side

#: Share of a host's pages that a line has to exceed, and the fewest pages it has to be on:
#: on a host of fewer than ten pages every line is on more than a tenth of them.
RATIO, MIN_PAGES = 0.1, 3
#: Parts that a host's pages are dealt to where its lines are too many to broadcast.
SALTS = 64


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def boilerplate(docs: DataFrame, *, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_pages: bool = False) -> DataFrame:
    """(host, line_hash) of the boilerplate lines of each host.

    A line is its text without surrounding blanks, by a 64-bit hash with the
    host beside it; blank lines never count, and a line counts once a page. At
    most ``lines per page / ratio`` rows per host can come out.
    """
    pages = docs.filter(docs[text].isNotNull()).select(docs[host].alias("_host"), docs[text].alias("_text"))
    if distinct_pages:
        pages = pages.withColumn("_page", F.xxhash64("_text"))
    found = F.array_distinct(F.transform(F.filter(_lines("_text"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))
    tagged = pages.withColumn("line_hash", F.explode(found)).drop("_text")
    total = pages.drop("_text")
    if distinct_pages:  # partial aggregation drops copies before the shuffle
        tagged, total = tagged.distinct(), total.distinct()
    count = tagged.groupBy("_host", "line_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    total = total.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("pages"))
    return count.join(total, F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("n") > ratio * F.col("pages")).select(F.col("_host").alias("host"), "line_hash")


def drop_boilerplate(docs: DataFrame, *, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_pages: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the lines removed from ``text``, and
    ``n_lines`` and ``n_dropped``.

    A null text stays null with no lines; a null host is a host of its own. A
    page of which all lines go keeps an empty text. Repeated rows are pages like
    others and are each cleaned. Lines keep their order and their blanks; long
    texts are cleaned whole. An empty table gives no rows.
    """
    if clash := {"n_lines", "n_dropped", "_drop", "_kept", "_host", "_salt", "_part"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.save(boilerplate(docs, text=text, host=host, ratio=ratio, min_pages=min_pages, distinct_pages=distinct_pages), "boilerplate")
    per_host = scratch.save(found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line_hash").alias("_drop")), "hosts")
    # A row per host with an array of 8 bytes a line.
    size = per_host.agg(F.coalesce(F.sum(F.size("_drop") * 8 + 128), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(per_host), docs[host].eqNullSafe(F.col("_host")), "left")
    else:  # a hot host's pages go to many tasks, each with the host's lines
        salted = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_part", F.pmod(F.xxhash64(docs[text]), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, dealt[host].eqNullSafe(F.col("_host")) & (F.col("_part") == F.col("_salt")), "left")
    keep = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_drop"), F.xxhash64(F.trim(x))))
    none = F.col("_drop").isNull() | F.col(text).isNull()
    kept = joined.withColumn("_kept", F.when(none, F.lit(None)).otherwise(keep))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    out = kept.withColumn("n_lines", n).withColumn("n_dropped", F.when(none, F.lit(0)).otherwise(F.size(_lines(text)) - F.size("_kept")).cast("long"))
    return out.withColumn(text, F.when(none, F.col(text)).otherwise(F.array_join("_kept", "\n"))).select(*docs.columns, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every document, its source as the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = {
    "op8_line_dedup": f"""
WITH lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
per AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT doc_id, source, trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '') GROUP BY 1, 2),
total AS (SELECT source, count(*) AS pages FROM documents WHERE text IS NOT NULL GROUP BY 1),
gone AS (SELECT source, line FROM per JOIN total USING (source) WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
cut AS (SELECT l.doc_id, l.line, l.pos, g.line IS NOT NULL AS dropped FROM lines l LEFT JOIN gone g ON l.source = g.source AND trim(l.line, ' ') = g.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped FROM cut GROUP BY doc_id"""
}
