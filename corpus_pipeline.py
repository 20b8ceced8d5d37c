"""From raw documents to tokens, in five stages.

Each stage reads what the one before it kept, written as Parquet. All but the
last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import bpe, decontamination, language_id, line_dedup, ngram_join
from stratum.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in none of the corpus's languages.

    Prototypes are learned from the labels of the stage's own input. A document
    goes if its text is null or has no letter, or if its cosine with the nearest
    prototype is what unrelated texts have (:func:`language_id.floor`): text in
    a language nobody labelled, or random letters. If nothing is labelled, a
    document is judged by its letters alone. Repeated rows are each judged; a
    null doc_id or source is of no account; an empty table stays empty.
    """
    model = language_id.learn(docs)
    if not model:
        return _columns(docs.filter(F.col("text").rlike(r"\p{L}")))
    return _columns(language_id.predict(_columns(docs), model, keep=COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= language_id.floor())))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the boilerplate lines of each source; every document stays.

    Every document is a page of its source, copies too, so a document copied to
    more than a tenth of a source's pages loses its lines like any banner. Null
    texts stay; a null source is a source of its own; an empty table stays empty.
    """
    out = line_dedup.drop_boilerplate(_columns(docs))
    return _columns(out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of similar documents: the one with the smallest doc_id.

    Rows are grouped, not ids (:func:`ngram_join.one_of_each`): texts without a
    doc_id or with a shared one are told apart, repeated rows and equal texts
    without words leave one. An empty table stays empty.
    """
    return ngram_join.one_of_each(_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item occurs.

    Null texts hold nothing and stay; repeated rows are each judged; an empty
    table or an empty benchmark changes nothing.
    """
    return _columns(decontamination.remove_contaminated(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left; null texts count as empty."""
    path, pattern = bpe.default_vocabulary()
    return bpe.digest(docs, path=path, pattern=pattern)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("tokens", tokenize),
]

#: SQL cannot express the stages; a brute-force version in the tests does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
