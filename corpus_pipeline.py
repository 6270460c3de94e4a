"""The training-data pipeline: stages over the documents, each written and read again.

Rejected and duplicate documents and repeated lines leave for good; every stage works on all that
its predecessor kept. The last stage returns ids instead of the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import jaccard, leaks, lines, pieces, quality
from lorekeep.llm.queries import PIECE_MODEL
from lorekeep.llm.tables import checkpointed, table, with_small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those left without a word go."""
    clean = lines.deduplicate_lines(docs, min_words=1, near_words=5, drop_empty=True)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text, and whether decoding them gives the text back."""
    model = pieces.load_pieces(PIECE_MODEL)
    coded = pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"), model)
    slim = coded.select("doc_id", "lang", "source", "ids", F.md5("text").alias("text_md5"))
    back = pieces.decode_ids(checkpointed(slim), model, text="decoded")  # one Python worker per task at a time
    exact = F.md5("decoded").eqNullSafe(F.col("text_md5"))
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), exact.alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", with_small_batches(good_documents)),
    ("line dedup", with_small_batches(distinct_lines)),
    ("n-gram Jaccard join", with_small_batches(distinct_documents)),
    ("benchmark decontamination", with_small_batches(unleaked_documents)),
    ("SentencePiece encoding and decoding", with_small_batches(encoded_documents)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs


#: The stages fit a model, align texts and encode them, which SQL cannot express.
ORACLE_SQL = None
