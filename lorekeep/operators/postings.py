"""Index of term postings for few questions: read only the buckets they mention.

The postings table is bucketed by id and sorted by term bucket. All postings of a row lie in one
partition, so scores are summed without a shuffle, and the pushed filter on the term bucket
skips the pages of all other terms.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.filters import compile_filter
from lorekeep.operators.embed import postings
from lorekeep.operators.ivf import next_version
from lorekeep.operators.search import BROADCAST_BYTES, question_bytes, rank_hits
from lorekeep.session import checkpointed, stored_table


ROWS_PER_PART = 4_000  # a task sorts their postings, and sums the scores of a question set over them
MOST_PARTS = 50_000  # Spark itself takes 100,000 buckets


def default_parts(spark: SparkSession, rows: int, least: int | None = None) -> int:
    """``least`` buckets, by default one per task slot; more where the rows ask for them, so a bucket stays one task's work."""
    return max(least or spark.sparkContext.defaultParallelism, min(MOST_PARTS, math.ceil(rows / ROWS_PER_PART)))


def _marks(bags: DataFrame) -> DataFrame:
    return bags.select("id", F.xxhash64("vector").alias("mark"))


def _save(bags: DataFrame, marks: DataFrame, table: str, path: str, parts: int, version: int, mode: str, files: int = 1) -> None:
    """Write postings and the marks of their rows. ``files`` tasks share a bucket: a hash of so many times the parts
    deals every task rows of one bucket only."""
    rows = postings(bags).withColumn("version", F.lit(version))
    (
        rows.repartition(parts * files, "id")
        .write.mode(mode)
        .bucketBy(parts, "id")
        .sortBy("bucket")
        .option("path", f"{path}/postings")
        .saveAsTable(table)
    )
    marks.withColumn("parts", F.lit(parts)).write.mode("overwrite").parquet(f"{path}/known/version={version}")


def build_postings(bags: DataFrame, table: str, path: str, parts: int | None = None) -> None:
    """Write the postings of ``id, vector`` rows as bucketed table ``table`` below ``path``.

    At least ``parts`` buckets, by default one per task slot; more where the number of rows asks for them.
    """
    parts = default_parts(bags.sparkSession, bags.count(), parts)
    _save(bags.select("id", "vector"), _marks(bags), table, path, parts, 0, "overwrite")


def _current(spark: SparkSession, path: str) -> DataFrame:
    """``id, mark, version`` of the rows that count."""
    known, gone = spark.read.parquet(f"{path}/known"), stored_table(spark, f"{path}/gone")
    if gone is not None:
        last = gone.groupBy("id").agg(F.max("before").alias("before"))
        known = known.join(last, "id", "left").filter("before IS NULL OR version >= before").drop("before")
    return known


def refresh_postings(bags: DataFrame, table: str, path: str) -> None:
    """Bring the index up to date: new and changed rows are added as the next version, the former
    postings of changed and removed ids are noted as gone."""
    spark = bags.sparkSession
    parts = spark.read.parquet(f"{path}/known").agg(F.max("parts")).first()[0]
    version = next_version(spark, path, "known")
    known, wanted = _current(spark, path).select("id", "mark"), checkpointed(_marks(bags))
    new = checkpointed(wanted.join(known, ["id", "mark"], "left_anti").select("id").distinct())
    gone = checkpointed(known.join(wanted, ["id", "mark"], "left_anti").select("id").distinct())
    if not gone.isEmpty():
        gone.write.parquet(f"{path}/gone/before={version}")
    if not new.isEmpty():
        rows, marks = (some.join(new, "id", "left_semi") for some in (bags.select("id", "vector"), wanted))
        _save(rows, marks, table, path, parts, version, "append", math.ceil(new.count() / ROWS_PER_PART / parts))


def search_postings(
    spark: SparkSession,
    table: str,
    path: str,
    questions: DataFrame,
    k: int = 5,
    filters: Mapping[str, Any] | None = None,
    rows: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``question_id, id, score, rank``, equal to ``search`` over the indexed rows.

    Question terms are broadcast, those of larger sets in blocks of the limit; the terms are
    the scan's filter. Scores are summed and cut to the best k within each bucket, before
    anything is shuffled. ``filters`` apply to ``rows``, which has their columns by id.
    """
    bags = questions.select(F.col("question_id").alias("id"), "vector")
    terms = checkpointed(postings(bags)).select(
        F.col("id").alias("question_id"), "bucket", F.col("w").alias("q"), F.col("norm").alias("q_norm")
    )
    stored, gone = spark.table(table), stored_table(spark, f"{path}/gone")
    blocks = max(1, math.ceil(question_bytes(questions) / broadcast_bytes))
    found = []
    for block in range(blocks):
        asked = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        wanted = [str(r["bucket"]) for r in asked.select("bucket").distinct().collect()]
        dots = (
            stored.filter(f"bucket IN ({', '.join(wanted) or 'NULL'})")
            .join(F.broadcast(asked), "bucket")
            .groupBy("id", "version", "question_id", "norm", "q_norm")
            .agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
        )
        if gone is not None:
            last = gone.groupBy("id").agg(F.max("before").alias("before"))
            dots = dots.join(last, "id", "left").filter("before IS NULL OR version >= before")
        if filters is not None:
            if rows is None:
                raise ValueError("filters need the rows that have their columns")
            dots = dots.join(rows.filter(compile_filter(filters, rows.schema)).select("id"), "id", "left_semi")
        score = F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 6)
        found.append(rank_hits(dots.select("question_id", "id", score.alias("score")), k))
    return functools.reduce(DataFrame.unionByName, found)
