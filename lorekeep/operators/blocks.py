"""Postings in blocks of falling weight, of which a search reads only those that can matter.

A posting's weight is its share in the row's norm, so a score is a sum of question weight times
posting weight. Postings of a term are sorted by weight and cut into blocks; a small table holds
each block's largest weight. A search reads the first block of every term of a question and scores the
rows that look best there, which bounds the k-th score from below. That bound is shared out as cuts over the question's terms: a row that
stays below every cut cannot reach the bound, so blocks that begin below their term's cut are not
read. Costly terms get a cut that leaves them out altogether as long as the bound allows it. Rows that reach a cut in the
blocks that are read are then scored exactly on their own vectors, each row once with all questions of a block.

The result equals ``search``, ties and rounding included.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.embed import postings
from lorekeep.operators.kernels import bag_entries, cosine, usable
from lorekeep.operators.search import BROADCAST_BYTES, hit_schema, lookup, question_bytes, rank_hits, score_vectors, thinned
from lorekeep.session import checkpointed

ROWS_PER_BLOCK = 256
POSTINGS_PER_PART = 4_000_000
TRIED_PER_HIT, TRIED = 8, 32  # rows scored for the bound: more make it tighter, never wrong
ROUNDING = 2e-6  # scores are rounded to six decimals
_ROW_BITS = 33
BLOCKS = "bucket bigint, part int, block int, top double, n bigint"


def build_blocks(bags: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Write the postings of ``id, vector`` rows below ``path``, and the table of their blocks.

    Postings are dealt by ranges of term and weight, so a term of all rows spreads over tasks.
    """
    spark = bags.sparkSession
    rows = checkpointed(postings(bags).select("bucket", (F.col("w") / F.col("norm")).alias("weight"), "id"))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / POSTINGS_PER_PART))
    order = ["bucket", F.desc("weight"), "id"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    numbered = dealt.withColumn("place", place).select(
        "bucket", "weight", "id", F.shiftright("place", _ROW_BITS).cast("int").alias("part"),
        F.floor(F.col("place").bitwiseAND((1 << _ROW_BITS) - 1) / rows_per_block).cast("int").alias("block"),
    )
    numbered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/postings")
    blocks = stored.groupBy("bucket", "part", "block").agg(F.max("weight").alias("top"), F.count("*").alias("n"))
    blocks.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{path}/blocks")


def question_blocks(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """Stored ``question_id, bucket, q, part, block, top, n`` of all blocks of the questions' terms."""
    terms = checkpointed(postings(questions.select(F.col("question_id").alias("id"), "vector")))
    terms = terms.select(F.col("id").alias("question_id"), "bucket", (F.col("w") / F.col("norm")).alias("q"))
    wanted = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most the hash dimension
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(F.col("bucket").isin(wanted))
    return checkpointed(blocks.join(F.broadcast(terms), "bucket"))


def read_blocks(spark: SparkSession, path: str, chosen: DataFrame, id_type: str) -> DataFrame:
    """``question_id, id, part_score`` of every posting in the chosen blocks; other parts' folders are not opened."""
    parts = [r["part"] for r in chosen.select("part").distinct().collect()]
    low, high = chosen.agg(F.min("bucket"), F.max("bucket")).first()
    schema = f"bucket bigint, weight double, id {id_type}, block int, part int"
    stored = spark.read.schema(schema).parquet(f"{path}/postings").filter(F.col("part").isin(parts))
    if low is not None:
        stored = stored.filter(F.col("bucket").between(low, high))
    small = chosen.count() * 64 <= BROADCAST_BYTES
    wanted = chosen.select("question_id", "bucket", "part", "block", "q")
    met = stored.join(F.broadcast(wanted) if small else wanted, ["part", "block", "bucket"])
    return met.select("question_id", "id", (F.col("q") * F.col("weight")).alias("part_score"))


def candidates(spark: SparkSession, path: str, chosen: DataFrame, id_type: str) -> DataFrame:
    """Distinct ``id`` of the rows that reach the cut of a term of some question.

    A term's chosen blocks hold what reaches its lowest cut, one number per term, which is broadcast. So a posting is
    read once for all questions, and only ids are shuffled, not pairs with questions.
    """
    parts = [r["part"] for r in chosen.select("part").distinct().collect()]
    least = chosen.groupBy("bucket").agg((F.min(F.col("cut") / F.col("q")) * (1 - 1e-9)).alias("least"))
    stored = spark.read.schema(f"bucket bigint, weight double, id {id_type}, part int").parquet(f"{path}/postings")
    met = stored.filter(F.col("part").isin(parts)).join(F.broadcast(checkpointed(least)), "bucket")
    return met.filter("weight >= least").select("id").distinct()


def lower_bounds(spark: SparkSession, path: str, blocks: DataFrame, rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``question_id, bound``: a score that k rows surely reach; none where fewer are met.

    The first block of each term names rows; those that look best in them are scored exactly.
    """
    first = Window.partitionBy("question_id", "bucket").orderBy(F.desc("top"), "part", "block")
    heads = checkpointed(blocks.withColumn("_at", F.row_number().over(first)).filter("_at = 1"))
    met = read_blocks(spark, path, heads, rows.schema["id"].dataType.simpleString()).groupBy("question_id", "id").agg(F.sum("part_score").alias("score"))
    best = checkpointed(rank_hits(met, TRIED_PER_HIT * k + TRIED).select("question_id", "id"))
    kth = rank_hits(pair_scores(lookup(best, rows, ["vector"]), questions), k).filter(F.col("rank") == k)
    return kth.select("question_id", F.greatest(F.col("score") - ROUNDING, F.lit(0.0)).alias("bound"))


def cuts(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """``question_id, bucket, cut``: contributions below their cuts add up to less than the bound.

    Terms with the most postings per unit of their largest contribution come first and are left out whole while
    the bound allows it; the others share what remains equally.
    """
    terms = blocks.groupBy("question_id", "bucket").agg(F.max(F.col("q") * F.col("top")).alias("most"), F.sum("n").alias("n"))
    terms = terms.join(bounds, "question_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    costly = Window.partitionBy("question_id").orderBy(F.desc(F.col("n") / F.col("most")), "bucket")
    terms = terms.withColumn("upto", F.sum("most").over(costly)).withColumn("out", F.col("upto") < F.col("bound"))
    whole = Window.partitionBy("question_id")
    left = F.col("bound") - F.sum(F.when(F.col("out"), F.col("most")).otherwise(0.0)).over(whole)
    share = left / F.sum(F.when(F.col("out"), 0).otherwise(1)).over(whole)
    # a term left out is below its cut with every posting; nextafter is not at hand, so a hair is added
    return terms.select("question_id", "bucket", F.when(F.col("out"), F.col("most") * (1 + 1e-12) + 1e-300).otherwise(share * (1 - 1e-9)).alias("cut"))


def chosen_blocks(spark: SparkSession, path: str, rows: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks that a search for the best k reads, and all blocks of the questions' terms."""
    blocks = question_blocks(spark, path, questions)
    limits = checkpointed(cuts(blocks, checkpointed(lower_bounds(spark, path, blocks, rows, questions, k))))
    return checkpointed(blocks.join(limits, ["question_id", "bucket"]).filter(F.col("q") * F.col("top") >= F.col("cut"))), blocks


def pair_scores(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, id, score`` of ``question_id, id, vector`` rows; the questions are of broadcast size."""
    schema, arrow = hit_schema(questions.schema["question_id"].dataType, pairs.schema["id"].dataType)
    table = usable(questions.select("question_id", "vector").toArrow(), "question_id")
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        q_row, q_bucket, q_weight, q_norms = bag_entries(asked.column("vector"))
        width = int(q_bucket.max(initial=0)) + 2
        keys = q_row * width + q_bucket
        place = {q: i for i, q in enumerate(asked.column("question_id").to_pylist())}
        for batch in batches:
            rows = usable(pa.Table.from_batches([batch]), "id")
            if not rows.num_rows:
                continue
            question = np.array([place[q] for q in rows.column("question_id").to_pylist()], np.int64)
            row, bucket, weight, norms = bag_entries(rows.column("vector"))
            wanted = question[row] * width + np.minimum(bucket, width - 1)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            dots = np.bincount(row, weights=np.where(keys[at] == wanted, weight * q_weight[at], 0.0), minlength=rows.num_rows)
            scores = cosine(dots, norms * q_norms[question])
            out = [rows.column("question_id").combine_chunks(), rows.column("id").combine_chunks(), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(out, arrow.types, strict=True)], schema=arrow).filter(pa.array(dots > 0))

    return pairs.select("question_id", "id", "vector").mapInArrow(run, schema)


def search_blocks(
    spark: SparkSession, path: str, rows: DataFrame, questions: DataFrame, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``question_id, id, score, rank`` of the best k; ``rows`` has the ``id, vector`` that were indexed.

    Question sets beyond the broadcast limit are searched in blocks of it.
    """
    questions = checkpointed(questions.select("question_id", "vector"))
    n = max(1, math.ceil(question_bytes(questions) / broadcast_bytes))
    found = []
    for i in range(n):
        asked = questions if n == 1 else questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(n)) == i)
        id_type = rows.schema["id"].dataType.simpleString()
        chosen, _ = chosen_blocks(spark, path, rows, asked, k)
        ids = checkpointed(candidates(spark, path, chosen, id_type))
        found.append(score_vectors(thinned(rows.select("id", "vector"), ids), asked, k, broadcast_bytes=broadcast_bytes))
    return rank_hits(functools.reduce(DataFrame.unionByName, found), k)
