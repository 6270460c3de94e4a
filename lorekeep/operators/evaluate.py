"""Retrieval quality: test sets, expected-document and relevancy evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.scorers import PairScorer, PandasPairScorer, coverage, score_pairs
from lorekeep.functions.text import sentences
from lorekeep.operators.kb import Base, FrameBase
from lorekeep.operators.limits import first_rows
from lorekeep.operators.search import LOOKUP_BYTES, fetch, lookup
from lorekeep.session import checkpointed, union_all
from lorekeep.sources.sinks import save_table

DEFAULT_TESTS = 20


def generate_tests(kb: DataFrame, count: int = DEFAULT_TESTS) -> DataFrame:
    """``question_id, question, expected_doc_id``: the longest sentence of ``count`` rows.

    Rows are taken in the order of the hash of their id, which looks random but repeats.
    """
    longest = F.array_max(
        F.transform(sentences("content"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))
    )
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    picked = first_rows(kb.select("id", "content"), order, count)
    return picked.select(
        F.col("id").alias("question_id"),
        F.coalesce(longest["s"], F.col("content")).alias("question"),
        F.col("id").alias("expected_doc_id"),
    )


def generate_tests_from_sql(
    spark: SparkSession,
    query: str,
    count: int = DEFAULT_TESTS,
    required: tuple[str, ...] = ("question",),
    args: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The first ``count`` rows of a query that names its columns as the test set needs."""
    rows = spark.sql(query, args=dict(args or {}))
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the query must return columns {missing}")
    return rows.limit(count)  # in the order of the query; without ORDER BY any rows


RUN = 5  # words by which a passage and a text meet
ROWS_PER_SLICE = 1_000


def passage_tests(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """``question_id, question, expected_doc_id``: every passage (``question_id, question``) with each of the rows (``id, content``) that hold it.

    A passage of seven words or more is met by its second to sixth word, which stand in the text as they are; only
    texts that share this run are searched. While the passages are few they are broadcast and met in one Arrow pass over
    the rows, else both sides meet by a shuffle of hashes. Shorter passages, if there are any, are searched in every row.
    """
    words = F.split("question", " ")
    known = passages.select("question_id", "question", F.size(words).alias("_n"), F.slice(words, 2, RUN).alias("_run"))
    known = checkpointed(known.filter("question IS NOT NULL"))
    whole = known.filter((F.col("_n") >= RUN + 2) & F.col("question_id").isNotNull())
    size = whole.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("question")), F.lit(0)).alias("bytes")).first()
    found = [_met_in_pass(rows, whole) if 256 * size["n"] + 2 * size["bytes"] <= LOOKUP_BYTES else _met_by_shuffle(rows, whole)]
    short = known.filter(F.col("_n") < RUN + 2).select("question_id", "question")
    if not short.isEmpty():
        found.append(rows.join(short, F.contains("content", "question")).select("question_id", "question", F.col("id").alias("expected_doc_id")))
    return union_all(found)


def _met_in_pass(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Texts are split into words once; only words of the passages' runs are numbered, and runs are compared as numbers."""
    kinds = (whole.schema["question_id"].dataType, T.StringType(), rows.schema["id"].dataType)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("question_id", "question", "expected_doc_id"), kinds, strict=True)])
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(whole.select("question_id", "question", "_run").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        vocabulary = pc.unique(pc.list_flatten(asked.column("_run")))
        keys = _run_keys(pc.index_in(pc.list_flatten(asked.column("_run")), vocabulary), np.full(len(asked), RUN))[0]
        order = np.argsort(keys, kind="stable")
        keys, questions = keys[order], asked.column("question").to_pylist()
        for batch in batches:
            for start in range(0, batch.num_rows if len(keys) else 0, ROWS_PER_SLICE):
                part = pa.Table.from_batches([batch.slice(start, ROWS_PER_SLICE)])
                part = part.filter(pc.and_(part.column("id").is_valid(), part.column("content").is_valid()))
                text = part.column("content").combine_chunks()
                split = pc.split_pattern(text, " ")
                met, row = _run_keys(pc.index_in(pc.list_flatten(split), vocabulary), pc.list_value_length(split).to_numpy(zero_copy_only=False))
                first, last = np.searchsorted(keys, met, "left"), np.searchsorted(keys, met, "right")
                at = np.flatnonzero(last > first)
                pairs = np.unique(row[at] * len(keys) + first[at])
                held, which = [], []
                for r, f in zip(pairs // len(keys), pairs % len(keys), strict=True):
                    content = text[int(r)].as_py()
                    some = [int(q) for q in order[f : np.searchsorted(keys, keys[f], "right")] if questions[q] in content]
                    held += [int(r)] * len(some)
                    which += some
                which = pa.array(which, pa.int64())
                out = [*(asked.column(c).take(which) for c in ("question_id", "question")), part.column("id").take(pa.array(held, pa.int64()))]
                yield from pa.Table.from_arrays([c.cast(t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow).to_batches()

    return rows.select("id", "content").mapInArrow(run, schema)


def _run_keys(words: pa.Array | pa.ChunkedArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``RUN`` known words and the row it is in; ``words`` are numbers of the words of all rows, NULL for unknown ones."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    number = words.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(number) < RUN:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    unknown = np.concatenate([[0], np.cumsum(number < 0)])
    starts = np.flatnonzero((unknown[RUN:] == unknown[:-RUN]) & (row[: len(row) - RUN + 1] == row[RUN - 1 :]))
    hashed = np.zeros(len(starts), np.uint64)
    for i in range(RUN):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + number[starts + i].astype(np.uint64) + np.uint64(1)
        hashed ^= hashed >> np.uint64(29)
    return hashed, row[starts]


def _met_by_shuffle(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Runs of all texts and of the passages as hashes in a join; texts that share one are then searched."""
    keys = whole.select("question_id", F.xxhash64(F.array_join("_run", " ")).alias("_key"))
    text = F.split("content", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(text) - RUN + 1), lambda i: F.xxhash64(F.array_join(F.slice(text, i, RUN), " ")))
    runs = F.when(F.size(text) >= RUN, F.array_distinct(runs))
    met = checkpointed(rows.select("id", F.explode_outer(runs).alias("_key")).join(keys, "_key").select("id", "question_id").distinct())
    held = lookup(met, rows, ["content"]).join(whole.select("question_id", "question"), "question_id").filter(F.contains("content", "question"))
    return held.select("question_id", "question", F.col("id").alias("expected_doc_id"))


def as_base(kb: Base | DataFrame) -> Base:
    """A frame counts as a base of hashed bags, whose column names their dimension; other vectors raise."""
    return kb if isinstance(kb, Base) else FrameBase(kb)


def evaluate_doc_id(kb: Base | DataFrame, tests: DataFrame, k: int = 5, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """``questions, found, accuracy, mrr, avg_rank`` over (question, expected document) rows.

    Questions are embedded, compared and reranked as the base says. Tests whose document is not
    found count as misses.
    """
    questions = tests.select("question_id", "question").dropDuplicates(["question_id"])
    hits = as_base(kb).score(questions, k, filters).select(
        "question_id", F.col("id").alias("expected_doc_id"), "rank"
    )
    reciprocal = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return tests.join(hits, ["question_id", "expected_doc_id"], "left").agg(
        F.count("*").alias("questions"),
        F.count("rank").alias("found"),
        F.round(F.count("rank") / F.count("*"), 6).alias("accuracy"),
        F.round(F.avg(reciprocal), 6).alias("mrr"),
        F.round(F.avg("rank"), 6).alias("avg_rank"),
    )


def evaluate_relevancy(
    kb: Base | DataFrame,
    tests: DataFrame,
    k: int = 5,
    threshold: float = 0.5,
    scorer: PairScorer | None = None,
    pandas_scorer: PandasPairScorer | None = None,
) -> DataFrame:
    """``question_id, hits, mean_relevancy, precision_at_k, ndcg`` per test question.

    The wanted text is ``expected_content`` or
    ``expected_answer`` where the test set has one, else the question. Questions without hits
    stay, with zeros.
    """
    wanted = [F.col(c) for c in ("expected_content", "expected_answer") if c in tests.columns]
    tests = tests.select(
        "question_id", "question", F.coalesce(*wanted, F.col("question")).alias("wanted")
    )
    base = as_base(kb)
    hits = base.score(tests, k)
    pairs = fetch(hits, base.rows(), ["content"]).join(
        tests.select("question_id", "wanted"), "question_id"
    )
    scored = score_pairs(pairs, "wanted", "content", scorer or coverage, pandas_scorer, "relevancy")
    gain = F.array_sort(
        F.collect_list(F.struct(F.col("rank").alias("at"), F.col("relevancy").alias("gain")))
    )
    per_question = scored.groupBy("question_id").agg(
        F.count("*").alias("hits"),
        F.round(F.avg("relevancy"), 6).alias("mean_relevancy"),
        F.round(F.sum((F.col("relevancy") >= threshold).cast("int")) / F.lit(k), 6).alias(
            "precision_at_k"
        ),
        F.transform(gain, lambda g: g["gain"]).alias("gains"),
    )
    ideal = F.sort_array("gains", asc=False)
    with_ndcg = per_question.withColumn(
        "ndcg", F.round(F.coalesce(F.try_divide(_dcg(F.col("gains")), _dcg(ideal)), F.lit(0.0)), 6)
    ).drop("gains")
    return (
        tests.select("question_id")
        .join(with_ndcg, "question_id", "left")
        .fillna(0, ["hits", "mean_relevancy", "precision_at_k", "ndcg"])
    )


def _dcg(gains):
    discounted = F.transform(gains, lambda g, i: g / F.log2(i + F.lit(2.0)))
    return F.aggregate(discounted, F.lit(0.0), lambda total, g: total + g)


def evaluate(
    kb: Base | DataFrame,
    tests: DataFrame | None = None,
    version: str = "doc_id",
    k: int = 5,
    generate: int | None = None,
    generate_sql: str | None = None,
    test_table: str | None = None,
    run: bool = True,
    save_to: str | None = None,
    **scoring: Any,
) -> DataFrame:
    """Generate test data if asked, then evaluate unless ``run`` is off.

    ``test_table`` and ``save_to`` name tables that receive the test data and the result.
    """
    if version not in ("doc_id", "relevancy", "llm_relevancy"):
        raise ValueError(f"unknown evaluation {version!r}")
    base = as_base(kb)
    spark = base.spark
    if generate_sql is not None:
        tests = generate_tests_from_sql(spark, generate_sql, generate or DEFAULT_TESTS)
    elif generate is not None:
        tests = generate_tests(base.rows(), generate)
    elif not run:
        raise ValueError("nothing to do: no generation option and no evaluation")
    if tests is None:
        if test_table is None:
            raise ValueError("evaluation needs a test set")
        tests = spark.table(test_table)
    elif test_table is not None:
        tests = save_table(tests, test_table)
    else:
        tests = checkpointed(tests)  # read as questions and again as the expected documents
    if "question_id" not in tests.columns:
        tests = tests.withColumn("question_id", F.xxhash64("question"))
    if not run:
        return tests
    if version == "doc_id":
        result = evaluate_doc_id(base, tests, k)
    else:
        result = evaluate_relevancy(base, tests, k, **scoring)
    return result if save_to is None else save_table(result, save_to)
