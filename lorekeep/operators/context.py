"""Answering questions from several knowledge bases and tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.prompt import render
from lorekeep.functions.scorers import coverage
from lorekeep.functions.text import DEFAULT_DIM, sentences
from lorekeep.operators.embed import hash_bags, idf_kind
from lorekeep.operators.evaluate import as_base
from lorekeep.operators.kb import Base, one_row_per_id
from lorekeep.operators.models import generate
from lorekeep.operators.search import lookup, rank_hits, search
from lorekeep.session import checkpointed, union_all

# Fixed value: the answer to a question without any context.
NO_RESULT = "Agent returned no results or an empty DataFrame."
FUSED_FROM = 60  # reciprocal ranks count from here, the usual constant
DEFAULT_TEMPLATE = "{{question}}\n{{context}}"


def retrieve(
    kbs: Mapping[str, Base | DataFrame],
    questions: DataFrame,
    k: int = 5,
    filters: Mapping[str, Mapping[str, Any]] | None = None,
    fuse: bool = False,
) -> DataFrame:
    """``question_id, kb, id, content, score, rank``: the best k rows over all bases.

    Scores of one kind are ranked against each other. Bases that score in different ways (bags or dense vectors,
    other embedders or rerankers) need ``fuse``: a row's score is then ``1 / (60 + rank)`` by its rank within its base.

    Each base embeds, compares and reranks in its own way. Bases with ids of different types
    give ids as text. Content is joined after the global top k, so only winners are read with their text.
    """
    if not kbs:
        raise ValueError("at least one knowledge base is needed")
    bases = {name: as_base(kb) for name, kb in kbs.items()}
    ways = {(base.kind, base.embedder, base.reranker) for base in bases.values()}
    if len(ways) > 1 and not fuse:
        raise ValueError("the bases score in different ways: use fuse=True to merge them by their ranks")
    rows = {name: base.rows() for name, base in bases.items()}
    if len({r.schema["id"].dataType for r in rows.values()}) > 1:
        rows = {name: r.withColumn("id", F.col("id").cast("string")) for name, r in rows.items()}
    per_kb = [
        checkpointed(
            base.score(questions, k, (filters or {}).get(name), rows[name])
            .select("question_id", "id", (F.lit(1.0) / (FUSED_FROM + F.col("rank")) if fuse else F.col("score")).alias("score"))
            .withColumn("kb", F.lit(name))
        )
        for name, base in bases.items()
    ]
    best = checkpointed(rank_hits(union_all(per_kb), k, keys=("kb", "id")))
    found = [lookup(best.filter(F.col("kb") == name), r, ["content"]) for name, r in rows.items()]
    return union_all(found).select("question_id", "kb", "id", "content", "score", "rank")


def attach_table(context: DataFrame, table: DataFrame, on: str, columns: Sequence[str],
                 kb: str) -> DataFrame:
    """Columns of a context table for the retrieved rows of base ``kb`` whose id it knows."""
    rows = table.select(F.col(on).cast(context.schema["id"].dataType).alias("id"), *columns)
    return context.filter(F.col("kb") == kb).join(rows, "id")


def with_tables(context: DataFrame, tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Append matching rows of context tables, as JSON, to the retrieved contents.

    ``tables`` maps a name to a frame, its id column and the base whose ids these are. Contents
    of other bases, and rows without a match, stay as they are. A prompt holds all rows of an id.
    """
    for name, (table, on, kb) in tables.items():
        others = [F.col(c) for c in table.columns if c != on]
        note = F.to_json(F.struct(*others)).alias("note")
        rows = table.select(F.col(on).cast(context.schema["id"].dataType).alias("id"), note)
        wanted = context.filter(F.col("kb") == kb).select("id").distinct()
        notes = rows.join(wanted, "id", "left_semi").groupBy("id").agg(
            F.array_join(F.sort_array(F.collect_set("note")), "\n").alias("note")
        )
        text = F.concat_ws("\n", "content", F.concat(F.lit(f"{name}: "), F.col("note")))
        joined = context.join(notes.withColumn("kb", F.lit(kb)), ["kb", "id"], "left")
        context = joined.withColumn("content", text).select(*context.columns)
    return context


@dataclass(frozen=True)
class TableRows:
    """A table without the ids of any base: its rows are found by the words of a question.

    ``key`` names a row, ``text`` the columns whose words count, ``columns`` what a prompt shows (all by default).
    """

    table: DataFrame
    key: str
    text: Sequence[str]
    columns: Sequence[str] | None = None
    k: int = 5
    dim: int = DEFAULT_DIM


def table_rows(name: str, source: TableRows, questions: DataFrame) -> DataFrame:
    """``question_id, kb, id, content, score, rank``: the table's best ``k`` rows that share words with a question.

    Words weigh by how few rows of this table hold them. Only rows with a common word are hits, and every task keeps
    ``k`` per question ahead of the shuffle; columns are read for hits only. ``kb`` is ``name``, ``id`` the key as
    text, ``content`` the row as JSON. NULLs in text columns are left out, rows without a key are never found, of rows
    of one key that whose JSON sorts last counts.
    """
    shown = F.to_json(F.struct(*(source.columns or source.table.columns)))
    words = F.concat_ws(" ", *[F.col(c).cast("string") for c in source.text])
    rows = one_row_per_id(source.table.select(F.col(source.key).alias("id"), shown.alias("content"), words.alias("words")))
    bags = hash_bags(rows.select("id", "words"), "words", source.dim).select("id", "vector")
    asked = hash_bags(questions.select("question_id", "question"), "question", source.dim)
    hits = checkpointed(search(bags, asked.select("question_id", "vector"), source.k, kind=idf_kind(bags, source.dim)))
    return lookup(hits, rows, ["content"]).select(
        "question_id", F.lit(name).alias("kb"), F.col("id").cast("string").alias("id"), "content", "score", "rank"
    )


def with_rows(context: DataFrame, questions: DataFrame, sources: Mapping[str, TableRows]) -> DataFrame:
    """``context`` and, ranked behind it, the rows of tables that share words with a question."""
    parts, before = [context.withColumn("id", F.col("id").cast("string"))], context.agg(F.max("rank")).first()[0] or 0
    for name, source in sources.items():
        found = table_rows(name, source, questions)
        parts.append(found.withColumn("rank", F.col("rank") + before))
        before += source.k
    return union_all([p.select("question_id", "kb", "id", "content", "score", "rank") for p in parts])


def context_texts(context: DataFrame, questions: DataFrame, separator: str = "\n") -> DataFrame:
    """``question_id, question, context``: contents in rank order, empty without hits."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content")))
    texts = context.groupBy("question_id").agg(
        F.array_join(F.transform(ranked, lambda x: x["content"]), separator).alias("context")
    )
    return (
        questions.select("question_id", "question")
        .join(texts, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
    )


def prompts(context: DataFrame, questions: DataFrame, template: str = DEFAULT_TEMPLATE,
            separator: str = "\n") -> DataFrame:
    texts = context_texts(context, questions, separator)
    return texts.withColumn("prompt", render(template, ("question", "context")))


def extractive_answers(context: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, answer``: the context sentence that covers most question tokens.

    Ties go to the better ranked row, then to the earlier sentence.
    """
    asked = questions.select("question_id", "question")
    parts = context.join(asked, "question_id").select(
        "question_id", "question", "rank", F.posexplode_outer(sentences("content")).alias("at", "sentence")
    )
    score = F.round(coverage(F.col("question"), F.col("sentence")).cast("double"), 6)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "at")
    best = (
        parts.select("question_id", "rank", "at", "sentence", score.alias("score"))
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .select("question_id", F.col("sentence").alias("answer"))
    )
    return asked.join(best, "question_id", "left").select(
        "question_id", F.coalesce("answer", F.lit(NO_RESULT)).alias("answer")
    )


@dataclass(frozen=True)
class Agent:
    """Knowledge bases and tables, a template and, if given, a user model that answers prompts."""

    kbs: Mapping[str, Base | DataFrame]
    template: str = DEFAULT_TEMPLATE
    k: int = 5
    model: Callable[[pd.Series], pd.Series] | None = None
    tables: Mapping[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    filters: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    rows: Mapping[str, TableRows] = field(default_factory=dict)

    def answer(self, questions: DataFrame) -> DataFrame:
        """``question_id, answer`` for every question; the model sees those with context only."""
        found = with_tables(retrieve(self.kbs, questions, self.k, self.filters), self.tables)
        found = checkpointed(with_rows(found, questions, self.rows) if self.rows else found)
        if self.model is None:
            return extractive_answers(found, questions)
        asked = prompts(found, questions, self.template).filter(F.col("context") != "")
        answered = generate(asked.select("question_id", "prompt"), self.model).drop("prompt")
        return questions.select("question_id").join(answered, "question_id", "left").select(
            "question_id", F.coalesce("answer", F.lit(NO_RESULT)).alias("answer")
        )
