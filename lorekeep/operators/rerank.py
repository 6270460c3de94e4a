"""Second-stage scoring of the first-stage candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lorekeep.functions.scorers import PairScorer, PandasPairScorer, score_pairs
from lorekeep.operators.search import fetch, rank_hits


def rerank(
    candidates: DataFrame,
    questions: DataFrame,
    kb: DataFrame,
    k: int = 5,
    scorer: PairScorer | None = None,
    pandas_scorer: PandasPairScorer | None = None,
) -> DataFrame:
    """Score question/content pairs of ``candidates`` again and keep the best k.

    Only the candidates (``questions x fetched`` rows) meet the content column; the default
    scorer is the Jaccard overlap of their tokens.
    """
    pairs = fetch(candidates.select("question_id", "id"), kb, ["content"]).join(
        questions.select("question_id", "question"), "question_id"
    )
    scored = score_pairs(pairs, "question", "content", scorer, pandas_scorer, "rerank_score")
    return rank_hits(scored.drop("question", "content"), k, by="rerank_score")
