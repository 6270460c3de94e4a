"""What one task holds stays bounded: meetings, buckets, candidates and slices."""

import numpy as np
import pyarrow as pa
import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.operators import blocks, embed, evaluate, ivf, listjoin, models, postings
from lorekeep.operators.embed import hash_bags
from lorekeep.operators.search import BAG, DENSE, search
from lorekeep.session import new_dir
from lorekeep.sources import sqlfunctions


def rows(df):
    return sorted((r["question_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


def bags(spark, texts, key="id"):
    return hash_bags(spark.createDataFrame(list(enumerate(texts)), f"{key} bigint, content string"))


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    return [" ".join(["the"] * 2 + [f"w{n}" for n in rng.integers(0, 40, 12)]) for _ in range(60)]


@pytest.mark.parametrize("few", [True, False])
def test_passages_are_met_in_one_pass_over_the_texts(spark, monkeypatch, few):
    texts = [(1, "x one two  two three four five six y"), (1, "one two  two three four five six"), (2, "one two  two three four five si"),
             (3, ""), (4, None), (None, "one two  two three four five six"), (5, "é ü é ü é ü é ü é ü é")]
    asked = [(7, "one two  two three four five six"), (8, "é ü é ü é ü é ü é"), (8, "é ü é ü é ü é ü é"), (9, None), (10, "no such words as these are here"), (None, "one two  two three four five six")]
    base = spark.createDataFrame(texts, "id bigint, content string").repartition(3)
    passages = spark.createDataFrame(asked, "question_id bigint, question string")
    if not few:
        monkeypatch.setattr(evaluate, "LOOKUP_BYTES", 0)
    found = evaluate.passage_tests(base, passages)
    assert sorted((r["question_id"], r["expected_doc_id"]) for r in found.collect()) == [(7, 1), (7, 1), (8, 5), (8, 5)]
    assert not few or "MapInArrow" in plan(found)
    assert evaluate.passage_tests(base, passages.limit(0)).count() == 0


def test_buckets_of_postings_grow_with_the_rows(spark, monkeypatch, words):
    monkeypatch.setattr(postings, "ROWS_PER_PART", 5)
    kb, asked = bags(spark, words), bags(spark, words[:3], "question_id")
    spark.sql("CREATE DATABASE IF NOT EXISTS test_scale")
    path = new_dir(spark, "postings")
    postings.build_postings(kb.filter("id < 20"), "test_scale.grown", path, parts=2)
    assert spark.read.parquet(f"{path}/known").agg(F.max("parts")).first()[0] == 4
    assert rows(postings.search_postings(spark, "test_scale.grown", path, asked, 6)) == rows(search(kb.filter("id < 20"), asked, 6))
    postings.refresh_postings(kb.filter("id <> 7"), "test_scale.grown", path)  # 40 new rows: two tasks a bucket
    files = spark.table("test_scale.grown").filter("version = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4
    assert rows(postings.search_postings(spark, "test_scale.grown", path, asked, 6)) == rows(search(kb.filter("id <> 7"), asked, 6))


def test_vectors_are_not_copied_for_every_list(spark, monkeypatch):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(400, 12))  # without clusters: nearly every list may hold a better row
    matrix[50:120] = matrix[50]
    base = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id bigint, vector array<double>")
    path, asked, seen, met = new_dir(spark, "ivf"), base.withColumnRenamed("id", "question_id"), [], listjoin._meet
    ivf.build_index(base, path, lists=20)

    def count(some, *others):
        seen.append(some.count())
        return met(some, *others)

    monkeypatch.setattr(listjoin, "_meet", count)
    assert rows(listjoin.search_join(spark, path, asked, 5, part_rows=64)) == rows(search(base, asked, 5, kind=DENSE))
    assert seen[0] == 400 and seen[1] <= 400


def test_candidates_of_blocks_are_rows_not_pairs(spark, monkeypatch, words):
    kb, asked, path, pairs, scored = bags(spark, words), bags(spark, words[:4], "question_id"), new_dir(spark, "blocks"), [], blocks.pair_scores

    def count(some, questions):
        pairs.append(some.count())
        return scored(some, questions)

    monkeypatch.setattr(blocks, "pair_scores", count)
    monkeypatch.setattr(blocks, "TRIED", 0)
    blocks.build_blocks(kb, path, rows_per_block=4)
    assert rows(blocks.search_blocks(spark, path, kb, asked, 1)) == rows(search(kb, asked, 1))
    assert sum(pairs) <= 4 * blocks.TRIED_PER_HIT  # those that bound the k-th score


def test_only_bags_go_through_python_in_prediction(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "blue dog", "b"), (3, "red red", "a"), (4, None, "b")], "id bigint, text string, lang string")
    model = models.fit_naive_bayes(docs, "text", "lang", dim=64)
    for numbers in (1, models.BLOCK_NUMBERS):
        found = model.transform(docs, "text", "lang", block_numbers=numbers)
        assert found.columns == ["id", "text", "lang"]
        assert {r["id"]: r["lang"] for r in found.collect()} == {1: "a", 2: "b", 3: "a", 4: "a"}
        assert "MapInArrow" not in plan(found)


def test_scores_and_postings_are_made_in_slices(monkeypatch):
    sizes, entries = [], sqlfunctions.bag_entries
    monkeypatch.setattr(sqlfunctions, "bag_entries", lambda c, w=None: (sizes.append(len(c)), entries(c, w))[1])
    left = pa.array([[i % 5, 7] if i % 9 else None for i in range(2000)], pa.list_(pa.int32()))
    right = pa.array([[i % 3] for i in range(2000)], pa.list_(pa.int32()))
    got = sqlfunctions.pair_scores(BAG)(left, right)
    assert max(sizes) <= 512 and embed.ROWS_PER_SLICE <= 512
    assert got.to_pylist() == [0.707107 if i % 9 and i % 5 == i % 3 else None for i in range(2000)]
    assert len(sqlfunctions.pair_scores(BAG)(left.slice(0, 0), right.slice(0, 0))) == 0
