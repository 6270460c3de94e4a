import re

import numpy as np
import pytest
from plans_text import plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import ivf
from lorekeep.operators.embed import embed_with, hash_bags, idf_kind, postings
from lorekeep.operators.postings import build_postings, refresh_postings, search_postings
from lorekeep.operators.rerank import rerank
from lorekeep.operators.search import BAG, DENSE, fetch, search
from lorekeep.session import new_dir

WORDS = ["red", "fox", "dog", "sun", "moon", "éa"]


def texts(spark, values, name="content", key="id"):
    return spark.createDataFrame(list(enumerate(values)), f"{key} bigint, {name} string")


def brute(docs, asked, k):
    """Cosine of token counts, rounded, ties by id."""
    out = set()
    for q, question in enumerate(asked):
        a = {w: question.split().count(w) for w in question.split()}
        scored = []
        for d, doc in enumerate(docs):
            b = {w: doc.split().count(w) for w in doc.split()}
            dot = sum(a[w] * b.get(w, 0) for w in a)
            if dot:
                size = np.sqrt(sum(v * v for v in a.values())) * np.sqrt(sum(v * v for v in b.values()))
                scored.append((-np.floor(dot / size * 1e6 + 0.5) / 1e6, d))
        for rank, (score, d) in enumerate(sorted(scored)[:k], 1):
            out.add((q, d, -score, rank))
    return out


def rows(df):
    return {(r["question_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


text = st.lists(st.sampled_from(WORDS), max_size=6).map(" ".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text, min_size=1, max_size=12), st.lists(text, min_size=1, max_size=4), st.integers(1, 14))
def test_search_equals_brute_force(spark, docs, asked, k):
    kb = hash_bags(texts(spark, docs)).repartition(3)
    questions = hash_bags(texts(spark, asked, "question", "question_id"), "question")
    want = brute(docs, asked, k)
    assert rows(search(kb, questions, k)) == want
    blocked = search(kb, questions, k, broadcast_bytes=100)
    assert rows(blocked) == want


def test_copies_tie_by_id_and_are_never_all_kept(spark):
    """A third of all rows are copies: each task keeps k of them, the lowest ids win."""
    docs = ["red fox"] * 400 + ["sun moon"] * 800
    kb = hash_bags(texts(spark, docs)).repartition(5)
    questions = hash_bags(texts(spark, ["red fox"], "question", "question_id"), "question")
    found = search(kb, questions, 3)
    assert [(r["id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_long_texts_use_doubles(spark):
    """Dot products beyond the range of single floats stay exact."""
    docs = ["red " * 9000 + "fox", "red " * 9001 + "fox", "fox"]
    asked = ["red " * 5000 + "fox", "fox"]
    kb = hash_bags(texts(spark, docs))
    questions = hash_bags(texts(spark, asked, "question", "question_id"), "question")
    assert rows(search(kb, questions, 3)) == brute(docs, asked, 3)


def test_string_ids_sort_like_spark(spark):
    data = [("b", "red"), ("é", "red"), ("B", "red"), ("a", "red"), ("10", "red"), ("9", "red")]
    kb = hash_bags(spark.createDataFrame(data, "id string, content string")).repartition(2)
    questions = hash_bags(texts(spark, ["red"], "question", "question_id"), "question")
    found = [r["id"] for r in search(kb, questions, 4).orderBy("rank").collect()]
    assert found == [r["id"] for r in kb.select("id").orderBy("id").limit(4).collect()]


def test_null_vectors_are_never_returned(spark):
    schema = "id bigint, vector array<float>"
    kb = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], schema)
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], schema.replace("id", "question_id"))
    for limits in ({}, {"broadcast_bytes": 10}):
        found = search(kb, asked, 3, kind=DENSE, **limits)
        assert [(r["question_id"], r["id"]) for r in found.collect()] == [(7, 1)]


def test_no_shared_token_gives_no_row_and_no_limit_gives_all(spark):
    kb = hash_bags(texts(spark, ["red fox", "red dog", "", "?!", "moon"]))
    asked = hash_bags(texts(spark, ["red", "nothing here", ""], "question", "question_id"), "question")
    for k in (None, 0, -1):
        found = search(kb, asked, k)
        assert {(r["question_id"], r["id"]) for r in found.collect()} == {(0, 0), (0, 1)}
        assert "rank" not in found.columns
    assert len(rows(search(kb, asked, 100))) == 2
    empty = kb.filter("id < 0")
    assert search(empty, asked, 3).count() == 0
    assert search(kb, asked.filter("question_id < 0"), 3).count() == 0


def test_filter_before_search_equals_search_of_filtered_rows(spark):
    kb = texts(spark, ["red fox", "red fox fox", "red", "fox"]).withColumn("n", F.col("id") % 2)
    kb = hash_bags(kb)
    asked = hash_bags(texts(spark, ["red fox"], "question", "question_id"), "question")
    assert rows(search(kb, asked, 1, {"n": 0})) == rows(search(kb.filter("n = 0"), asked, 1))


def test_plan_has_group_limit_and_no_cross_join(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"
    )
    asked = hash_bags(texts(spark, ["the"], "question", "question_id"), "question")
    shown = plan(search(hash_bags(docs), asked, 5, {"lang": "en"}))
    assert shown.count("WindowGroupLimit") >= 2
    assert "Cartesian" not in shown and "NestedLoop" not in shown
    assert "EqualTo(lang,en)" in shown
    assert "n_chars" not in shown  # unused columns are not read


def test_idf_changes_the_order(spark):
    docs = ["the the the fox", "the dog", "the sun", "the moon", "the the the"]
    kb = hash_bags(texts(spark, docs))
    asked = hash_bags(texts(spark, ["the the the fox dog"], "question", "question_id"), "question")
    kind = idf_kind(kb)
    best = search(kb, asked, 1, kind=kind).first()["id"]
    plain = search(kb, asked, 1).first()["id"]
    assert plain == 0 and best in (0, 1)
    scores = {r["id"]: r["score"] for r in search(kb, asked, 5, kind=kind).collect()}
    assert scores[4] < {r["id"]: r["score"] for r in search(kb, asked, 5).collect()}[4]


def test_postings(spark):
    got = postings(hash_bags(texts(spark, ["red red fox", "", "?"])))
    assert sorted(r["w"] for r in got.collect()) == [1, 2]


def test_rerank_keeps_best_pairs(spark):
    kb = hash_bags(texts(spark, ["red fox sun moon dog", "red fox", "red"]))
    questions = texts(spark, ["red fox"], "question", "question_id")
    candidates = search(kb, hash_bags(questions, "question"), 3)
    best = rerank(candidates, questions, kb, 2).orderBy("rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in best] == [(1, 1.0), (2, 0.5)]
    longest = rerank(candidates, questions, kb, 1, pandas_scorer=lambda q, c: c.str.len() * 1.0)
    assert longest.first()["id"] == 0


def test_fetch_returns_content(spark):
    kb = hash_bags(texts(spark, ["red fox", "dog"]))
    asked = hash_bags(texts(spark, ["dog"], "question", "question_id"), "question")
    assert fetch(search(kb, asked, 1), kb, ["content"]).first()["content"] == "dog"


def test_lookup_pushes_ids_to_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "id")
    hits = spark.createDataFrame([(1, 3), (1, 5), (2, 3)], "question_id int, id bigint")
    found = fetch(hits, docs, ["text"])
    assert found.count() == 3
    assert "In(doc_id, [3,5])" in plan(found)


def test_postings_index_equals_search_without_a_shuffle_of_scores(spark):
    rng = np.random.default_rng(3)
    docs = [" ".join(rng.choice(WORDS, rng.integers(0, 9))) for _ in range(120)]
    kb = hash_bags(texts(spark, docs))
    asked = hash_bags(texts(spark, ["red fox", "moon moon sun", "", "none"], "question", "question_id"), "question")
    spark.sql("CREATE DATABASE IF NOT EXISTS test_index")
    path = new_dir(spark, "postings")
    build_postings(kb.filter("id < 90"), "test_index.terms", path, parts=3)
    for _ in range(2):
        refresh_postings(kb, "test_index.terms", path)
    found = search_postings(spark, "test_index.terms", path, asked, 4)
    assert rows(found) == rows(search(kb, asked, 4))
    assert rows(search_postings(spark, "test_index.terms", path, asked, 4, broadcast_bytes=200)) == rows(found)
    shown = plan(search_postings(spark, "test_index.terms", path, asked, 4))
    assert "In(bucket" in shown or "EqualTo(bucket" in shown
    assert len(re.findall(r"^\(\d+\) Exchange", shown, re.M)) == 1  # only the final ranking


def vector_frame(spark, matrix, key="id"):
    data = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, f"{key} bigint, vector array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 5
    kb = np.concatenate([c + rng.normal(size=(40, 8)) * 0.3 for c in centres])
    return kb, rng.normal(size=(9, 8)) + centres[rng.integers(0, 6, 9)]


def test_dense_search_equals_numpy(spark, clustered):
    kb, asked = clustered
    got = rows(search(vector_frame(spark, kb), vector_frame(spark, asked, "question_id"), 4, kind=DENSE))
    a, b = kb.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    cosine = (b @ a.T) / np.linalg.norm(b, axis=1)[:, None] / np.linalg.norm(a, axis=1)[None]
    for q, row in enumerate(np.round(cosine, 6)):
        best = sorted((-s, i) for i, s in enumerate(row))[:4]
        assert {(i, r) for r, (_, i) in enumerate(best, 1)} == {(g[1], g[3]) for g in got if g[0] == q}


def test_index_is_exact_without_nprobe_and_recall_grows_with_it(spark, clustered):
    kb, asked = (vector_frame(spark, clustered[0]), vector_frame(spark, clustered[1], "question_id"))
    path = new_dir(spark, "ivf")
    ivf.build_index(kb.filter("id < 200"), path, lists=6)
    ivf.refresh_index(kb, path)
    ivf.refresh_index(kb, path)
    index = ivf.read_index(spark, path)
    assert index.count() == index.select("id").distinct().count() == 240
    want = rows(search(kb, asked, 5, kind=DENSE))
    assert rows(ivf.search_index(spark, path, asked, 5)) == want
    assert rows(ivf.search_index(spark, path, asked, 5, nprobe=6)) == want
    assert rows(ivf.search_index(spark, path, asked, 5, broadcast_bytes=10)) == want
    found = [len(rows(ivf.search_index(spark, path, asked, 5, nprobe=n)) & want) for n in (1, 3, 6)]
    assert found == sorted(found) and found[-1] == len(want)
    shown = plan(ivf.search_index(spark, path, asked, 5, nprobe=1))
    assert re.search(r"PartitionFilters: \[.*list_id#\d+ IN|PartitionFilters: \[.*list_id#\d+ = ", shown)


def test_user_embedder(spark):
    def model(series):
        return series.map(lambda t: [float(t.count("a")), float(t.count("b"))])

    kb = embed_with(texts(spark, ["aaa", "bbb", "ab"]), model)
    asked = embed_with(texts(spark, ["a"], "question", "question_id"), model, "question")
    best = search(kb, asked, 2, kind=DENSE).orderBy("rank").collect()
    assert [r["id"] for r in best] == [0, 2]


def test_bag_is_the_default_kind():
    assert not BAG.dense and BAG.weights is None
