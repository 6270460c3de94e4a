"""Functions of SQL text, refits from differences, stored classifiers and rows of tables without a base's ids."""

import json

import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.functions.text import bucket_sql, term_buckets
from lorekeep.operators import context as ctx
from lorekeep.operators import models
from lorekeep.operators.embed import hash_bags
from lorekeep.operators.kb import FrameBase
from lorekeep.operators.search import DENSE, search
from lorekeep.session import new_dir, union_all
from lorekeep.sources.sqlfunctions import register_base, register_model

TEXTS = [(1, "red fox and red hen", "en"), (2, "fox", "en"), (3, "Füchse, rot", "de"), (4, "", "de"), (5, None, "en"), (6, "moon", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id bigint, content string, lang string")


@pytest.fixture(scope="module")
def reviews(spark):
    data = [("good great good", "pos"), ("great fun", "pos"), ("bad awful", "neg"), ("", "pos"), (None, "neg"), ("x", None)]
    return spark.createDataFrame(data, "review string, sentiment string")


def test_buckets_in_sql(spark, texts):
    got = texts.select(F.expr(bucket_sql("content", 97)).alias("a"), term_buckets("content", 97).alias("b"))
    assert all(r["a"] == r["b"] for r in got.collect())


def test_base_in_sql(spark, texts):
    base = FrameBase(hash_bags(texts, dim=512))
    register_base(spark, base, "shelf")
    for question in ("red fox", "FÜCHSE", "nothing of it", ""):
        asked = hash_bags(spark.createDataFrame([(0, question)], "question_id int, q string"), "q", 512)
        want = {(r["id"], r["score"], r["rank"]) for r in search(base.rows(), asked, 2).collect()}
        got = spark.sql("SELECT * FROM shelf_search(:q, 2)", args={"q": question})
        assert {(r["id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert spark.sql("SELECT * FROM shelf_search(NULL, 2)").collect() == []
    by_lang = "SELECT id, shelf_score(vector, 'red fox') AS s FROM shelf WHERE lang = 'en' ORDER BY s DESC NULLS LAST, id LIMIT 1"
    assert spark.sql(by_lang).first()["id"] == 1
    with pytest.raises(ValueError, match="no name"):
        register_base(spark, base, "a b")


def test_dense_base_in_sql(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 1.0]), (3, "c", [0.0, 0.0]), (4, "d", None), (None, "e", [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id bigint, content string, vector array<double>")
    register_base(spark, FrameBase(frame, embedder=lambda df, c: df, kind=DENSE), "points")
    got = spark.sql("SELECT * FROM points_search(array(2.0D, 0.0D), 5)").collect()
    assert [(r["id"], r["score"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0, 1), (2, 0.707107, 2)]


@pytest.mark.parametrize("numbers", [models.BLOCK_NUMBERS, 4096])
def test_model_in_sql(spark, reviews, texts, numbers, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_NUMBERS", numbers)  # 4096: one class per block
    reviews.createOrReplaceTempView("reviews_sql")
    path, name = new_dir(spark, "model"), f"mood{numbers}"
    models.create_model(spark, path, "SELECT * FROM reviews_sql", "review", "sentiment")
    register_model(spark, path, name)
    asked = union_all([reviews.select(F.col("review").alias("t")), texts.select(F.col("content").alias("t"))])
    asked.createOrReplaceTempView("asked_sql")
    got = spark.sql(f"SELECT t, {name}(t) AS prediction FROM asked_sql")
    assert "Exchange" not in plan(got)
    want = models.predict_model(spark, path, asked, "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_refit_from_differences(spark, reviews):
    reviews.createOrReplaceTempView("reviews_delta")
    path = new_dir(spark, "model")
    models.create_model(spark, path, "SELECT * FROM reviews_delta", "review", "sentiment")
    out = reviews.filter("review = 'great fun' OR sentiment = 'neg'")
    new = spark.createDataFrame([("great fun", "neutral"), ("awful good", "pos"), (None, "neutral")], reviews.schema)
    assert models.refit_delta(spark, path, "a", new, out) == 2
    assert models.refit_delta(spark, path, "a", new, out) == 2  # counted once
    now = union_all([reviews.filter("NOT (review <=> 'great fun' OR sentiment <=> 'neg')"), new])
    assert models.load_version(spark, "sentiment", path) == models.fit_naive_bayes(now, "review", "sentiment")
    assert models.load_version(spark, "sentiment", path).classes == ("neutral", "pos")
    assert models.load_version(spark, "sentiment", path, 1) == models.fit_naive_bayes(reviews, "review", "sentiment")
    with pytest.raises(ValueError, match="not fitted on"):
        models.refit_delta(spark, path, "b", None, out)
    assert models.refit_delta(spark, path, "b", None, new.filter("sentiment = 'neutral'")) == 3
    assert models.load_version(spark, "sentiment", path).classes == ("pos",)
    with pytest.raises(ValueError, match="no labelled rows"):
        models.refit_delta(spark, path, "c", None, now.filter("sentiment IS NULL OR sentiment = 'pos'"))


def test_refit_from_differences_after_a_crash(spark, reviews, monkeypatch):
    reviews.createOrReplaceTempView("reviews_crash")
    path = new_dir(spark, "model")
    models.create_model(spark, path, "SELECT * FROM reviews_crash", "review", "sentiment")

    def crash(*_):
        raise RuntimeError("lost before the classes were written")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(models, "_write_classes", crash)
        models.refit_delta(spark, path, "a", reviews)
    assert models.load_version(spark, "sentiment", path) == models.fit_naive_bayes(reviews, "review", "sentiment")
    assert models.refit_delta(spark, path, "b", reviews.filter("sentiment = 'pos'")) == 2
    assert models.refit_delta(spark, path, "a", reviews) == 3
    now = union_all([reviews, reviews, reviews.filter("sentiment = 'pos'")])
    assert models.load_version(spark, "sentiment", path) == models.fit_naive_bayes(now, "review", "sentiment")


def test_stored_classifier(spark, reviews):
    reviews.filter("sentiment = 'pos' OR review = 'x'").createOrReplaceTempView("reviews_fit")
    path = new_dir(spark, "model")
    reviews.fillna("").createOrReplaceTempView("reviews_fit")
    models.create_model(spark, path, "SELECT * FROM reviews_fit WHERE sentiment <> ''", "review", "sentiment", 256, "classifier")
    asked = spark.createDataFrame([(1, "bad awful"), (2, "great fun"), (3, None)], "id int, t string")
    got = {r["id"]: r for r in models.predict_model(spark, path, asked, "t", "mood").collect()}
    assert got[1]["mood"] == "neg" and got[2]["mood"] == "pos" and got[3]["t"] is None and got[3]["mood"] in ("neg", "pos")
    assert models.predict_model(spark, path, asked, "t").columns == ["id", "t", "prediction"]
    spark.sql("SELECT review, CASE WHEN review = 'bad awful' THEN 'poor' ELSE 'fine' END AS sentiment FROM reviews_fit").createOrReplaceTempView("other")
    spark.table("other").createOrReplaceTempView("reviews_fit")
    assert models.refit_model(spark, path) == 2
    assert models.predict_model(spark, path, asked, "t").first()["prediction"] == "poor"
    assert models.predict_model(spark, path, asked, "t", version=1).first()["prediction"] == "neg"
    with pytest.raises(ValueError, match="clash"):
        models.predict_model(spark, path, asked.withColumn("review", F.lit(1)), "t")
    with pytest.raises(ValueError, match="only counts"):
        models.refit_delta(spark, path, "a", reviews)
    with pytest.raises(ValueError, match="no kind"):
        models.create_model(spark, new_dir(spark, "model"), "SELECT 1", "a", "b", kind="tree")


def test_rows_of_tables_without_ids(spark, texts):
    facts = spark.createDataFrame(
        [("k1", "fox", "hunts"), ("k2", "moon", None), ("k2", "moon", "z"), (None, "fox", "never found"), ("k4", None, None), ("k5", "stone", "")],
        "key string, about string, says string",
    )
    questions = spark.createDataFrame([(1, "the red fox"), (2, "Moon and fox"), (3, "nothing"), (4, None)], "question_id bigint, question string")
    source = ctx.TableRows(facts, "key", ("about", "says"), k=2)
    found = ctx.table_rows("facts", source, questions).collect()
    assert {(r["question_id"], r["id"], r["rank"]) for r in found} == {(1, "k1", 1), (2, "k2", 1), (2, "k1", 2)}  # "fox" is in more rows
    says = {json.loads(r["content"])["key"]: json.loads(r["content"]).get("says") for r in found}
    assert says == {"k1": "hunts", "k2": None}  # of one key the row whose JSON sorts last
    base = FrameBase(hash_bags(texts))
    agent = ctx.Agent({"texts": base}, model=lambda p: p, rows={"facts": source})
    answers = {r["question_id"]: r["answer"] for r in agent.answer(questions.filter("question_id < 4")).collect()}
    assert "hunts" in answers[1] and answers[1].index("red hen") < answers[1].index("hunts")
    assert answers[3] == ctx.NO_RESULT
    empty = ctx.table_rows("facts", ctx.TableRows(facts.limit(0), "key", ("about",)), questions)
    assert empty.collect() == [] and empty.columns == ["question_id", "kb", "id", "content", "score", "rank"]
