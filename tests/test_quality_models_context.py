import math

import numpy as np
import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.operators import context as ctx
from lorekeep.operators import evaluate as ev
from lorekeep.operators import models, summarize
from lorekeep.operators.embed import hash_bags
from lorekeep.operators.kb import FrameBase
from lorekeep.session import new_dir


@pytest.fixture(scope="module")
def kb(spark):
    data = [
        (1, "The red fox ran. It was quick and red."),
        (2, "The dog slept all day long."),
        (3, "Sun and moon! Stars too."),
        (4, "..."),
    ]
    return hash_bags(spark.createDataFrame(data, "id bigint, content string"))


def test_generated_tests_repeat_and_use_a_sentence(kb):
    tests = ev.generate_tests(kb, 4)
    got = {r["expected_doc_id"]: r["question"] for r in tests.collect()}
    assert got == {1: "It was quick and red", 2: "The dog slept all day long", 3: "Sun and moon", 4: "..."}
    assert ev.generate_tests(kb.repartition(3), 2).collect() == ev.generate_tests(kb, 2).collect()


def test_doc_id_evaluation_counts_misses(spark, kb):
    tests = spark.createDataFrame(
        [(1, "red fox", 1), (2, "the dog", 1), (3, "unknown", 3)],
        "question_id bigint, question string, expected_doc_id bigint",
    )
    row = ev.evaluate_doc_id(kb, tests, 5).first()
    assert (row["questions"], row["found"]) == (3, 2)
    assert row["accuracy"] == pytest.approx(2 / 3, abs=1e-6)
    assert row["mrr"] == pytest.approx((1 + 1 / 2) / 3, abs=1e-6)
    assert row["avg_rank"] == 1.5


def test_relevancy_keeps_questions_without_hits(spark, kb):
    tests = spark.createDataFrame(
        [(1, "red fox", "quick red fox"), (2, "unknown", None)],
        "question_id bigint, question string, expected_answer string",
    )
    got = {r["question_id"]: r for r in ev.evaluate_relevancy(kb, tests, 2).collect()}
    assert got[1]["mean_relevancy"] == 1.0 and got[1]["precision_at_k"] == 0.5 and got[1]["ndcg"] == 1.0
    assert tuple(got[2])[1:] == (0, 0.0, 0.0, 0.0)
    user = ev.evaluate_relevancy(kb, tests, 2, pandas_scorer=lambda q, c: q.str.len() * 0.0)
    assert {r["mean_relevancy"] for r in user.collect()} == {0.0}


def test_evaluate_options(spark, kb):
    spark.sql("CREATE DATABASE IF NOT EXISTS test_eval")
    made = ev.evaluate(kb, generate=2, run=False, test_table="test_eval.tests")
    assert made.count() == spark.table("test_eval.tests").count() == 2
    saved = ev.evaluate(kb, test_table="test_eval.tests", save_to="test_eval.result")
    assert saved.first()["questions"] == spark.table("test_eval.result").first()["questions"] == 2
    kb.createOrReplaceTempView("eval_kb")
    sql = "SELECT content AS question, id AS expected_doc_id FROM eval_kb WHERE id < 3 ORDER BY id"
    assert ev.evaluate(kb, generate_sql=sql, generate=1).first()["questions"] == 1
    assert ev.evaluate(kb, generate_sql=sql).first()["found"] == 2
    with pytest.raises(ValueError):
        ev.evaluate(kb, run=False)
    with pytest.raises(ValueError):
        ev.evaluate(kb)
    with pytest.raises(ValueError):
        ev.evaluate(kb, version="other", generate=1)
    with pytest.raises(ValueError, match="expected_answer"):
        ev.generate_tests_from_sql(spark, sql, required=("question", "expected_answer"))


@pytest.fixture(scope="module")
def reviews(spark):
    data = [("good great good", "pos"), ("great fun", "pos"), ("bad awful", "neg"), ("", "pos"), ("x", None)]
    return spark.createDataFrame(data, "review string, sentiment string")


def test_naive_bayes_predicts_every_row(spark, reviews):
    model = models.fit_naive_bayes(reviews, "review", "sentiment")
    assert model.classes == ("neg", "pos")
    assert model.priors == (round(math.log(1 / 4) * 1e6), round(math.log(3 / 4) * 1e6))
    rows = [(1, "good fun"), (2, "bad awful"), (3, ""), (4, "never seen"), (5, None)]
    got = models.predict_rows(spark, rows, "id int, text string", model, "text")
    found = {r["id"]: r["prediction"] for r in got.collect()}
    assert found == {1: "pos", 2: "neg", 3: "pos", 4: "pos", 5: "pos"}
    by_rows = models.fit_naive_bayes(reviews.repartition(3), "review", "sentiment")
    assert by_rows == model


def test_prediction_needs_no_shuffle_and_filters_reach_the_scan(spark, sf, reviews):
    model = models.fit_naive_bayes(reviews, "review", "sentiment", dim=64)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shown = plan(model.transform(docs.filter("n_chars > 100"), "text").select("doc_id", "prediction"))
    assert "Exchange" not in shown and "GreaterThan(n_chars,100)" in shown


def test_versions_and_refit(spark, reviews):
    reviews.createOrReplaceTempView("reviews")
    path = new_dir(spark, "model")
    models.refit(spark, "SELECT * FROM reviews WHERE sentiment = 'pos'", "review", "sentiment", path, 1)
    models.refit(spark, "SELECT * FROM reviews", "review", "sentiment", path, 2)
    assert models.load_version(spark, "sentiment", path, 1).classes == ("pos",)
    assert models.load_version(spark, "sentiment", path) == models.fit_naive_bayes(reviews, "review", "sentiment")


def test_model_limits(spark, reviews):
    many = spark.range(1_500).select(F.concat(F.lit("word"), "id").alias("t"), F.col("id").alias("label"))
    model = models.fit_naive_bayes(many, "t", "label", dim=4096)
    got = model.transform(many.filter("id % 100 = 7"), "t", block_numbers=4096 * 400)
    buckets = {r["t"]: r["b"] for r in many.select("t", models.term_buckets("t", 4096)[0].alias("b")).collect()}
    for r in got.collect():  # ties of one bucket go to the smallest label
        assert r["prediction"] == min(i for i in range(1_500) if buckets[f"word{i}"] == buckets[r["t"]])
    with pytest.raises(ValueError, match="no labelled"):
        models.fit_naive_bayes(reviews.filter("sentiment IS NULL"), "review", "sentiment")


def test_classifier_learns(spark, reviews):
    data = reviews.filter("sentiment IS NOT NULL").withColumn("y", (F.col("sentiment") == "pos").cast("int"))
    fitted = models.fit_classifier(data, "review", "y", dim=256)
    assert [r["prediction"] for r in fitted.transform(data).select("prediction").collect()][:3] == [1, 1, 0]


def test_user_generator(spark):
    df = models.render_prompts(spark.createDataFrame([("a",)], "x string"), "say {{x}}")
    assert models.generate(df, lambda p: p.str.upper()).first()["answer"] == "SAY A"


def test_summary_prefers_common_words(spark):
    data = [(1, "The fox ran. The the the. Zebra quux! Odd."), (2, "The fox"), (3, ""), (4, "--- !")]
    docs = spark.createDataFrame(data, "id int, text string")
    table = summarize.frequency_table(hash_bags(docs, "text"))
    got = {r["id"]: r["s"] for r in docs.select("id", summarize.summary("text", table).alias("s")).collect()}
    assert got == {1: "The fox ran. The the the", 2: "The fox", 3: "", 4: "---"}


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [(1, "Was the fox red?"), (2, "moon stars"), (3, "unknown words"), (4, "?")],
        "question_id bigint, question string",
    )


@pytest.fixture(scope="module")
def second(spark):
    data = [(1, "A red fox is a red animal"), (9, "Moon landing")]
    return hash_bags(spark.createDataFrame(data, "id bigint, content string"))


def test_retrieval_over_several_bases(kb, second, questions):
    found = ctx.retrieve({"a": kb, "b": second}, questions, 2)
    got = {(r["question_id"], r["rank"]): (r["kb"], r["id"]) for r in found.collect()}
    assert got[(1, 1)] in {("a", 1), ("b", 1)} and {q for q, _ in got} == {1, 2}
    assert all(rank <= 2 for _, rank in got)
    only = ctx.retrieve({"a": kb, "b": second}, questions, 2, {"a": {"id": {"$gt": 100}}})
    assert {r["kb"] for r in only.collect()} == {"b"}
    with pytest.raises(ValueError):
        ctx.retrieve({}, questions)


def test_prompts_keep_questions_without_context(kb, questions):
    found = ctx.retrieve({"a": kb}, questions, 1)
    got = {r["question_id"]: r["prompt"] for r in ctx.prompts(found, questions, "Q {{question}} C {{context}}").collect()}
    assert got[2] == "Q moon stars C Sun and moon! Stars too." and got[4] == "Q ? C " and len(got) == 4


def test_answers(kb, second, questions):
    agent = ctx.Agent({"a": kb, "b": second})
    got = {r["question_id"]: r["answer"] for r in agent.answer(questions).collect()}
    assert got[2] in ("Stars too", "Sun and moon") and got[3] == got[4] == ctx.NO_RESULT and len(got) == 4
    shout = ctx.Agent({"a": kb}, "{{question}} {{context}}", model=lambda p: p.str.upper())
    got = {r["question_id"]: r["answer"] for r in shout.answer(questions).collect()}
    assert got[2].startswith("MOON STARS") and got[4] == ctx.NO_RESULT


def test_context_tables(spark, kb, questions):
    notes = spark.createDataFrame([(3, "space"), (3, "sky"), (77, "x")], "key bigint, topic string")
    found = ctx.retrieve({"a": kb}, questions, 1)
    assert {(r["id"], r["topic"]) for r in ctx.attach_table(found, notes, "key", ["topic"], "a").collect()} == {
        (3, "space"), (3, "sky")
    }
    rows = {r["id"]: r["content"] for r in ctx.with_tables(found, {"notes": (notes, "key", "a")}).collect()}
    assert 'notes: {"topic":"sky"}\n{"topic":"space"}' in rows[3]
    assert rows[1] == "The red fox ran. It was quick and red."
    many = spark.range(1_200).select(F.lit(3).cast("bigint").alias("key"), "id")
    text = {r["id"]: r["content"] for r in ctx.with_tables(found, {"many": (many, "key", "a")}).collect()}[3]
    assert text.count("\n") == 1_200
    other = ctx.with_tables(found, {"many": (many, "key", "b")})
    assert sorted(other.collect()) == sorted(found.collect())
    agent = ctx.Agent({"a": kb}, model=lambda p: p, tables={"notes": (notes, "key", "a")})
    assert "space" in agent.answer(questions.filter("question_id = 2")).first()["answer"]


def test_context_of_ids_of_several_types(spark, kb, questions):
    talks = hash_bags(spark.createDataFrame([("x3", "Moon and stars"), ("3", "Sun")], "id string, content string"))
    found = ctx.retrieve({"a": kb, "b": talks}, questions.filter("question_id = 2"), 3)
    assert {(r["kb"], r["id"]) for r in found.collect()} == {("a", "3"), ("b", "x3")}


def test_other_dimensions_find_their_documents(spark, kb):
    rows = kb.select("id", "content")
    small = FrameBase(hash_bags(rows, dim=64), dim=64)
    tests = rows.filter("id < 4").selectExpr("id AS question_id", "content AS question", "id AS expected_doc_id")
    assert ev.evaluate_doc_id(small, tests, 5).first()["found"] == 3
    assert ev.evaluate_doc_id(kb, tests, 5).first()["found"] == 3
    assert ev.evaluate_doc_id(hash_bags(rows, dim=1 << 19), tests, 5).first()["found"] == 3  # the column names its buckets
    with pytest.raises(ValueError, match="buckets"):
        FrameBase(hash_bags(rows, dim=1 << 19), dim=4096)
    asked = tests.select("question_id", "question")
    assert ctx.retrieve({"s": small}, asked, 1).filter("id = question_id").count() == 3


def test_text_targets(spark, reviews):
    fitted = models.fit_classifier(reviews, "review", "sentiment", dim=256)
    got = {r["review"]: r["predicted"] for r in fitted.transform(reviews).collect()}
    assert got["bad awful"] == "neg" and got["great fun"] == "pos" and len(got) == 5
    path = new_dir(spark, "classifier")
    fitted.write().save(path)
    again = type(fitted).load(path).transform(reviews).select("predicted").collect()
    assert again == fitted.transform(reviews).select("predicted").collect()


def test_stored_definitions(spark, reviews):
    reviews.filter("sentiment = 'pos'").createOrReplaceTempView("reviews_now")
    path = new_dir(spark, "model")
    models.create_model(spark, path, "SELECT * FROM reviews_now", "review", "sentiment")
    asked = spark.createDataFrame([("bad awful",)], "text string")
    assert models.predict_model(spark, path, asked, "text").first()["prediction"] == "pos"
    reviews.createOrReplaceTempView("reviews_now")
    assert models.refit_model(spark, path) == 2
    assert models.predict_model(spark, path, asked, "text").first()["prediction"] == "neg"
    assert models.predict_model(spark, path, asked, "text", version=1).first()["prediction"] == "pos"
    with pytest.raises(ValueError, match="there is a model"):
        models.create_model(spark, path, "SELECT 1", "review", "sentiment")


def test_model_is_asked_with_context_only(spark, kb, questions):
    def note(prompts):
        return prompts.map(lambda p: "?" if p.endswith("|") else "ok")

    agent = ctx.Agent({"a": kb}, "{{question}}|{{context}}", model=note)
    got = {r["question_id"]: r["answer"] for r in agent.answer(questions).collect()}
    assert got == {1: "ok", 2: "ok", 3: ctx.NO_RESULT, 4: ctx.NO_RESULT}


def test_token_sums():
    rng = np.random.default_rng(5)
    logs = rng.integers(-9_000_000, 0, (16, 3))
    for numbers in (1, 9, 60, 10**6):
        lengths = rng.integers(0, 9, 40) * (rng.random(40) < 0.7)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        values = rng.integers(0, 16, ends[-1])
        want = [logs[values[a:b]].sum(axis=0) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert np.array_equal(models._token_sums(values, ends, logs, numbers), want)
