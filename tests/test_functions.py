import datetime as dt

import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.functions.filters import compile_filter
from lorekeep.functions.prompt import render
from lorekeep.functions.scorers import coverage, jaccard, score_pairs
from lorekeep.functions.text import sentences, term_buckets, tokens


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expression.alias("x")).first()["x"]


def test_tokens_are_unicode_letters_and_digits(spark):
    assert one(spark, tokens("t"), t="Éleère, ß-Ωmega 42! 😀") == ["éleère", "ß", "ωmega", "42"]
    assert one(spark, tokens("t"), t="?! ...") == []


def test_buckets_keep_repeats_and_range(spark):
    got = one(spark, term_buckets("t", 16), t="a b a")
    assert len(got) == 3 and got[0] == got[2] and all(0 <= b < 16 for b in got)


@pytest.mark.parametrize("dim", [0, -1, (1 << 20) + 1])
def test_hash_dimension_is_bounded(spark, dim):
    with pytest.raises(ValueError):
        term_buckets(F.lit("a"), dim)


def test_sentences(spark):
    assert one(spark, sentences("t"), t="One. Two!\n\n Three?  ") == ["One", "Two", "Three"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "O'Hara", 5, dt.date(2023, 1, 1), True, dt.datetime(2023, 1, 1, 12)),
        (2, 'a "b"', 7, dt.date(2024, 1, 1), False, dt.datetime(2024, 1, 1, 12)),
        (3, None, None, None, None, None),
    ]
    return spark.createDataFrame(data, "id int, name string, n int, day date, ok boolean, ts timestamp")


@pytest.mark.parametrize(
    "document, ids",
    [
        (None, [1, 2, 3]),
        ({"name": "O'Hara"}, [1]),
        ({"name": {"$gt": "P"}}, [2]),
        ({"name": None}, [3]),
        ({"n": {"$gte": 5, "$lt": 7}}, [1]),
        ({"n": {"$gt": 5}, "name": 'a "b"'}, [2]),
        ({"n": {"$lte": 5.5}}, [1]),
        ({"day": {"$gt": "2023-06-01"}}, [2]),
        ({"day": dt.date(2023, 1, 1)}, [1]),
        ({"ts": {"$lte": "2023-01-01 12:00:00"}}, [1]),
        ({"ok": False}, [2]),
    ],
)
def test_filters(rows, document, ids):
    found = rows.filter(compile_filter(document, rows.schema))
    assert sorted(r["id"] for r in found.collect()) == ids


@pytest.mark.parametrize(
    "document, error",
    [
        ({"nope": 1}, ValueError),
        ({"n": {"$ne": 1}}, ValueError),
        ({"n": "5"}, TypeError),
        ({"n": True}, TypeError),
        ({"name": {"$gt": 5}}, TypeError),
        ({"n": {"$gt": None}}, ValueError),
    ],
)
def test_bad_filters_raise(rows, document, error):
    with pytest.raises(error):
        compile_filter(document, rows.schema)


def test_filters_reach_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(docs.filter(compile_filter({"lang": "en", "n_chars": {"$gt": 500}}, docs.schema)))
    assert "EqualTo(lang,en)" in text and "GreaterThan(n_chars,500)" in text


def test_prompt_renders_once_and_keeps_braces(spark):
    df = spark.createDataFrame([("{{b}}", None, 3)], "a string, b string, n int")
    got = df.select(render("<{{a}}|{{ b }}|{{n}}> O'Hara", df.columns).alias("x")).first()["x"]
    assert got == "<{{b}}||3> O'Hara"
    assert df.select(render("", df.columns).alias("x")).first()["x"] == ""
    with pytest.raises(ValueError):
        render("{{nope}}", df.columns)


def test_scorers(spark):
    pair = {"a": "the red fox", "b": "The fox, the dog"}
    assert one(spark, jaccard(F.col("a"), F.col("b")), **pair) == pytest.approx(2 / 4)
    assert one(spark, coverage(F.col("a"), F.col("b")), **pair) == pytest.approx(2 / 3)
    assert one(spark, jaccard(F.col("a"), F.col("b")), a="", b="") == 0
    assert one(spark, coverage(F.col("a"), F.col("b")), a="!", b="x") == 0


def test_user_scorer_runs_in_batches(spark):
    df = spark.createDataFrame([("ab", "abc"), ("x", "y")], "l string, r string")
    scored = score_pairs(df, "l", "r", pandas_scorer=lambda a, b: (b.str.len() - a.str.len()) * 1.0)
    assert [r["score"] for r in scored.collect()] == [1.0, 0.0]
