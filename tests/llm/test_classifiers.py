import random
import zlib

import numpy as np
import pytest

from lorekeep.llm import quality, toxicity

DOCS, LABELS = "doc_id bigint, text string, label string, score double, id bigint", "doc_id bigint, quality int, toxic int"


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeghilmnoprstu", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 120))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            text = [w + "%%%" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobnik", "Plunkos!", "you idiot", "st0opid grobnik"]))
        docs.append((i, " ".join(text), "x", 0.5, -i))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), labels


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out(spark, name):
    docs, labels, known = corpus(spark)
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    rows = score(docs, labels).collect()
    assert len(rows) == len(known) and set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    want = {i: q if name == "quality" else t for i, q, t in known}
    limit = 0.3 if name == "quality" else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.95


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, score):
    docs, labels, _ = corpus(spark, 200)
    odd = [(900, None, None, None, None), (901, "", None, None, None), (None, "no id", None, None, None),
           (902, "wörter " * 100_000, None, None, None), (903, "same", None, None, None), (903, "same", None, None, None)]
    more = spark.createDataFrame([(900, None, None), (None, 1, 1), (5, 0, 0), (5, 1, 1)], LABELS)
    rows = score(docs.union(spark.createDataFrame(odd, DOCS)), labels.union(more)).collect()
    assert len(rows) == 206
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[900] == by[901] and by[903][0] == by[903][1] and all(s is not None for v in by.values() for s in v)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_nothing_to_learn(spark, score):
    docs, labels, _ = corpus(spark, 20)
    assert score(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in score(docs, labels.limit(0)).collect()} == {0.5}
    ones = labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    assert {r["score"] for r in score(docs, ones).collect()} == {1.0}


def test_keep_good(spark):
    docs, labels, _ = corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.score_quality(docs, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.95


def test_hidden_and_near(spark):
    text = "YOU are an 1d10t and trash. nothing else".encode()
    data = np.frombuffer(text, np.uint8)
    none = (np.zeros(0, np.uint64), np.zeros(0))
    f = toxicity.dense_features(data, np.array([0, len(data)]), none, toxicity.word_hashes(toxicity.INSULTS), toxicity.word_hashes(toxicity.SECOND_PERSON))
    assert f["insults"][0] == 1 and f["hidden"][0] == 1 and f["near_you"][0] == 0
    data = np.frombuffer("you idiot".encode(), np.uint8)
    f = toxicity.dense_features(data, np.array([0, len(data)]), none, toxicity.word_hashes(toxicity.INSULTS), toxicity.word_hashes(toxicity.SECOND_PERSON))
    assert f["near_you"][0] == 1 and f["hidden"][0] == 0
