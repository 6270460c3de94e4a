"""Removals, notes ahead of rows, known dimensions and ways of scoring."""

import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.operators import kb as kb_module
from lorekeep.operators.context import retrieve
from lorekeep.operators.embed import embed_with, hash_bags
from lorekeep.operators.evaluate import evaluate_doc_id, passage_tests
from lorekeep.operators.kb import FrameBase, KnowledgeBase, KnowledgeBaseSpec, among
from lorekeep.operators.search import DENSE, search
from lorekeep.session import checkpointed, new_dir

SPEC = KnowledgeBaseSpec("id", ("text",))


def source(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string")


def held(kb):
    return {r["id"]: r["content"] for r in kb.rows().collect()}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def test_delete_follows_batch_order(spark):
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), SPEC)
    kb.append(source(spark, [(i, f"a{i}") for i in range(5)] + [(None, "no id")]), 0)
    kb.delete(ids(spark, 1, 2, 99, None), 1)
    assert held(kb) == {0: "a0", 3: "a3", 4: "a4", None: "no id"}
    kb.append(source(spark, [(1, "b1"), (3, "b3")]), 2)
    assert held(kb) == {0: "a0", 1: "b1", 3: "b3", 4: "a4", None: "no id"}
    kb.append(source(spark, [(i, f"a{i}") for i in range(5)]), 0)  # a retried load does not bring removed rows back
    assert held(kb) == {0: "a0", 1: "b1", 3: "b3", 4: "a4"}
    for _ in range(2):
        kb.delete(ids(spark, 0, 1), 3)
    compact = kb.compact()
    assert held(kb) == held(compact) == {3: "b3", 4: "a4"}
    compact.append(source(spark, [(0, "c0")]), 0)
    assert held(compact) == {0: "c0", 3: "b3", 4: "a4"}


def test_rows_are_never_readable_before_their_repeats_are_noted(spark, monkeypatch):
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), SPEC)
    kb.append(source(spark, [(1, "a"), (2, "b")]), 0)

    def crash(self, rows, data, feed, batch_id):
        write(self, rows, data, feed, batch_id)
        raise RuntimeError("lost after the rows were written")

    write = KnowledgeBase._write
    monkeypatch.setattr(KnowledgeBase, "_write", crash)
    with pytest.raises(RuntimeError):
        kb.append(source(spark, [(2, "new"), (3, "c")]), 1)
    monkeypatch.undo()
    assert held(kb) == {1: "a", 2: "new", 3: "c"} and kb.rows().count() == 3
    kb.append(source(spark, [(3, "again")]), 1)  # the replaced batch named fewer ids
    assert held(kb) == {1: "a", 2: "b", 3: "again"} and kb.rows().count() == 3


def test_stored_ids_are_not_shuffled_by_an_append(spark, monkeypatch):
    stored = checkpointed(spark.range(1000))
    few = checkpointed(ids(spark, 3, 5, 2000))
    found = among(stored, few)
    assert sorted(r["id"] for r in found.collect()) == [3, 5]
    assert "BroadcastHashJoin" in plan(found) and "Exchange hashpartitioning" not in plan(found)
    monkeypatch.setattr(kb_module, "LOOKUP_BYTES", 0)
    assert sorted(r["id"] for r in among(stored, few).collect()) == [3, 5]


def test_frames_name_their_dimension(spark):
    texts = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(50)], "id bigint, content string")
    small = hash_bags(texts, dim=256)
    tests = texts.select(F.col("id").alias("question_id"), F.col("content").alias("question"), F.col("id").alias("expected_doc_id"))
    found = evaluate_doc_id(small, tests).first()["found"]
    assert found == evaluate_doc_id(FrameBase(small, dim=256), tests).first()["found"] >= 45
    assert FrameBase(checkpointed(small)).dim == 256
    with pytest.raises(ValueError, match="256 buckets"):
        FrameBase(small, dim=4096)
    with pytest.raises(ValueError, match="dimension"):
        FrameBase(small.withColumn("vector", F.transform("vector", lambda b: b + 0)))


def test_bases_that_score_differently_merge_by_rank_only(spark):
    def model(series):
        return series.map(lambda t: [float(t.count("a")), float(t.count("b"))])

    def embed(df, column):
        return embed_with(df, model, column)

    texts = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "b b c")], "id bigint, content string")
    bases = {"bags": hash_bags(texts), "dense": FrameBase(embed(texts, "content"), embedder=embed, kind=DENSE)}
    asked = spark.createDataFrame([(0, "a b")], "question_id bigint, question string")
    with pytest.raises(ValueError, match="fuse"):
        retrieve(bases, asked, 4)
    got = [(r["kb"], r["id"], r["score"]) for r in retrieve(bases, asked, 4, fuse=True).orderBy("rank").collect()]
    assert got[:2] == [("bags", 1, 1 / 61), ("dense", 1, 1 / 61)] and len(got) == 4


def test_another_embedder_does_not_open_a_base(spark):
    def one(df, column):
        return df.withColumn("vector", F.array(F.length(column).cast("double"), F.lit(1.0)))

    def two(df, column):
        return df.withColumn("vector", F.array(F.lit(1.0), F.length(column).cast("double")))

    path = new_dir(spark, "kb")
    KnowledgeBase(spark, path, SPEC, embedder=one, kind=DENSE).append(source(spark, [(1, "a")]), 0)
    assert KnowledgeBase(spark, path, SPEC, embedder=one, kind=DENSE).check()
    with pytest.raises(ValueError, match="was made with"):
        KnowledgeBase(spark, path, SPEC, embedder=two, kind=DENSE).check()


def test_index_of_bags_follows_its_base(spark):
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), SPEC)
    kb.append(source(spark, [(i, f"red w{i % 5} w{i}") for i in range(40)]), 0)
    asked = spark.createDataFrame([(0, "red w3"), (1, "w7 w2")], "question_id bigint, question string")
    bags = hash_bags(asked, "question")
    for change in (lambda: None, lambda: kb.append(source(spark, [(3, "other"), (90, "red w3")]), 1), lambda: kb.delete(ids(spark, 8), 2)):
        change()
        kb.index()
        assert sorted(kb.search_indexed(asked, 4).collect()) == sorted(search(kb.rows(), bags, 4).collect())
    with pytest.raises(ValueError, match="filters"):
        kb.search_indexed(asked, 4, {"x": 1})


def test_passages_meet_the_texts_that_hold_them(spark):
    passages = ["one two three four five six seven", "ne two  three four five six seven eigh", "short one", "", None, "a b c d e f g h"]
    texts = ["zero one two three four five six seven eight", "one two  three four five six seven eight nine", "a short one", None, "", "xa b c d e f g hx a b", "one two three four five six"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    asked = spark.createDataFrame(list(enumerate(passages)), "question_id bigint, question string")
    got = {(r["question_id"], r["expected_doc_id"]) for r in passage_tests(rows, asked).collect()}
    assert got == {(q, i) for q, p in enumerate(passages) for i, t in enumerate(texts) if p is not None and t is not None and p in t}
