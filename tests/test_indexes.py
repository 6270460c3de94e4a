"""Index structures: removals over several refreshes, two levels of centres, blocks of postings."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.operators import blocks, ivf
from lorekeep.operators.embed import hash_bags
from lorekeep.operators.postings import build_postings, refresh_postings, search_postings
from lorekeep.operators.search import DENSE, search
from lorekeep.session import new_dir


def rows(df):
    return {(r["question_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


def vector_frame(spark, matrix, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} bigint, vector array<double>")


def bags(spark, texts, key="id"):
    return hash_bags(spark.createDataFrame(list(enumerate(texts)), f"{key} bigint, content string"))


def test_removals_in_successive_refreshes_stay_removed(spark):
    rng = np.random.default_rng(1)
    frame = vector_frame(spark, rng.normal(size=(60, 4)))
    asked = vector_frame(spark, rng.normal(size=(5, 4)), "question_id")
    path = new_dir(spark, "ivf")
    ivf.build_index(frame, path, lists=4)
    for gone in ([7], [7, 8], [7, 8], [8], []):
        kept = frame.filter(~F.col("id").isin(gone)) if gone else frame
        ivf.refresh_index(kept, path)
        assert sorted(r["id"] for r in ivf.read_index(spark, path).select("id").collect()) == [i for i in range(60) if i not in gone]
        assert rows(ivf.search_index(spark, path, asked, 6)) == rows(search(kept, asked, 6, kind=DENSE))


def test_removals_of_postings(spark):
    frame = bags(spark, [f"red fox w{i % 7} w{i}" for i in range(30)])
    asked = bags(spark, ["red w3", "fox w9"], "question_id")
    spark.sql("CREATE DATABASE IF NOT EXISTS test_index")
    path = new_dir(spark, "postings")
    build_postings(frame, "test_index.removed", path, parts=3)
    for gone in ([3], [3, 4], [4], []):
        kept = frame.filter(~F.col("id").isin(gone)) if gone else frame
        refresh_postings(kept, "test_index.removed", path)
        assert rows(search_postings(spark, "test_index.removed", path, asked, 8)) == rows(search(kept, asked, 8))


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    kb = np.concatenate([c + rng.normal(size=(60, 16)) * 0.25 for c in centres])
    asked = kb[rng.choice(len(kb), 50, replace=False)] + rng.normal(size=(50, 16)) * 0.1
    path = new_dir(spark, "tree")
    frame = vector_frame(spark, kb)
    ivf.build_tree_index(frame.filter("id % 10 <> 3"), path, lists=49)
    ivf.refresh_index(frame, path)
    return frame, vector_frame(spark, asked, "question_id"), path


def test_rows_and_questions_meet_few_centres(spark, tree):
    known = ivf.read_tree(spark, tree[2])
    assert 20 < len(known.lists) <= 60
    assert known.compared() < 3 * np.sqrt(len(known.lists))
    index = ivf.read_index(spark, tree[2])
    assert index.count() == index.select("id").distinct().count() == 2400


def test_tree_is_exact_with_all_lists_and_near_with_few(spark, tree):
    frame, asked, path = tree
    want = rows(search(frame, asked, 20, kind=DENSE))
    known = ivf.read_tree(spark, path)
    assert rows(ivf.search_index(spark, path, asked, 20)) == want
    assert rows(ivf.search_index(spark, path, asked, 20, nprobe=len(known.lists), groups=len(known.groups))) == want
    found = rows(ivf.search_index(spark, path, asked, 20, nprobe=8))
    assert len({r[:2] for r in found} & {r[:2] for r in want}) >= 0.9 * len(want)


def test_a_row_goes_to_the_list_that_is_nearest_within_its_group(spark, tree):
    frame, _, path = tree
    known = ivf.read_tree(spark, path)
    for r in ivf.read_index(spark, path).limit(200).collect():
        unit = ivf.unit_rows(np.array([r["vector"]]))
        group = ivf.distances(unit, known.groups)[0].argmin()
        far = ivf.distances(unit, known.lists)[0]
        assert known.group_of[r["list_id"]] == group
        assert far[r["list_id"]] == pytest.approx(far[known.group_of == group].min()) == pytest.approx(r["away"])


def test_hot_group_and_tiny_bases(spark):
    rng = np.random.default_rng(2)
    kb = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(60, 8))])
    path = new_dir(spark, "tree")
    ivf.build_tree_index(vector_frame(spark, kb), path, lists=25)
    asked = vector_frame(spark, rng.normal(size=(4, 8)), "question_id")
    assert rows(ivf.search_index(spark, path, asked, 5)) == rows(search(vector_frame(spark, kb), asked, 5, kind=DENSE))
    one = new_dir(spark, "tree")
    ivf.build_tree_index(vector_frame(spark, kb[-1:]), one)
    assert len(rows(ivf.search_index(spark, one, asked, 5, nprobe=1))) == 4


WORDS = ["the", "the", "the", "of", "red", "fox", "dog", "sun", "moon", "éa", "rare", "x1", "x2"]
text = st.lists(st.sampled_from(WORDS), max_size=9).map(" ".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text, min_size=1, max_size=40), st.lists(text, min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 4))
def test_blocks_equal_search(spark, docs, asked, k, size):
    kb, questions = bags(spark, docs), bags(spark, asked, "question_id")
    path = new_dir(spark, "blocks")
    blocks.build_blocks(kb, path, rows_per_block=size)
    want = rows(search(kb, questions, k))
    assert rows(blocks.search_blocks(spark, path, kb, questions, k)) == want
    assert rows(blocks.search_blocks(spark, path, kb, questions, k, broadcast_bytes=200)) == want


def test_common_words_are_not_read(spark):
    """Every row has the common word; the rare words decide, so few of its postings are read."""
    rng = np.random.default_rng(9)
    docs = [" ".join(["common"] * 2 + [f"w{rng.integers(0, 400)}" for _ in range(12)]) for _ in range(4000)]
    kb = bags(spark, docs)
    asked = bags(spark, ["common w1 w2 w3", "common w7 common w9 w11"], "question_id")
    path = new_dir(spark, "blocks")
    blocks.build_blocks(kb, path, rows_per_block=64)
    chosen, everything = blocks.chosen_blocks(spark, path, kb, asked, 5)
    read, known = (f.agg(F.sum("n")).first()[0] for f in (chosen, everything))
    assert read < 0.2 * known
    assert rows(blocks.search_blocks(spark, path, kb, asked, 5)) == rows(search(kb, asked, 5))


def test_text_ids_and_empty_base(spark):
    kb = bags(spark, ["red fox", "red dog", ""]).withColumn("id", F.concat(F.lit("n"), "id"))
    asked = bags(spark, ["red", "nothing"], "question_id")
    for base in (kb, kb.limit(0)):
        path = new_dir(spark, "blocks")
        blocks.build_blocks(base, path)
        assert rows(blocks.search_blocks(spark, path, base, asked, 2)) == rows(search(base, asked, 2))


def test_copies_tie_by_id_in_blocks(spark):
    kb = bags(spark, ["same text here"] * 900 + ["other text"] * 20)
    asked = bags(spark, ["same text", "text"], "question_id")
    path = new_dir(spark, "blocks")
    blocks.build_blocks(kb, path, rows_per_block=16)
    assert rows(blocks.search_blocks(spark, path, kb, asked, 7)) == rows(search(kb, asked, 7))
