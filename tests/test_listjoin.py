"""Questions of any number meet the lists of an inverted file."""

import numpy as np
import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.operators import ivf
from lorekeep.operators.listjoin import search_join
from lorekeep.operators.search import DENSE, search
from lorekeep.session import new_dir


def rows(df):
    return sorted((str(r["question_id"]), r["id"], r["score"], r["rank"]) for r in df.collect())


def frame(spark, matrix, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} bigint, vector array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    matrix = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 8)) / 8
    matrix[100:250] = matrix[100]  # a hot list of copies
    matrix[7] = 0
    path = new_dir(spark, "ivf")
    base = frame(spark, matrix).withColumn("even", F.col("id") % 2)
    ivf.build_index(base, path, lists=12)
    return path, base, frame(spark, matrix, "question_id")


@pytest.mark.parametrize("part_rows", [1_000, 16])
def test_join_equals_search(spark, clustered, part_rows):
    path, base, asked = clustered
    assert rows(search_join(spark, path, asked, 4, part_rows=part_rows)) == rows(search(base, asked, 4, kind=DENSE))


def test_filters_nulls_and_more_than_there_is(spark, clustered):
    path, base, asked = clustered
    some = asked.filter("question_id < 30").withColumn("question_id", F.col("question_id").cast("string"))
    some = some.union(spark.createDataFrame([(None, [1.0] * 8), ("none", None)], "question_id string, vector array<double>"))
    wanted = search(base.filter("even = 1 AND id < 20"), some, 50, kind=DENSE)
    got = search_join(spark, path, some, 50, {"even": 1, "id": {"$lt": 20}})
    assert rows(got) == rows(wanted)
    assert rows(search_join(spark, path, some.limit(0), 5)) == []
    with pytest.raises(ValueError):
        search_join(spark, path, some, 0)


def test_tree_and_later_versions(spark, clustered):
    _, base, asked = clustered
    path = new_dir(spark, "ivf")
    ivf.build_tree_index(base.filter("id % 3 <> 0"), path, lists=16)
    ivf.refresh_index(base.filter("id % 5 <> 0"), path)
    assert rows(search_join(spark, path, asked, 3)) == rows(search(base.filter("id % 5 <> 0"), asked, 3, kind=DENSE))


def test_no_part_holds_more_than_its_share(spark, clustered, monkeypatch):
    from lorekeep.operators import listjoin

    path, base, asked = clustered
    met = listjoin._meet
    seen = []

    def count(some, index, sizes, k, part_rows):
        seen.append(some)
        return met(some, index, sizes, k, part_rows)

    monkeypatch.setattr(listjoin, "_meet", count)
    joined = search_join(spark, path, asked, 3)
    assert "Broadcast" not in plan(joined).split("FlatMapCoGroups")[0]
    own, others = seen
    assert own.count() == 500
    assert others.count() < 500 * 11 / 2  # bounds keep most lists apart
