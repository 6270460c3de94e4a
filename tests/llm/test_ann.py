import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm.ann import nearest

SCHEMA = "vec_id bigint, embedding array<float>, score double, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.5, "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    out = {}
    for q in queries:
        v = dict(rows)[q]
        scores = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), i) for i, w in rows if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 32))
    rows = [(i, centres[i % 8] + 0.7 * rng.standard_normal(32)) for i in range(1500)]
    df = frame(spark, rows).repartition(3)
    asked = df.filter(F.col("vec_id") % 20 == 0)
    got, want = found(nearest(df, asked, "vec_id", "embedding", 20)), brute(rows, range(0, 1500, 20), 20)
    share = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(share) >= 0.98
    exact = dict(rows)
    assert all(s == pytest.approx(float(np.dot(np.float64(np.float32(exact[q])), np.float64(np.float32(exact[i])))), abs=1e-9) for q in got for i, s in got[q])
    blocks = found(nearest(df, asked, "vec_id", "embedding", 20, block_bytes=4_000))
    assert {q: [i for i, _ in v] for q, v in blocks.items()}.keys() == got.keys()


def test_ties_and_copies(spark):
    """A third of the rows are one vector: the smallest ids are found, one's own is not."""
    rows = [(i, [1, 2, 3, 4]) if i % 3 == 0 else (i, [math.sin(i), math.cos(i), 0.1, -1]) for i in range(120)]
    df = frame(spark, rows)
    got = found(nearest(df, df.filter("vec_id IN (0, 60, 119)"), "vec_id", "embedding", 5))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[60]] == [0, 3, 6, 9, 12]
    assert got[0][0][1] == 30.0
    assert [i for i, _ in got[119]] == [i for i, _ in brute(rows, [119], 5)[119]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0, 1]), (2, None), (3, [0, 0]), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, [1, 1]), (8, [1, 1, 1]), (20, [2, 0]), (40, None), (7, [1, 1])]
    df = frame(spark, rows)
    got = found(nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", 20))
    assert {q: {i for i, _ in v} for q, v in got.items()} == {0: {1, 7, 20}, 20: {0, 1, 7}}
    assert got[20] == [(0, 2.0), (7, 2.0), (1, 0.0)]
    assert found(nearest(df.limit(0), df.limit(0), "vec_id", "embedding")) == {}
    assert found(nearest(df, df.limit(0), "vec_id", "embedding")) == {}
    assert found(nearest(df.filter("vec_id = 0"), df.filter("vec_id = 0"), "vec_id", "embedding")) == {}
    with pytest.raises(ValueError):
        nearest(df, df, "vec_id", "embedding", 0)


def test_every_length_of_vectors_and_narrow_ids(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(100 + i, [float(i), 2.0, -1.0]) for i in range(41)] + [(300, [5.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = found(nearest(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5))
    for length in (2, 3):
        same = [r for r in rows if len(r[1]) == length]
        asked = [i for i, _ in same if i % 20 == 0]
        want = brute(same, asked, 5)
        assert {q: [i for i, _ in got[q]] for q in asked} == {q: [i for i, _ in want[q]] for q in asked}
    assert 300 not in got
