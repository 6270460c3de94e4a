import random

import pytest
from brute import components
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lorekeep.llm import jaccard
from lorekeep.llm.jaccard import jaccard_components

SCHEMA = "doc_id bigint, text string, n_shingles string, n bigint"


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard_components(df, **more).collect()), key=str)


def near_copies(seed, n_docs=60, groups=6):
    """Groups of edited copies, a passage shared by all, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 12, 40, 90, 91, 200]))] for _ in range(groups)]
    rows = []
    for i in range(n_docs):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            if words:
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i * 7 % 101, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2 if seed % 2 else 32)
    rows = near_copies(seed)
    assert found(spark, rows) == components(rows)


def test_lower_threshold_and_width(spark):
    rows = near_copies(11)
    assert found(spark, rows, width=2, percent=50) == components(rows, 2, 50)


def test_odd_rows(spark):
    long = "été " * 3 + "w " * 50_000 + " ".join(map(str, range(3_000)))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (9, "one TWO"), (5, "one two three"), (6, long), (7, long + " end"),
            (None, "one two"), (8, "one two"), (10, "a b c d e"), (11, "A\x0bB\x0cc d\re")]
    assert found(spark, rows) == components(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_hot_group(spark):
    """Copies and near copies of one text, a third of the table and more."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(100)]
    rows += [(100 + i, " ".join([*base[:59], f"x{i}"])) for i in range(100)]
    rows += [(200 + i, " ".join([f"y{i}"] * 3)) for i in range(20)]
    assert found(spark, rows) == components(rows)


def test_missing_column(spark):
    with pytest.raises(ValueError, match="lacks"):
        jaccard_components(spark.range(3))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=14), max_size=12))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    assert found(spark, rows, width=2, percent=60) == components(rows, 2, 60)
