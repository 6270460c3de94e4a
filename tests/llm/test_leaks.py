import random

import numpy as np
import pytest
from brute import leak_edits

from lorekeep.llm.leaks import align, find_leaks, without_leaks

DOCS, ITEMS = "doc_id bigint, text string, item_id string, start int", "item_id bigint, text string, doc_id string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "y") for i in items], ITEMS)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at : at + rng.randint(0, 1)] = rng.choices("abé ", k=rng.randint(0, 2))
    return "".join(chars)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choices("abcdefgé  ", k=n))
    items = [(i, prose(rng.choice([20, 45, 60, 80, 120]))) for i in range(8)]
    docs = []
    for i in range(30):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            text += edited(rng, rng.choice(items)[1], rng.randint(0, 5)).upper() + prose(rng.randint(0, 30))
        docs.append((i, text))
    want = set()
    for i, text in docs:
        for j, item in items:
            if len(item) >= 40 and leak_edits(item, text) <= min(int(0.05 * len(item) + 1e-9), (len(item) - 10) // 10):
                want.add((i, j))
    found = find_leaks(*frames(spark, docs, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) >= len(want) > 5
    for r in found:
        stretch = dict(docs)[r["doc_id"]][r["start"] : r["end"]]
        assert leak_edits(dict(items)[r["item_id"]], stretch) <= r["edits"]
    blocks = find_leaks(*frames(spark, docs, items), block_chars=100).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    clean = without_leaks(*frames(spark, docs, items))
    assert clean.columns == ["doc_id", "text", "item_id", "start"]
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "X " + item), (4, "z" * 300_000 + item + "z" * 300_000), (5, "short")]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "short")]
    found = sorted(((r["doc_id"], r["edits"], r["start"], r["end"]) for r in find_leaks(*frames(spark, docs, items)).collect()), key=str)
    n = len(item)
    assert found == sorted([(3, 0, 0, n)] * 4 + [(4, 0, 300_000, 300_000 + n)] * 2 + [(None, 0, 2, 2 + n)] * 2, key=str)
    assert find_leaks(*frames(spark, docs, [])).collect() == []
    assert find_leaks(*frames(spark, [], items)).collect() == []
    assert without_leaks(*frames(spark, docs, [])).count() == 7


def test_align():
    to = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    assert align(to("abcd"), to("xxabcdxx"), 1, 0, 4) == (0, 6)
    assert align(to("abcd"), to("xxabdxx"), 1, 0, 4) == (1, 5)
    assert align(to("abcd"), to("zzzzzz"), 1, 0, 4) is None


def test_every_region_integer_ids_and_equal_names(spark):
    item = "how many legs does a spider have when it stands on the kitchen table at noon"
    filler = " ".join(f"word{i}" for i in range(60))
    near = item.replace("spider", "spidor")
    text = f"{filler} {item} {filler} {near} {filler}"
    docs = spark.createDataFrame([(1, text), (2, filler), (3, item)], "id int, text string")
    items = spark.createDataFrame([(7, item), (8, None)], "id int, text string")
    got = sorted(tuple(r) for r in find_leaks(docs, items, "id", "text", "id", "text").select("id", "item_id", "edits", "start", "end").collect())
    second = text.index(near)
    assert [g[:3] for g in got] == [(1, 7, 0), (1, 7, 1), (3, 7, 0)]
    assert text[got[0][3] : got[0][4]] == item and abs(got[1][3] - second) <= 1 and abs(got[1][4] - second - len(near)) <= 1


def test_overlapping_regions_count_once(spark):
    item = "ab cd ef gh " * 8
    docs = spark.createDataFrame([(1, "ab cd ef gh " * 40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    got = sorted((r["start"], r["end"]) for r in find_leaks(docs, items).collect())
    assert got and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
