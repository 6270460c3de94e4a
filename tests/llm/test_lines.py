import random

import numpy as np
import pytest
from brute import deduplicated, word_edits
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lorekeep.llm import lines, tables
from lorekeep.llm.lines import deduplicate_lines, edits_within, one_edit
from lorekeep.llm.queries import op1_line_dedup

SCHEMA = "doc_id bigint, text string, numbers string, `key` bigint"


def kept(spark, rows, **more):
    df = deduplicate_lines(spark.createDataFrame([(i, t, "n", 7) for i, t in rows], SCHEMA), **more)
    assert df.columns == ["doc_id", "text", "numbers", "key"]
    found = df.collect()
    assert all((r["numbers"], r["key"]) == ("n", 7) for r in found)
    return {r["doc_id"]: r["text"] for r in found}


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 4)))
    pool = [[word() for _ in range(rng.randint(1, 14))] for _ in range(25)]
    rows = []
    for i in rng.sample(range(500), n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            line = rng.choice([" ", "  ", "\t"]).join(words)
            lines.append(line.upper() if rng.random() < 0.2 else line)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    assert kept(spark, rows, min_words=2, near_words=4) == deduplicated(rows, 2, 4)


def test_odd_rows(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(3, line), (1, None), (2, ""), (7, "\n\n"), (5, "x\n" + line.upper() + " twelve\r\ny"), (8, line.replace("six", "6") * 2_000),
            (9, "short line"), (10, "short line"), (11, (line + "\n") * 3)]
    assert kept(spark, rows) == deduplicated(rows, 5, 10)
    assert kept(spark, []) == {}


def test_repeated_ids_and_no_id(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line), (None, line), (4, line), (4, line), (5, line)], "doc_id bigint, text string")
    rows = sorted(((r["doc_id"], r["text"]) for r in deduplicate_lines(df).collect()), key=str)
    assert rows == [(4, line), (4, line), (5, ""), (None, line), (None, line)]


def test_drop_empty(spark):
    line = "one two three four five six"
    assert kept(spark, [(1, line), (2, line), (3, ""), (4, line + "\nmore")], drop_empty=True) == {1: line, 3: "", 4: "more"}


def test_hot_line(spark):
    line = "a b c d e f g h i j k l"
    rows = [(i, line if i % 3 else line.replace("f", f"f{i}")) for i in range(300)]
    assert kept(spark, rows) == deduplicated(rows, 5, 10)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aÉ \n", max_size=20), max_size=10))
def test_any_texts(spark, lines):
    rows = list(enumerate(lines))
    assert kept(spark, rows, min_words=1, near_words=2) == deduplicated(rows, 1, 2)


def test_one_edit():
    assert one_edit([1, 2, 3], [1, 3]) and one_edit([1], []) and one_edit([1, 2], [1, 9]) and one_edit([], [])
    assert not one_edit([1, 2], [2, 1]) and not one_edit([1, 2, 3], [1]) and not one_edit([1, 2, 3], [3, 1, 2, 3, 4])


def test_short_lines(spark, tmp_path):
    rows = [(1, "Menu\n\nsee also\none two three four five"), (2, "menu\n\nsee  also\none two three four 5"), (3, "see this\n \none three four five"), (4, "a b c d e f g h i"), (5, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (0 if t == "" else len(t.split("\n")), len(t)) for i, t in deduplicated(rows, 1, 5).items()}
    assert {r["doc_id"]: (r["n_kept"], r["n_chars"]) for r in op1_line_dedup(spark, str(tmp_path)).collect()} == want
    assert want[2] == (0, 0) and want[5] == (0, 0)
    left = corpus_pipeline.distinct_lines(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {i: t for i, t in deduplicated(rows, 1, 5).items() if t.strip() or t == dict(rows)[i]}


def test_long_lines(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(30)]
    pool = [passage + [word() for _ in range(n)] for n in (25, 40, 70, 150, 300)]
    rows = []
    for i in range(60):
        words = list(rng.choice(pool))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((i, " ".join(words)))
    gone, words_in = set(), [t.split() for _, t in rows]
    for i, x in enumerate(words_in):
        if any(word_edits(x, y) <= max(1, min(len(x), len(y)) // 30) for y in words_in[:i]):
            gone.add(i)
    assert kept(spark, rows) == {i: "" if i in gone else t for i, t in rows}
    one = {i for i, x in enumerate(words_in) if any(word_edits(x, y) <= 1 for y in words_in[:i])}
    assert len(gone - one) > 5 and len(gone) < 58


def test_edits_within():
    rng = random.Random(2)
    for _ in range(300):
        x, y = rng.choices("abc", k=rng.randint(0, 9)), rng.choices("abc", k=rng.randint(0, 9))
        assert all(edits_within(x, y, k) == (word_edits(x, y) <= k) for k in range(6))


def test_shared_passage_needs_no_pairs(spark, monkeypatch):
    """Lines that share only a passage are not verified against each other, however many they are."""
    rng, met = random.Random(8), []
    passage = [f"p{i}" for i in range(25)]
    real = lines.verified_pairs
    monkeypatch.setattr(lines, "verified_pairs", lambda docs, pairs: met.append(pairs.count()) or real(docs, pairs))
    for n in (200, 800):
        rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + passage + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(n)]
        rows.append((n, rows[5][1].replace(" p3 ", " ").replace(" p9 ", " x ")))
        left = kept(spark, rows)
        assert left == {**dict(rows), n: ""}
    assert met[0:3] == met[3:6] and sum(met) <= 4


def test_parities_change_by_two_per_edit():
    rng = random.Random(4)
    for _ in range(50):
        x = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 90))]
        y = list(x)
        for _ in range(3):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = [f"w{rng.randrange(300)}"] * rng.randint(0, 1)
        data = f"{' '.join(x)}\n{' '.join(y) or 'w'}".encode()
        both = lines.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)])).parities()
        assert sum(int(p[0] ^ p[1]).bit_count() for p in both) <= 2 * word_edits(x, y or ["w"])


def test_only_shared_keys_become_rows(spark, monkeypatch):
    """Where runs are too many to be counted apart, as in large inputs, keys of one line alone do not become rows."""
    monkeypatch.setattr(lines, "count_slots", lambda n: lines.CHUNK)
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(90))) for i in range(300)]
    rows.append((300, rows[7][1].replace(" ", " extra ", 1)))
    docs = spark.createDataFrame(rows, "id bigint, text string")
    keys = lines.key_table(lines.line_keys(docs, len(rows), 1, 5), len(rows)).collect()
    assert {r["id"] for r in keys if r["role"] == lines.RARE} >= {7, 300}
    assert len(keys) < 60  # 10 keys of every line before
    assert kept(spark, rows, near_words=5) == dict(rows) | {300: ""}


def test_packed_keys_and_counts():
    keys = np.array([5, 9, 5, 5, 1 << 40, 5], np.uint64) << np.uint64(16)
    owners = np.array([1, 2, 3, 1, 4, 2], np.uint64) << np.uint64(32)
    packer = lines.Packer(4)
    assert list(packer.add(keys, owners)) == []
    (batch,) = packer.sent()
    assert not list(packer.sent()) and batch.column("part").to_pylist() == [0]
    values = np.frombuffer(batch.column("keys")[0].as_py(), np.uint64)
    assert [(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in values] == [(0, 1), (0, 3), (1 << 24, 4)]
    counts, total = np.zeros(lines.CHUNK, np.uint16), np.ones(lines.CHUNK, np.int64)
    counts[[0, 7, 4095]] = 1, 65_535, 300
    names, (piece,) = lines.packed_counts(np.concatenate([np.zeros_like(counts), counts]))
    assert names.tolist() == [1]
    lines.add_counts(total, piece)
    assert (total == counts.astype(np.int64) + 1).all()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_more_than_a_broadcast(spark, monkeypatch, kind):
    """Many lines to verify and to remove: texts are not shuffled to verify them, and only those that lose lines after that."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    rows = texts(5) + [(600 + i, t) for i, t in texts(5)[:20]] + [(700, None), (701, "")]
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"{i:04d}")
    df = spark.createDataFrame([(name(i), t) for i, t in rows] + [(None, "a b c d"), (None, "a b c d")], f"doc_id {kind}, text string")
    found = [(r["doc_id"], r["text"]) for r in deduplicate_lines(df, min_words=2, near_words=4).collect()]
    want = deduplicated(rows, 2, 4)
    assert dict(x for x in found if x[0] is not None) == {name(i): t for i, t in want.items()}
    assert [t for i, t in found if i is None] == ["a b c d"] * 2 and len(found) == len(rows) + 2
    docs = df.filter("doc_id IS NOT NULL").select(df.doc_id.alias("id"), "text")
    wanted = spark.createDataFrame([(name(rows[0][0]), [0]), (name(701), [0])], f"id {kind}, numbers array<int>")
    words = lines.line_words(docs, wanted)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["number"]) for r in words.collect()} >= {(name(rows[0][0]), 0), (name(701), 0)}
