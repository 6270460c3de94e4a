import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import packing
from lorekeep.llm.packing import knapsack, pack, patterns, sequences

PATH = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id bigint, text string, n bigint, rest string, index int"


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(spark, rows, length=2048, most_padding=None):
    """Every id in exactly one piece, right digests, gapless sequences that fit; returns the padding."""
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], SCHEMA)
    pieces = pack(docs, PATH, length=length)
    got = [r.asDict() for r in pieces.collect()]
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(ids_of(t))
    for r in got:
        by_doc[r["id"]][(r["doc_tokens"], r["start"], r["length"], r["ids_crc32"])] += 1
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, lists in texts.items():
        for ids in {tuple(x): x for x in lists}.values():
            n = sum(x == ids for x in lists)
            covered = np.zeros(len(ids), int)
            for (tokens, start, size, crc), times in by_doc[i].items():
                if tokens == len(ids) and zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()) == crc:
                    covered[start : start + size] += times
            same_length = sum(len(x) == len(ids) for x in lists)
            assert (covered == n).all() or same_length > n
    assert set(by_doc) == set(texts)
    assert sum(s for p in by_sequence.values() for _, s in p) == sum(len(ids_of(t)) for _, t in rows)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    made = {r["sequence_id"]: r["ids"] for r in sequences(docs, pieces, PATH).collect()}
    assert {k: len(v) for k, v in made.items()} == {k: sum(s for _, s in p) for k, p in by_sequence.items()}
    assert Counter(x for v in made.values() for x in v) == Counter(x for _, t in rows for x in ids_of(t)) or len(set(rows)) < len(rows)
    if most_padding is not None:
        assert padding <= most_padding
    return padding


WORDS = ["the", "thntwhre", "über", "naïve", "12", "3.4", "don't", "日本", "x y", " ", "", "a,b", "\n", "\t", "<|endoftext|>", "'s", "é", "🙂", "\x1c", "can'T"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé1.  　日🙂\x85\x1c<|>", max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    raw = [t.encode() for t in texts]
    ids, bounds = packing.coder(PATH)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in texts]


def test_ids_of_every_vocabulary_entry_and_long_words(monkeypatch):
    words = [t for t in (TOKENIZER.decode([i]) for i in range(TOKENIZER.get_vocab_size())) if "\ufffd" not in t]
    words += ["xq" * 4000, "e" * 5000, " " * 700 + "a", "don't " * 300, "é" * 999, "a|b " * 50, "<|endoftext|> x<|endoftext|>"]
    raw = [t.encode() for t in words]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [ids_of(t) for t in words]
    coder = packing.coder(PATH)
    assert coder.fast is not None
    for _ in range(2):
        ids, bounds = coder(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        monkeypatch.setattr(coder, "fast", None)


def test_knapsack_and_patterns_against_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 12, 5))
        prices = rng.random(len(sizes))
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [best[c - s] + p for s, p in zip(sizes, prices) if s <= c])
        counts, value = knapsack(sizes, prices, 20)
        assert counts @ sizes <= 20 and value == pytest.approx(best[20]) and counts @ prices == pytest.approx(value)
    for _ in range(10):
        sizes = np.unique(rng.integers(1, 65, 20))
        demand = rng.integers(1, 1000, len(sizes)).astype(float)
        basis, used = patterns(sizes, demand, 64, gap=1e-9)
        assert (basis.T @ sizes <= 64).all() and np.allclose(basis @ used, demand)
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))  # dual feasible: no pattern is worth more than 1
        assert knapsack(sizes, prices, 64)[1] <= 1 + 1e-6 and prices @ demand == pytest.approx(used.sum())


def test_small_corpus_is_packed_without_padding(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.choice([0, 1, 5, 60, 300, 900, 3000]))) for i in range(150)] + [(151, None), (152, ""), (None, "no id"), (None, None)]
    assert check(spark, rows, most_padding=0) == 0


def test_many_copies_of_one_length(spark):
    rng = random.Random(6)
    rows = [(i, "word " * 100 + str(i)) for i in range(400)] + [(500 + i, None) for i in range(300)] + [(1000 + i, text(rng, 40)) for i in range(200)]
    check(spark, rows, length=512, most_padding=512)


def test_repeated_rows(spark):
    rows = [(7, "same text twice")] * 40 + [(7, "other text")] * 3 + [(None, None)] * 50 + [(8, "a long one " * 400)] * 2
    check(spark, rows, length=256)


def test_gaps_are_filled(spark):
    # 1,500 tokens each: no two fit, so a good part is cut to fill the rest of the others
    rows = [(i, "a " * 750 + "b " * 749) for i in range(300)]
    padding = check(spark, rows)
    assert padding <= 0.02 * 300 * 1500


def test_empty_table_and_full_sequences_only(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = [(i, " ".join(["the"] * 255)) for i in range(5)]
    assert {len(ids_of(t)) for _, t in rows} == {256}
    assert check(spark, rows, length=256) == 0
