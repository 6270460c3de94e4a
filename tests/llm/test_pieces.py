import functools
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import pieces as sp

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return sp.load_pieces(PATH)


@pytest.fixture(scope="module")
def known():
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {m.id_to_piece(i).replace("▁", " "): (i, m.get_score(i)) for i in range(259, m.get_piece_size())}


def best_score(text, known, unknown):
    """Largest score over all segmentations, by trying every piece at every place."""

    @functools.cache
    def rest(at):
        if at == len(text):
            return 0.0
        scores = [known[text[at:end]][1] + rest(end) for end in range(at + 1, len(text) + 1) if text[at:end] in known]
        return max([*scores, unknown + rest(at + 1)])

    return rest(0)


def encode(model, texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, ends = sp.Encoder(model).encode(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def check(model, known, text, ids):
    names = {i: t for t, (i, _) in known.items()}
    joined = b"".join(names[i].encode() if i in names else bytes([i - 3]) for i in ids)
    assert joined.decode() == (" " + text if text else "")
    total, left = 0.0, 0
    for i in ids:
        if i in names:
            total += known[names[i]][1]
        elif not left:
            byte = i - 3
            left = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            total += model.unknown_score
        left = max(0, left - 1) if i not in names else 0
    return total


@pytest.mark.parametrize("text", ["Hello  world", "a", "", "   ", "été où\nla 梦 ▁x", "x" * 60 + "\t\u0007🙂", "ththing ofanreand"])
def test_best_segmentation(model, known, text):
    ids = encode(model, [text])[0]
    assert check(model, known, text, ids) == (best_score(" " + text, known, model.unknown_score) if text else 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" abcdeinort\né▁🙂.0"), max_size=70), max_size=6))
def test_any_texts(model, known, texts):
    for text, ids in zip(texts, encode(model, texts), strict=True):
        if text:
            assert check(model, known, text, ids) == best_score(" " + text, known, model.unknown_score)


def test_both_ways_agree(model):
    rng = random.Random(5)
    units = ["".join(rng.choices("abcdefghté ", k=rng.randint(1, 40))).encode() for _ in range(300)]
    assert sp.segment_many(units, model) == [sp.segment(u, model)[0] for u in units]


def test_round_trip_of_a_table(spark, model):
    texts = [None, "", " ", "two  blanks ", "▁marker ▁▁", "été\r\n\t\0", "🙂" * 50, "long " * 100_000, "y" * 20_000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("doc_id", "ids_")
    coded = sp.encode_texts(df, model)
    assert coded.columns == ["ids_", "text", "ids"]
    back = {r["ids_"]: r for r in sp.decode_ids(coded.withColumnRenamed("text", "before"), model).collect()}
    for i, text in enumerate(texts):
        assert back[i]["text"] == text and (back[i]["ids"] is None) == (text is None)
    assert back[1]["ids"] == [] and back[9]["ids"] == back[10]["ids"]
    assert sp.encode_texts(df.limit(0), model).count() == 0


def test_odd_ids(spark, model):
    df = spark.createDataFrame([([], 1), (None, 2), ([0, 1, 2], 3), ([-5, 99_999_999, None], 4), ([3 + 0xC3], 5)], "ids array<int>, text int")
    assert [r["text"] for r in sp.decode_ids(df, model).collect()] == ["", None, "⁇ ", "", "�"]


def test_small_cache(monkeypatch, model):
    texts = ["one two three", "four five six", "one two three"]
    want = encode(model, texts)
    monkeypatch.setattr(sp, "CACHE_UNITS", 1)
    encoder, got = sp.Encoder(model), []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        got.append(encoder.encode(data, np.array([0, len(data)]))[0].tolist())
    assert got == want
