"""The stages against plain versions on a small corpus, each on its predecessor's rows."""

import random

import pytest
from brute import components, deduplicated, leak_edits

import corpus_pipeline
from lorekeep.llm import quality
from lorekeep.llm.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeghilmnoprstu", k=rng.randint(2, 7))) for _ in range(400)]
    item = " ".join(rng.choices(words, k=20))
    docs, labels = [], []
    for i in range(160):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(rng.randint(1, 4)))
        bad = rng.random() < 0.25
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        elif docs and rng.random() < 0.3:
            text = docs[rng.randrange(len(docs))][1]
            text = text.replace(" ", "  ") if rng.random() < 0.5 else " ".join([rng.choice(words), text, rng.choice(words)])
        elif rng.random() < 0.15:
            text += "\n" + item.upper()
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages(spark, folder):
    path, item = folder
    docs = table(spark, path, "documents")
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, table(spark, path, "labels")).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps, held = dict(corpus_pipeline.STAGES), []
    at = docs
    for name, stage in list(steps.items())[:-1]:
        at = stage(spark, at, path)
        assert at.columns == COLUMNS
        kept = at.collect()
        at = spark.createDataFrame(kept, docs.schema)
        held.append({r["doc_id"]: r["text"] for r in kept})
        assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None)
    assert held[0] == {i: t for i, t in rows.items() if scored[i]}
    lines = deduplicated(list(held[0].items()), 1, 5)
    assert held[1] == {i: t for i, t in lines.items() if t is None or t.strip() or t == held[0][i]}
    root = {i: c for i, _, c in components(list(held[1].items()))}
    assert held[2] == {i: t for i, t in held[1].items() if root[i] == i}
    budget = min(int(0.05 * len(item)), (len(item) - 10) // 10)
    assert held[3] == {i: t for i, t in held[2].items() if leak_edits(item, t) > budget}
    assert len(held[0]) > len(held[1]) > 0 and len(held[2]) > len(held[3]) > 0
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(last) == set(held[3])
    assert all(r["exact"] and (r["ids"] is None) == (held[3][i] is None) for i, r in last.items())
