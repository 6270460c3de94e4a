import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import merkle, ranks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, idx int, path string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """The root of a list of digests, and of each one the siblings level by level, left and right."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            start = place // 8 * 8
            paths[i].append((digests[start:place], digests[place + 1 : start + 8]))
        digests = [H(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
        at = [place // 8 for place in at]
    return digests[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0], leaf(r)))
        made.append((members, *climb([leaf(r) for r in members])))
    if not made:
        return None, []
    root, over = climb([m[1] for m in made])
    out = []
    for (members, subroot, paths), upper in zip(made, over):
        for r, path in zip(members, paths):
            out.append((r[0], leaf(r), subroot, [("".join(a), "".join(b)) for a, b in path + upper]))
    return root, sorted(out, key=str)


def found(spark, rows):
    made = merkle.manifest(spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA), keep={"again": F.col("source")})
    steps = F.transform("path", lambda s: F.struct(merkle.hexed(s["before"]).alias("b"), merkle.hexed(s["after"]).alias("a")))
    got = made.leaves.select("doc_id", "leaf", "subroot", steps.alias("path"), merkle.fold(F.col("path"), F.col("leaf")).alias("folded"), merkle.siblings_digest(F.col("path")).alias("proof")).collect()
    for r in got:
        assert r["folded"] == made.root
        assert r["proof"] == H(*(s["b"] + s["a"] for s in r["path"]))
    return made.root, sorted(((r["doc_id"], r["leaf"], r["subroot"], [(s["b"], s["a"]) for s in r["path"]]) for r in got), key=str)


def documents(sizes, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "Ä text", "x" * 5000, f"t{i}"]), lang, rng.choice([None, "s"]), rng.choice([None, i])) for lang, n in sizes.items() for i in rng.sample(range(10_000), n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 9}, {"en": 1}, {None: 1, "": 1}, {None: 8, "de": 64, "en": 65, "z": 1, "é": 513}, {f"l{i}": i % 3 + 1 for i in range(20)}])
def test_equals_brute_force(spark, sizes):
    rows = documents(sizes)
    assert found(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (4, "a", "en", "s", 1), (4, "b", "en", "s", 1), (4, "b", "en", "s", 1), (2, None, None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == (None, [])


def test_groups_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", 0)
    rows = documents({"en": 200, "de": 3, None: 2})
    assert found(spark, rows) == brute(rows)


def test_changed_text_does_not_verify(spark):
    rows = documents({"en": 20, "de": 3})
    made = merkle.manifest(spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA), keep={"other": F.sha2(F.lit("x").cast("binary"), 256)})
    assert made.leaves.filter(merkle.fold(F.col("path"), F.col("other")) == made.root).isEmpty()
