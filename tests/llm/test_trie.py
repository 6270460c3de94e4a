import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lorekeep.llm import ranks, trie
from lorekeep.llm.trie import branched, placed_turns, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def originals(rows):
    """``{conv_id: [(role, text)]}`` in the order of turns, equal numbers in the order of the turn's id."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest() + str(len(text.encode()))
            convs[c].append((turn is not None, turn, name, (role, text)))
    return {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    below = {k: [0, 0] for k in members}
    for k, cs in members.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += children[k] == 0
            below[k[:d]][1] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    rows = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(k))
        rows.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(spark, rows, rebuild=True):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = prefix_trie(*(branched if rebuild else placed_turns)(df))
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str)


def conversations(seed, n=60, longest=30):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "a long text " * 9])))
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    return rows + rng.sample(rows, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_ROW", 3)
    rows = conversations(seed)
    assert found(spark, rows) == nodes(rebuilt(originals(rows)))


def test_long_conversations_span_parts_and_share_prefixes(spark):
    common = [("user" if i % 2 else "assistant", f"turn {i % 7}") for i in range(150)]
    rows = [(c, i, *t) for c, n in ((1, 150), (2, 150), (3, 149), (4, 8), (5, 16), (6, 17)) for i, t in enumerate(common[:n])]
    rows += [(7, i, *(t if i != 90 else ("user", "another"))) for i, t in enumerate(common)]
    assert found(spark, rows, rebuild=False) == nodes(originals(rows))


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_ROW", 16)
    rows = [(c, i, "user", f"t{i}") for c in range(0, 500, 5) for i in range(3)] + [(1000, 0, "user", "t0")]
    assert found(spark, rows) == nodes(rebuilt(originals(rows)))


def test_turnless_conversations_and_empty_table(spark):
    # conversations without turns after the rebuild: their base is absent and h covers their own turns
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9)]
    made = rebuilt(originals(rows))
    assert any(not t for t in made.values())
    assert found(spark, rows) == nodes(made)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_hot_owner_is_broadcast_alone(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", 0)
    rows = [(c, i, "user", f"t{i % 5}") for c, n in ((1, 900), (2, 40), (3, 5), (11, 900)) for i in range(n)]
    assert found(spark, rows, rebuild=False) == nodes(originals(rows))
