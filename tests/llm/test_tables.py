import random

from lorekeep.llm.tables import checkpointed, connected, flag_bits


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (201, 200), (300, 300)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = checkpointed(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert got == {x: find(x) for x in root if x != 300}
    assert connected(links.limit(0)).count() == 0


def test_flag_bits(spark):
    keys = [-5, 0, 7, 32_767, 32_768, 65_535, 1 << 40]
    bits = flag_bits(spark.createDataFrame([(k,) for k in keys], "key bigint"), "key", 1 << 16)
    on = {i for i in range(1 << 16) if bits[i >> 3] >> (i & 7) & 1}
    assert on == {k % (1 << 16) for k in keys}
