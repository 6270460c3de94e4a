import random

import pytest
from brute import licenses

from lorekeep.llm.license_texts import APACHE_HEADER, MIT, TEMPLATES
from lorekeep.llm.licenses import scan_licenses

SCHEMA = "doc_id bigint, text string, license string, unit int"


def found(spark, docs, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    return scan_licenses(df, **more).collect()


def test_equals_brute_force(spark):
    rng = random.Random(4)
    templates = [("a", "one two three four five six"), ("a", "one two three"), ("b", "uno dos tres cuatro"), ("c", "x y " * 20), ("d", "lone")]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(templates)[1].split() if rng.random() < 0.6 else rng.choices("p q r s".split(), k=rng.randint(0, 9))
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "été"
            lines.append(rng.choice([" ", ", ", "-"]).join(words).title() + rng.choice(["", ".", "\r"]))
        docs.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    rows = found(spark, docs, templates=templates, least=0.7)
    got = {(r["doc_id"], r["unit"], r["number"], r["license"]): r["dice"] for r in rows}
    assert len(got) == len(rows) > 20
    every = {(i, *k): d for i, t in docs for k, d in licenses(t, templates, 0.7).items()}
    top = {}
    for (i, kind, number, _), d in every.items():
        top[i, kind, number] = max(d, top.get((i, kind, number), 0))
    want = {k: d for k, d in every.items() if d == top[k[:3]]}
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    # what is missing is a larger unit of the same words as a smaller one
    order = ["line", "paragraph", "text"]
    for i, kind, number, name in set(want) - set(got):
        assert any(j == i and n == name and order.index(k) < order.index(kind) and got[j, k, m, n] == pytest.approx(want[i, kind, number, name]) for j, k, m, n in got)


def test_real_texts(spark):
    header = "\n".join("# " + x for x in APACHE_HEADER.split("\n"))
    docs = [
        (1, "Some prose of ours.\n\n" + MIT.upper() + "\n\nMore prose."),
        (2, header + "\n\nimport os\n" * 40),
        (3, "words\nReleased under the MIT license\nwords"),
        (4, "This has nothing to do with the license of the software and of the terms."),
        (5, MIT.replace("Software", "Program")),
    ]
    rows = found(spark, docs)
    assert {(r["doc_id"], r["license"], r["unit"]) for r in rows} >= {(1, "mit", "paragraph"), (2, "apache-2.0", "paragraph"), (3, "mit", "line"), (5, "mit", "paragraph")}
    assert 4 not in {r["doc_id"] for r in rows}
    assert all(0.8 <= r["dice"] <= 1 for r in rows)


def test_odd_rows(spark):
    notice = "Released under the MIT License."
    docs = [(1, None), (2, ""), (3, "\n\n\n"), (4, "word"), (5, notice), (5, notice), (None, notice), (6, "a b " * 200_000 + "\n" + notice)]
    rows = sorted(((r["doc_id"], r["unit"], r["number"], r["dice"]) for r in found(spark, docs)), key=str)
    assert rows == sorted([(5, "line", 0, 1.0)] * 2 + [(None, "line", 0, 1.0), (6, "line", 1, 1.0)], key=str)
    assert found(spark, []) == [] and found(spark, docs, templates=[]) == []


def test_paragraph_numbers_do_not_depend_on_other_rows(spark):
    notice = "Released under the\nMIT License."
    docs = [(1, "x\n"), (2, "\n" + notice), (3, "a\n\n" + notice)]
    rows = {r["doc_id"]: (r["unit"], r["number"]) for r in found(spark, docs) if r["dice"] == 1}
    assert rows == {2: ("paragraph", 0), 3: ("paragraph", 1)}


def test_every_template_finds_itself(spark):
    rows = found(spark, [(i, t.replace("\n", " ")) for i, (_, t) in enumerate(TEMPLATES)])
    assert sorted((r["doc_id"], r["license"], r["dice"]) for r in rows) == [(i, name, 1.0) for i, (name, _) in enumerate(TEMPLATES)]


def test_licences_inside_texts(spark):
    parted = MIT.replace("Permission", "\n\nPermission").replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    prose = " ".join(f"w{random.Random(k).randrange(900)}" for k in range(1500)) + "."
    docs = [(1, prose + "\n\n" + parted + "\n\n" + prose), (2, prose + "\nCopyright 2020 Foo. Released under the MIT License. " + prose),
            (3, prose), (4, (prose + "\n\n" + parted) * 3), (5, "Released under the MIT License.")]
    got = [(r["doc_id"], r["license"], r["unit"]) for r in found(spark, docs, windows=True)]
    assert sorted(got) == [(1, "mit", "window"), (2, "mit", "window"), *[(4, "mit", "window")] * 3, (5, "mit", "line")]


def test_windows_equal_brute_force(spark):
    rng = random.Random(7)
    templates = [("a", "one two three four five six"), ("b", "uno dos tres cuatro cinco")]
    gram = lambda w: set(zip(w, w[1:]))
    docs, want = [], {}
    for i in range(60):
        words = rng.choices("p q r one two three dos".split(), k=12)
        at = rng.randrange(12)
        words[at:at] = [w if rng.random() < 0.85 else "x" for w in rng.choice(templates)[1].split()]
        docs.append((i, "\n\n".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3))))
        for name, text in templates:
            b = gram(text.split())
            runs = [gram(words[k:m]) for k in range(len(words)) for m in range(k + 2, len(words) + 1)]
            top = max(2 * len(a & b) / (len(a) + len(b)) for a in runs)
            if top >= 0.8:
                want[i, name] = top
    rows = found(spark, docs, templates=templates, windows=True)
    got = {}
    for r in rows:
        got[r["doc_id"], r["license"]] = max(r["dice"], got.get((r["doc_id"], r["license"]), 0))
    assert len(want) > 10 and got == pytest.approx(want)
