import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.queries import URL_RULES
from lorekeep.llm.urls import Rule, judge_urls

SCHEMA = "page_id bigint, url string, host int, weight string"


def judged(spark, urls, **more):
    df = spark.createDataFrame([(i, u, 7, "w") for i, u in enumerate(urls)], SCHEMA)
    return {r["page_id"]: r for r in judge_urls(df, **more).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.com/x?y#z", "a.com", "/x", "com/", "allow"),
        ("HTTP://WWW.Example.COM/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://b.example.com/en/5", "b.example.com", "/en/5", "example.com/en/", "block"),
        ("https://example.com/EN/5", "example.com", "/EN/5", "com/", "allow"),
        ("https://notexample.com/en/5", "notexample.com", "/en/5", "com/", "allow"),
        ("https://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("https://x.net/fr", "x.net", "/fr", None, "allow"),
        ("https://a.com", "a.com", "", None, "allow"),
        ("https://a.com?casino", "a.com", "", None, "block"),
        ("https://casino.org/", "casino.org", "/", None, "block"),
        ("https://my-casinos.org/", "my-casinos.org", "/", None, "allow"),
        ("https://free-stuff.org/win", "free-stuff.org", "/win", None, "block"),
        ("https://free.org/free/freedom", "free.org", "/free/freedom", None, "allow"),
        ("https://éfree.org/win", "éfree.org", "/win", None, "block"),
        ("casino.org/en", "", "", None, "block"),
        ("x://y://z/w", "y:", "//z/w", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    row = judged(spark, [url], rules=URL_RULES)[0]
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)
    assert row["url"] == url


def test_repeated_empty_and_long(spark):
    long = "http://x.org/" + "a" * 200_000 + "/porn"
    rows = judged(spark, [long, "http://x.org/", "http://x.org/"])
    assert [rows[i]["verdict"] for i in range(3)] == ["block", "allow", "allow"]
    assert judged(spark, []) == {}
    with pytest.raises(ValueError):
        judged(spark, ["x"], vocabulary={"Upper": 1})
    with pytest.raises(ValueError, match="lacks"):
        judge_urls(spark.range(1))


def test_ties_block_first(spark):
    rules = [Rule("allow", "a.org", "/"), Rule("block", "a.org", "/")]
    assert judged(spark, ["http://a.org/"], rules=rules)[0]["verdict"] == "block"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("afrewin.-/é", max_size=16), min_size=1, max_size=25))
def test_counts_equal_plain_search(spark, urls):
    terms = {"free": 1, "win": 1, "fre": 2}
    rows = judged(spark, urls, vocabulary=terms)

    def distinct(url, wanted):
        touch = lambda c: c.isascii() and c.isalnum()
        found = set()
        for t in wanted:
            for at in range(len(url)):
                if url.startswith(t, at) and not touch(url[at - 1 : at] if at else "") and not touch(url[at + len(t) : at + len(t) + 1]):
                    found.add(t)
        return len(found)

    for i, url in enumerate(urls):
        assert (rows[i]["strict_hits"], rows[i]["soft_hits"]) == (distinct(url, ["fre"]), distinct(url, ["free", "win"]))
