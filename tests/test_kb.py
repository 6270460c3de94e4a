import pytest
from plans_text import plan
from pyspark.sql import functions as F

from lorekeep.functions.scorers import jaccard
from lorekeep.operators.embed import embed_with
from lorekeep.operators.kb import (
    KnowledgeBase,
    KnowledgeBaseSpec,
    newest,
    one_row_per_id,
    project_source,
)
from lorekeep.operators.limits import first_rows
from lorekeep.operators.search import DENSE
from lorekeep.session import new_dir, union_all
from lorekeep.sources import mapping


@pytest.fixture(scope="module")
def stories(spark):
    data = [
        (1, "ann", "Red fox", "It ran", 5, 100),
        (2, "bob", None, "Only text", 7, 200),
        (3, "cat", "Only title", None, 9, 300),
        (4, "dan", None, None, 1, 400),
    ]
    return spark.createDataFrame(
        data, "id int, by string, title string, text string, score int, time int"
    ).withColumn("descendants", F.lit(None).cast("int"))


def kb_of(spark, spec, **options):
    return KnowledgeBase(spark, new_dir(spark, "kb"), spec, **options)


def test_content_skips_nulls_and_drops_empty_rows(stories):
    rows = project_source(stories, KnowledgeBaseSpec("id", ("title", "text"))).collect()
    assert {r["id"]: r["content"] for r in rows} == {
        1: "Red fox\nIt ran", 2: "Only text", 3: "Only title"
    }


def test_comma_list_is_split_and_columns_appear_once(stories):
    spec = KnowledgeBaseSpec("id", "title, text,title", {"kb_id": "id", "who": "by"})
    assert spec.content_columns == ("title", "text")
    assert spec.source_columns() == ["id", "title", "text", "by"]


def test_metadata_is_renamed(stories):
    spec = KnowledgeBaseSpec("id", ("text",), {"story_id": "id", "points": "score"})
    row = project_source(stories, spec).filter("id = 2").first()
    assert (row["story_id"], row["points"]) == (2, 7)


@pytest.mark.parametrize(
    "arguments",
    [("", ("text",)), ("id", ("",)), ("id", ("text",), {"vector": "by"})],
)
def test_bad_specs_raise(arguments):
    with pytest.raises(ValueError):
        KnowledgeBaseSpec(*arguments)


def test_missing_source_column_raises(stories):
    with pytest.raises(ValueError, match="nope"):
        project_source(stories, KnowledgeBaseSpec("id", ("nope",)))


def test_default_mappings():
    stories = mapping.ingest_spec("stories")
    assert stories.content_columns == ("title",)
    assert list(stories.metadata) == ["story_id", "time", "score", "descendants"]
    assert mapping.ingest_spec("comments").metadata["parent"] == "parent"
    with pytest.raises(ValueError):
        mapping.ingest_spec("hnstories")
    assert mapping.ingest_spec("hnstories", "title,text").metadata == {"story_id": "id"}
    with pytest.raises(ValueError):
        mapping.ingest_spec("other")
    with pytest.raises(TypeError):
        mapping.ingest_spec("stories", metadata={"a": 1})
    assert mapping.feed_spec("stories").metadata == {"story_id": "id", "author": "by"}
    assert mapping.feed_spec("other").metadata == {"original_id": "id"}


@pytest.mark.parametrize("limit, ids", [(2, [4, 3]), (1, [4]), (9, [4, 3, 2, 1])])
def test_newest(stories, limit, ids):
    assert [r["id"] for r in newest(stories, limit).collect()] == ids


@pytest.mark.parametrize("limit", [None, 0, -3])
def test_no_limit_keeps_everything(stories, limit):
    assert newest(stories, limit).count() == 4


@pytest.mark.parametrize("limit", [1, 99, 100, 101, 500, 999, 1000, 5000])
def test_large_limits_equal_small_ones(spark, limit):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("group")).repartition(3)
    order = [F.desc("group"), F.col("id")]
    got = first_rows(df, order, limit).collect()
    assert sorted(got) == sorted(df.orderBy(*order).limit(limit).collect())
    tied = first_rows(df, [F.desc("group")], limit).collect()
    assert sorted(tied) == sorted(df.orderBy(F.desc("group"), "id").limit(limit).collect())


def test_newest_is_planned_as_top_n(stories):
    assert "TakeOrderedAndProject" in plan(newest(stories, 2))


def test_hot_id_is_reduced_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("id"), F.col("id").cast("string").alias("content"))
    single = one_row_per_id(rows)
    assert single.count() == 3
    assert plan(single).count("WindowGroupLimit") >= 2


def test_unique_ids_are_not_shuffled_and_repeats_are_reduced(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("content"))
    assert "Exchange" not in plan(one_row_per_id(rows))
    null = spark.createDataFrame([(None, "n1"), (None, "n2"), (3, "zz"), (3, "a")], "id bigint, content string")
    got = one_row_per_id(union_all([rows, null])).collect()
    assert len(got) == 52 and {r["content"] for r in got if r["id"] in (None, 3)} == {"n1", "n2", "zz"}


def test_latest_batch_wins_and_a_retry_changes_nothing(spark, stories):
    spec = KnowledgeBaseSpec("id", ("title",), {"who": "by"})
    kb = kb_of(spark, spec)
    kb.append(stories, 0)
    changed = stories.filter("id = 1").withColumn("title", F.lit("Blue fox"))
    for _ in range(2):
        kb.append(changed.unionByName(changed), 1)
    assert kb.all_rows().count() == 3
    got = {r["id"]: (r["content"], r["batch_id"], r["who"]) for r in kb.rows().collect()}
    assert got == {1: ("Blue fox", 1, "ann"), 3: ("Only title", 0, "cat")}
    kb.append(stories, 0)
    assert {r["id"]: r["batch_id"] for r in kb.rows().collect()} == {1: 1, 3: 0}
    compact = kb.compact()
    assert {r["id"]: r["content"] for r in compact.rows().collect()} == {1: "Blue fox", 3: "Only title"}
    kb.register("test_kb_view")
    assert spark.sql("SELECT content FROM test_kb_view WHERE who = 'ann'").first()[0] == "Blue fox"


def test_bounded_append(spark, stories):
    kb = kb_of(spark, KnowledgeBaseSpec("id", ("title", "text")))
    kb.append(stories, 0, limit=2)
    assert [r["id"] for r in kb.rows().collect()] == [3]  # row 4 has no content


def test_query_with_filter_and_metadata(spark, stories):
    kb = kb_of(spark, KnowledgeBaseSpec("id", ("title", "text"), {"points": "score"}))
    kb.append(stories, 0)
    hits = kb.query("only O'Hara", {"points": {"$gt": 7}}).collect()
    assert [(r["id"], r["content"], r["points"], r["rank"]) for r in hits] == [(3, "Only title", 9, 1)]
    assert kb.query("only", limit=0).count() == 2


def test_reranker_and_user_embedder(spark, stories):
    spec = KnowledgeBaseSpec("id", ("title", "text"))
    kb = kb_of(spark, spec, reranker=jaccard)
    kb.append(stories, 0)
    best = kb.query("only title", limit=1).first()
    assert (best["id"], best["rerank_score"]) == (3, 1.0)

    def letters(df, column):
        return embed_with(df, lambda s: s.map(lambda t: [float(t.count("t")), float(t.count("x"))]), column)

    dense = kb_of(spark, spec, embedder=letters, kind=DENSE)
    dense.append(stories, 0)
    assert dense.query("xx", limit=1).first()["id"] == 1


def test_a_compaction_is_never_replaced(spark, stories):
    kb = kb_of(spark, KnowledgeBaseSpec("id", ("title", "text")))
    kb.append(stories, 0)
    small = kb.compact()
    changed = stories.filter("id = 1").withColumn("title", F.lit("Blue fox"))
    for _ in range(2):
        small.append(changed, 0)
    small.append(stories.filter("id = 2").withColumn("text", F.lit("other")), 0, feed="stream")
    got = {r["id"]: r["content"] for r in small.rows().collect()}
    assert got == {1: "Blue fox\nIt ran", 2: "other", 3: "Only title"}
    with pytest.raises(ValueError):
        small.append(stories, 0, feed="compacted")


def test_content_is_not_shuffled_by_later_batches(spark, stories):
    kb = kb_of(spark, KnowledgeBaseSpec("id", ("title", "text")))
    for number in range(3):
        kb.append(stories.withColumn("title", F.concat("title", F.lit(str(number)))), number)
    shown = plan(kb.rows())
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    assert {r["id"]: r["content"] for r in kb.rows().collect()} == {1: "Red fox2\nIt ran", 2: "Only text", 3: "Only title2"}


def test_a_base_is_opened_as_it_was_made(spark, stories):
    kb = kb_of(spark, KnowledgeBaseSpec("id", ("title",), dim=128))
    kb.append(stories, 0)
    again = KnowledgeBase(spark, kb.path, KnowledgeBaseSpec("id", ("title",)))
    with pytest.raises(ValueError, match="made with"):
        again.rows()
    with pytest.raises(ValueError, match="made with"):
        again.append(stories, 1)


def test_equal_content_has_one_winner(spark):
    rows = spark.createDataFrame([(1, "same", i) for i in range(20)], "id int, content string, points int")
    for parts in (1, 7):
        assert one_row_per_id(rows.repartition(parts)).first()["points"] == 9  # the last by its JSON text
