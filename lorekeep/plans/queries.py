"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.filters import compile_filter
from lorekeep.operators import context as ctx
from lorekeep.operators import evaluate as ev
from lorekeep.operators import blocks as block_index
from lorekeep.operators import ivf, models, summarize
from lorekeep.operators import postings as posting_index
from lorekeep.operators.embed import hash_bags, idf_kind, postings
from lorekeep.operators.kb import (
    Base,
    FrameBase,
    KnowledgeBase,
    KnowledgeBaseSpec,
    newest,
    one_row_per_id,
    project_source,
)
from lorekeep.operators.listjoin import search_join
from lorekeep.operators.rerank import rerank
from lorekeep.operators.search import DENSE, fetch, search
from lorekeep.plans import jobs
from lorekeep.session import checkpointed, new_dir, union_all
from lorekeep.sources import catalog, mapping
from lorekeep.sources.sinks import save_table
from lorekeep.sources.sqlfunctions import register_base, register_model
from lorekeep.streaming.incremental import folder_per_batch, ingest_new

Query = Callable[[SparkSession, str], DataFrame]

SOURCE_TABLES = ["conversations", "documents", "events", "orders", "pages"]
LITERALS = [
    (1, "The of and in with that is thed."),
    (2, "Le la de que les en un et avec."),
    (3, "!!! ??? ..."),
]


# --- inputs ----------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(scan: DataFrame, key: str) -> DataFrame:
    """A table that is one single file, hashed over the task slots; others as they are.

    One file of one row group keeps one core busy with per-row text work. Large tables have many
    files and never move.
    """
    if len(scan.inputFiles()) > 1:
        return scan
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism, key)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents"), "doc_id")


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as knowledge-base rows with vectors; metadata stays typed and pushable."""
    rows = documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "n_chars"
    )
    return hash_bags(rows)


def conversation_source(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in the shape of a comments table."""
    return dealt(table(spark, sf, "conversations"), "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("role").alias("by"),
        "text",
        F.col("turn").alias("time"),
        F.col("conv_id").alias("parent"),
    )


def conversation_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversation_source(spark, sf)
    return hash_bags(rows.select("id", F.col("text").alias("content")))


def story_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shape of a stories table: the first line is the title."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("by"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.col("n_chars").alias("score"),
        (F.col("doc_id") * 60).alias("time"),
        F.lit(None).cast("bigint").alias("descendants"),
    )


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return documents(spark, sf).join(labels, "doc_id")


def text_search(spark: SparkSession, sf: str, k: int = 5, filters=None) -> DataFrame:
    questions = hash_bags(benchmark_questions(spark, sf), "question")
    return search(document_rows(spark, sf), questions, k, filters)


# --- sources and sinks -----------------------------------------------------------------------


def source_scan(spark: SparkSession, sf: str) -> DataFrame:
    for name in SOURCE_TABLES:
        catalog.register_table(spark, "lore_source", name, f"{sf}/{name}.parquet")
    return catalog.table_counts(spark, "lore_source", SOURCE_TABLES)


def source_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Version 1 is the table without open orders, version 2 all of it; both stay readable."""
    orders = table(spark, sf, "orders")
    root = new_dir(spark, "refresh")
    first = catalog.refresh_table(orders.filter("o_orderstatus <> 'O'"), "lore_refresh", "orders", root, 1)
    before = checkpointed(first.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders")))
    current = catalog.refresh_table(orders, "lore_refresh", "orders", root, 2)
    after = checkpointed(current.groupBy("o_orderstatus").agg(F.count("*").alias("n_orders")))
    return union_all([before.withColumn("version", F.lit(1)), after.withColumn("version", F.lit(2))])


def sql_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("documents", "labels"):
        catalog.register_table(spark, "lore_sql", name, f"{sf}/{name}.parquet")
    return catalog.run_sql(
        spark,
        """SELECT d.doc_id AS id, d.source AS author, d.n_chars, l.quality
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id
           WHERE d.lang = :lang AND d.n_chars > :n""",
        {"lang": "en", "n": 500},
        source="lore_sql",
    )


def sql_top(spark: SparkSession, sf: str) -> DataFrame:
    """The documented ``ORDER BY ... LIMIT`` use: a report of the 20 longest documents."""
    catalog.register_table(spark, "lore_sql", "documents", f"{sf}/documents.parquet")
    return catalog.run_sql(
        spark,
        """SELECT doc_id AS id, source AS author, n_chars FROM lore_sql.documents
           ORDER BY n_chars DESC, doc_id LIMIT 20""",
    )


def kb_append(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "kb")
    text = KnowledgeBaseSpec("id", ("content",))
    kb = KnowledgeBase(spark, path, text)
    kb.append(document_rows(spark, sf).select("id", "content"), 0)
    kb.append(conversation_rows(spark, sf).select("id", "content"), 1)
    return kb.all_rows().groupBy("batch_id").agg(F.count("*").alias("n_rows"))


# --- knowledge-base build --------------------------------------------------------------------


def kb_content(spark: SparkSession, sf: str) -> DataFrame:
    spec = KnowledgeBaseSpec("doc_id", ("source", "text"))
    return project_source(documents(spark, sf), spec).select(
        "id",
        F.length("content").cast("bigint").alias("content_len"),
        F.md5("content").alias("content_md5"),
    )


def kb_metadata(spark: SparkSession, sf: str) -> DataFrame:
    spec = KnowledgeBaseSpec(
        "doc_id", ("text",), {"kb_id": "doc_id", "user": "source", "points": "n_chars"}
    )
    return project_source(documents(spark, sf), spec).select("kb_id", "user", "points")


def kb_defaults(spark: SparkSession, sf: str) -> DataFrame:
    stories = project_source(story_source(spark, sf), mapping.ingest_spec("stories"))
    comments = project_source(conversation_source(spark, sf), mapping.ingest_spec("comments"))
    nothing = F.lit(None).cast("bigint")
    stories = stories.select(
        F.lit("stories").alias("kind"),
        F.col("story_id").alias("id"),
        F.md5("content").alias("content_md5"),
        "time",
        nothing.alias("parent"),
        "score",
    )
    comments = comments.select(
        F.lit("comments").alias("kind"),
        F.col("comment_id").alias("id"),
        F.md5("content").alias("content_md5"),
        "time",
        "parent",
        nothing.alias("score"),
    )
    return union_all([stories, comments])


def kb_ingest_topn(spark: SparkSession, sf: str) -> DataFrame:
    spec = mapping.ingest_spec("stories")
    source = story_source(spark, sf).select(*spec.source_columns())
    rows = one_row_per_id(project_source(newest(source, 100, "id"), spec))
    return rows.select("id", F.md5("content").alias("content_md5"))


def kb_upsert(spark: SparkSession, sf: str) -> DataFrame:
    source = documents(spark, sf).select("doc_id", "text", "lang")
    changed = source.filter("lang = 'fr'").withColumn("text", F.concat(F.lit("new: "), "text"))
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), KnowledgeBaseSpec("doc_id", ("text",)))
    kb.append(source, 0)
    kb.append(changed, 1)
    return kb.rows().select("id", "batch_id", F.md5("content").alias("content_md5"))


def kb_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows are removed, some come back with other content, others go, then the base is compacted."""
    source = documents(spark, sf).select("doc_id", "text", "lang")
    ids = source.select(F.col("doc_id").alias("id"), "lang")
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), KnowledgeBaseSpec("doc_id", ("text",)))
    kb.append(source, 0)
    kb.delete(ids.filter("lang = 'fr'"), 1)
    back = source.filter("lang = 'fr' AND doc_id % 2 = 0").withColumn("text", F.concat(F.lit("back: "), "text"))
    kb.append(back, 2)
    kb.delete(ids.filter("lang = 'de' AND id % 3 = 0"), 3)
    return kb.compact().rows().select("id", "feed", F.md5("content").alias("content_md5"))


def kb_index_bags(spark: SparkSession, sf: str) -> DataFrame:
    """A base of bags follows its rows: indexed, changed, indexed again and asked through its index."""
    source = documents(spark, sf).select("doc_id", "text", "lang")
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), KnowledgeBaseSpec("doc_id", ("text",)))
    kb.append(source.filter("lang <> 'en'"), 0)
    kb.index()
    kb.append(source.filter("lang = 'en'"), 1)
    kb.delete(source.select(F.col("doc_id").alias("id")).filter("id % 11 = 0"), 2)
    kb.index()
    return kb.search_indexed(benchmark_questions(spark, sf), 5)


def kb_embed(spark: SparkSession, sf: str) -> DataFrame:
    return postings(document_rows(spark, sf)).select("id", "bucket", "w")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def class_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question vector per label: the mean of its vectors."""
    means = (
        vectors(spark, sf)
        .select("label", F.posexplode("vector").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean")))
    return means.groupBy(F.col("label").cast("bigint").alias("question_id")).agg(
        F.transform(ordered, lambda m: m["mean"]).alias("vector")
    )


def kb_index_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the built index: every id lies in exactly one list."""
    path = new_dir(spark, "ivf")
    rows = vectors(spark, sf).select("id", "vector")
    ivf.build_index(rows, path)
    ivf.refresh_index(rows, path)  # nothing is missing, so nothing may be added
    per_id = ivf.read_index(spark, path).groupBy("id").agg(F.count("*").alias("n"))
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_ids"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
    )


def kb_index_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Build the postings index, then search it."""
    path = new_dir(spark, "postings")
    catalog.ensure_source(spark, "lore_index")
    name = "lore_index." + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    rows = document_rows(spark, sf).select("id", "vector")
    posting_index.build_postings(rows, name, path)
    questions = hash_bags(benchmark_questions(spark, sf), "question")
    return posting_index.search_postings(spark, name, path, questions, 5)


# --- search ----------------------------------------------------------------------------------


def kb_search_text(spark: SparkSession, sf: str) -> DataFrame:
    return text_search(spark, sf)


def kb_search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Build a knowledge base, then ask it: the stored vectors are read, not the text."""
    spec = KnowledgeBaseSpec("doc_id", ("text",), {"lang": "lang"})
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), spec)
    kb.append(documents(spark, sf), 0)
    hits = kb.search(benchmark_questions(spark, sf), 5, columns=("lang",))
    return hits.select("question_id", "id", "lang", "score", "rank")


def kb_search_idf(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf)
    questions = hash_bags(benchmark_questions(spark, sf), "question")
    return search(rows, questions, 5, kind=idf_kind(rows))


def kb_search_vector(spark: SparkSession, sf: str) -> DataFrame:
    return search(vectors(spark, sf), class_questions(spark, sf), 5, kind=DENSE)


def kb_search_ivf(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "ivf")
    ivf.build_index(vectors(spark, sf).select("id", "vector"), path)
    return ivf.search_index(spark, path, class_questions(spark, sf), 5)


def kb_filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    wanted = docs.filter(compile_filter({"lang": "fr"}, docs.schema))
    return wanted.select(F.col("doc_id").alias("id"), "lang", "n_chars")


def kb_filter_range(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    wanted = docs.filter(compile_filter({"n_chars": {"$gte": 500, "$lt": 2000}}, docs.schema))
    return wanted.select(F.col("doc_id").alias("id"), "lang", "n_chars")


def kb_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    hits = text_search(spark, sf, 5, {"lang": "en", "n_chars": {"$gt": 500}})
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return fetch(hits, docs, ["lang"]).select("question_id", "id", "lang", "score", "rank")


def kb_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return text_search(spark, sf, 3).groupBy("question_id").agg(
        F.count("*").alias("n_hits"), F.max("score").alias("best_score")
    )


def kb_search_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows, questions = document_rows(spark, sf), benchmark_questions(spark, sf)
    candidates = search(rows, hash_bags(questions, "question"), 20)
    return rerank(candidates, questions, rows, 5).select("question_id", "id", "rerank_score", "rank")


# --- evaluation ------------------------------------------------------------------------------


def eval_doc_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf)
    return ev.evaluate(rows, generate=20).select("questions", "found", "accuracy", "mrr")


def eval_relevancy(spark: SparkSession, sf: str) -> DataFrame:
    questions = benchmark_questions(spark, sf)
    tests = questions.withColumn("expected_answer", F.col("question"))
    return ev.evaluate(document_rows(spark, sf), tests, "relevancy").select(
        "question_id", "mean_relevancy", "precision_at_k", "ndcg"
    )


def eval_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf)
    return ev.evaluate(rows, generate=20, run=False).select("question", "expected_doc_id")


def eval_generate_sql(spark: SparkSession, sf: str) -> DataFrame:
    catalog.register_table(spark, "lore_eval", "benchmark", f"{sf}/benchmark.parquet")
    return ev.generate_tests_from_sql(
        spark,
        "SELECT text AS question, text AS expected_answer FROM lore_eval.benchmark ORDER BY item_id",
        required=("question", "expected_answer"),
    )


def eval_saved(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "eval")
    catalog.ensure_source(spark, "lore_eval")
    saved = save_table(eval_relevancy(spark, sf), "lore_eval.relevancy", path)
    return saved.agg(
        F.count("*").alias("n_rows"), F.round(F.avg("mean_relevancy"), 6).alias("avg_relevancy")
    )


# --- models ----------------------------------------------------------------------------------


def model_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rendered = models.render_prompts(documents(spark, sf), "Classify {{lang}}: {{text}}")
    return rendered.select(F.col("doc_id").alias("id"), F.md5("prompt").alias("prompt_md5"))


def model_fit_nb(spark: SparkSession, sf: str) -> DataFrame:
    return models.class_counts(labelled_documents(spark, sf), "text", "quality")


def model_nb_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return models.token_counts(labelled_documents(spark, sf), "text", "quality")


def model_fit_mllib(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models.fit_classifier(labelled_documents(spark, sf), "text", "quality")
    return fitted.transform(documents(spark, sf).select("doc_id", "text")).select("doc_id", "prediction")


def model_predict_join(spark: SparkSession, sf: str) -> DataFrame:
    model = models.fit_naive_bayes(labelled_documents(spark, sf), "text", "quality")
    wanted = documents(spark, sf).filter("n_chars > 100")
    return model.transform(wanted, "text", "predicted_quality").select("doc_id", "predicted_quality")


def model_predict_literal(spark: SparkSession, sf: str) -> DataFrame:
    model = models.fit_naive_bayes(labelled_documents(spark, sf), "text", "quality")
    rows = models.predict_rows(
        spark, LITERALS, "input_id bigint, text string", model, "text", "predicted_quality"
    )
    return rows.select("input_id", "predicted_quality")


def model_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Fit while only English rows have arrived, then again on everything."""
    path = new_dir(spark, "model")
    labelled_documents(spark, sf).createOrReplaceTempView("lore_labelled")
    training = "SELECT text, quality FROM lore_labelled"
    models.refit(spark, f"{training} WHERE lang = 'en'", "text", "quality", path, 1)
    models.refit(spark, training, "text", "quality", path, 2)
    return spark.read.parquet(f"{path}/classes").select(
        F.col("version").cast("bigint").alias("version"), "quality", "n_docs"
    )


def model_summarize(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    frequencies = summarize.frequency_table(hash_bags(docs, "text"))
    return docs.select("doc_id", F.md5(summarize.summary("text", frequencies, 2)).alias("summary_md5"))


# --- context ---------------------------------------------------------------------------------


def _bases(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "documents": document_rows(spark, sf).select("id", "content", "vector"),
        "conversations": conversation_rows(spark, sf),
    }


def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    found = ctx.retrieve(_bases(spark, sf), benchmark_questions(spark, sf), 5)
    return found.select("question_id", "kb", "id", "score", "rank")


def _vowels(df: DataFrame, column: str) -> DataFrame:
    """A small dense embedding: how often each vowel occurs."""
    text = F.lower(column)
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(v), F.lit("")))).cast("double") for v in "aeiou"]
    return df.withColumn("vector", F.array(*counts))


def rag_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Two bases that score in different ways, merged by the rows' ranks."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    dense = FrameBase(_vowels(rows, "content"), embedder=_vowels, kind=DENSE)
    found = ctx.retrieve({"words": document_rows(spark, sf), "vowels": dense}, benchmark_questions(spark, sf), 6, fuse=True)
    return found.select("question_id", "kb", "id", F.round("score", 6).alias("score"), "rank")


def rag_context_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = ctx.retrieve(_bases(spark, sf), benchmark_questions(spark, sf), 5)
    labels = table(spark, sf, "labels")
    attached = ctx.attach_table(found, labels, "doc_id", ["quality", "toxic"], "documents")
    return attached.select("question_id", "id", "quality", "toxic")


def rag_prompt(spark: SparkSession, sf: str) -> DataFrame:
    questions = benchmark_questions(spark, sf)
    found = ctx.retrieve(_bases(spark, sf), questions, 5)
    asked = ctx.prompts(found, questions, "Q: {{question}} C: {{context}}")
    return asked.select("question_id", F.md5("prompt").alias("prompt_md5"))


def rag_answer(spark: SparkSession, sf: str) -> DataFrame:
    answers = ctx.Agent(_bases(spark, sf)).answer(benchmark_questions(spark, sf))
    return answers.select("question_id", F.md5("answer").alias("answer_md5"))


# --- jobs ------------------------------------------------------------------------------------


def delivery_of(key: str, count: int):
    """Which of ``count`` deliveries a row comes in: no row, whatever it holds, is left out."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(count)), F.lit(0))


def kb_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive in three deliveries; one run per delivery takes only what is new."""
    events = table(spark, sf, "events")
    source, target, checkpoint = (new_dir(spark, n) for n in ("feed", "target", "checkpoint"))
    for number in range(3):
        arrived = events.filter(delivery_of("event_id", 3) == number)
        arrived.write.parquet(f"{source}/delivery={number}")
        ingest_new(spark, f"{source}/*", events.schema, checkpoint, folder_per_batch(target))
    return spark.read.parquet(target).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("event_id").alias("n_ids"),
        F.max("event_id").alias("max_id"),
        F.countDistinct("batch_id").alias("n_batches"),
    )


def kb_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Comments delivered in three parts into a knowledge base with the feed's default mapping."""
    comments = conversation_source(spark, sf)
    source, checkpoint = new_dir(spark, "feed"), new_dir(spark, "checkpoint")
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), mapping.feed_spec("comments"))
    for number in range(3):
        arrived = comments.filter(delivery_of("id", 3) == number)
        arrived.write.parquet(f"{source}/delivery={number}")
        ingest_new(spark, f"{source}/*", comments.schema, checkpoint, kb.append)
    rows = kb.rows().select("id", "comment_id", "author", "content")
    return rows.withColumn("content_md5", F.md5("content")).drop("content")


def job_gated(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    log = jobs.RunLog(spark, new_dir(spark, "log"))
    target = new_dir(spark, "gated")

    def copy_urgent() -> int:
        orders.filter("o_orderpriority = '1-URGENT'").write.mode("overwrite").parquet(target)
        return spark.read.parquet(target).count()

    has_open = orders.filter("o_orderstatus = 'O'")
    has_negative = orders.filter("o_totalprice < 0")
    jobs.run_job("orders", "gate_true", [copy_urgent], log, has_open)
    jobs.run_job("orders", "gate_false", [copy_urgent], log, has_negative)
    return log.read().select("name", "status", F.col("rows").alias("n_rows"))


def job_staged(spark: SparkSession, sf: str) -> DataFrame:
    """Orders staged by month; one month moves to the main table."""
    orders = table(spark, sf, "orders").withColumn("date", F.trunc("o_orderdate", "month"))
    root = new_dir(spark, "staged")
    database = "lore_" + re.sub(r"\W", "_", root.rsplit("/", 1)[-1])
    catalog.ensure_source(spark, database, f"{root}/db")
    staging = f"{database}.staging"
    jobs.create_staging(orders, staging)
    jobs.load_staged(spark, staging, f"{root}/main", "1996-03-01", run_id="first")
    jobs.load_staged(spark, staging, f"{root}/main", "1996-03-01", run_id="first")  # a retry
    places = (("main", spark.read.parquet(f"{root}/main")), ("staging", spark.table(staging)))
    counts = [
        rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("place"), "n_rows")
        for name, rows in places
    ]
    return union_all(counts)


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a run log: type is the project, user the job."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("project"),
        F.col("user_id").cast("string").alias("name"),
        F.col("ts").alias("end_ts"),
        F.when(F.col("value") < 1, "failed").otherwise("done").alias("status"),
    )


def _stamp(rows: DataFrame) -> DataFrame:
    return rows.withColumn("end_ts", F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs.history(event_log(spark, sf), "error")
    return _stamp(found.select("name", "end_ts", "status"))


def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return _stamp(jobs.latest_status(event_log(spark, sf)).select("project", "name", "end_ts", "status"))


# --- further shapes of the same operators ----------------------------------------------------


SMALL_DIM = 256


def _vector_base(spark: SparkSession) -> KnowledgeBase:
    """A stored base of dense vectors: content is the vector's JSON, which the embedder reads back."""
    spec = KnowledgeBaseSpec("id", ("text",), {"label": "label"})
    return KnowledgeBase(spark, new_dir(spark, "kb"), spec, embedder=_read_vector, kind=DENSE)


def _read_vector(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("vector", F.from_json(column, "array<double>"))


def _vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    return class_questions(spark, sf).select("question_id", F.to_json("vector").alias("question"))


def kb_search_ivf_nprobe(spark: SparkSession, sf: str) -> DataFrame:
    """As many probes as lists, with questions cut into blocks: the exact result."""
    path = new_dir(spark, "ivf")
    ivf.build_index(vectors(spark, sf), path, lists=8)
    return ivf.search_index(spark, path, class_questions(spark, sf), 5, nprobe=8, broadcast_bytes=4096)


def kb_search_ivf_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of centres with every list of every group probed: the exact result."""
    path = new_dir(spark, "ivf")
    ivf.build_tree_index(vectors(spark, sf), path, lists=16)
    n = ivf.read_tree(spark, path)
    return ivf.search_index(spark, path, class_questions(spark, sf), 5, nprobe=len(n.lists), groups=len(n.groups))


def kb_search_postings_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Postings in blocks of falling weight; blocks that cannot reach the best five are not read."""
    path, rows = new_dir(spark, "blocks"), document_rows(spark, sf).select("id", "vector")
    block_index.build_blocks(rows, path)
    return block_index.search_blocks(spark, path, rows, hash_bags(benchmark_questions(spark, sf), "question"), 5)


def _refreshes(rows: DataFrame) -> list[DataFrame]:
    """What an index follows: a third removed, then two, then one of them back with its rows as they were."""
    third = F.pmod(F.xxhash64("id"), F.lit(3))
    return [rows.filter(third != 0), rows.filter(third == 2), rows.filter(third != 1), rows.filter("id % 7 <> 0")]


def kb_index_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows leave the index in three refreshes, some come back: what is gone stays gone."""
    path, rows = new_dir(spark, "ivf"), vectors(spark, sf)
    ivf.build_index(rows, path)
    for kept in _refreshes(rows):
        ivf.refresh_index(kept, path)
    return ivf.search_index(spark, path, class_questions(spark, sf), 5)


def kb_postings_removed(spark: SparkSession, sf: str) -> DataFrame:
    """The same for postings."""
    path = new_dir(spark, "postings")
    catalog.ensure_source(spark, "lore_index")
    name = "lore_index." + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    rows = document_rows(spark, sf).select("id", "vector")
    posting_index.build_postings(rows, name, path, parts=8)
    for kept in _refreshes(rows):
        posting_index.refresh_postings(kept, name, path)
    questions = hash_bags(benchmark_questions(spark, sf), "question")
    return posting_index.search_postings(spark, name, path, questions, 5)


def kb_search_ivf_filtered(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "ivf")
    ivf.build_index(vectors(spark, sf), path)
    return ivf.search_index(spark, path, class_questions(spark, sf), 5, filters={"label": {"$lt": 5}})


def kb_index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """An index built before rows were changed, removed and added, then brought up to date through its base."""
    rows = vectors(spark, sf)
    third = F.pmod(F.col("id"), F.lit(3))
    turned = F.transform("vector", lambda x: -x)
    kb = _vector_base(spark)
    kb.append(kb_source(rows.filter(third != 0).withColumn("vector", F.when(third == 1, turned).otherwise(F.col("vector")))), 0)
    kb.index()
    kb.append(kb_source(rows.filter(third != 2)), 1)  # changed and new rows
    kb.index()
    return kb.search_indexed(_vector_questions(spark, sf), 5)


def kb_source(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.to_json(F.col("vector").cast("array<double>")).alias("text"), "label")


def kb_postings_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Postings built from cut texts, then brought up to date with the real ones; rows of one language go."""
    path = new_dir(spark, "postings")
    catalog.ensure_source(spark, "lore_index")
    name = "lore_index." + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    rows = document_rows(spark, sf)
    cut = hash_bags(rows.select("id", F.substring_index("content", "\n", 1).alias("content")))
    posting_index.build_postings(cut.select("id", "vector"), name, path, parts=4)
    posting_index.refresh_postings(rows.filter("lang <> 'fr'").select("id", "vector"), name, path)
    questions = hash_bags(benchmark_questions(spark, sf), "question")
    return posting_index.search_postings(spark, name, path, questions, 5, {"n_chars": {"$gt": 500}}, rows)


def kb_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Compaction, then a batch with a number that was used before, and once more as a retry."""
    source = documents(spark, sf).select("doc_id", "text", "lang")
    kb = KnowledgeBase(spark, new_dir(spark, "kb"), KnowledgeBaseSpec("doc_id", ("text",)))
    kb.append(source.filter("lang <> 'de'"), 0)
    small = kb.compact()
    for _ in range(2):
        small.append(source.filter("lang IN ('de', 'fr')").withColumn("text", F.concat(F.lit("new: "), "text")), 0)
    return small.rows().select("id", "feed", F.md5("content").alias("content_md5"))


def _small_base(spark: SparkSession, sf: str) -> FrameBase:
    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    return FrameBase(hash_bags(rows, dim=SMALL_DIM), dim=SMALL_DIM)


def eval_doc_id_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A base of another dimension, asked every benchmark text with each document that holds it."""
    rows = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    tests = ev.passage_tests(rows, benchmark_questions(spark, sf))
    found = ev.evaluate(_small_base(spark, sf), tests)
    return found.select("questions", "found", "accuracy", "mrr")


def rag_context_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Bases of two dimensions, one of them filtered."""
    talks = conversation_source(spark, sf).select("id", F.col("text").alias("content"))
    bases = {"documents": _small_base(spark, sf), "conversations": FrameBase(hash_bags(talks))}
    found = ctx.retrieve(bases, benchmark_questions(spark, sf), 5, {"documents": {"lang": "en"}})
    return found.select("question_id", "kb", "id", "score", "rank")


def rag_with_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Labels appended to documents only, beside a base whose ids are texts that look the same."""
    talks = conversation_source(spark, sf).select(F.col("parent").cast("string").alias("id"), F.concat_ws(" ", "by", "text").alias("content"))
    bases: dict[str, Base] = {
        "documents": FrameBase(document_rows(spark, sf).select("id", "content", "vector")),
        "conversations": FrameBase(hash_bags(one_row_per_id(talks))),
    }
    found = ctx.retrieve(bases, benchmark_questions(spark, sf), 5)
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    noted = ctx.with_tables(found, {"labels": (labels, "doc_id", "documents")})
    return noted.select("question_id", "kb", "id", "rank", F.md5("content").alias("content_md5"))


def model_predict_text_label(spark: SparkSession, sf: str) -> DataFrame:
    """Languages, a text label, predicted for every document by a stored model with blocks of one class."""
    docs = documents(spark, sf).filter("lang IS NOT NULL")
    model = models.fit_naive_bayes(docs, "text", "lang", dim=SMALL_DIM)
    return model.transform(docs.select("doc_id", "text"), "text", "predicted_lang", block_numbers=1).select("doc_id", "predicted_lang")


def model_refit_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """A model knows its query: more rows arrive, and refitting needs its place only."""
    path = new_dir(spark, "model")
    view = "lore_training_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    rows = labelled_documents(spark, sf)
    rows.filter("lang = 'en'").createOrReplaceTempView(view)
    models.create_model(spark, path, f"SELECT text, quality FROM {view}", "text", "quality")
    rows.createOrReplaceTempView(view)
    models.refit_model(spark, path)
    return models.predict_model(spark, path, documents(spark, sf).select("doc_id", "text"), "text", "predicted_quality").select(
        "doc_id", "predicted_quality"
    )


def job_staged_late(spark: SparkSession, sf: str) -> DataFrame:
    """A date is loaded, a late row arrives, the run is repeated, then another run takes the rest."""
    orders = table(spark, sf, "orders").withColumn("date", F.trunc("o_orderdate", "month"))
    root = new_dir(spark, "staged")
    database = "lore_" + re.sub(r"\W", "_", root.rsplit("/", 1)[-1])
    catalog.ensure_source(spark, database, f"{root}/db")
    staging, main = f"{database}.staging", f"{root}/main"
    late = F.col("o_orderstatus") == "P"
    jobs.create_staging(orders.filter(~late), staging)
    moved = [jobs.load_staged(spark, staging, main, "1996-03-01", run_id="first")]
    jobs.stage_rows(orders.filter(late), staging)
    moved += [jobs.load_staged(spark, staging, main, "1996-03-01", run_id=r) for r in ("first", "second", "second")]
    rows = spark.read.parquet(main).groupBy("run_id").agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"))
    left = spark.table(staging).agg(F.lit("staging").alias("run_id"), F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"))
    return union_all([checkpointed(rows), checkpointed(left)])


def run_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A job of SQL steps over the longest text as its parameter: its error is logged whole."""
    log = jobs.RunLog(spark, new_dir(spark, "log"))
    longest = table(spark, sf, "documents").orderBy(F.desc(F.length("text")), "doc_id").first()["text"]
    jobs.run_job("texts", "broken", ["SELECT raise_error(:message)"], log, "SELECT 1", {"message": longest})
    jobs.run_job("texts", "gated", ["SELECT raise_error('not run')"], log, "SELECT 1 WHERE :message = ''", {"message": longest})
    expected = checkpointed(spark.createDataFrame([("broken", longest), ("gated", longest)], "name string, message string"))
    whole = F.coalesce(F.contains("error", "message"), F.lit(False))
    return log.read().join(expected, "name").select("name", "status", whole.alias("has_message"))


def kb_search_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a question: questions and rows meet by the lists of an inverted file."""
    path, rows = new_dir(spark, "ivf"), vectors(spark, sf).select("id", "vector")
    ivf.build_index(rows, path)
    return search_join(spark, path, rows.withColumnRenamed("id", "question_id"), 5)


def rag_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, whose ids no base knows, found by the words of the benchmark texts."""
    source = ctx.TableRows(dealt(table(spark, sf, "pages"), "page_id"), "page_id", ("url", "html"), ("page_id", "url"))
    found = ctx.table_rows("pages", source, benchmark_questions(spark, sf))
    url = F.get_json_object("content", "$.url").alias("url")
    return found.select("question_id", F.col("id").cast("bigint").alias("id"), "score", "rank", url)


def model_refit_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on a part with some labels turned, then brought up to date from differences: rows added, changed and removed."""
    path, view = new_dir(spark, "model"), "lore_delta"
    rows = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    part = F.pmod(F.col("doc_id"), F.lit(3))
    turned = rows.filter(part == 1).withColumn("quality", 1 - F.col("quality"))
    gone = rows.filter(part == 2).withColumn("text", F.concat(F.lit("removed "), "text"))
    union_all([rows.filter(part == 2), turned, gone]).createOrReplaceTempView(view)
    models.create_model(spark, path, f"SELECT text, quality FROM {view}", "text", "quality")
    for _ in range(2):  # a repeated batch changes nothing
        models.refit_delta(spark, path, "changes", rows.filter(part == 1), union_all([turned, gone]))
    models.refit_delta(spark, path, "new", rows.filter(part == 0))
    found = models.predict_model(spark, path, documents(spark, sf).select("doc_id", "text"), "text", "predicted_quality")
    return found.select("doc_id", "predicted_quality")


def model_classifier_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A stored classifier of texts that name their language, fitted without the French ones, then again with all."""
    path, view = new_dir(spark, "model"), "lore_languages"
    lang = F.coalesce("lang", F.lit("none")).alias("lang")
    rows = documents(spark, sf).select("doc_id", F.concat_ws(" ", lang, "source").alias("words"), lang)
    rows.filter("lang <> 'fr'").createOrReplaceTempView(view)
    models.create_model(spark, path, f"SELECT words, lang FROM {view}", "words", "lang", SMALL_DIM, "classifier")
    rows.createOrReplaceTempView(view)
    last = models.refit_model(spark, path)
    asked = rows.select("doc_id", "words")
    found = models.predict_model(spark, path, asked, "words", "predicted_lang")
    n_docs = spark.read.parquet(f"{path}/classes").filter(F.col("version") == last).select(F.col("lang").alias("predicted_lang"), "n_docs")
    return found.join(n_docs, "predicted_lang").select("doc_id", "predicted_lang", "n_docs")


def sql_search(spark: SparkSession, sf: str) -> DataFrame:
    """A base asked in SQL: the best rows of a question, and the best of one language by the score."""
    register_base(spark, FrameBase(document_rows(spark, sf)), "lore_docs")
    table(spark, sf, "benchmark").createOrReplaceTempView("lore_asked")
    asked = "(SELECT text FROM lore_asked ORDER BY item_id LIMIT 1)"
    return catalog.run_sql(spark, f"""
        SELECT 'all' AS part, id, score, rank FROM lore_docs_search({asked}, 10)
        UNION ALL
        SELECT 'fr', id, score, row_number() OVER (ORDER BY score DESC, id) FROM (
            SELECT id, lore_docs_score(vector, {asked}) AS score FROM lore_docs WHERE lang = 'fr'
            ORDER BY score DESC NULLS LAST, id LIMIT 5) WHERE score IS NOT NULL""")


def sql_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A stored model applied by a SQL text."""
    path = new_dir(spark, "model")
    labelled_documents(spark, sf).createOrReplaceTempView("lore_labelled")
    models.create_model(spark, path, "SELECT text, quality FROM lore_labelled", "text", "quality")
    register_model(spark, path, "lore_quality")
    documents(spark, sf).createOrReplaceTempView("lore_texts")
    return catalog.run_sql(spark, "SELECT doc_id, lore_quality(text) AS predicted_quality FROM lore_texts")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        source_scan, source_refresh, sql_passthrough, sql_top,
        kb_content, kb_metadata, kb_defaults, kb_ingest_topn, kb_append, kb_upsert, kb_embed,
        kb_index_ivf, kb_index_postings, kb_delete, kb_index_bags, rag_fused,
        kb_search_text, kb_search_stored, kb_search_idf, kb_search_vector, kb_search_ivf,
        kb_filter_eq, kb_filter_range, kb_search_filtered, kb_search_batch, kb_search_rerank,
        eval_doc_id, eval_relevancy, eval_generate, eval_generate_sql, eval_saved,
        model_prompt, model_fit_nb, model_nb_tokens, model_fit_mllib, model_predict_join,
        model_predict_literal, model_refit, model_summarize,
        rag_context, rag_context_tables, rag_prompt, rag_answer,
        kb_incremental, kb_feed, job_gated, job_staged, run_history, run_status,
        kb_search_ivf_nprobe, kb_search_ivf_tree, kb_search_postings_pruned, kb_index_removed, kb_postings_removed, kb_search_ivf_filtered, kb_index_refresh, kb_postings_refresh, kb_compact,
        eval_doc_id_custom, rag_context_custom, rag_with_tables, model_predict_text_label,
        model_refit_by_name, job_staged_late, run_errors,
        kb_search_join, rag_table_rows, model_refit_delta, model_classifier_versions, sql_search, sql_predict,
    )
}
