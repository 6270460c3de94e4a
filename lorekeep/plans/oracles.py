"""The registered queries as SQL over the same tables, for comparison on another engine."""

from __future__ import annotations

from lorekeep.operators.context import NO_RESULT
from lorekeep.plans.queries import LITERALS

TOKEN = r"[^\p{L}\p{N}]+"
SENTENCE = r"[.!?\n]+"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{TOKEN}'), lambda t: t <> '')"


def sentences(text: str) -> str:
    parts = f"list_transform(string_split_regex({text}, '{SENTENCE}'), lambda s: trim(s))"
    return f"list_filter({parts}, lambda s: s <> '')"


# CRC-32 (reflected, polynomial 0xEDB88320): one table of 256 steps, then one step per byte.
BIT = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
STEPS = f"list_transform(range(256), lambda n: list_reduce(range(8), lambda c, x: {BIT}, n))"


def crc32(token: str) -> str:
    codes = f"('0x' || substr(hex(encode({token})), 2 * i + 1, 2))::BIGINT"
    step = "xor(c >> 8, steps[(xor(c, x) & 255) + 1])"
    codes = f"list_transform(range(strlen({token})), lambda i: {codes})"
    return f"xor(list_reduce({codes}, lambda c, x: {step}, 4294967295), 4294967295)"


def bags(name: str, rows: str, dim: int = 4096) -> str:
    """CTEs for the rows of ``rows`` (id, text): ``name`` (id, b, w), ``name_n`` (id, n) and the
    buckets of the words ``name_w`` (t, b)."""
    return f"""
{name}_t AS (SELECT id, unnest({tokens('text')}) AS t FROM ({rows})),
{name}_w AS (
  SELECT t, {crc32('t')} % {dim} AS b
  FROM (SELECT DISTINCT t FROM {name}_t) CROSS JOIN (SELECT {STEPS} AS steps)),
{name} AS (SELECT id, b, count(*) AS w FROM {name}_t JOIN {name}_w USING (t) GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM {name} GROUP BY id)"""


def hits(name: str, kb: str, asked: str, k: int) -> str:
    """CTE ``name`` (question_id, id, score, rank)."""
    return f"""
{name}_s AS (
  SELECT q.id AS question_id, d.id, sum(d.w * q.w) AS dot
  FROM {kb} d JOIN {asked} q ON d.b = q.b GROUP BY ALL),
{name}_r AS (
  SELECT question_id, s.id, round(dot / (dn.n * qn.n), 6) AS score
  FROM {name}_s s JOIN {kb}_n dn ON dn.id = s.id JOIN {asked}_n qn ON qn.id = s.question_id),
{name} AS (
  SELECT question_id, id, score,
    row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank
  FROM {name}_r QUALIFY rank <= {k})"""


DOCS = "SELECT doc_id AS id, text FROM documents"
TALKS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"
ASKED = "SELECT item_id AS id, text FROM benchmark"


def text_search(k: int, docs: str = DOCS, asked: str = ASKED) -> str:
    return f"WITH {bags('kb', docs)}, {bags('qs', asked)}, {hits('hit', 'kb', 'qs', k)}"


def overlap(a: str, b: str, over: str) -> str:
    """Shared distinct tokens of two texts over the size of ``over`` (may use x and y)."""
    x, y = f"list_distinct({tokens(a)})", f"list_distinct({tokens(b)})"
    sizes = {"union": f"len(list_distinct(list_concat({x}, {y})))", "left": f"len({x})"}
    return f"round(coalesce(len(list_intersect({x}, {y})) / nullif({sizes[over]}, 0), 0)::DOUBLE, 6)"


RELEVANCY = f"""{text_search(5)},
pair AS (
  SELECT h.question_id, h.rank, {overlap('b.text', 'd.text', 'left')} AS rel
  FROM hit h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.question_id),
ideal AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rel DESC) AS best FROM pair),
scored AS (
  SELECT question_id, round(avg(rel), 6) AS mean_relevancy,
    round(count(*) FILTER (rel >= 0.5) / 5, 6) AS precision_at_k,
    round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0), 6) AS ndcg
  FROM ideal GROUP BY question_id),
relevancy AS (
  SELECT b.item_id AS question_id, coalesce(mean_relevancy, 0) AS mean_relevancy,
    coalesce(precision_at_k, 0) AS precision_at_k, coalesce(ndcg, 0) AS ndcg
  FROM benchmark b LEFT JOIN scored s ON s.question_id = b.item_id)"""

TESTS = f"""
sentence AS (
  SELECT id, unnest({sentences('text')}) AS s
  FROM ({DOCS}) ORDER BY md5(id::VARCHAR), id),
longest AS (
  SELECT id, s FROM sentence
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(s) DESC, s DESC) = 1),
tests AS (
  SELECT d.id, coalesce(l.s, d.text) AS text FROM ({DOCS}) d LEFT JOIN longest l ON l.id = d.id
  ORDER BY md5(d.id::VARCHAR), d.id LIMIT 20)"""

LABELLED = "SELECT d.doc_id AS id, d.text, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id"

# Whole-number naive Bayes, as fitted by the library.
BAYES = f"""
train AS ({LABELLED}),
{bags('tb', 'SELECT id, text FROM train')},
totals AS (
  SELECT quality, count(*) AS docs, coalesce(sum(n), 0) AS toks
  FROM train LEFT JOIN (SELECT id, sum(w) AS n FROM tb GROUP BY id) USING (id) GROUP BY quality),
counts AS (SELECT quality, b, sum(w) AS n FROM tb JOIN train USING (id) GROUP BY ALL),
model AS (
  SELECT t.quality, r.b, round(ln((coalesce(c.n, 0) + 1) / (t.toks + 4096)) * 1000000)::BIGINT AS lp
  FROM totals t CROSS JOIN (SELECT unnest(range(4096)) AS b) r
  LEFT JOIN counts c ON c.quality = t.quality AND c.b = r.b),
prior AS (
  SELECT quality, round(ln(docs / (SELECT sum(docs) FROM totals)) * 1000000)::BIGINT AS p FROM totals)"""


def bayes_predict(rows: str, key: str) -> str:
    return f"""WITH {BAYES}, input AS ({rows}), {bags('ib', 'SELECT id, text FROM input')},
token_score AS (
  SELECT i.id, m.quality, sum(i.w * m.lp) AS s FROM ib i JOIN model m ON m.b = i.b GROUP BY ALL),
total AS (
  SELECT i.id, p.quality, p.p + coalesce(s.s, 0) AS s FROM input i CROSS JOIN prior p
  LEFT JOIN token_score s ON s.id = i.id AND s.quality = p.quality)
SELECT id AS {key}, quality AS predicted_quality FROM total
QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, quality) = 1"""


CONTEXT = f"""WITH {bags('kb', DOCS)}, {bags('talk', TALKS)}, {bags('qs', ASKED)},
{hits('dhit', 'kb', 'qs', 5)}, {hits('thit', 'talk', 'qs', 5)},
both_kb AS (
  SELECT 'documents' AS kb, question_id, id, score FROM dhit
  UNION ALL SELECT 'conversations', question_id, id, score FROM thit),
ctx AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, kb, id) AS rank
  FROM both_kb QUALIFY rank <= 5),
full_ctx AS (
  SELECT ctx.*, d.text FROM ctx JOIN ({DOCS}) d ON d.id = ctx.id WHERE kb = 'documents'
  UNION ALL
  SELECT ctx.*, d.text FROM ctx JOIN ({TALKS}) d ON d.id = ctx.id WHERE kb = 'conversations')"""

VECTOR = """
WITH part AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mean AS (SELECT label, pos, avg(x) AS m FROM part GROUP BY ALL),
q AS (SELECT label::BIGINT AS question_id, list(m ORDER BY pos) AS v FROM mean GROUP BY label),
s AS (
  SELECT q.question_id, e.vec_id AS id,
    round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score
  FROM embeddings e CROSS JOIN q)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::BIGINT AS rank
FROM s QUALIFY rank <= 5"""
VECTOR_OF_SMALL_LABELS = VECTOR.replace("CROSS JOIN q)", "CROSS JOIN q WHERE e.label < 5)")


def context(docs: str, talks: str, dim: int = 4096, where: str = "") -> str:
    """CTE ``ctx``: the best five rows of documents and conversations per benchmark question."""
    return f"""WITH {bags('kb', docs + where, dim)}, {bags('qd', ASKED, dim)}, {bags('talk', talks)}, {bags('qs', ASKED)},
{hits('dhit', 'kb', 'qd', 5)}, {hits('thit', 'talk', 'qs', 5)},
both_kb AS (
  SELECT 'documents' AS kb, question_id, id::VARCHAR AS id, score FROM dhit
  UNION ALL SELECT 'conversations', question_id, id::VARCHAR, score FROM thit)"""


ONE_TALK = """SELECT conv_id::VARCHAR AS id, max(role || ' ' || text) AS text FROM conversations GROUP BY conv_id"""

def idf_search(docs: str, table: str) -> str:
    """Search with words weighted by how few rows of ``table`` hold them."""
    return f"""WITH {bags('kb0', docs)}, {bags('qs0', ASKED)},
        idf AS (
          SELECT b, round(ln(((SELECT count(*) FROM {table}) + 1) / (count(*) + 1)) * 100)::BIGINT + 1 AS i
          FROM kb0 GROUP BY b),
        kb AS (SELECT id, b, w * i AS w FROM kb0 JOIN idf USING (b)),
        kb_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM kb GROUP BY id),
        qs AS (SELECT id, b, w * coalesce(i, 1) AS w FROM qs0 LEFT JOIN idf USING (b)),
        qs_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM qs GROUP BY id),
        {hits('hit', 'kb', 'qs', 5)}"""


SEARCH_COLUMNS = "question_id, id, score, rank::BIGINT AS rank"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

ORACLES: dict[str, str] = {
    "source_scan": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
        for t in ("conversations", "documents", "events", "orders", "pages")
    ),
    "source_refresh": """SELECT o_orderstatus, count(*) AS n_orders, 1::INT AS version FROM orders
        WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus UNION ALL
        SELECT o_orderstatus, count(*), 2 FROM orders GROUP BY o_orderstatus""",
    "sql_passthrough": """SELECT d.doc_id AS id, d.source AS author, d.n_chars, l.quality
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id
        WHERE d.lang = 'en' AND d.n_chars > 500""",
    "sql_top": """SELECT doc_id AS id, source AS author, n_chars FROM documents
        ORDER BY n_chars DESC, doc_id LIMIT 20""",
    "kb_append": """SELECT 0::BIGINT AS batch_id, count(*) AS n_rows FROM documents
        UNION ALL SELECT 1, count(*) FROM conversations""",
    "kb_content": r"""SELECT doc_id AS id, length(source || chr(10) || text)::BIGINT AS content_len,
        md5(source || chr(10) || text) AS content_md5 FROM documents""",
    "kb_metadata": "SELECT doc_id AS kb_id, source AS \"user\", n_chars AS points FROM documents",
    "kb_defaults": """
        SELECT 'stories' AS kind, doc_id AS id, md5(split_part(text, chr(10), 1)) AS content_md5,
          doc_id * 60 AS time, NULL::BIGINT AS parent, n_chars AS score FROM documents
        UNION ALL
        SELECT 'comments', conv_id * 1000 + turn, md5(text), turn, conv_id, NULL FROM conversations""",
    "kb_ingest_topn": """SELECT doc_id AS id, md5(split_part(text, chr(10), 1)) AS content_md5
        FROM documents ORDER BY doc_id DESC LIMIT 100""",
    "kb_upsert": """SELECT doc_id AS id, (lang = 'fr')::BIGINT AS batch_id,
        md5(CASE WHEN lang = 'fr' THEN 'new: ' || text ELSE text END) AS content_md5
        FROM documents""",
    "kb_delete": """SELECT doc_id AS id, 'compacted' AS feed, md5(CASE WHEN lang = 'fr' THEN 'back: ' || text ELSE text END) AS content_md5
        FROM documents WHERE NOT coalesce(lang = 'fr' AND doc_id % 2 <> 0, false) AND NOT coalesce(lang = 'de' AND doc_id % 3 = 0, false)""",
    "kb_index_bags": f"{text_search(5, DOCS + ' WHERE lang IS NOT NULL AND doc_id % 11 <> 0')} SELECT {SEARCH_COLUMNS} FROM hit",
    "rag_fused": f"""{text_search(6)},
        vowel AS (SELECT id, which, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(t) - length(replace(t, v, ''))) AS c
          FROM (SELECT id, 'kb' AS which, lower(text) AS t FROM ({DOCS}) UNION ALL SELECT id, 'q', lower(text) FROM ({ASKED}))),
        near AS (SELECT q.id AS question_id, d.id, round(list_sum(list_transform(range(1, 6), lambda i: q.c[i] * d.c[i]))
            / (sqrt(list_sum(list_transform(q.c, lambda x: x * x))) * sqrt(list_sum(list_transform(d.c, lambda x: x * x)))), 6) AS score
          FROM vowel q JOIN vowel d ON q.which = 'q' AND d.which = 'kb' WHERE list_sum(d.c) > 0 AND list_sum(q.c) > 0),
        ranked AS (SELECT 'vowels' AS kb, question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r FROM near QUALIFY r <= 6
          UNION ALL SELECT 'words', question_id, id, rank FROM hit)
        SELECT question_id, kb, id, round(1.0::DOUBLE / (60 + r), 6) AS score,
          row_number() OVER (PARTITION BY question_id ORDER BY 1.0::DOUBLE / (60 + r) DESC, kb, id)::BIGINT AS rank FROM ranked QUALIFY rank <= 6""",
    "kb_embed": f"WITH {bags('kb', DOCS)} SELECT id, b AS bucket, w FROM kb",
    "kb_index_ivf": """SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids,
        0::BIGINT AS n_repeated FROM embeddings""",
    "kb_index_postings": f"{text_search(5)} SELECT {SEARCH_COLUMNS} FROM hit",
    "kb_search_text": f"{text_search(5)} SELECT {SEARCH_COLUMNS} FROM hit",
    "kb_search_stored": f"""{text_search(5)}
        SELECT question_id, id, lang, score, rank::BIGINT AS rank
        FROM hit JOIN documents d ON d.doc_id = hit.id""",
    "kb_search_idf": f"""{idf_search(DOCS, 'documents')} SELECT {SEARCH_COLUMNS} FROM hit""",
    "kb_search_vector": VECTOR,
    "kb_search_ivf": VECTOR,
    "kb_filter_eq": "SELECT doc_id AS id, lang, n_chars FROM documents WHERE lang = 'fr'",
    "kb_filter_range": """SELECT doc_id AS id, lang, n_chars FROM documents
        WHERE n_chars >= 500 AND n_chars < 2000""",
    "kb_search_filtered": f"""{text_search(5, DOCS + " WHERE lang = 'en' AND n_chars > 500")}
        SELECT question_id, id, lang, score, rank::BIGINT AS rank
        FROM hit JOIN documents d ON d.doc_id = hit.id""",
    "kb_search_batch": f"""{text_search(3)}
        SELECT question_id, count(*) AS n_hits, max(score) AS best_score FROM hit GROUP BY question_id""",
    "kb_search_rerank": f"""{text_search(20)},
        scored AS (
          SELECT h.question_id, h.id, {overlap('b.text', 'd.text', 'union')} AS rerank_score
          FROM hit h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.question_id)
        SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, id))::BIGINT AS rank
        FROM scored QUALIFY rank <= 5""",
    "eval_doc_id": f"""WITH {TESTS}, {bags('kb', DOCS)}, {bags('qs', 'SELECT id, text FROM tests')},
        {hits('hit', 'kb', 'qs', 5)}
        SELECT count(*) AS questions, count(rank) AS found, round(count(rank) / count(*), 6) AS accuracy,
          round(avg(coalesce(1 / rank, 0)), 6) AS mrr
        FROM tests t LEFT JOIN hit h ON h.question_id = t.id AND h.id = t.id""",
    "eval_relevancy": f"{RELEVANCY} SELECT * FROM relevancy",
    "eval_generate": f"WITH {TESTS} SELECT text AS question, id AS expected_doc_id FROM tests",
    "eval_generate_sql": """SELECT text AS question, text AS expected_answer FROM benchmark
        ORDER BY item_id LIMIT 20""",
    "eval_saved": f"""{RELEVANCY}
        SELECT count(*) AS n_rows, round(avg(mean_relevancy), 6) AS avg_relevancy FROM relevancy""",
    "model_prompt": """SELECT doc_id AS id, md5('Classify ' || lang || ': ' || text) AS prompt_md5
        FROM documents""",
    "model_fit_nb": f"""WITH {BAYES}
        SELECT quality, toks::BIGINT AS n_tokens, docs AS n_docs FROM totals""",
    "model_nb_tokens": f"WITH {BAYES} SELECT quality, b AS bucket, n::BIGINT AS n FROM counts",
    "model_predict_join": bayes_predict(DOCS + " WHERE n_chars > 100", "doc_id"),
    "model_predict_literal": bayes_predict(
        "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in LITERALS) + ") v(id, text)",
        "input_id",
    ),
    "model_refit": f"""WITH train AS ({LABELLED})
        SELECT 1::BIGINT AS version, quality, count(*) AS n_docs FROM train WHERE lang = 'en' GROUP BY quality
        UNION ALL SELECT 2, quality, count(*) FROM train GROUP BY quality""",
    "model_summarize": f"""WITH {bags('kb', DOCS)},
        freq AS (SELECT b, count(*) AS df FROM kb GROUP BY b),
        sen0 AS (SELECT id, {sentences('text')} AS ss FROM ({DOCS})),
        sen AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sen0),
        tok AS (SELECT id, pos, unnest({tokens('s')}) AS t FROM sen),
        score AS (
          SELECT id, pos, sum(df) / count(*) AS score
          FROM tok JOIN kb_w USING (t) JOIN freq USING (b) GROUP BY ALL),
        best AS (
          SELECT id, pos, s FROM sen LEFT JOIN score USING (id, pos)
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0) DESC, pos) <= 2),
        text AS (SELECT id, string_agg(s, '. ' ORDER BY pos) AS summary FROM best GROUP BY id)
        SELECT d.doc_id, md5(coalesce(summary, '')) AS summary_md5
        FROM documents d LEFT JOIN text t ON t.id = d.doc_id""",
    "rag_context": f"{CONTEXT} SELECT question_id, kb, id, score, rank::BIGINT AS rank FROM ctx",
    "rag_context_tables": f"""{CONTEXT} SELECT question_id, id, quality, toxic
        FROM ctx JOIN labels l ON l.doc_id = ctx.id WHERE kb = 'documents'""",
    "rag_prompt": f"""{CONTEXT},
        texts AS (SELECT question_id, string_agg(text, chr(10) ORDER BY rank) AS c FROM full_ctx GROUP BY 1)
        SELECT item_id AS question_id, md5('Q: ' || b.text || ' C: ' || coalesce(c, '')) AS prompt_md5
        FROM benchmark b LEFT JOIN texts t ON t.question_id = b.item_id""",
    "rag_answer": f"""{CONTEXT},
        sen0 AS (SELECT question_id, rank, {sentences('text')} AS ss FROM full_ctx),
        sen AS (SELECT question_id, rank, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sen0),
        best AS (
          SELECT question_id, s FROM sen JOIN benchmark b ON b.item_id = question_id
          QUALIFY row_number() OVER (
            PARTITION BY question_id ORDER BY {overlap('b.text', 's', 'left')} DESC, rank, pos) = 1)
        SELECT item_id AS question_id, md5(coalesce(s, '{NO_RESULT}')) AS answer_md5
        FROM benchmark b LEFT JOIN best ON best.question_id = b.item_id""",
    "kb_incremental": """SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids,
        max(event_id) AS max_id, 3::BIGINT AS n_batches FROM events""",
    "kb_feed": """SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn AS comment_id,
        role AS author, md5(text) AS content_md5 FROM conversations""",
    "job_gated": """SELECT 'gate_true' AS name, 'done' AS status, count(*) AS n_rows FROM orders
        WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'gate_false', 'skipped', 0""",
    "job_staged": """SELECT CASE WHEN date_trunc('month', o_orderdate) = DATE '1996-03-01'
          THEN 'main' ELSE 'staging' END AS place, count(*) AS n_rows FROM orders GROUP BY 1""",
    "kb_search_ivf_nprobe": VECTOR,
    "kb_search_ivf_tree": VECTOR,
    "kb_search_postings_pruned": f"{text_search(5)} SELECT {SEARCH_COLUMNS} FROM hit",
    "kb_index_removed": VECTOR.replace("CROSS JOIN q)", "CROSS JOIN q WHERE e.vec_id % 7 <> 0)"),
    "kb_postings_removed": f"{text_search(5, DOCS + ' WHERE doc_id % 7 <> 0')} SELECT {SEARCH_COLUMNS} FROM hit",
    "kb_search_ivf_filtered": VECTOR_OF_SMALL_LABELS,
    "kb_index_refresh": VECTOR,
    "kb_postings_refresh": f"""{text_search(5, DOCS + " WHERE lang <> 'fr' AND n_chars > 500")}
        SELECT {SEARCH_COLUMNS} FROM hit""",
    "kb_compact": """SELECT doc_id AS id, CASE WHEN lang IN ('de', 'fr') THEN 'main' ELSE 'compacted' END AS feed,
        md5(CASE WHEN lang IN ('de', 'fr') THEN 'new: ' || text ELSE text END) AS content_md5 FROM documents""",
    "eval_doc_id_custom": f"""WITH {bags('kb', DOCS, 256)}, {bags('qs', ASKED, 256)}, {hits('hit', 'kb', 'qs', 5)},
        tests AS (SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
        SELECT count(*) AS questions, count(rank) AS found, round(count(rank) / count(*), 6) AS accuracy,
          round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr
        FROM tests t LEFT JOIN hit h ON h.question_id = t.item_id AND h.id = t.doc_id""",
    "rag_context_custom": f"""{context(DOCS, TALKS, 256, " WHERE lang = 'en'")}
        SELECT question_id, kb, id::BIGINT AS id, score,
          row_number() OVER (PARTITION BY question_id ORDER BY score DESC, kb, id::BIGINT) AS rank
        FROM both_kb QUALIFY rank <= 5""",
    "rag_with_tables": f"""{context(DOCS.replace("doc_id AS", "doc_id::VARCHAR AS"), ONE_TALK)},
        ctx AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, kb, id) AS rank
          FROM both_kb QUALIFY rank <= 5)
        SELECT question_id, kb, ctx.id, rank, md5(CASE WHEN kb = 'conversations' THEN t.text
            WHEN l.doc_id IS NULL THEN d.text
            ELSE d.text || chr(10) || 'labels: {{"quality":' || quality || ',"toxic":' || toxic || '}}' END) AS content_md5
        FROM ctx LEFT JOIN ({ONE_TALK}) t ON kb = 'conversations' AND t.id = ctx.id
        LEFT JOIN documents d ON kb = 'documents' AND d.doc_id::VARCHAR = ctx.id
        LEFT JOIN labels l ON kb = 'documents' AND l.doc_id::VARCHAR = ctx.id""",
    "model_predict_text_label": bayes_predict(DOCS, "doc_id").replace(
        LABELLED, "SELECT doc_id AS id, text, lang AS quality FROM documents").replace(
        "% 4096", "% 256").replace("+ 4096)", "+ 256)").replace("range(4096)", "range(256)").replace(
        "predicted_quality", "predicted_lang"),
    "model_refit_by_name": bayes_predict(DOCS, "doc_id"),
    "job_staged_late": """WITH o AS (SELECT *, date_trunc('month', o_orderdate) = DATE '1996-03-01' AS due FROM orders)
        SELECT CASE WHEN due AND o_orderstatus <> 'P' THEN 'first' WHEN due THEN 'second' ELSE 'staging' END AS run_id,
          count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM o GROUP BY 1""",
    "run_errors": """SELECT 'broken' AS name, 'failed' AS status, true AS has_message
        UNION ALL SELECT 'gated', 'skipped', false""",
    "run_history": f"""SELECT user_id::VARCHAR AS name, {STAMP.format('ts')} AS end_ts,
        CASE WHEN value < 1 THEN 'failed' ELSE 'done' END AS status
        FROM events WHERE event_type = 'error'""",
    "run_status": f"""SELECT event_type AS project, user_id::VARCHAR AS name,
        {STAMP.format('ts')} AS end_ts, CASE WHEN value < 1 THEN 'failed' ELSE 'done' END AS status
        FROM events QUALIFY row_number() OVER (
          PARTITION BY event_type, user_id
          ORDER BY ts DESC, CASE WHEN value < 1 THEN 'failed' ELSE 'done' END DESC) = 1""",
    "kb_search_join": """
        WITH s AS (
          SELECT q.vec_id AS question_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
          FROM embeddings e CROSS JOIN embeddings q)
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::BIGINT AS rank
        FROM s QUALIFY rank <= 5""",
    "rag_table_rows": f"""{idf_search("SELECT page_id AS id, concat_ws(' ', url, html) AS text FROM pages", 'pages')}
        SELECT question_id, id, score, rank::BIGINT AS rank, url FROM hit JOIN pages ON page_id = id""",
    "model_refit_delta": bayes_predict(DOCS, "doc_id"),
    "model_classifier_versions": """SELECT doc_id, coalesce(lang, 'none') AS predicted_lang,
        count(*) OVER (PARTITION BY coalesce(lang, 'none')) AS n_docs FROM documents""",
    "sql_search": f"""{text_search(10, asked=ASKED + " ORDER BY id LIMIT 1")},
        fr_rank AS (
          SELECT h.id, h.score, row_number() OVER (ORDER BY h.score DESC, h.id) AS rank
          FROM hit_r h JOIN documents d ON d.doc_id = h.id WHERE d.lang = 'fr' QUALIFY rank <= 5)
        SELECT 'all' AS part, id, score, rank::BIGINT AS rank FROM hit UNION ALL SELECT 'fr', id, score, rank FROM fr_rank""",
    "sql_predict": bayes_predict(DOCS, "doc_id"),
}
