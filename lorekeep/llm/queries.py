"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import ann, jaccard, leaks, licenses, lines, merkle, packing, pieces, quality, toxicity, trie, urls, warc
from lorekeep.llm.tables import checkpointed, table, with_small_batches

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)
QUERY_STEP = 20
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and words left of every document, with a digest of its new text."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    clean = lines.deduplicate_lines(docs, min_words=1, near_words=5)
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return clean.select("doc_id", "n_lines", left.alias("n_kept"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    pages = warc.deduplicated_pages(table(spark, sf, "pages"))
    return pages.select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to")
    )


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"), windows=True)


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules=URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, their digest, and whether decoding gives the text back."""
    model = pieces.load_pieces(PIECE_MODEL)
    coded = pieces.encode_texts(table(spark, sf, "documents").select("doc_id", "text"), model)
    slim = checkpointed(coded.select("doc_id", "ids", F.md5("text").alias("text_md5")))  # one Python worker per task at a time
    back = pieces.decode_ids(slim, model, text="decoded")
    spelled = F.size(F.filter("ids", lambda i: i.isin([int(b) for b in model.byte_ids])))
    return back.select(
        "doc_id", F.size("ids").alias("n_ids"), spelled.alias("n_byte_ids"), F.xxhash64("ids").alias("ids_hash"), F.md5("decoded").eqNullSafe(F.col("text_md5")).alias("exact")
    )


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the benchmark items that leak into them."""
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter(F.col("vec_id") % QUERY_STEP == 0)
    return ann.nearest(vectors, asked, "vec_id", "embedding", k=20)


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"), "doc_id", "text")


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The prefix trie of all conversations, each continuing the one its id names."""
    return trie.prefix_trie(*trie.branched(table(spark, sf, "conversations")))


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    pieces_ = packing.pack(table(spark, sf, "documents"), TOKENIZER)
    return pieces_.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof, checked with a third of the texts tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    values = [F.translate("text", urls.UPPER, urls.LOWER) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    offered = F.when(tampered, merkle.leaf_digest(values)).otherwise(merkle.leaf_digest([F.col(c) for c in merkle.COLUMNS]))
    made = merkle.manifest(table(spark, sf, "documents"), keep={"offered": offered})
    folded = made.leaves.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), merkle.siblings_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("path"), F.col("offered")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {
    f.__name__: with_small_batches(f)
    for f in (
        op1_line_dedup,
        op2_warc_revisits,
        op3_license_scan,
        op4_url_filter,
        op5_sentencepiece,
        op6_toxicity,
        op7_quality,
        op8_decontamination,
        op9_nearest_neighbours,
        op10_jaccard_join,
        op11_prefix_trie,
        op12_packing,
        op13_merkle_manifest,
    )
}
