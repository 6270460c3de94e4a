"""Toxicity: boosted trees over dense features of whole texts, calibrated by isotonic regression.

A lexicon is learned from labelled texts: words, and beginnings of ``STEM_BYTES`` bytes of longer
words, that occur in toxic texts and hardly ever in others; a fixed list of insults is added. One
pass over all texts then gives lexicon densities, how near hits are to a second person, capitals,
punctuation and obfuscation (hits that appear only after digits and symbols are read as letters).
The trees and the calibration are Spark's own; they are fitted on separate parts of the labelled
rows.

The lexicon is learned from at most about ``LEXICON_ROWS`` labelled texts (a documented bound);
trees and calibration use every labelled row outside the held-out fold. Terms are known by 64-bit hashes.

Defined results: NULL and empty texts have all features zero and get the score of that. Repeated
ids are scored row by row. Where only one label is known, every score is the share of label 1 (a half without any
row). Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.labelled import fold, training_labels
from lorekeep.llm.quality import EXCLAIM, LETTER, SYMBOL, UPPER
from lorekeep.llm.tables import checkpointed, require, within
from lorekeep.llm.textkit import LOWER, RangeHash, folded, row_sums, signed, text_slices, word_bounds

LEXICON_ROWS = 20_000
LEXICON_TERMS = 4_096
MIN_TEXTS = 4
MIN_LOG_ODDS = 2.0
STEM_BYTES = 6
NEAR = 5

INSULTS = (
    "bastard", "clown", "coward", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "jerk",
    "loser", "moron", "parasite", "pathetic", "pig", "rat", "scum", "stupid", "subhuman", "trash", "ugly", "vermin",
    "worthless",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "ur", "u", "tu", "toi", "te", "vous", "votre", "du", "dich", "dir", "dein",
    "ihr", "euch", "usted", "ustedes", "tú", "vos",
)

#: Characters that stand for letters in obfuscated words.
STANDS_FOR = LOWER.copy()
for symbol, letter in zip("@4$5013!7", "aassoieit", strict=True):
    STANDS_FOR[ord(symbol)] = ord(letter)

NAMES = [
    "hits", "hit_words", "hit_weight", "hit_density", "top_weight", "insults", "insult_density", "near_you", "you_density",
    "hidden", "hidden_density", "upper", "shouted", "exclaim", "symbol", "log_words", "word_length",
]


class Terms:
    """Words and stems of a buffer as hashes; words are runs of letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends, self.rows = word_bounds(data, offsets, ~LETTER)
        spans = RangeHash(data)
        self.words = spans.of(self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.long = np.flatnonzero(self.ends - self.starts > STEM_BYTES)
        cut = self.starts[self.long] + STEM_BYTES
        self.stems = spans.of(self.starts[self.long], cut) ^ np.uint64(1) if len(self.long) else np.zeros(0, np.uint64)


def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Terms(data, np.array([0, len(data)])).words)


def member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted ``known``, and where."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    flags = np.zeros(1 << 16, bool)
    flags[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(flags[(values & np.uint64(0xFFFF)).astype(np.int64)])
    found, place = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    found[maybe], place[maybe] = known[at] == values[maybe], at
    return found, place


def learn_lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term hashes and weights from ``text, label`` rows.

    Each task counts the terms of a slice before anything is shuffled. The weight of a term is its smoothed log
    odds among toxic texts against others; at most ``LEXICON_TERMS`` terms with the largest
    product of weight and toxic texts are taken.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                terms = Terms(folded(data), offsets)
                values = np.concatenate([terms.words, terms.stems])
                rows = np.concatenate([terms.rows, terms.rows[terms.long]])
                order = np.lexsort((rows, values))
                values, rows = values[order], rows[order]
                new = np.ones(len(values), bool)
                new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
                values, label = values[new], part.column("label").to_numpy()[rows[new]]
                kinds, at = np.unique(values, return_inverse=True)
                toxic = np.bincount(at, label, len(kinds))
                yield pa.RecordBatch.from_pydict({"term": signed(kinds), "toxic": toxic, "n": np.bincount(at, minlength=len(kinds)).astype(np.float64)})

    counted = texts.select("text", "label").mapInArrow(count, "term bigint, toxic double, n double")
    totals = texts.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    if not totals["n"] or not totals["toxic"] or totals["toxic"] == totals["n"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    base = math.log(totals["toxic"] / (totals["n"] - totals["toxic"]))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)) - F.lit(base)
    terms = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter(F.col("toxic") >= MIN_TEXTS)
    terms = terms.withColumn("weight", odds).filter(F.col("weight") >= MIN_LOG_ODDS)
    best = terms.orderBy(F.desc(F.col("weight") * F.col("toxic")), "term").limit(LEXICON_TERMS).select("term", "weight").toArrow()
    hashes = np.asarray(best.column("term").combine_chunks()).astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.asarray(best.column("weight").combine_chunks())[order]


def dense_features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], insults: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """``NAMES`` for each row of a text buffer."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    terms = Terms(folded(data), offsets)
    rows, words = terms.rows, np.maximum(np.bincount(terms.rows, minlength=n), 1)
    weight = np.zeros(len(rows))
    found, place = member(terms.words, lexicon[0])
    if len(lexicon[0]):
        weight[found] = lexicon[1][place[found]]
        stem, place = member(terms.stems, lexicon[0])
        weight[terms.long[stem]] = np.maximum(weight[terms.long[stem]], lexicon[1][place[stem]])
    insult, _ = member(terms.words, insults)
    hit = insult | (weight > 0)
    you, _ = member(terms.words, second)
    at, person = np.flatnonzero(hit), np.flatnonzero(you)
    near = np.zeros(len(at), bool)
    if len(person):
        for side in (0, 1):
            other = person[np.clip(np.searchsorted(person, at) - side, 0, len(person) - 1)]
            near |= (np.abs(other - at) <= NEAR) & (rows[other] == rows[at])
    plain = np.bincount(rows, hit, n)
    # words as they read once digits and symbols stand for letters; only whole words that hold such a sign count
    read = STANDS_FOR[folded(data)]
    seen = Terms(read, offsets)
    changed = np.concatenate([[0], np.cumsum((data < 0x80) & ~LETTER[data] & LETTER[read])])
    signs = changed[seen.ends] > changed[seen.starts]
    known = member(seen.words, insults)[0] | member(seen.words, lexicon[0])[0]
    hidden = np.bincount(seen.rows, known & signs, n)
    top = np.zeros(n)
    np.maximum.at(top, rows, weight)
    capital = np.concatenate([[0], np.cumsum(UPPER[data])])
    length = terms.ends - terms.starts
    shouted = (capital[terms.ends] - capital[terms.starts] == length) & (length > 2)
    kinds = np.unique(np.stack([rows[at].astype(np.uint64), terms.words[at]]), axis=1)[0] if len(at) else np.zeros(0, np.uint64)
    columns = [
        plain, np.bincount(kinds.astype(np.int64), minlength=n), np.bincount(rows, weight, n), plain / words, top,
        np.bincount(rows, insult, n), np.bincount(rows, insult, n) / words, np.bincount(rows[at], near, n),
        np.bincount(rows, you, n) / words, hidden, hidden / words, row_sums(UPPER[data], offsets) / size,
        np.bincount(rows, shouted, n) / words, row_sums(EXCLAIM[data], offsets) / words, row_sums(SYMBOL[data], offsets) / size,
        np.log1p(np.bincount(rows, minlength=n)), np.bincount(rows, length, n) / words,
    ]
    return {name: np.asarray(c, np.float64) for name, c in zip(NAMES, columns, strict=True)}


def feature_table(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id`` and ``NAMES`` of ``id, text`` rows, stored."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, word_hashes(INSULTS), word_hashes(SECOND_PERSON)))
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), **dense_features(data, offsets, *shared.value)})

    return checkpointed(docs.mapInArrow(scan, f"id {kind}, " + ", ".join(f"{n} double" for n in NAMES)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, trees: int = 20, depth: int = 3) -> DataFrame:
    """``id, held_out, score, predicted`` of every row; the id keeps its name."""
    require(docs, id_column, text)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    few = checkpointed(training_labels(labels, id_column, label, LEXICON_ROWS))
    features = feature_table(rows, learn_lexicon(within(rows, few, "id", "inner")))
    known = checkpointed(features.join(training_labels(labels, id_column, label), "id"))
    ready = VectorAssembler(inputCols=NAMES, outputCol="features")
    part = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0
    fit, held = known.filter(~part), known.filter(part)
    counts = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    out = F.col("id").alias(id_column), (fold(F.col("id")) == 0).alias("held_out")
    if len(counts) < 2:
        share = known.agg(F.avg("label")).first()[0]
        scored = features.withColumn("score", F.lit(0.5 if share is None else float(share)))
    else:
        trainer = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=3)
        model = trainer.fit(ready.transform(fit.select("label", *NAMES)))
        raised = lambda df: model.transform(ready.transform(df)).withColumn("raw", vector_to_array("probability")[1])
        judged = raised(held).select("label", "raw")
        calibration = IsotonicRegression(labelCol="label", featuresCol="raw").fit(judged) if held.select("label").distinct().count() > 1 else None
        scored = raised(features).select("id", "raw")
        scored = calibration.transform(scored).withColumnRenamed("prediction", "score") if calibration else scored.withColumnRenamed("raw", "score")
    return scored.select(*out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
