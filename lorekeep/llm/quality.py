"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of whole texts are binned at quantiles. Cyclic boosting visits one feature after
the other, each time with a tree of a few leaves on that feature alone, and adds its leaves to the
feature's lookup table. The pairs with the largest gain on what is left then get tables of their
own the same way, from trees with one cut on either feature. A score is the sum of table entries, one bin lookup per feature
and pair, through the logistic function.

The features of all texts are computed in one pass and stored. The model is fitted on the driver on
a sample of at most about ``FIT_ROWS`` labelled rows (a documented bound); nothing else is sampled.

Defined results: NULL and empty texts have all features zero and are scored like any other. Rows
keep their number; repeated ids are scored row by row. Without rows of both labels to learn from, every score is
the share of label 1 (a half without any row). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.labelled import fold, to_rows, training_labels
from lorekeep.llm.tables import checkpointed, require
from lorekeep.llm.textkit import LOWER, RangeHash, row_sums, text_slices, tidy, window_hashes, word_bounds

FIT_ROWS = 40_000
THRESHOLD = 0.3

NAMES = [
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "bare_symbol_words", "symbol_ended_words",
    "exclaim", "stops", "non_ascii", "spaces", "distinct_words", "top_word", "same_word_again", "repeated_fives",
    "log_lines", "line_length", "repeated_lines",
]


def _flags(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _flags("0123456789")
SYMBOL = _flags("#$%&*+/<=>@\\^_`{|}~[]")
EXCLAIM = _flags("!?")
STOP = _flags(".")
NEWLINE = _flags("\n")
LETTER = UPPER | _flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
CONTINUED = (np.arange(256) & 0xC0) == 0x80


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its most frequent value occurs."""
    order = np.lexsort((hashes, rows))
    values, at = hashes[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
    starts = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, at[starts], np.diff(np.append(starts, len(order))))
    return np.bincount(at[starts], minlength=n), top


def shape_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``NAMES`` for each row of a text buffer."""
    n, size = len(offsets) - 1, np.diff(offsets)
    bytes_ = np.maximum(size, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return row_sums(table[data], offsets) / bytes_

    starts, ends, rows = word_bounds(data, offsets)
    words = np.bincount(rows, minlength=n)
    some = np.maximum(words, 1)
    lower = LOWER[data]
    spans = RangeHash(lower)
    hashes = spans.of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    letters = np.concatenate([[0], np.cumsum(LETTER[data] | DIGIT[data])])
    bare = letters[ends] == letters[starts]
    ended = (SYMBOL[data[ends - 1]] & ~bare) if len(ends) else np.zeros(0, bool)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, top = _repeats(hashes, rows, n)
    fives, five_rows = window_hashes(hashes, rows, n, 5)
    five_kinds, _ = _repeats(fives, five_rows, n)
    five_count = np.maximum(np.bincount(five_rows, minlength=n), 1)
    line_start, line_end, line_rows = word_bounds(data, offsets, NEWLINE)
    lines = np.bincount(line_rows, minlength=n)
    line_kinds, _ = _repeats(spans.of(line_start, line_end) if len(line_start) else np.zeros(0, np.uint64), line_rows, n)
    columns = [
        np.log1p(size - row_sums(CONTINUED[data], offsets)), np.log1p(words), np.bincount(rows, ends - starts, n) / some,
        share(UPPER), share(DIGIT), share(SYMBOL), np.bincount(rows, bare, n) / some, np.bincount(rows, ended, n) / some,
        row_sums(EXCLAIM[data], offsets) / some, row_sums(STOP[data], offsets) / some, share(np.arange(256) >= 0x80),
        1 - np.bincount(rows, ends - starts, n) / bytes_, distinct / some, top / some, np.bincount(rows, again, n) / some,
        1 - five_kinds / five_count, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), 1 - line_kinds / np.maximum(lines, 1),
    ]
    empty = size == 0
    return {name: np.where(empty, 0.0, c).astype(np.float32) for name, c in zip(NAMES, columns, strict=True)}


def feature_table(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id`` and ``NAMES`` of every row, stored."""
    require(docs, id_column, text)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), **shape_features(data, offsets)})

    return checkpointed(rows.mapInArrow(tidy(scan), f"id {kind}, " + ", ".join(f"{n} float" for n in NAMES)))


@dataclass
class AdditiveModel:
    """Lookup tables of features and pairs over the features' bins."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, i], bins[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values per bin of a tree that cuts one feature's bins greedily into ``leaves`` ranges."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    ranges = [(0, len(g))]
    for _ in range(leaves - 1):
        best, cut, which = 1e-9, None, None
        for r, (a, b) in enumerate(ranges):
            m = np.arange(a + 1, b)
            m = m[(ch[m] - ch[a] >= least) & (ch[b] - ch[m] >= least)]
            if len(m):
                gains = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(gains.argmax())
                if gains[k] > best:
                    best, cut, which = gains[k], int(m[k]), r
        if cut is None:
            break
        a, b = ranges.pop(which)
        ranges += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best four quadrants of a pair's histogram."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return 0.0, np.zeros_like(g)
    quads = []
    for c in (cg, ch):
        a, up, left, whole = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
        quads.append((a, up - a, left - a, whole - up - left + a))
    gains = sum(q**2 / (w + ridge) for q, w in zip(*quads, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    gains = np.where(np.minimum.reduce(quads[1]) >= least, gains, 0)
    at = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(g)
    if gains[at] <= 0:
        return 0.0, out
    a, b = i[at], j[at]
    for q, w, rows, columns in zip(*quads, (slice(a), slice(a), slice(a, None), slice(a, None)), (slice(b), slice(b, None), slice(b), slice(b, None)), strict=True):
        out[rows, columns] = q[at] / (w[at] + ridge)
    return float(gains[at]), out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, leaves: int = 3, bins: int = 48, n_pairs: int = 6, pair_rounds: int = 40, ridge: float = 1.0, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the logistic loss; both labels must occur."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = AdditiveModel(cuts, base, [np.zeros(len(c) + 1) for c in cuts], [], [])
    binned, logit = model.bins(x), np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[:, j], g, len(table)), np.bincount(binned[:, j], h, len(table)), leaves, ridge, least)
            table += step
            logit += step[binned[:, j]]

    def cells(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        at = binned[:, i] * shape[1] + binned[:, j]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    gains = {(i, j): _cross(*cells(i, j, g, h), ridge, least)[0] for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = [p for p in sorted(gains, key=lambda p: -gains[p])[:n_pairs] if gains[p] > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _cross(*cells(i, j, *slopes()), ridge, least)[1]
            table += step
            logit += step[binned[:, i], binned[:, j]]
    return model


def fit_quality(features: DataFrame, labels: DataFrame, id_column: str, label: str, rows: int = FIT_ROWS) -> AdditiveModel | float:
    """The model, or the share of label 1 where only one label occurs."""
    known = features.join(training_labels(labels, id_column, label, rows), "id")
    x, y = to_rows(known, NAMES)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit_additive(x, y)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` of every row; the id keeps its name."""
    features = feature_table(docs, id_column, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(features, labels, id_column, label, fit_rows))
    kind = features.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy() for n in NAMES]).astype(np.float64)
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": score})

    scored = features.mapInArrow(tidy(scan), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_column), (fold(F.col("id")) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold.

    The model is fitted from the stored features; the texts are scored where they lie, so no text is shuffled.
    """
    features = feature_table(docs, id_column, text)
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(features, labels, id_column, label, fit_rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, text):
                if isinstance(model, float):
                    good = np.full(part.num_rows, model >= threshold)
                else:
                    found = shape_features(data, offsets)
                    good = model.score(np.column_stack([found[n] for n in NAMES]).astype(np.float64)) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(tidy(scan), docs.schema)
