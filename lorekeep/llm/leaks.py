"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item leaks into a text if some stretch of the text is at most ``rate`` times the item's length
in character edits away from it (letters in lower case, any white space as a space). An
alignment with e edits keeps at least ``m - q + 1 - e * q`` of an item's q-grams, and they lie on
diagonals at most e apart. So shared q-grams are counted in overlapping bands of diagonals, two bands per q-gram, and
only regions that reach the bound are aligned, within the region's band.

Texts are scanned once per block of items; a block is broadcast and its size is bounded by
``BLOCK_CHARS``. No text is shuffled, and a common passage costs each text that holds it
its own work only.

Defined results: NULL and empty texts leak nothing, NULL items and those shorter than ``min_chars``
take no part. Repeated items and ids are reported each. Extra columns are not read. Memory follows the
longest text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.llm.tables import checkpointed, require
from lorekeep.llm.textkit import _BASE, _INVERSE, mix, powers, text_slices, tidy

Q = 10
RATE = 0.05
MIN_CHARS = 40
BLOCK_CHARS = 2_000_000
FLAG_BITS = 22
PLANE = 1 << 16


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of the code points of the first plane (white space: a space), and their codes."""
    lower = np.arange(PLANE, dtype=np.uint32)
    for c in range(PLANE):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            lower[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return lower, mix(np.arange(1, PLANE + 1, dtype=np.uint64))


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text buffer in lower case, and the rows' offsets among them."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    found = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(found) != starts[-1]:  # not UTF-8: bytes count as characters
        found, starts = data.astype(np.uint32), np.arange(len(data) + 1)
    lower, _ = _tables()
    return np.where(found < PLANE, lower[np.minimum(found, PLANE - 1)], found), starts[offsets]


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on."""
    n = len(chars)
    if n < q:
        return np.zeros(0, np.uint64)
    terms = _tables()[1][np.minimum(chars, PLANE - 1)]
    terms *= powers(_BASE, n + 1)[:n]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mix((sums[q:] - sums[:-q]) * powers(_INVERSE, n + 1)[: n - q + 1])


@dataclass
class Items:
    """A block of items: characters, edit budgets, and their q-grams sorted by hash."""

    names: list
    chars: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    kinds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    flags: np.ndarray


def item_block(rows: list[tuple], q: int, rate: float) -> Items:
    chars = []
    for _, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        chars.append(points(data, np.array([0, len(data)]))[0])
    length = np.array([len(c) for c in chars])
    edits = np.minimum((rate * length + 1e-9).astype(np.int64), (length - q) // q)
    grams = [gram_hashes(c, q) for c in chars]
    hashes = np.concatenate(grams)
    item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    offset = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(hashes, kind="stable")
    kinds, first = np.unique(hashes[order], return_index=True)
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[(kinds & np.uint64((1 << FLAG_BITS) - 1)).astype(np.int64)] = True
    bound = length - q + 1 - edits * q
    return Items([r[0] for r in rows], chars, edits, bound, kinds, np.append(first, len(hashes)), item[order], offset[order], flags)


def align(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int, anchored: bool = False) -> tuple[int, int] | None:
    """Fewest edits between the item and a stretch of the region, and the stretch's end; None
    beyond the budget. Only diagonals ``low`` to ``high`` (region minus item position) are filled.
    An anchored stretch begins where the region does."""
    wide = high - low + 1
    far = budget + 1
    steps = np.arange(wide)
    padded = np.full(len(item) + wide + max(0, -low) + 1, -1, np.int64)
    # padded[i + k] is the region's character that diagonal low + k meets at item position i
    source = np.arange(len(padded)) + low
    inside = (source >= 0) & (source < len(region))
    padded[inside] = region[source[inside]]
    ends = low + steps
    row = np.where((ends >= 0) & (ends <= len(region)), ends if anchored else 0, far)
    for i, c in enumerate(item):
        change = row + (padded[i : i + wide] != c)
        drop = np.append(row[1:], far) + 1
        best = np.minimum(change, drop)
        best = np.minimum.accumulate(best - steps) + steps
        ends = low + steps + i + 1
        row = np.where((ends >= 0) & (ends <= len(region)), np.minimum(best, far), far)
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), int(low + k + len(item))


def scan_rows(chars: np.ndarray, offsets: np.ndarray, items: Items, q: int, every: bool = True) -> Iterator[tuple[int, int, int, int, int]]:
    """``row, item, edits, start, end`` of the leaks of a buffer; places count within the row.

    Of regions of one item that overlap, that with fewest edits counts (ties: the one with more shared q-grams).
    Without ``every`` one region per row and item is enough.
    """
    n_items = len(items.names)
    hashes = gram_hashes(chars, q)
    if not len(hashes) or not n_items:
        return
    flagged = items.flags[(hashes & np.uint64((1 << FLAG_BITS) - 1)).astype(np.int64)]
    reach = max(len(c) for c in items.chars) + int(items.edits.max())
    seen = np.concatenate([[0], np.cumsum(flagged)])
    at = np.flatnonzero(flagged)
    around = seen[np.minimum(at + reach, len(hashes))] - seen[np.maximum(at - reach, 0)]
    at = at[around >= items.bound.min()]
    place = np.minimum(np.searchsorted(items.kinds, hashes[at]), len(items.kinds) - 1)
    same = items.kinds[place] == hashes[at]
    at, place = at[same], place[same]
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + q <= offsets[row + 1]
    at, place, row = at[whole], place[whole], row[whole]
    count = items.first[place + 1] - items.first[place]
    hit = np.repeat(np.arange(len(at)), count)
    entry = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(items.first[place], count)
    item = items.item[entry]
    shift = reach + 1
    diagonal = at[hit] - offsets[row[hit]] - items.offset[entry] + shift
    width = items.edits[item] + 1
    band = diagonal // width
    n_bands = int(np.diff(offsets).max()) + 2 * shift + 2
    key = (row[hit].astype(np.int64) * n_items + item) * n_bands
    keys, counts = np.unique(np.concatenate([key + band, key + np.maximum(band - 1, 0)]), return_counts=True)
    which = (keys // n_bands) % n_items
    enough = counts >= items.bound[which]
    keys, counts, which = keys[enough], counts[enough], which[enough]
    done: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k in np.argsort(-counts, kind="stable"):
        owner, i = int(keys[k] // n_bands // n_items), int(which[k])
        known = done.get((owner, i), [])
        if known and not every:
            continue
        budget, pattern = int(items.edits[i]), items.chars[i]
        low = int(keys[k] % n_bands) * (budget + 1) - shift
        if any(2 * (min(e, low + len(pattern)) - max(s, low)) > len(pattern) for _, s, e in known):
            continue
        text = chars[offsets[owner] : offsets[owner + 1]]
        left = max(0, low - budget)
        right = min(len(text), low + 2 * (budget + 1) + len(pattern) + budget)
        region = text[left:right]
        span = low - left - budget, low - left + 2 * (budget + 1) + budget
        found = align(pattern, region, budget, *span)
        if found is None:
            continue
        edits, end = found
        back = align(pattern[::-1], region[:end][::-1], edits, -edits, edits, True) if edits else (0, len(pattern))
        start = end - (back[1] if back else len(pattern))
        span = left + start, left + end
        over = [x for x in known if x[1] < span[1] and span[0] < x[2]]
        if all(edits < x[0] for x in over):
            done[owner, i] = [x for x in known if x not in over] + [(edits, *span)]
    for (owner, i), regions in done.items():
        for edits, start, end in sorted(regions, key=lambda x: x[1]):
            yield owner, i, edits, start, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, q: int = Q, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id, item_id, edits, start, end`` (characters) of each region of a text into which an item leaks; both ids
    keep their names, with ``item_`` before the item's where they are equal. Regions of one item do not overlap."""
    require(docs, id_column, text)
    require(benchmark, item_id, item_text)
    if min_chars < q or not 0 <= rate < 1 / q:
        raise ValueError("min_chars must be at least q, and rate below 1 / q")
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    items = checkpointed(items.filter(F.length("text") >= min_chars))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, start int, `end` int"
    named = to_arrow_schema(items.schema).field("item").type
    spark = docs.sparkSession

    def scanned(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        told = spark.sparkContext.broadcast(sorted(((r["item"], r["text"]) for r in part), key=str))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not told.value:
                return
            known = item_block(told.value, q, rate)
            for batch in batches:
                for part, data, offsets in text_slices(batch, "text"):
                    found = list(scan_rows(*points(data, offsets), known, q))
                    if found:
                        owner, item, edits, start, end = zip(*found, strict=True)
                        names = pa.array([known.names[i] for i in item], named)
                        yield pa.RecordBatch.from_pydict(
                            {"id": part.column("id").take(pa.array(owner)), "item": names, "edits": pa.array(edits, pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())}
                        )

        return rows.mapInArrow(tidy(scan), schema)

    leaks = functools.reduce(DataFrame.unionAll, [scanned(b) for b in range(blocks)])
    return leaks.select(F.col("id").alias(id_column), F.col("item").alias(item_id if item_id != id_column else f"item_{item_id}"), "edits", "start", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_text: str = "text", rate: float = RATE, q: int = Q, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows into which an item leaks, in one scan per block of items."""
    require(docs, id_column, text)
    items = checkpointed(benchmark.select(F.col(item_text).cast("string").alias("text")).filter(F.length("text") >= min_chars))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        told = docs.sparkSession.sparkContext.broadcast(sorted({(i, r["text"]) for i, r in enumerate(part)}))
        docs = docs.mapInArrow(tidy(_cleaner(told, text, q, rate)), docs.schema)
    return docs


def _cleaner(told, text: str, q: int, rate: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = item_block(told.value, q, rate) if told.value else None
        for batch in batches:
            for part, data, offsets in text_slices(batch, text):
                clean = np.ones(part.num_rows, bool)
                if known:
                    for owner, *_ in scan_rows(*points(data, offsets), known, q, every=False):
                        clean[owner] = False
                yield part.filter(pa.array(clean))

    return scan
