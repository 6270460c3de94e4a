"""Line deduplication by deletion neighbourhoods: a line goes if an earlier one is at most one word away, or from
60 words on at most one word in 30 of the shorter line.

A line is the words between line feeds, ASCII and Latin-1 letters in lower case. Its edit distance to another counts
inserted, deleted and replaced words. Every variant of a line with one word left out is a hashed
key, once alone (it equals a line that lacks the word) and once with the place of the gap (it
equals the same variant of a line with another word there). Lines with equal keys are one edit
apart, so the earliest line of a key answers for all of them, and groups need no pairs. The one
pair per line that is left is verified on the words themselves.

Before that, what has no partner is left out exactly: one edit lies within one quarter of a line, so
a variant is only made where another line of fitting length agrees on all the rest.

Long lines of e edits or less between them share an unedited run of words, and each has at most 3 e runs of three
words that the other lacks. So the first 3 e + 1 of a line's different runs of three, in one order for all lines, are
its keys, and such lines share one for certain. The order is by how often a run occurs, rare ones first, so passages
that many lines share are keys of few. Each line first meets the earliest line of each key; those still there meet
the earlier lines of their keys whose words, counted modulo two in 128 classes, differ in at most 2 e classes, as they
do for all lines that near; only pairs that pass are verified.

Earliest is by document id, then line number. Lines of fewer than ``min_words`` words stay, those of fewer than
``near_words`` go only as exact repeats. Defined results: a text that is NULL or has no line to
remove stays as it is; rows without an id stay; rows of one id count as one document, and lines at equal
places are both kept. Extra columns are kept. Unequal keys are taken as equal with a chance of
about 5e-20 per pair, and then the verification keeps the line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.llm.tables import checkpointed, fits, flag_bits, flag_count, private, require, with_partners, within
from lorekeep.llm.textkit import _BASE, _INVERSE, RangeHash, folded, mix, powers, signed, text_slices, tidy, word_bounds

MIN_WORDS = 5
NEAR_WORDS = 10
WORDS_PER_EDIT = 30
RUN = 3
CHUNK = 4096  # counts of runs travel in pieces of this many
MAX_COUNTS = 1 << 24
ONCE = 8  # a run with this count, scaled, is no other line's
QUARTERS = 4
LINES_PER_PART = 65_536
LINE_STEP = 2_654_435_761  # spreads the lines of one document over the bits; its product with a number is a bigint
KEYS_PER_PACK = 1 << 19  # keys a task gathers before it sends them
SUBSTITUTED, DELETED, WHOLE, RARE, LINE = 0, 1, 2, 3, 4


class Lines:
    """Lines of a text buffer: the words ``a`` to ``b`` of a row, hashed as sequences of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = folded(data)
        starts, ends, rows = word_bounds(lower, offsets)
        words = RangeHash(lower).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        feeds = np.flatnonzero(lower == 10)
        before = np.searchsorted(feeds, starts)
        group = before + rows
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        self.a = np.flatnonzero(new)
        self.b = np.append(self.a[1:], len(group))
        self.row = rows[self.a]
        self.number = before[self.a] - np.searchsorted(feeds, offsets[self.row])
        self.count = self.b - self.a
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(_BASE, len(words) + 1)[: len(words)], dtype=np.uint64)])
        self.inverse = powers(_INVERSE, len(words) + 1)
        self.hash = mix(self.part(self.a, self.b) + self.count.astype(np.uint64))
        self.words = words

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every RUN successive words of the lines ``at``: the line and the hash."""
        count = np.maximum(self.count[at] - RUN + 1, 0)
        line = np.repeat(at, count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + self.a[line]
        return line, mix(self.part(place, place + RUN))

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words of each line modulo two, in 128 classes of words: two times 64 bits."""
        if not len(self.a):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        bit, low = np.uint64(1) << (self.words & np.uint64(63)), self.words & np.uint64(64) > 0
        zero = np.uint64(0)
        return np.bitwise_xor.reduceat(np.where(low, bit, zero), self.a), np.bitwise_xor.reduceat(np.where(low, zero, bit), self.a)

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def quarter(self, at: np.ndarray, shorter: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word (exclusive) of a quarter of the lines ``at`` and the hash of the rest.

        With ``shorter`` 1 the line counts as the longer of two: quarters are those of a line of one
        word less, and the quarter has one word more.
        """
        a, b, c = self.a[at], self.b[at], self.count[at] - shorter
        first, last = c * which // QUARTERS, c * (which + 1) // QUARTERS
        rest = self.part(a, a + first) + self.part(b - (c - last), b) * powers(_BASE, int(first.max(initial=0)) + 1)[first]
        return first, last + shorter, mix(rest ^ mix((c * QUARTERS + which).astype(np.uint64)))

    def gaps(self, line: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word ``first`` to ``last`` of each line: the line, the hash without the word, the
        same with its place."""
        count = last - first
        line = np.repeat(line, count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        a, b = self.a[line], self.b[line]
        rest = self.part(a, a + place) + self.part(a + place + 1, b) * powers(_BASE, int(place.max(initial=0)) + 1)[place]
        variant = mix(rest + (self.count[line] - 1).astype(np.uint64))
        return line, variant, mix(variant ^ mix(place.astype(np.uint64) + np.uint64(1)))


def line_count(docs: DataFrame) -> int:
    """Line feeds, and one more for each text."""
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return docs.agg(F.sum(feeds + 1)).first()[0] or 0


def earliest(lines: Lines, ids: pa.Array, near_words: int) -> np.ndarray:
    """The earliest line of each hash among those long enough."""
    at = np.flatnonzero(lines.count >= near_words)
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    at = at[np.lexsort((lines.number[at], rank[lines.row[at]]))]
    return at[np.unique(lines.hash[at], return_index=True)[1]]


def short(keys: np.ndarray, parts: int) -> np.ndarray:
    """Keys by 32 high and a few low bits; others may share a flag, which costs time only."""
    return mix((keys >> np.uint64(32) << np.uint64(32)) | (keys & np.uint64(parts - 1)))


def count_slots(n_lines: int) -> int:
    return 1 << min(MAX_COUNTS.bit_length() - 1, max(16, math.ceil(math.log2(8 * max(1, n_lines)))))


def part_count(n_lines: int) -> int:
    return 1 << min(20, max(2, math.ceil(math.log2(max(1, n_lines / LINES_PER_PART)))))


def two_owners(values: np.ndarray) -> np.ndarray:
    """Of sorted packed keys, the first and the last owner of each key: enough to see whether there are two."""
    key = values >> np.uint64(32)
    new = np.ones(len(values) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    return values[new[:-1] | new[1:]]


class Packer:
    """Keys with their lines' hashes, eight bytes a key, gathered into one array per part of keys."""

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, owners))
        self.size += len(keys)
        if self.size >= KEYS_PER_PACK:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, owners = (np.concatenate(x) for x in zip(*self.held, strict=True))
            place = (keys & np.uint64(self.parts - 1)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            values = (keys[order] >> np.uint64(32) << np.uint64(32)) | (owners[order] >> np.uint64(32))
            names, first = np.unique(place[order], return_index=True)
            packed = [two_owners(np.unique(x)).tobytes() for x in np.split(values, first[1:])]
            yield pa.RecordBatch.from_pydict({"part": names, "keys": pa.array(packed, pa.binary())})
        self.held, self.size = [], 0


def shared(part: int, arrays: list[np.ndarray]) -> pa.Array:
    """Keys of a part, as ``short`` makes them, that different lines have."""
    values = np.unique(np.concatenate(arrays))
    names, lines = np.unique(values >> np.uint64(32) << np.uint64(32), return_counts=True)
    return pa.array(signed(mix(names[lines > 1] | np.uint64(part))))


def key_flags(keys: DataFrame) -> np.ndarray:
    """A bit per ``key``, in bytes."""
    return np.frombuffer(flag_bits(keys, "key", flag_count(keys.count())), np.uint8)


def flagged(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    slot = signed(keys) & (len(flags) * 8 - 1)
    return (flags[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def packed_counts(counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Counts, most of them zero, in pieces of ``CHUNK``: a bit for each that is not, then their low and high bytes."""
    used = counts > 0
    bits, values = np.packbits(used).reshape(-1, CHUNK // 8), counts[used]
    size = used.reshape(-1, CHUNK).sum(axis=1)
    ends = np.cumsum(size)
    low, high = values.astype(np.uint8), (values >> np.uint16(8)).astype(np.uint8)
    names = np.flatnonzero(size)
    return names, [b"".join((bits[c].tobytes(), low[ends[c] - size[c] : ends[c]].tobytes(), high[ends[c] - size[c] : ends[c]].tobytes())) for c in names]


def add_counts(total: np.ndarray, packed: bytes) -> None:
    """Adds a piece that ``packed_counts`` has made."""
    data = np.frombuffer(packed, np.uint8)
    low, high = data[CHUNK // 8 :].astype(np.int64).reshape(2, -1)
    total[np.flatnonzero(np.unpackbits(data[: CHUNK // 8]))] += low + (high << 8)


def shared_rests(docs: DataFrame, n_lines: int, near_words: int) -> tuple[np.ndarray, np.ndarray]:
    """One bit per rest of a line that different lines share, and how often runs of words occur.

    Rests travel packed, eight bytes each with half of the line's hash, some hundred thousand of a task at once.
    Runs of long lines are counted by their hash modulo ``count_slots``, in one array per task; the result has
    a byte per slot, eight times the binary logarithm of one more than the count. The negative parts are its pieces.
    """
    parts = part_count(n_lines)
    slots, least = count_slots(n_lines), max(near_words, 2 * WORDS_PER_EDIT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, packer = np.zeros(slots, np.uint16), Packer(parts)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                lines = Lines(data, offsets)
                at = earliest(lines, part.column("id"), near_words)
                met, n = np.unique(lines.runs(at[lines.count[at] >= least])[1] & np.uint64(slots - 1), return_counts=True)
                counts[met] = np.minimum(counts[met] + n, np.iinfo(np.uint16).max)
                yield from packer.add(np.concatenate([lines.quarter(at, s, q)[2] for s in (0, 1) for q in range(QUARTERS)]), np.tile(lines.hash[at], 2 * QUARTERS))
        yield from packer.sent()
        names, pieces = packed_counts(counts)
        for i in range(0, len(names), 256):
            yield pa.RecordBatch.from_pydict({"part": (-1 - names[i : i + 256]).astype(np.int32), "keys": pa.array(pieces[i : i + 256], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if part < 0:
                    add_counts(totals.setdefault(part, np.zeros(CHUNK, np.int64)), packed)
                else:
                    held.setdefault(part, []).append(np.frombuffer(packed, np.uint64))
        for part, arrays in held.items():
            keys = shared(part, arrays)
            yield pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names=["key", "piece", "counts"])
        scaled = [np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes() for total in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(scaled), pa.int64()), pa.array([-1 - part for part in totals], pa.int32()), pa.array(scaled, pa.binary())], names=["key", "piece", "counts"])

    packed = docs.mapInArrow(tidy(pack), "part int, keys binary")
    found = checkpointed(packed.repartition(parts, "part").mapInArrow(tidy(count), "key bigint, piece int, counts binary"))
    often = np.zeros(slots, np.uint8)
    for row in found.filter("piece IS NOT NULL").select("piece", "counts").collect():
        often[row["piece"] * CHUNK : (row["piece"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return key_flags(found.filter("key IS NOT NULL").select("key")), often


def line_keys(docs: DataFrame, n_lines: int, min_words: int, near_words: int) -> DataFrame:
    """``role, hash, id, number, n, low, high, keys``: every line that may go (role LINE, no keys), and per line and role the
    packed keys, those of the variants with a gap where another line agrees on the rest, and (role RARE) of the rarest
    runs of lines long enough for two edits, which alone have ``n, low, high``."""
    told = docs.sparkSession.sparkContext.broadcast(shared_rests(docs, n_lines, near_words))
    kind = docs.schema["id"].dataType.simpleString()
    least, parts = max(near_words, 2 * WORDS_PER_EDIT), part_count(n_lines)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, often = told.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                lines = Lines(data, offsets)
                at = earliest(lines, part.column("id"), near_words)
                keys, owners, roles, whole = [], [], [], np.zeros(len(at), bool)
                for longer in (0, 1):
                    for which in range(QUARTERS):
                        first, last, key = lines.quarter(at, longer, which)
                        meets = flagged(short(key, parts), flags)
                        line, left, replaced = lines.gaps(at[meets], first[meets], last[meets])
                        keys.append(left if longer else replaced)
                        owners.append(line)
                        roles.append(np.full(len(line), DELETED if longer else SUBSTITUTED, np.int64))
                        whole |= meets & (longer == 0)
                line, rare = rarest_runs(lines, at[lines.count[at] >= least], often)
                keys += [lines.hash[at[whole]], rare]
                owners += [at[whole], line]
                roles += [np.full(len(owners[-2]), WHOLE, np.int64), np.full(len(line), RARE, np.int64)]
                group = np.concatenate(roles) * len(lines.a) + np.concatenate(owners)
                order = np.argsort(group, kind="stable")
                names, first = np.unique(group[order], return_index=True)
                role, owner = np.divmod(names, max(1, len(lines.a)))
                bounds = np.append(first, len(group)).astype(np.int32) * np.int32(8)
                packed = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(bounds), pa.py_buffer(np.concatenate(keys)[order])])
                low, high = lines.parities()
                may = np.flatnonzero(lines.count >= min_words)
                owner, role = np.append(owner, may), np.append(role, np.full(len(may), LINE))
                packed = pa.concat_arrays([packed, pa.nulls(len(may), pa.binary())])
                yield pa.RecordBatch.from_pydict(
                    {
                        "role": role.astype(np.int8),
                        "hash": signed(lines.hash[owner]),
                        "id": part.column("id").take(pa.array(lines.row[owner])),
                        "number": lines.number[owner].astype(np.int32),
                        "n": pa.array(lines.count[owner].astype(np.int32), mask=role != RARE),
                        "low": pa.array(signed(low[owner]), mask=role != RARE),
                        "high": pa.array(signed(high[owner]), mask=role != RARE),
                        "keys": packed,
                    }
                )

    return checkpointed(docs.mapInArrow(tidy(scan), f"role tinyint, hash bigint, id {kind}, number int, n int, low bigint, high bigint, keys binary"))


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a batch of ``line_keys``, and the row of each."""
    packed = pc.cast(batch.column("keys"), pa.large_binary())
    bounds = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8)
    keys = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
    return keys, np.repeat(np.arange(len(packed)), np.diff(bounds) // 8)


def key_table(table: DataFrame, n_lines: int) -> DataFrame:
    """``key, role, hash, id, number, n, low, high`` of the keys of ``line_keys`` that different lines have.

    Most keys are one line's. Those that are not are found as shared rests are, eight bytes a key; only they become rows.
    A few others pass, whose bits are set by chance.
    """
    table, parts = table.filter(f"role <> {LINE}"), part_count(n_lines)
    kind = table.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for batch in batches:
            if batch.num_rows:
                keys, row = unpacked(batch)
                yield from packer.add(keys, batch.column("hash").to_numpy().view(np.uint64)[row])
        yield from packer.sent()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(packed, np.uint64))
        for part, arrays in held.items():
            yield pa.RecordBatch.from_arrays([shared(part, arrays)], names=["key"])

    packed = table.select("hash", "keys").mapInArrow(tidy(pack), "part int, keys binary")
    flags = key_flags(checkpointed(packed.repartition(parts, "part").mapInArrow(tidy(count), "key bigint")))
    told = table.sparkSession.sparkContext.broadcast(flags)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, row = unpacked(batch)
                meets = np.flatnonzero(flagged(short(keys, parts), told.value))
                rest = batch.drop_columns(["keys"]).take(pa.array(row[meets]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[meets])), *rest.columns], names=["key", *rest.schema.names])

    return checkpointed(table.mapInArrow(tidy(spread), f"key bigint, role tinyint, hash bigint, id {kind}, number int, n int, low bigint, high bigint"))


def rarest_runs(lines: Lines, at: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and hashes of their first 3 e + 1 different runs, rare ones first, but for those that occur once."""
    line, keys = lines.runs(at)
    bits = np.uint64(max(1, len(at)).bit_length())
    weight = often[keys & np.uint64(len(often) - 1)]
    ordinal = np.repeat(np.arange(len(at), dtype=np.uint64), np.maximum(lines.count[at] - RUN + 1, 0))
    order = np.argsort((ordinal << (np.uint64(64) - bits)) | (weight.astype(np.uint64) << (np.uint64(56) - bits)) | (keys >> (bits + np.uint64(8))))
    line, keys, weight = line[order], keys[order], weight[order]
    new = np.ones(len(line), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    line, keys, weight = line[new], keys[new], weight[new]
    head = np.ones(len(line), bool)
    head[1:] = line[1:] != line[:-1]
    starts = np.flatnonzero(head)
    place = np.arange(len(line)) - np.repeat(starts, np.diff(np.append(starts, len(line))))
    chosen = (place <= RUN * (lines.count[line] // WORDS_PER_EDIT)) & (weight > ONCE)
    return line[chosen], keys[chosen]


def near_pairs(variants: DataFrame) -> DataFrame:
    """``hash, at, other``: lines with the earliest line one edit away, where that is earlier.

    Only keys with two lines or more are joined back; the minima are combined before the shuffle.
    """
    at = F.struct("id", "number", "hash")
    first = [F.min(F.when(F.col("role") == role, at)).alias(name) for role, name in ((SUBSTITUTED, "s"), (DELETED, "d"), (WHOLE, "w"))]
    keys = variants.groupBy("key").agg(*first, F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    other = F.when(F.col("role") == SUBSTITUTED, F.col("s")).when(F.col("role") == DELETED, F.col("w")).otherwise(F.col("d"))
    met = variants.join(checkpointed(keys), "key").select("hash", at.alias("at"), other.alias("other"))
    met = met.filter("other IS NOT NULL AND other.hash <> hash AND struct(other.id, other.number) < struct(at.id, at.number)")
    return checkpointed(met.groupBy("hash").agg(F.min("at").alias("at"), F.min("other").alias("other")))


def one_edit(x: list[bytes], y: list[bytes]) -> bool:
    """Whether two lists of words are at most one edit apart."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    same = 0
    while same < len(x) and x[same] == y[same]:
        same += 1
    return x[same + (len(x) == len(y)) :] == y[same + 1 :]


def edits_within(x: list[bytes], y: list[bytes], budget: int) -> bool:
    """Whether two lists of words are at most ``budget`` edits apart.

    Per number of edits and shift of ``y`` against ``x``: how many words of ``x`` can be passed at most.
    """
    shift = len(y) - len(x)
    if abs(shift) > budget:
        return False
    none = -2 - budget
    reach: dict[int, int] = {}
    for edits in range(budget + 1):
        last, reach = reach, {}
        for at in range(max(-edits, shift - budget + edits), min(edits, shift + budget - edits) + 1):
            i = max(last.get(at, none) + 1, last.get(at - 1, none), last.get(at + 1, none) + 1) if edits else 0
            end = min(len(x), len(y) - at)
            i = min(i, end)
            while i < end and x[i] == y[i + at]:
                i += 1
            reach[at] = i
        if reach.get(shift) == len(x):
            return True
    return False


def near_words_apart(x: list[bytes], y: list[bytes]) -> bool:
    return one_edit(x, y) or edits_within(x, y, min(len(x), len(y)) // WORDS_PER_EDIT)


#: Pairs ``at, other`` of different lines that can be within their bound of edits, the other one earlier.
FITS = (
    "other.hash <> at.hash AND struct(other.id, other.number) < struct(at.id, at.number) "
    f"AND abs(at.n - other.n) <= least(at.n, other.n) div {WORDS_PER_EDIT} "
    f"AND bit_count(at.low ^ other.low) + bit_count(at.high ^ other.high) <= 2 * (least(at.n, other.n) div {WORDS_PER_EDIT})"
)


def near_long(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Places ``id, number`` of long lines with an earlier one within their bound of edits."""
    line = F.struct("id", "number", "hash", "n", "low", "high")
    keys = checkpointed(runs.groupBy("key").agg(F.min(line).alias("other"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter("lo <> hi").drop("lo", "hi"))
    met = runs.join(keys, "key").groupBy("key", "hash", "other").agg(F.min(line).alias("at"))
    met = checkpointed(met.select("key", "at", "other"))
    first = checkpointed(verified_pairs(docs, checkpointed(met.filter(FITS).select("at", "other").distinct())).distinct())
    left = met.drop("other").join(first.select(F.struct("id", "number").alias("place")), F.expr("struct(at.id, at.number) = place"), "left_anti")
    pairs = left.join(met.select("key", F.col("at").alias("other"), F.col("other").alias("leader")), "key")
    pairs = checkpointed(pairs.filter("other <> leader").filter(FITS).select("at", "other").distinct())
    return first.unionByName(verified_pairs(docs, pairs))


def chosen_lines(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> list[np.ndarray]:
    """Numbers of the lines of each row that have a bit of ``line_words``."""
    feeds = np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1
    count = np.bincount(feeds, minlength=part.num_rows) + 1
    row = np.repeat(np.arange(part.num_rows), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hit = flagged((part.column("hash").to_numpy()[row] ^ (number * LINE_STEP)).view(np.uint64), flags)
    return np.split(number[hit], np.cumsum(np.bincount(row[hit], minlength=part.num_rows))[:-1])


def line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, number, words`` of the wanted lines; ``wanted`` has ``id, numbers``.

    Where these are too many to be broadcast, a bit for each is, and a few other lines come along; texts are never shuffled.
    """
    kind = docs.schema["id"].dataType.simpleString()
    wanted = checkpointed(wanted)
    flags = None
    if fits(wanted):
        docs = within(docs, wanted, "id", "inner")
    else:
        places = wanted.select(F.xxhash64("id").alias("hash"), F.explode("numbers").alias("number"))
        told = docs.sparkSession.sparkContext.broadcast(key_flags(places.select(F.col("hash").bitwiseXOR(F.col("number").cast("bigint") * LINE_STEP).alias("key"))))
        docs, flags = docs.withColumn("hash", F.xxhash64("id")), told

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                lower = folded(data).tobytes()
                ids, numbers, words = [], [], []
                chosen = part.column("numbers").to_pylist() if flags is None else chosen_lines(part, data, offsets, flags.value)
                for row, (name, some) in enumerate(zip(part.column("id").to_pylist(), chosen, strict=True)):
                    lines = lower[offsets[row] : offsets[row + 1]].split(b"\n") if len(some) else []
                    for number in some:
                        ids.append(name)
                        numbers.append(number)
                        words.append(b" ".join(lines[number].split()))
                arrays = [pa.array(ids, part.schema.field("id").type), pa.array(numbers, pa.int32()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "number", "words"])

    return docs.mapInArrow(tidy(scan), f"id {kind}, number int, words binary")


def verified_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places ``id, number`` of the lines whose pair holds on the words."""
    kind = docs.schema["id"].dataType.simpleString()
    places = pairs.select(F.explode(F.array("at", "other")).alias("p")).select("p.id", "p.number")
    words = checkpointed(line_words(docs, places.groupBy("id").agg(F.collect_set("number").alias("numbers"))))
    own, earlier = words.select("id", "number", F.col("words").alias("x")), words.select(F.col("id").alias("oid"), F.col("number").alias("onumber"), F.col("words").alias("y"))
    both = pairs.select("at.id", "at.number", F.col("other.id").alias("oid"), F.col("other.number").alias("onumber"))
    both = both.join(own, ["id", "number"]).join(earlier, ["oid", "onumber"]).select("id", "number", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [near_words_apart(x.split(), y.split()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["id", "number"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(tidy(check), f"id {kind}, number int")


def repeated_lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """``id, numbers``: the lines of each document that go. ``docs`` has ``id, text`` without NULL ids."""
    n_lines = line_count(docs)
    table = line_keys(docs, n_lines, min_words, near_words)
    lines = table.filter(f"role = {LINE}")
    distinct = lines.groupBy("hash").agg(F.min(F.struct("id", "number")).alias("first"), F.count("*").alias("n"))
    again = checkpointed(distinct.filter("n > 1").select("hash", "first"))
    later = within(lines.select("id", "number", "hash"), again, "hash", "inner").filter("struct(id, number) > first").select("id", "number")
    keys = key_table(table, n_lines)
    near = near_pairs(keys.filter(f"role <> {RARE}").drop("n", "low", "high"))
    gone = later.union(verified_pairs(docs, near)).union(near_long(docs, keys.filter(f"role = {RARE}").drop("role")))
    return checkpointed(gone.groupBy("id").agg(F.collect_set("number").alias("numbers")))


def deduplicate_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, drop_empty: bool = False) -> DataFrame:
    """``docs`` with the lines removed that repeat an earlier one, and otherwise unchanged.

    ``drop_empty`` also removes documents that lost lines and have no word left.
    """
    require(docs, id_column, text)
    plain = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    lists = private("numbers")
    gone = repeated_lines(plain, min_words, near_words).select(F.col("id").alias(id_column), F.col("numbers").alias(lists))
    joined = with_partners(docs, gone, id_column)
    schema = T.StructType([T.StructField(text, T.StringType()) if f.name == text else f for f in docs.schema.fields])
    arrow, names = to_arrow_schema(schema), docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text).cast(pa.string()).to_pylist(), np.ones(batch.num_rows, bool)
            for row, numbers in enumerate(batch.column(lists).to_pylist()):
                if numbers and texts[row] is not None:
                    out = set(numbers)
                    texts[row] = "\n".join(x for i, x in enumerate(texts[row].split("\n")) if i not in out)
                    keep[row] = not drop_empty or bool(texts[row].strip(" \t\n\v\f\r"))
            arrays = [pa.array(texts, arrow.field(c).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, arrow.types, strict=True)], schema=arrow).filter(pa.array(keep))

    return joined.select(*docs.columns, lists).mapInArrow(tidy(rewrite), schema)
