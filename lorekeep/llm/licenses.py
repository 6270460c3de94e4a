"""Licence scan: Dice coefficient over word bigrams between units of a text and licence templates.

A unit is a line, a paragraph (lines between blank ones) or the whole text. Texts are normalised:
ASCII and Latin-1 letters in lower case, words are runs of letters and digits. With bigram sets A and B the
coefficient is 2 |A & B| / (|A| + |B|), so a template can reach ``least`` only if the sizes lie
within (2 - least) / least of each other; the others are pruned. Units are pruned by lower
bounds too: |A| is at least the number of its distinct bigrams in an eighth of the hash space.

With ``windows`` a licence is also met inside a text, whatever its lines and paragraphs: in every text that holds
enough of a template's bigrams, each run of words that begins and ends with one of them is scored (other runs
score less), up to the size bound. A first bigram that comes again within a run adds nothing, so runs end before it.

One pass over the texts, no shuffle; the templates are a fixed short list sent with the task.
Bigrams are known by 64-bit hashes.

Defined results: units with fewer than two words match nothing, so NULL and empty texts give no
rows. Repeated rows are reported each. Extra columns are not read. Memory follows the longest text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.license_texts import TEMPLATES
from lorekeep.llm.quality import DIGIT, LETTER
from lorekeep.llm.tables import require
from lorekeep.llm.textkit import RangeHash, folded, mix, text_slices, word_bounds

LEAST = 0.8
LINE, PARAGRAPH, TEXT, WINDOW = "line", "paragraph", "text", "window"
_NEXT = np.uint64(0x2545F4914F6CDD1D)


class Bigrams:
    """Word bigrams of a buffer with the places of their first words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lower = folded(data)
        self.starts, ends, self.rows = word_bounds(lower, offsets, ~(LETTER | DIGIT))
        words = RangeHash(lower).of(self.starts, ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.hashes = mix(words[:-1] * _NEXT + words[1:]) if len(words) else words


class TemplateIndex:
    """Bigrams of all templates, each with the templates that hold it."""

    def __init__(self, templates: Sequence[tuple[str, str]], least: float) -> None:
        self.names = [name for name, _ in templates]
        self.least = least
        sets = []
        for _, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            sets.append(np.unique(Bigrams(data, np.array([0, len(data)])).hashes))
        self.sizes = np.array([len(s) for s in sets])
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(hashes, kind="stable")
        self.kinds, first = np.unique(hashes[order], return_index=True)
        self.first, self.owner = np.append(first, len(order)), owner[order]
        self.holds = np.zeros((len(sets), len(self.kinds)), bool)
        self.holds[self.owner, np.repeat(np.arange(len(self.kinds)), np.diff(self.first))] = True
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.kinds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known hashes, and which they are."""
        at = np.flatnonzero(self.flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        kind = np.minimum(np.searchsorted(self.kinds, hashes[at]), len(self.kinds) - 1)
        same = self.kinds[kind] == hashes[at]
        return at[same], kind[same]

    def match(self, hashes: np.ndarray, unit: np.ndarray, known: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """``unit, template, coefficient`` of the matches. ``unit`` numbers the bigrams' units in
        ascending order, -1 for bigrams across units."""
        inside = unit[known] >= 0
        known, kind = known[inside], kind[inside]
        if not len(known):
            return
        held = np.unique(np.stack([unit[known], kind]), axis=1)
        owners, shared = np.unique(held[0], return_counts=True)
        # 2c >= least (|A| + |B|) and |B| >= c: |A| <= (2 / least - 1) c
        limit = np.floor((2 / self.least - 1) * shared + 1e-9).astype(np.int64)
        good = np.zeros(int(unit.max()) + 1, bool)
        good[owners] = True
        for bits in (7, 0):
            at = np.flatnonzero((unit >= 0) & (hashes & np.uint64(bits) == 0))
            at = at[good[unit[at]]]
            order = np.lexsort((hashes[at], unit[at]))
            u, h = unit[at][order], hashes[at][order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (h[1:] != h[:-1])
            size = np.bincount(u[new], minlength=len(good))
            good[owners] &= size[owners] <= limit
        held = held[:, good[held[0]]]
        count = self.first[held[1] + 1] - self.first[held[1]]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[held[1]], count)
        of, template = np.repeat(held[0], count), self.owner[entry]
        a, b = size[of], self.sizes[template]
        near = (a * self.least <= b * (2 - self.least) + 1e-9) & (b * self.least <= a * (2 - self.least) + 1e-9)
        pairs, common = np.unique(np.stack([of[near], template[near]]), axis=1, return_counts=True)
        dice = 2 * common / (size[pairs[0]] + self.sizes[pairs[1]])
        for u, t, d in zip(*pairs, dice, strict=True):
            if d >= self.least - 1e-12:
                yield int(u), int(t), float(d)

    def likely(self, rows: np.ndarray, known: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Rows with the templates of which they hold enough bigrams anywhere: |B| <= (2 / least - 1) c."""
        held = np.unique(rows[known].astype(np.int64) * len(self.kinds) + kind)
        row, kind = held // len(self.kinds), held % len(self.kinds)
        count = self.first[kind + 1] - self.first[kind]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[kind], count)
        pairs, shared = np.unique(np.repeat(row, count) * len(self.names) + self.owner[entry], return_counts=True)
        template = pairs % len(self.names)
        pairs = pairs[self.sizes[template] <= (2 / self.least - 1) * shared + 1e-9]
        for r in np.unique(pairs // len(self.names)):
            yield int(r), pairs[pairs // len(self.names) == r] % len(self.names)

    def windows(self, hashes: np.ndarray, places: np.ndarray, kind: np.ndarray, templates: np.ndarray, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
        """``first, last`` word, licence and coefficient of the runs of words of one text that match.

        ``places`` and ``kind`` are its known bigrams; ``found`` has the words of its units that
        match. Runs of one licence share no word with each other or with such a unit, the largest
        coefficients first; a run that is mostly a unit or a better run of another licence is
        left out, like the other licences of a unit.
        """
        n = len(hashes)
        order = np.argsort(hashes, kind="stable")
        again = hashes[order[1:]] == hashes[order[:-1]]
        before, after = np.full(n, -1), np.full(n, n)
        before[order[1:][again]], after[order[:-1][again]] = order[:-1][again], order[1:][again]
        taken: dict[str, np.ndarray] = {}
        for first, last, name in found:
            taken.setdefault(name, np.zeros(n + 1, bool))[first : last + 1] = True
        marks = {}

        def best(t: int, start: int, stop: int) -> tuple[float, int]:
            size, mark = self.sizes[t], marks[t]
            limit = int((2 - self.least) / self.least * size + 1e-9)
            stop = min(stop, int(after[start]))
            end = min(stop, start + 2 * limit + 16)
            while True:
                new = before[start:end] < start
                wide = np.cumsum(new)
                if end == stop or wide[-1] > limit:
                    break
                end = min(stop, 2 * end - start)
            dice = np.where(mark[start:end], 2 * np.cumsum(new & mark[start:end]) / (wide + size), 0)
            k = int(dice.argmax())
            return float(dice[k]), start + k

        heap = []

        def push(t: int, start: int, stop: int) -> None:
            dice, end = best(t, start, stop)
            if dice >= self.least - 1e-12:
                heapq.heappush(heap, (-dice, end - start, start, t))

        for t in map(int, templates):
            marks[t] = np.zeros(n, bool)
            marks[t][places[self.holds[t, kind]]] = True
            starts = np.flatnonzero(marks[t])
            met = np.concatenate([[0], np.cumsum(marks[t])])
            for start in starts[(met[after[starts]] - met[starts]) * (2 / self.least - 1) + 1e-9 >= self.sizes[t]]:
                push(t, int(start), n)
        out: list[tuple[int, int, str, float]] = []
        while heap:
            less, long, start, t = heapq.heappop(heap)
            name, last = self.names[t], start + long + 1
            own = taken.setdefault(name, np.zeros(n + 1, bool))
            if own[start]:
                continue
            if own[start : last + 1].any():  # a shorter run may end before the words that are taken
                stop = start + int(own[start : last + 1].argmax()) - 1
                if stop > start:
                    push(t, start, stop)
                continue
            own[start : last + 1] = True
            rivals = [(a, b) for a, b, x in found if x != name] + [(a, b) for a, b, x, d in out if x != name and (d > -less or (a, b) != (start, last))]
            if all(2 * (min(b, last) - max(a, start) + 1) < max(b, last) - min(a, start) + 1 for a, b in rivals):
                out.append((start, last, name, -less))
        return out


def unit_numbers(data: np.ndarray, offsets: np.ndarray, bigrams: Bigrams) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind of unit, the unit of each word in ascending order, and the number within the row of each unit."""
    rows, starts = bigrams.rows, bigrams.starts
    feed = data == 10
    blank = np.zeros(len(data), bool)  # the feed that ends a blank line
    ends = np.flatnonzero(feed)
    dark = np.concatenate([[0], np.cumsum(~np.isin(data, (0x20, 0x09, 0x0B, 0x0C, 0x0D, 0x0A)))])
    row = np.searchsorted(offsets, ends, "right")
    blank[ends[1:]] = (dark[ends[1:]] == dark[ends[:-1]]) & (row[1:] == row[:-1])
    for kind, marks in ((LINE, feed), (PARAGRAPH, blank), (TEXT, None)):
        before = np.zeros(len(data) + 1, np.int64) if marks is None else np.concatenate([[0], np.cumsum(marks)])
        number = before[starts] - before[offsets[rows]]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
        yield kind, np.cumsum(new) - 1, number[new]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST, windows: bool = False) -> DataFrame:
    """``id, license, unit, number, dice`` for every unit that reaches ``least`` with a template: the
    licence with the largest coefficient (ties: each), the unit's kind and its number within the
    text. A paragraph that is one line, or a text that is one paragraph, is reported as the smaller
    unit only. With ``windows`` runs of words inside a text that match are units too, where no other unit of theirs
    matches; their number is that of the first word within the text. The id keeps its name."""
    require(docs, id_column, text)
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(list(templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(told.value, least) if told.value else None
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                bigrams = Bigrams(data, offsets)
                if index is None or len(bigrams.starts) < 2:
                    continue
                known, which = index.find(bigrams.hashes)
                found, seen, whole = [], set(), []
                for name, unit, number in unit_numbers(data, offsets, bigrams):
                    own = np.where(unit[1:] == unit[:-1], unit[:-1], -1)
                    first = np.searchsorted(unit, np.arange(len(number)))
                    last = np.append(first[1:], len(unit)) - 1
                    best: dict[int, dict[str, float]] = {}
                    for u, t, d in index.match(bigrams.hashes, own, known, which):
                        of = best.setdefault(u, {})
                        of[index.names[t]] = max(of.get(index.names[t], 0.0), d)
                    for u, of in sorted(best.items()):
                        words = int(first[u]), int(last[u])
                        if words not in seen:
                            seen.add(words)
                            top = max(of.values())
                            row = int(bigrams.rows[words[0]])
                            found += [(row, x, name, int(number[u]), d) for x, d in of.items() if d == top]
                            whole += [(row, *words, x) for x, d in of.items() if d == top]
                if windows:
                    inside = bigrams.rows[known] == bigrams.rows[known + 1]
                    at, kinds_at = known[inside], which[inside]
                    for row, templates_of in index.likely(bigrams.rows, at, kinds_at):
                        begin, end = np.searchsorted(bigrams.rows, [row, row + 1])
                        a, b = np.searchsorted(at, [begin, end])
                        units = [(first - begin, last - begin, x) for r, first, last, x in whole if r == row]
                        runs = index.windows(bigrams.hashes[begin : end - 1], at[a:b] - begin, kinds_at[a:b], templates_of, units)
                        found += [(row, x, WINDOW, first, d) for first, _, x, d in runs]
                if found:
                    row, license_, name, number, dice = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {"id": part.column("id").take(pa.array(row)), "license": license_, "unit": name, "number": pa.array(number, pa.int32()), "dice": pa.array(dice)}
                    )

    found = rows.mapInArrow(scan, f"id {kind}, license string, unit string, number int, dice double")
    return found.withColumnRenamed("id", id_column)
