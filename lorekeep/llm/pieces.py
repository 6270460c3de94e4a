"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A model file gives pieces with log scores. Texts get a leading blank, blanks are the pieces'
white-space marker, and the segmentation with the largest sum of scores is found by Viterbi (ties:
the longest last piece). A character that no piece covers costs the smallest score minus ten and is
written as its UTF-8 bytes, one byte piece each (as the unknown id if the model has none). Decoding joins pieces and bytes and
takes the leading blank away, so with byte pieces every text comes back exactly; the marker itself in a text counts as
an unknown character and survives too.

No piece goes on behind its leading markers with another marker (checked), so the best
segmentation of a text is that of its units: blanks with the characters up to the next blank. Equal
units are segmented once per task: units are known by 64-bit hashes, short ones go through Viterbi together, one numpy step
per byte, and a bounded cache holds their ids.

Defined results: an empty text has no ids, NULL stays NULL either way. All columns are kept, one
of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.llm.tables import require
from lorekeep.llm.textkit import RangeHash, text_slices, tidy

MARKER = "▁"
BLANK = 0x20
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "
CACHE_UNITS = 150_000
SHORT_BYTES = 48
CELLS = 1 << 20


@dataclass
class Pieces:
    """The trie of the pieces' bytes, their scores, and what ids decode to."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    unknown_score: float
    unknown_id: int
    byte_ids: np.ndarray | None
    longest: int
    text: list[bytes]

    def walk(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """Ends and ids of the pieces that begin at ``start``."""
        state, at = 0, start
        while at < len(data):
            after = self.base[state] + data[at] + 1
            if self.check[after] != state:
                return
            state, at = after, at + 1
            if self.piece[state] >= 0:
                yield at, self.piece[state]


def double_array(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value`` of the words (value: the word's place): state s goes by byte c to
    ``base[s] + c + 1`` if ``check`` there is s. The root is state 0."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for place, word in enumerate(words):
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = place
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    check[0] = 0
    free, todo = 1, [(0, 0)]
    for node, state in todo:
        codes = np.array(sorted(children[node]), np.int64) + 1
        if not len(codes):
            continue
        while used[free]:
            free += 1
        start = max(0, free - int(codes[0]))
        while True:
            if start + 4096 + 257 > size:
                grown = size * 2
                base, check, value = np.resize(base, grown), np.resize(check, grown), np.resize(value, grown)
                used = np.resize(used, grown)
                base[size:], check[size:], value[size:], used[size:] = 0, -1, -1, False
                size = grown
            fits = np.ones(4096, bool)
            for c in codes:
                fits &= ~used[start + c : start + c + 4096]
            if fits.any():
                start += int(fits.argmax())
                break
            start += 4096
        base[state] = start
        for c in codes:
            used[start + c] = True
            check[start + c] = state
            child = children[node][int(c) - 1]
            value[start + c] = ends.get(child, -1)
            todo.append((child, int(start + c)))
    return base, np.append(check, np.full(512, -1, np.int32)), value


def load_pieces(path: str) -> Pieces:
    """Read a SentencePiece model file; only pieces and scores are used, whatever it was trained as."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names = {i: model.id_to_piece(i) for i in ids}
    if any(MARKER in names[i].lstrip(MARKER) for i in plain):
        raise ValueError("a piece holds the marker behind other characters")
    words = [names[i].replace(MARKER, " ").encode() for i in plain]
    base, check, value = double_array(words)
    piece = np.where(value >= 0, np.array([*plain, -1], np.int32)[value], -1).astype(np.int32)
    score = np.zeros(len(ids))
    score[plain] = [model.get_score(i) for i in plain]
    known = {int(names[i][3:-1], 16): i for i in ids if model.is_byte(i)}
    text = [b""] * len(ids)  # control pieces decode to nothing
    for i, word in zip(plain, words, strict=True):
        text[i] = word
    for byte, i in known.items():
        text[i] = bytes([byte])
    text[model.unk_id()] = UNKNOWN_TEXT.encode()
    byte_ids = np.array([known[b] for b in range(256)], np.int32) if len(known) == 256 else None
    least = min((model.get_score(i) for i in plain), default=0.0)
    return Pieces(base, check, piece, score, least - UNKNOWN_PENALTY, model.unk_id(), byte_ids, max(map(len, words), default=0), text)


def _character_bytes(first: np.ndarray) -> np.ndarray:
    """Length of a UTF-8 character by its first byte (1 for a stray byte)."""
    return np.select([first < 0xC0, first < 0xE0, first < 0xF0], [1, 2, 3], 4)


def _spelled(data: bytes, steps: list[tuple[int, int, int]], pieces: Pieces) -> list[int]:
    out = []
    for start, end, piece in steps:
        if piece >= 0:
            out.append(piece)
        elif pieces.byte_ids is None:
            out.append(pieces.unknown_id)
        else:
            out.extend(pieces.byte_ids[b] for b in data[start:end])
    return out


def segment(data: bytes, pieces: Pieces) -> tuple[list[int], float]:
    """Ids and score of one unit, position by position."""
    n = len(data)
    best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        here = best[at]
        if here == float("-inf"):
            continue
        for end, piece in pieces.walk(data, at):
            score = here + pieces.score[piece]
            if score > best[end]:
                best[end], back[end] = score, (at, piece)
        end = min(n, at + int(_character_bytes(np.array(data[at]))))
        if here + pieces.unknown_score > best[end]:
            best[end], back[end] = here + pieces.unknown_score, (at, -1)
    steps, at = [], n
    while at:
        start, piece = back[at]
        steps.append((start, at, piece))
        at = start
    return _spelled(data, steps[::-1], pieces), best[n]


def segment_many(units: list[bytes], pieces: Pieces) -> list[list[int]]:
    """Ids of short units: all of them move through the trie together, one byte at a time."""
    n, width = len(units), max(map(len, units))
    length = np.array([len(u) for u in units])
    cells = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width)
    best = np.full((n, width + 1), -np.inf)
    came, which = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    best[:, 0] = 0
    for at in range(width):
        rows = np.flatnonzero((length > at) & (best[:, at] > -np.inf))
        if not len(rows):
            continue
        here, live, state = best[rows, at], np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for end in range(at + 1, min(width, at + pieces.longest) + 1):
            after = pieces.base[state].astype(np.int64) + cells[rows[live], end - 1] + 1
            good = (pieces.check[after] == state) & (length[rows[live]] >= end)
            live, state = live[good], after[good]
            if not len(live):
                break
            piece = pieces.piece[state]
            has = piece >= 0
            row, score = rows[live[has]], here[live[has]] + pieces.score[piece[has]]
            more = score > best[row, end]
            row = row[more]
            best[row, end], came[row, end], which[row, end] = score[more], at, piece[has][more]
        end = np.minimum(length[rows], at + _character_bytes(cells[rows, at]))
        more = here + pieces.unknown_score > best[rows, end]
        row, end = rows[more], end[more]
        best[row, end], came[row, end], which[row, end] = here[more] + pieces.unknown_score, at, -1
    out = []
    came, which = came.tolist(), which.tolist()
    for i, unit in enumerate(units):
        steps, at = [], len(unit)
        while at:
            start = came[i][at]
            steps.append((start, at, which[i][at]))
            at = start
        out.append(_spelled(unit, steps[::-1], pieces))
    return out


class Encoder:
    """Encodes text buffers; remembers the ids of units."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.places: dict[int, int] = {}
        self.pool: list[np.ndarray] = []
        self.ends = np.zeros(1, np.int64)

    def learn(self, keys: list[int], units: list[bytes]) -> None:
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        ids: list[list[int]] = [[] for _ in units]
        short = [i for i in order if len(units[i]) <= SHORT_BYTES]
        at = 0
        while at < len(short):
            step = max(1, CELLS // max(8, len(units[short[min(at + CELLS // 8, len(short)) - 1]])))
            chosen = short[at : at + step]
            for i, found in zip(chosen, segment_many([units[i] for i in chosen], self.pieces), strict=True):
                ids[i] = found
            at += step
        for i in order[len(short) :]:
            ids[i] = segment(units[i], self.pieces)[0]
        for place, key in enumerate(keys, len(self.ends) - 1):
            self.places[key] = place
        self.pool.append(np.array([x for found in ids for x in found], np.int32))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(found) for found in ids])])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the rows' offsets among them."""
        n, size = len(offsets) - 1, np.diff(offsets)
        lead = np.concatenate([[0], np.cumsum(size > 0)])
        begin = offsets + lead
        spaced = np.full(begin[-1], BLANK, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(lead[1:], size)] = data
        blank = spaced == BLANK
        new = blank.copy()
        new[1:] &= ~blank[:-1]
        new[begin[:-1][size > 0]] = True
        starts = np.flatnonzero(new)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(spaced))
        keys, first, unit = np.unique(RangeHash(spaced).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.places) > CACHE_UNITS:
            self.clear()
        names = keys.tolist()
        missing = [i for i, k in enumerate(names) if k not in self.places]
        if missing:
            raw = spaced.tobytes()
            self.learn([names[i] for i in missing], [raw[starts[first[i]] : ends[first[i]]] for i in missing])
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        place = np.array([self.places[k] for k in names])[unit]
        count = self.ends[place + 1] - self.ends[place]
        total = np.cumsum(count)
        ids = self.pool[0][np.arange(total[-1]) - np.repeat(total - count, count) + np.repeat(self.ends[place], count)]
        row = np.searchsorted(begin, starts, "right") - 1
        return ids, np.concatenate([[0], np.cumsum(np.bincount(row, count, n).astype(np.int64))])


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode_texts(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as an int array."""
    require(docs, text)
    schema = _with_column(docs, ids, T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part, data, offsets in text_slices(batch, text):
                found, ends = encoder.encode(data, offsets)
                absent = part.column(text).is_null()
                bounds = pa.array(ends.astype(np.int32))
                if absent.true_count:
                    bounds = pa.array(ends.astype(np.int32), mask=np.append(absent.to_numpy(zero_copy_only=False), False))
                column = pa.ListArray.from_arrays(bounds, pa.array(found)).cast(arrow.field(ids).type)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in arrow.names[:-1]), column], schema=arrow)

    return docs.mapInArrow(tidy(scan), schema)


def decode_ids(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of each id array. NULL and unknown numbers within an array decode to
    nothing; bytes that are no UTF-8 become replacement characters."""
    require(rows, ids)
    schema = _with_column(rows, text, T.StringType())
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(pieces)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.text
        pool = np.frombuffer(b"".join(known), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in known])])
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                column = batch.column(ids)
                numbers = column.flatten()
                ids_ = numbers.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids_ = np.where((ids_ >= 0) & (ids_ < len(known)), ids_, -1)
                size = np.where(ids_ >= 0, ends[ids_ + 1] - ends[ids_], 0)
                total = np.concatenate([[0], np.cumsum(size)])
                data = pool[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(ends[ids_], size)].tobytes()
                counts = [0 if n is None else n for n in column.value_lengths().to_pylist()]
                bounds = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
                texts = [
                    data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if valid else None
                    for a, b, valid in zip(bounds[:-1], bounds[1:], column.is_valid().to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in arrow.names[:-1]), pa.array(texts, arrow.field(text).type)], schema=arrow)

    return rows.mapInArrow(tidy(scan), schema)
