"""Documents packed into sequences of fixed length, as a cutting-stock problem by column generation.

A document's ids are cut into full sequences and one shorter rest. The driver sees only how many rests of
each length there are (at most 2,047 numbers): a linear program over patterns, combinations of length
classes that fit a sequence, is solved by column generation, where a knapsack dynamic program over
the dual prices finds the next pattern. Whole copies of the patterns are dealt to the rests by their rank
within their class, all in Spark: ranks come from a global order, patterns from a table of
at most a few thousand rows.

Classes are eight tokens wide, and patterns need not be full. What stays open is filled without padding by
documents that are cut freely: a share of rests chosen by a hash of id and text, as large as the
space that the patterns leave, and the few rests that rounding leaves over. Rests and gaps
are laid on one axis by running sums and meet where they overlap. What is left
of the axis makes further sequences, the last of them powers of two.

CRC-32 of full sequences and rests is taken where a text is tokenised, so only texts cut for filling
are read a second time, and no ids are shuffled or stored.

Tokenising cuts a text at single blanks between two other characters, where no token of the byte-level
pattern can cross, and reads the different pieces of a slice once: pieces of plain letters by ``tiktoken``
with the ranks of the same vocabulary file, which gives equal ids in a third of the time, others by ``tokenizers``.

Defined results: a NULL or empty text is the end id alone; rows of one id are packed each for itself (equal rows
are alike); an id may be NULL; an empty table has no pieces; extra columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.ranks import ordered, running_before
from lorekeep.llm.tables import BROADCAST_BYTES, checkpointed, require
from lorekeep.llm.textkit import RangeHash, text_slices
from lorekeep.session import union_all

LENGTH = 2_048
UNIT = 8
END_ID = 1
GAP = 5e-4  # the linear program may stop this near to its bound
AXIS_BLOCK = 64
SHARES = 1 << 20  # steps of the share that is cut for filling


def _blanks_between(data: np.ndarray) -> np.ndarray:
    """Places of single blanks whose neighbours are surely no white space.

    Outside ASCII all white space starts with the bytes C2, E1, E2 or E3; characters that start so are not judged.
    """
    sure = np.zeros(256, bool)
    sure[0x21:0x7F] = sure[0xC3:0xE1] = sure[0xE4:0xF5] = True
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[sure[data[at + 1]]]
    lead = at - 1
    for _ in range(3):  # back to the first byte of the character before
        inside = (data[lead] & 0xC0 == 0x80) & (lead > 0)
        lead = np.where(inside, lead - 1, lead)
    return at[sure[data[lead]]]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


#: The split of the byte-level vocabulary into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Bytes of ASCII and Latin letters, read alike by every version of Unicode; a bar may belong to a special token.
PLAIN = np.zeros(256, bool)
PLAIN[:0x80] = PLAIN[0x80:0xC0] = PLAIN[0xC3:0xCC] = True
PLAIN[[ord("|"), *range(0x1C, 0x20)]] = False


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others for the letters from U+0100 on, in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def ranked_pieces(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes with ranks, where its ids are the order of its merges; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, letters = model["vocab"], byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if model["type"] != "BPE" or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}


class Coder:
    """Token ids of texts, equal to those of the ``tokenizers`` library. Pieces of plain text go through a faster
    reader of the same ranks where the vocabulary has them, all else through the tokenizer itself."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = ranked_pieces(path)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

        vocab, letters = self.tokenizer.get_vocab(with_added_tokens=False), byte_letters()
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if not set().union(*vocab) <= set(letters):
            raise ValueError("not a byte-level vocabulary")
        sizes = {i: len(t) for t, i in vocab.items()}
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for i, n in (sizes | added).items():
            self.bytes_of[i] = n

    def run_ids(self, raw: bytes, plain: bool) -> np.ndarray:
        text = raw.decode()
        if plain and self.fast is not None:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each begin with a blank, one after the other, and how many each has.

        Different pieces are read as one text, where they do not touch either; a piece's ids are those
        that make up its bytes.
        """
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        hashes = RangeHash(data).of(starts, ends)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        if not np.array_equal(data[_ranges(starts, ends - starts)], data[_ranges(starts[first][which], ends - starts)]):
            first, which = np.arange(len(order)), np.arange(len(order))  # unequal pieces with equal hashes
        sizes = (ends - starts)[first]
        ids = self.run_ids(data[_ranges(starts[first], sizes)].tobytes(), plain)
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
        begin = np.concatenate([[0], upto[:-1]])
        count = (upto - begin)[which]
        return ids[_ranges(begin[which], count)], count

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, each with the end id, and the offsets of the rows."""
        cuts = np.sort(np.concatenate([offsets, _blanks_between(data)]))
        cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
        starts, ends = cuts[:-1], cuts[1:]
        odd = np.concatenate([[0], np.cumsum(~PLAIN[data])])
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offsets] = True
        kinds = np.where(row_start[starts], 2, odd[ends] > odd[starts])  # plain, other, first of its row
        at = np.argsort(kinds, kind="stable")
        ends_of = np.searchsorted(kinds[at], [1, 2])
        plain, other, heads = np.split(at, ends_of)
        coded = [self.pieces(data, starts[p], ends[p], k == 0) for k, p in enumerate((plain, other))]
        raw = [data[a:b].tobytes() for a, b in zip(starts[heads].tolist(), ends[heads].tolist())]
        first = [self.run_ids(r, odd[b] == odd[a]) for r, a, b in zip(raw, starts[heads].tolist(), ends[heads].tolist())]
        coded.append((np.concatenate([*first, np.zeros(0, np.uint32)]), np.array([len(f) for f in first], np.int64)))
        ids, count = np.concatenate([c for c, _ in coded]), np.concatenate([n for _, n in coded])
        begin = np.empty(len(at), np.int64)
        sizes = np.empty(len(at), np.int64)
        begin[at], sizes[at] = np.cumsum(count) - count, count
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[np.searchsorted(starts, offsets)]  # an empty row has no piece
        out = np.insert(ids[_ranges(begin, sizes)], bounds[1:], END_ID).astype("<u4")
        return out, bounds + np.arange(len(bounds))


@functools.lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def text_digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def lengths(docs: DataFrame, path: str, length: int) -> DataFrame:
    """Stored ``id, digest, n, crcs`` of ``docs`` (``id, text``): ids with the end id, and CRC-32 of each run of ``length`` ids."""
    kind = docs.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                crcs = [[crc(ids[a : min(a + length, end)]) for a in range(begin, end, length)] for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "digest": part.column("digest"), "n": np.diff(bounds), "crcs": pa.array(crcs, pa.list_(pa.int64()))})

    return checkpointed(docs.select("id", "text", text_digest().alias("digest")).mapInArrow(scan, f"id {kind}, digest string, n bigint, crcs array<bigint>"))


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often to take each of the ascending sizes for the highest price within the capacity."""
    best = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            values = best[c - sizes[:k]] + prices[:k]
            i = int(values.argmax())
            if values[i] > best[c]:
                best[c], chosen[c] = values[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            counts[chosen[c]] += 1
            c -= sizes[chosen[c]]
    return counts, float(best[capacity])


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each, items per class) and how often each is used, fractional: the linear program's
    optimum up to ``gap``. ``sizes`` ascend, ``demand`` is positive.

    Revised simplex method: the basis starts with one pattern per class; the dual prices of the classes price
    new patterns, and one of value over 1 enters.
    """
    fits = capacity // sizes
    basis, inverse, used = np.diag(fits).astype(np.int64), np.diag(1.0 / fits), demand / fits
    for _ in range(100 * len(sizes)):
        prices = inverse.sum(axis=0)
        pattern, value = knapsack(sizes, prices, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        steps = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        inverse[out] /= direction[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        basis[:, out] = pattern
    return basis, used


def plan_patterns(histogram: dict[int, int], length: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sizes`` of the classes in units, the patterns and their fractional use, for rests of given lengths."""
    count = np.zeros(length // unit + 1, np.int64)
    for rest, n in histogram.items():
        count[-(-rest // unit)] += n
    sizes = np.flatnonzero(count)
    basis, used = patterns(sizes, count[sizes].astype(float), length // unit)
    return sizes, basis, used


def _histogram(rows: DataFrame) -> dict[int, int]:
    """Rests by length: at most as many rows as a sequence has tokens."""
    return {r["rest"]: r["n"] for r in rows.filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}


def _share(histogram: dict[int, int], length: int, unit: int) -> float:
    """The share of the rests' tokens that fills what the patterns for all of them leave open."""
    tokens = sum(r * n for r, n in histogram.items())
    if not tokens:
        return 0.0
    _, _, used = plan_patterns(histogram, length, unit)
    waste = max(0.0, used.sum() * length - tokens)
    return min(1.0, 1.05 * waste / (waste + tokens))


def _coded_pieces(cut: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """``id, digest, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of freely cut documents: ``cut`` has a list of pieces per row."""
    kind = cut.schema["id"].dataType.simpleString()
    both = cut.join(texts.withColumnsRenamed({"id": "text_id", "digest": "text_digest"}), F.col("id").eqNullSafe(F.col("text_id")) & (F.col("digest") == F.col("text_digest")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                lists = part.column("pieces")
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                start, size = flat.field("start").to_numpy(), flat.field("length").to_numpy()
                crcs = [crc(ids[a : a + n]) for a, n in zip((bounds[row] + start).tolist(), size.tolist())]
                at = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id").take(at), "digest": part.column("digest").take(at), "start": start, "length": size, "ids_crc32": pa.array(crcs, pa.int64()),
                     "doc_tokens": np.diff(bounds)[row], "sequence_id": flat.field("sequence_id"), "offset": flat.field("offset")}
                )

    rows = both.select("id", "digest", "text", "pieces")
    return rows.mapInArrow(scan, f"id {kind}, digest string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents: ``id, digest`` (MD5 of the text), ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``length`` is a power of two and a multiple of ``unit``. Sequence ids are unique, not gapless.
    """
    require(docs, id_column, text)
    spark = docs.sparkSession
    plain = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    rows = lengths(plain, path, length)
    n_docs = rows.count()
    rows = rows.withColumns({"rest": F.col("n") % length, "full": F.expr(f"n div {length}"), "draw": F.pmod(F.xxhash64("id", "digest", F.lit("fill")), F.lit(SHARES))})
    everything = _histogram(rows)
    limit = int(_share(everything, length, unit) * SHARES)
    drawn = F.col("draw") < limit
    sizes, basis, used = plan_patterns(_histogram(rows.filter(~drawn)), length, unit)
    copies = np.floor(used + 1e-6).astype(np.int64)

    # places: the ranks of a class that go to a pattern, and where its items stand there (larger classes first)
    first = np.concatenate([[0], np.cumsum(copies)])
    n_patterned = int(first[-1])
    table, taken = [], np.zeros(len(sizes), np.int64)
    for p in np.flatnonzero(copies):
        slot = 0
        for i in range(len(sizes) - 1, -1, -1):
            if each := int(basis[i, p]):
                table.append((int(sizes[i]), int(taken[i]), int(taken[i] + each * copies[p]), each, int(first[p]), slot))
                taken[i] += each * copies[p]
                slot += each
    places = spark.createDataFrame(table, "class bigint, low bigint, high bigint, each bigint, first bigint, slot bigint")

    cls = F.when((F.col("rest") > 0) & ~drawn, F.ceil(F.col("rest") / unit)).otherwise(0).cast("bigint")
    placed = ordered(rows.withColumn("class", cls), [F.col("class"), F.col("id"), F.col("digest")], n_docs, "index")
    starts = placed.groupBy("class").agg(F.min("index").alias("from"))
    ranked = placed.join(F.broadcast(starts), "class").withColumn("rank", F.col("index") - F.col("from"))
    fits = (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    dealt = checkpointed(ranked.join(F.broadcast(places.withColumnRenamed("class", "of")), fits, "left"))

    cut = dealt.filter("rest > 0 AND first IS NULL")
    whole = dealt.filter("first IS NOT NULL").select(
        "id", "digest", (F.col("full") * length).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"), (F.col("slot") + (F.col("rank") - F.col("low")) % F.col("each")).alias("place"),
    )
    sequence = Window.partitionBy("sequence_id")
    before = sequence.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({"offset": F.coalesce(F.sum("length").over(before), F.lit(0)), "total": F.sum("length").over(sequence)}).drop("place")
    whole = checkpointed(whole)
    gaps = whole.filter(f"offset + length = total AND total < {length}").select("sequence_id", F.col("total").alias("offset"), (F.lit(length) - F.col("total")).alias("size"))

    pieces = [whole.drop("total")]
    n_cut, to_fill = cut.agg(F.count("*"), F.coalesce(F.sum("rest"), F.lit(0))).first()
    if n_cut:
        filled, n_sequences = _filled(cut, n_cut, to_fill, gaps, n_patterned, length)
        drawn_or_few = _texts(plain, cut, limit)
        pieces.append(_coded_pieces(filled, drawn_or_few, path))
    else:
        n_sequences = n_patterned
    several = dealt.filter("full > 0").select("id", "digest", "n", "index", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("k", "ids_crc32"))
    pieces.append(several.select(
        "id", "digest", (F.col("k") * F.lit(length).cast("bigint")).alias("start"), F.lit(length).cast("bigint").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"),
        (F.lit(n_sequences) + F.col("index") + F.col("k") * F.lit(n_docs).cast("bigint")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    ))
    return union_all(pieces)


def _texts(plain: DataFrame, cut: DataFrame, limit: int) -> DataFrame:
    """``id, digest, text`` once per document to be cut: those drawn by the hash, and the few that rounding left over."""
    rows = plain.withColumn("digest", text_digest())
    drawn = F.pmod(F.xxhash64("id", "digest", F.lit("fill")), F.lit(SHARES)) < limit
    few = checkpointed(cut.filter(F.col("draw") >= limit).select(F.col("id").alias("few_id"), F.col("digest").alias("few_digest")).distinct())
    small = few.count() * 128 <= BROADCAST_BYTES  # less than a sequence of items per pattern
    among = F.col("id").eqNullSafe(F.col("few_id")) & (F.col("digest") == F.col("few_digest"))
    left = rows.filter(~drawn).join(F.broadcast(few) if small else few, among, "left_semi")
    return union_all([rows.filter(drawn), left]).groupBy("id", "digest").agg(F.first("text").alias("text"))


def _filled(cut: DataFrame, n_cut: int, to_fill: int, gaps: DataFrame, n_sequences: int, length: int) -> tuple[DataFrame, int]:
    """``id, digest, pieces`` of the rests of ``cut`` laid into the gaps and, beyond them, into new sequences; the number of sequences after that."""
    spark = cut.sparkSession
    one = F.lit(0).alias("all")
    gaps = checkpointed(gaps)
    n_gaps, space = gaps.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    axis = ordered(gaps.select("*", one), [F.col("sequence_id")], n_gaps, "index", part="part")
    axis = running_before(axis, "all", "index", "part", {"at": F.sum("size")}, n_gaps).select("sequence_id", "offset", "size", "at")
    more = max(0, to_fill - space)
    new = spark.range(more // length).select(
        (F.col("id") + n_sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(length).cast("bigint").alias("size"), (F.col("id") * length + space).alias("at")
    )
    axis = union_all([axis, new])
    n_sequences, at, last = n_sequences + more // length, space + more // length * length, []
    for bit in range(length.bit_length() - 1, -1, -1):  # the end of the axis, in powers of two
        if more % length >> bit & 1:
            last.append((n_sequences, 0, 1 << bit, at))
            n_sequences, at = n_sequences + 1, at + (1 << bit)
    axis = union_all([axis, spark.createDataFrame(last, "sequence_id bigint, offset bigint, size bigint, at bigint")])
    rests = ordered(cut.select("id", "digest", "index", "rest", (F.col("full") * length).alias("base"), one).withColumnRenamed("index", "row"), [F.col("row")], n_cut, "index", part="part")
    rests = running_before(rests, "all", "index", "part", {"begin": F.sum("rest")}, n_cut).select("id", "digest", "row", "rest", "base", "begin")

    def blocks(a: str, size: str):
        return F.explode(F.sequence(F.expr(f"{a} div {AXIS_BLOCK}"), F.expr(f"({a} + {size} - 1) div {AXIS_BLOCK}"))).alias("block")

    met = axis.select("*", blocks("at", "size")).join(rests.select("*", blocks("begin", "rest")), "block")
    low, high = F.greatest("at", "begin"), F.least(F.col("at") + F.col("size"), F.col("begin") + F.col("rest"))
    met = met.withColumns({"low": low, "high": high}).filter(f"low < high AND low div {AXIS_BLOCK} = block")
    piece = F.struct(
        (F.col("base") + F.col("low") - F.col("begin")).alias("start"), (F.col("high") - F.col("low")).alias("length"), "sequence_id", (F.col("offset") + F.col("low") - F.col("at")).alias("offset")
    )
    return met.groupBy("row", "id", "digest").agg(F.collect_list(piece).alias("pieces")).drop("row"), n_sequences


def sequences(docs: DataFrame, pieces: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, without padding. ``pieces`` is what ``pack`` gave for ``docs``."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).withColumn("digest", text_digest())
    texts = texts.groupBy("id", "digest").agg(F.first("text").alias("text"))
    piece = F.struct("start", "length", "sequence_id", "offset")
    lists = pieces.groupBy("id", "digest").agg(F.collect_list(piece).alias("pieces"))
    both = texts.join(lists.withColumnsRenamed({"id": "of", "digest": "of_digest"}), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path)
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                lists = part.column("pieces")
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                begin, size = bounds[row] + flat.field("start").to_numpy(), flat.field("length").to_numpy()
                runs = [ids[a : a + n].astype(np.int32) for a, n in zip(begin.tolist(), size.tolist())]
                yield pa.RecordBatch.from_pydict({"sequence_id": flat.field("sequence_id"), "offset": flat.field("offset"), "ids": pa.array(runs, pa.list_(pa.int32()))})

    coded = both.select("text", "pieces").mapInArrow(scan, "sequence_id bigint, offset bigint, ids array<int>")
    return coded.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
