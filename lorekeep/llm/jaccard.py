"""Exact Jaccard join of word n-gram sets, by set relations, and the components of its links.

Sets are hashed to 64-bit tokens in one global order: first tokens that one text holds alone, then
others, at last those that more than ``FREQUENT`` texts hold, each by hash. Two sets that link share a token of their
prefixes, so only prefixes are indexed, without the tokens of one text. A set whose own tokens fill
its prefix cannot link and is not indexed at all.

* Lists are cut into blocks by set size; from its position in a set a token tells the largest size
  that can still link, so a set probes only the blocks that its position allows and skips the rest.
* Answers are derived from a similar set's: within a block every set is first compared with one
  leader, the one with the fewest tokens of its own. Sets that link to it share its answers up to reachability, so afterwards a list is only
  read again where it holds sets of different groups, and only pairs across groups are compared. A group
  of m near copies costs about m comparisons.

Every reported link is verified on the whole sets. Equal sets are found by their hash, and one row
stands for them. Hash values are 64 bits wide: unequal tokens are taken as equal with
a chance of about 5e-20 per pair compared.

Defined results: a text without words, or NULL, has an empty set, links with nothing and is its own
component. A NULL id takes no part; its component is NULL. Rows of one id are one node. Extra
columns are not read. Memory of a task follows its longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import checkpointed, connected, flag_bits, require, within
from lorekeep.llm.textkit import LOWER, RangeHash, mix, signed, text_slices, tidy, window_hashes, word_bounds

WIDTH = 5
PERCENT = 80
FREQUENT = 32
MAX_FREQUENT = 2_000_000
LOW_BITS = 32
DOCS_PER_PART = 8_192
LEADER_TOKENS = 16


def token_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and their offsets."""
    n = len(offsets) - 1
    lower = LOWER[data]
    starts, ends, rows = word_bounds(lower, offsets)
    words = RangeHash(lower).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    hashes, rows = window_hashes(words, rows, n, width)
    hashes = hashes[np.argsort(rows, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    first = np.ones(len(hashes), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    first[1:] = hashes[1:] != hashes[:-1]
    first[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    sizes = np.concatenate([[0], np.cumsum(first)])
    return hashes[first], sizes[bounds]


def short(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Tokens by 32 high and a few low bits; others may share a count, which costs time only."""
    return mix((tokens >> np.uint64(LOW_BITS) << np.uint64(LOW_BITS)) | (tokens & np.uint64(parts - 1)))


def shared_tokens(docs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """``token, n``: shortened tokens that more than one text holds, and the number of parts.

    Tokens travel as packed arrays, four bytes each, one per part and slice.
    """
    parts = 1 << min(20, max(2, math.ceil(math.log2(max(1, docs.count() / DOCS_PER_PART)))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch, "text"):
                tokens, _ = token_sets(data, offsets, width)
                part = (tokens & np.uint64(parts - 1)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                values = (tokens[order] >> np.uint64(LOW_BITS)).astype(np.uint32)
                names, at = np.unique(part[order], return_index=True)
                packed = [x.tobytes() for x in np.split(values, at[1:])] if len(names) else []
                yield pa.RecordBatch.from_pydict({"part": names, "tokens": pa.array(packed, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(packed, np.uint32))
        for part, arrays in held.items():
            values, n = np.unique(np.concatenate(arrays), return_counts=True)
            more = n > 1
            tokens = mix((values[more].astype(np.uint64) << np.uint64(LOW_BITS)) | np.uint64(part))
            yield pa.RecordBatch.from_pydict({"token": signed(tokens), "n": n[more]})

    packed = docs.select("text").mapInArrow(tidy(pack), "part int, tokens binary")
    counted = packed.repartition(parts, "part").mapInArrow(tidy(count), "token bigint, n bigint")
    return checkpointed(counted), parts


def frequent_tokens(shared: DataFrame) -> np.ndarray:
    """Tokens that most texts hold, ascending: at most ``MAX_FREQUENT``, the bar rises by doubling.

    They only order the sets; any bar gives the same links.
    """
    powers = shared.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()
    sizes = {r["p"]: r["count"] for r in powers}
    bar = int(math.log2(FREQUENT))
    while sum(c for p, c in sizes.items() if p >= bar) > MAX_FREQUENT:
        bar += 1
    found = shared.filter(F.col("n") >= (1 << bar)).select("token").toArrow()
    return np.sort(np.asarray(found.column("token").combine_chunks()).astype(np.int64))


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, n, own, key, tokens, positions``: size of each set, tokens of its own, its hash, and the
    prefix tokens that other texts hold."""
    shared, parts = shared_tokens(docs, width)
    n_bits = 1 << min(28, max(18, math.ceil(math.log2(8 * max(1, shared.count())))))
    flags = np.frombuffer(flag_bits(shared, "token", n_bits), np.uint8)
    told = docs.sparkSession.sparkContext.broadcast((frequent_tokens(shared), flags))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, flags = told.value
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                tokens, bounds = token_sets(data, offsets, width)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                brief = signed(short(tokens, parts))
                slot = brief & (len(flags) * 8 - 1)
                rank = ((flags[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(np.int8)
                if len(frequent):
                    more = np.flatnonzero(rank)
                    at = np.minimum(np.searchsorted(frequent, brief[more]), len(frequent) - 1)
                    rank[more] += frequent[at] == brief[more]
                position = np.zeros(len(tokens), np.int64)
                ahead = np.zeros(len(n), np.int64)
                for kind in (0, 1, 2):
                    of_kind = np.concatenate([[0], np.cumsum(rank == kind)])
                    here = rank == kind
                    position[here] = (ahead[row] + of_kind[:-1] - of_kind[bounds[:-1]][row])[here]
                    ahead += of_kind[bounds[1:]] - of_kind[bounds[:-1]]
                    own = ahead.copy() if kind == 0 else own
                length = n - -(-percent * n // 100) + 1
                take = np.flatnonzero((position < length[row]) & (rank > 0))
                ends = np.searchsorted(row[take], np.arange(len(n) + 1)).astype(np.int32)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens), dtype=np.uint64)])
                key = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"),
                        "n": n,
                        "own": own,
                        "key": signed(key),
                        "tokens": pa.ListArray.from_arrays(ends, signed(tokens[take])),
                        "positions": pa.ListArray.from_arrays(ends, position[take].astype(np.int32)),
                    }
                )

    kind = docs.schema["id"].dataType.simpleString()
    return checkpointed(docs.mapInArrow(tidy(index), f"id {kind}, n bigint, own bigint, key bigint, tokens array<bigint>, positions array<int>"))


def size_class(n: Column, percent: int, shift: float = 0.0) -> Column:
    return F.floor(F.log(n.cast("double")) / -math.log(percent / 100) + F.lit(shift)).cast("int")


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link. ``a`` may repeat little, ``b`` may be hot."""
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                tokens, bounds = token_sets(data, offsets, width)
                columns = [part.column(c) for c in part.schema.names if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds.astype(np.int32), signed(tokens))], names=[*names, "tokens"])

    left = within(docs, pairs.withColumnRenamed("a", "id"), "id", "inner").mapInArrow(tidy(sets), f"id {kind}, b {kind}, tokens array<bigint>")
    right = within(docs, pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").mapInArrow(tidy(sets), f"id {kind}, tokens array<bigint>")
    both = left.select(F.col("id").alias("a"), "b", F.col("tokens").alias("x")).join(right.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each set with the leader it shares most lists with. Blocks are formed twice, the second time
    with borders half a class on, so that sets of nearly one size meet in one of them."""
    chosen = []
    for shift in (0.0, 0.5):
        blocks = entries.select("token", "rep", "own", size_class(F.col("n"), percent, shift).alias("block"))
        leaders = blocks.groupBy("token", "block").agg(F.min_by("rep", "own").alias("leader"), F.count("*").alias("c")).filter("c > 1")
        led = blocks.join(leaders.drop("c"), ["token", "block"]).filter("rep <> leader")
        counted = led.groupBy("rep", "leader").agg(F.count("*").alias("c"))
        most = counted.groupBy("rep").agg(F.max_by("leader", "c").alias("leader"))
        chosen.append(most.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    return chosen[0].union(chosen[1]).distinct()


def cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different groups with a shared prefix token that lets them link.

    ``entries`` has ``token, rep, n, position, group``. The larger set (ties: the smaller id)
    probes the blocks of the smaller one; what is left of it from the token's position on bounds
    the overlap, hence the size of the other, and the blocks beyond are skipped.
    """
    mixed = entries.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).filter("g <> h").select("token")
    lists = checkpointed(entries.join(mixed, "token", "left_semi").withColumn("block", size_class(F.col("n"), percent)))
    n, rest = F.col("n"), F.col("n") - F.col("position")
    # percent / (100 + percent) * (n + m) <= overlap <= rest bounds the other size m
    most = F.least(n.cast("double"), (100 + percent) / percent * rest - n + 1e-6)
    least = percent / 100 * n - 1e-6
    first, last = (size_class(F.greatest(x, F.lit(1.0)), percent) for x in (least, most + 2e-6))
    probe = lists.filter(most >= least).select(
        "token", F.col("rep").alias("a"), F.col("n").alias("na"), rest.alias("ra"), F.col("group").alias("ga"),
        F.explode(F.sequence(first, last)).alias("block"),
    )
    index = lists.select("token", "block", F.col("rep").alias("b"), F.col("n").alias("nb"), rest.alias("rb"), F.col("group").alias("gb"))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-6)
    ordered = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = probe.join(index, ["token", "block"]).filter(
        (F.col("ga") != F.col("gb")) & ordered & (100 * F.col("nb") >= percent * F.col("na")) & (F.least("ra", "rb") >= need)
    )
    return met.select("a", "b").distinct()


def promising(index: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share enough tokens: the overlap is at most what they share plus what
    lies behind the prefix of the larger set."""
    left = within(index.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), pairs, "a", "inner")
    right = within(index.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), pairs.select("b").distinct(), "b", "left_semi")
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-6)
    behind = F.ceil(percent * F.greatest("na", "nb") / 100) - 1
    return left.join(right, "b").filter(F.size(F.array_intersect("ta", "tb")) + behind >= need).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id`` per row of ``docs``; the id column keeps its name.

    Texts link when 100 x intersection >= percent x union; a component's id is its smallest id.
    """
    require(docs, id_column, text)
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width positive")
    docs = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    sets = prefixes(docs, width, percent)
    reps = checkpointed(sets.filter("n > 0 AND id IS NOT NULL").groupBy("key", "n").agg(F.min("id").alias("rep")))
    chosen = reps.select(F.col("rep").alias("id"), "key", "n")
    index = checkpointed(within(sets.filter("size(tokens) > 0"), chosen, ["id", "key", "n"], "left_semi"))

    def entries(rows: DataFrame, *more: str) -> DataFrame:
        pair = F.explode(F.arrays_zip("tokens", "positions")).alias("e")
        return rows.select(F.col("id").alias("rep"), "n", *more, pair).select("rep", "n", *more, F.col("e.tokens").alias("token"), F.col("e.positions").alias("position"))

    # leaders only save work: a set's first tokens by hash, the same ones in similar sets, name them
    few = index.withColumns({c: F.slice(c, 1, LEADER_TOKENS) for c in ("tokens", "positions")})
    stars = checkpointed(star_pairs(entries(few, "own"), percent))
    stars = checkpointed(promising(index, stars, percent))
    links = checkpointed(verified(docs, stars, width, percent))
    roots = checkpointed(connected(links))
    grouped = within(index, roots.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root")
    pairs = checkpointed(cross_pairs(entries(grouped, "group"), percent))
    pairs = checkpointed(promising(index, pairs, percent))
    if not pairs.isEmpty():
        more = verified(docs, pairs, width, percent)
        roots = checkpointed(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    rows = within(sets.select("id", "key", "n"), reps, ["key", "n"], "left")
    found = within(rows, roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest id of each component only. Rows without an id or without words stay."""
    found = jaccard_components(docs, id_column, text, width, percent)
    gone = checkpointed(found.filter(F.col("component_id") != F.col(id_column)).select(id_column).distinct())
    return within(docs, gone, id_column, "left_anti").select(*docs.columns)
