"""The prefix trie of conversations: one node per distinct sequence of first turns.

A turn is an id, its digest and byte length. A conversation is cut into blocks of eight turns, one row
each, with the ids in positional columns and the key of the node where the block begins. One ROLLUP
over these columns gives all prefixes of all blocks at once; ``grouping_id`` tells how deep a group
is. A node's key is the exclusive-or of hashes of its turns with their places (128 bits), so the node
where a block begins is known without going through the blocks before it, however long a
conversation is. What a node sums over its subtree is turned into sums over its members, which the
same ROLLUP gives:

* the conversation of smallest id of a node is its namesake; a conversation is the namesake of a run
  of nodes that ends with its last turn, so bytes of distinct nodes are bytes of namesakes' runs;
* a leaf counts at its namesake.

Positions come from a global order (``ranks``), not from a window over one conversation, so a
conversation or a first turn may hold a third of all rows. Ids of conversations that end in one node
are packed into rows of up to ``IDS_PER_ROW`` in their order, then hashed in a stream: SHA-256 has to
see one node's ids one after the other, but never holds them together.

Defined results: turns are in the order of their number, NULL first, equal numbers in the order of
the turn's id; rows without a conversation id are left out; a NULL role or text is an empty one; a
conversation without turns is a member of the root; an empty table has no nodes. Extra columns are
not looked at. Unequal prefixes count as equal with a chance of about 3e-39 per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.ranks import ordered, running_before, with_owner
from lorekeep.llm.tables import checkpointed, require
from lorekeep.session import union_all

WIDTH = 8
IDS_PER_ROW = 8_192
BRANCH, HEADS = 5, 9  # conversation c continues conversation c - c % BRANCH after fewer than HEADS turns
_DIGEST = 32  # hexadecimal digits in front of the byte length in a turn's id
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(digest, F.octet_length(text).cast("string"))


def turn_bytes(turn: Column) -> Column:
    return F.substring(turn, _DIGEST + 1, 18).cast("bigint")


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, turn_id`` with positions from 1, and the stored ``conv_id, n`` of all conversations."""
    require(turns, "conv_id", "turn", "role", "text")
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("turn_id"))
    placed = ordered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")], turns.count(), "place")
    convs = checkpointed(placed.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n")))
    placed = with_owner(placed, convs.select("conv_id", "start"), "conv_id")
    return placed.select("conv_id", (F.col("place") - F.col("start") + 1).alias("pos"), "turn_id"), convs.select("conv_id", "n")


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that continue another one: ``conv_id, pos, turn_id`` and the stored ``conv_id, n`` (0 turns too).

    Conversation c has the first h turns of conversation c - c % 5, then its own turns after its
    first h, with h = crc32(c as text) % 9.
    """
    placed, convs = placed_turns(turns)
    placed = checkpointed(placed)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    told = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % BRANCH).alias("base"), heads.alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).cast("bigint")
    told = checkpointed(told.join(bases, "base", "left").withColumn("taken", taken))
    first = placed.filter(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "turn_id")
    heads_of = told.select("base", "conv_id", "taken").join(first, "base").filter("pos <= taken").select("conv_id", "pos", "turn_id")
    own = with_owner(placed, checkpointed(told.select("conv_id", "h", "taken")), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id")
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return checkpointed(union_all([heads_of, own])), checkpointed(told.select("conv_id", (F.col("taken") + rest).alias("n")))


def _hashes(turn: Column, depth: Column) -> tuple[Column, Column]:
    return F.xxhash64(turn, depth), F.xxhash64(F.lit(1), depth, turn)


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Stored ``conv_id, n, total, block, x1, x2, bytes, t1 .. t8``: the turns of a block in positional columns and the
    key and bytes of the node where it begins. ``total`` is the conversation's bytes."""
    block = F.expr(f"(pos - 1) div {WIDTH}").alias("block")
    runs = turns.groupBy("conv_id", block).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id"))).alias("run"))
    columns = [F.get("run", F.lit(j))["turn_id"].alias(f"t{j + 1}") for j in range(WIDTH)]
    at = [F.col(f"t{j + 1}") for j in range(WIDTH)]
    filled = runs.select("conv_id", "block", *columns)
    keys = [_hashes(t, F.col("block") * WIDTH + j + 1) for j, t in enumerate(at)]
    own = [F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")]
    for t, (one, two) in zip(at, keys):
        own = [own[0].bitwiseXOR(F.when(t.isNotNull(), one).otherwise(0)), own[1].bitwiseXOR(F.when(t.isNotNull(), two).otherwise(0)), own[2] + F.coalesce(turn_bytes(t), F.lit(0))]
    filled = checkpointed(filled.select("*", own[0].alias("own_x1"), own[1].alias("own_x2"), own[2].alias("own_bytes")))
    totals = checkpointed(filled.groupBy("conv_id").agg(F.sum("own_bytes").alias("total")))
    convs = checkpointed(convs.join(totals, "conv_id", "left").select("conv_id", "n", F.coalesce("total", F.lit(0)).alias("total")))
    whole = with_owner(filled, convs, "conv_id")
    zero = F.lit(0).cast("bigint")
    short = whole.filter(F.col("n") <= WIDTH).select("*", zero.alias("x1"), zero.alias("x2"), zero.alias("bytes"))
    n_long = filled.filter("block > 0").count()
    long = whole.filter(F.col("n") > WIDTH)
    placed = ordered(long, [F.col("conv_id"), F.col("block")], 2 * n_long, "place", part="part")
    sums = {"xor1": F.bit_xor("own_x1"), "xor2": F.bit_xor("own_x2"), "size": F.sum("own_bytes")}
    begun = running_before(placed, "conv_id", "place", "part", sums, n_long).drop("place", "part")
    begun = begun.withColumnsRenamed({"xor1": "x1", "xor2": "x2", "size": "bytes"})
    empty = convs.filter("n = 0").select(
        "conv_id", "n", "total", *[zero.alias(c) for c in ("block", "x1", "x2", "bytes", "own_x1", "own_x2", "own_bytes")], *[F.lit(None).cast("string").alias(f"t{j + 1}") for j in range(WIDTH)]
    )
    return checkpointed(union_all([short, begun, empty]))


def rolled(blocks: DataFrame, measures: dict[str, str]) -> DataFrame:
    """All prefixes of ``blocks``: ``depth, x1, x2`` (the node's key), ``p1, p2`` (its parent's), ``last_bytes``,
    ``before`` (bytes above its last turn) and the measures, SQL aggregates over the members."""
    names = [f"t{j + 1}" for j in range(WIDTH)]
    asked = ", ".join(f"{sql} AS {name}" for name, sql in measures.items())
    groups = blocks.sparkSession.sql(
        f"SELECT block, x1 AS from1, x2 AS from2, bytes, {', '.join(names)}, grouping_id() AS gid, {asked} "
        f"FROM {{blocks}} GROUP BY block, x1, x2, bytes, ROLLUP({', '.join(names)})",
        blocks=blocks,
    )
    level = (F.lit(WIDTH) - F.bit_count("gid")).cast("int")
    turns = F.array(*names)
    groups = groups.withColumn("level", level).withColumn("last", F.get(turns, F.col("level") - 1))
    groups = groups.filter("last IS NOT NULL OR (level = 0 AND block = 0)")
    depth = F.col("block") * WIDTH + F.col("level")
    x1, x2, before = F.col("from1"), F.col("from2"), F.col("bytes")
    for j, t in enumerate(map(F.col, names)):
        above = F.col("level") > j + 1  # turns above the last one
        one, two = _hashes(t, F.col("block") * WIDTH + j + 1)
        x1, x2 = x1.bitwiseXOR(F.when(above, one).otherwise(0)), x2.bitwiseXOR(F.when(above, two).otherwise(0))
        before = before + F.when(above, turn_bytes(t)).otherwise(0)
    one, two = _hashes(F.col("last"), depth)
    top = F.col("last").isNull()
    nodes = groups.select(depth.alias("depth"), x1.alias("p1"), x2.alias("p2"), F.when(top, x1).otherwise(x1.bitwiseXOR(one)).alias("x1"), F.when(top, x2).otherwise(x2.bitwiseXOR(two)).alias("x2"),
        F.coalesce(turn_bytes(F.col("last")), F.lit(0)).alias("last_bytes"), before.alias("before"), *measures)
    return nodes


def ends_digests(ends: DataFrame, n_rows: int) -> DataFrame:
    """``depth, x1, x2, ends_sha256`` from ``depth, x1, x2, conv_id``: SHA-256 of the ascending ids with commas between."""
    node = ["depth", "x1", "x2"]
    placed = ordered(ends, [*map(F.col, node), F.col("conv_id")], n_rows, "place")
    row = F.floor(F.col("place") / IDS_PER_ROW).cast("bigint")
    packed = placed.groupBy(*node, row.alias("row")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = packed.select(*node, "row", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in node]))
            out = []
            for at, ids in zip(keys, batch.column("ids")):
                if at == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*node, "ends_sha256"], r)) for r in out], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*node, "ends_sha256"], (*key, state.hexdigest())))], schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
    dealt = chunks.repartition(*node).sortWithinPartitions(*node, "row")
    return dealt.mapInArrow(hashed, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id, pos, turn_id``) over all ``convs`` (``conv_id, n``).

    Per node: ``conv_id`` (namesake), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that members beyond the first need not repeat, over the subtree), ``ends_sha256``.
    """
    key = ["depth", "x1", "x2"]
    blocks = turn_blocks(turns, convs)
    nodes = checkpointed(rolled(blocks, {"conv_id": "min(conv_id)"}))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.groupBy("conv_id").agg(F.sum("last_bytes").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    totals = blocks.filter("block = 0").select("conv_id", "total")
    own = checkpointed(own.join(totals, "conv_id"))
    zero = F.lit(0).cast("bigint")
    full = with_owner(blocks, own.select("conv_id", "owned", "leaves"), "conv_id", "left")
    full = full.withColumns({"owned": F.coalesce("owned", zero), "leaves": F.coalesce("leaves", zero)})
    sums = rolled(full, {"n_convs": "count(*)", "n_leaves": "sum(leaves)", "totals": "sum(total)", "owned_all": "sum(owned)"}).select(*key, "before", "n_convs", "n_leaves", "totals", "owned_all")
    nodes = checkpointed(nodes.drop("before").join(sums, key))
    nodes = with_owner(nodes, own.select("conv_id", "owned", "total"), "conv_id")
    repeated = F.col("totals") - F.col("n_convs") * F.col("before")
    distinct = F.col("owned_all") - F.col("owned") + F.col("total") - F.col("before")
    nodes = nodes.withColumn("saved_tokens", repeated - distinct)
    last = blocks.filter(F.col("block") == F.expr(f"greatest(n - 1, 0) div {WIDTH}"))
    ends = checkpointed(last.select(F.col("n").alias("depth"), F.col("x1").bitwiseXOR(F.col("own_x1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("own_x2")).alias("x2"), "conv_id"))
    nodes = nodes.join(ends_digests(ends, ends.count()), key, "left")
    nodes = checkpointed(nodes.withColumn("parent", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")))))
    parents = checkpointed(nodes.filter("n_children > 0").select(F.struct(*key).alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    nodes = union_all([with_owner(nodes.filter("depth > 0"), parents, "parent"), nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))])
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")
    )
