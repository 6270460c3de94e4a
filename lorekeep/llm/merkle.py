"""A Merkle manifest of a dataset: one digest for all rows, and a proof per row.

Every row is a leaf, the SHA-256 of its columns with their byte lengths. Leaves stand in the order of
their ids within a group (a language); runs of eight nodes become their digest until one is left, the
group's subroot; the subroots, in the order of the groups, become the root in the same way.

Every level is a self-join: a node asks for the indices of its siblings, its own slot shifted by 0 to
7 within the run, and the asked indices meet the nodes by equality. Rows at slot zero then emit the
parents. Paths go down again, from a parent to at most eight children, so no key is hot, however
large one group is. Levels are stored, so a lost executor repeats one level.

Defined results: NULL in a column is a leaf's field ``-``; rows of equal id stand in the order of
their leaves, wholly equal rows in any order (they are alike); rows without an id come first; an empty
table has no rows and no root; columns beyond the named ones do not enter a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.ranks import ordered, with_owner
from lorekeep.llm.tables import checkpointed, require
from lorekeep.session import union_all

FAN_OUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon, value; ``-`` for NULL."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def hexed(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def joined(run: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The digests of a run, one after the other."""
    part = F.filter(run, keep) if keep else run
    return F.aggregate(part, F.expr("X''"), lambda so_far, node: F.concat(so_far, node["digest"]))


def node_digest(content: Column) -> Column:
    return F.unhex(F.sha2(hexed(content).cast("binary"), 256))


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``tree, idx, n, carry, before, after, parent``: each node of the stored ``nodes`` (``tree, idx, n,
    digest, carry``) with its siblings' digests left and right of it, and the digest of its run."""
    slot = F.col("idx") % FAN_OUT
    asks = nodes.select("tree", "idx", "n", "carry", F.explode(F.sequence(F.lit(0), F.lit(FAN_OUT - 1))).alias("shift"))
    asks = asks.select(
        "tree", "idx", "n", F.when(F.col("shift") == 0, F.col("carry")).alias("carry"), (F.col("idx") - slot + (slot + F.col("shift")) % FAN_OUT).alias("sibling")
    ).filter("sibling < n")
    met = asks.join(nodes.select("tree", F.col("idx").alias("sibling"), "digest"), ["tree", "sibling"])
    runs = met.groupBy("tree", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("run"), F.first("carry", ignorenulls=True).alias("carry"))
    return runs.select(
        "tree", "idx", "n", "carry",
        joined(F.col("run"), lambda node: node["sibling"] < F.col("idx")).alias("before"),
        joined(F.col("run"), lambda node: node["sibling"] > F.col("idx")).alias("after"),
        F.when(F.col("idx") % FAN_OUT == 0, node_digest(joined(F.col("run")))).alias("parent"),
    )


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, with siblings, and ``tree, height, digest`` of their roots."""
    levels: list[DataFrame] = []
    roots: list[DataFrame] = []
    while True:
        roots.append(nodes.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        several = nodes.filter("n > 1")
        if several.isEmpty():
            return levels, checkpointed(union_all(roots))
        levels.append(checkpointed(with_siblings(several)))
        parents = levels[-1].filter(F.col("idx") % FAN_OUT == 0)
        up = parents.select("tree", F.expr(f"idx div {FAN_OUT}").alias("idx"), F.ceil(F.col("n") / FAN_OUT).cast("bigint").alias("n"), F.col("parent").alias("digest"), F.lit(None).cast("string").alias("carry"))
        nodes = checkpointed(up)


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, carry, path`` of every node of the lowest level: sibling digests from its own level
    up. ``above`` has ``tree, height, path``: what stands above a tree's root."""
    paths = None
    for height in range(len(levels) - 1, -1, -1):
        tops = above.filter(F.col("height") == height + 1).select("tree", F.lit(0).cast("bigint").alias("up"), "path")
        parents = tops if paths is None else union_all([tops, paths.select("tree", F.col("idx").alias("up"), "path")])
        level = levels[height].withColumn("up", F.expr(f"idx div {FAN_OUT}"))
        met = level.join(parents, ["tree", "up"])
        step = F.array(F.struct("before", "after"))
        paths = met.select("tree", "idx", "carry", F.concat(step, F.col("path")).alias("path"))
        paths = checkpointed(paths) if height else paths
    return paths


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf (hexadecimal) and its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(hexed(step["before"]), digest, hexed(step["after"])).cast("binary"), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of a path's digests as hexadecimal text, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda text, step: F.concat(text, hexed(step["before"]), hexed(step["after"]))).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves`` has ``leaf``, ``subroot``, ``path`` (steps of ``before`` and ``after``, the binary digests left and
    right, from the leaf's level up) and the kept columns, one row per row of the dataset."""

    leaves: DataFrame
    root: str | None


def manifest(docs: DataFrame, id_column: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``keep`` names further columns of its leaves, computed from ``docs``."""
    require(docs, id_column, group, *columns)
    kept = {f"k{i}": value for i, value in enumerate((keep or {}).values())}
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(group).cast("string").alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), *[v.alias(n) for n, v in kept.items()]
    )
    rows = checkpointed(rows)
    n_rows = rows.count()
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"))
    groups = checkpointed(ordered(groups, [F.col("grp").asc_nulls_first()], 0, "tree"))
    # a NULL group meets its tree through a key that no other has
    key = F.coalesce(F.concat(F.lit("="), "grp"), F.lit("-"))
    named = with_owner(rows.withColumn("key", key).drop("grp"), groups.select(key.alias("key"), "tree", "n"), "key").drop("key")
    placed = ordered(named, [F.col("tree"), F.col("id").asc_nulls_first(), F.col("leaf")], n_rows, "place")
    starts = checkpointed(placed.groupBy("tree").agg(F.min("place").alias("start")))
    carry = F.struct("id", "leaf", *kept).alias("carry")
    placed = with_owner(placed, starts, "tree").select("tree", (F.col("place") - F.col("start")).alias("idx"), "n", F.unhex("leaf").alias("digest"), carry)
    leaves = checkpointed(placed)
    levels, subroots = grow(leaves)
    n_trees = subroots.count()
    tops = subroots.select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("bigint").alias("n"), "digest", F.struct("tree", "height", "digest").alias("carry")
    )
    upper, roots = grow(checkpointed(tops))
    none = F.expr("cast(array() as array<struct<before: binary, after: binary>>)")
    if upper:
        over = descend(upper, roots.select("tree", "height", none.alias("path")))
    else:
        over = tops.select("tree", "carry", none.alias("path"))
    over = checkpointed(over.select("carry.tree", "carry.height", F.col("carry.digest").alias("subroot"), "path"))
    single = with_owner(leaves.filter("n = 1"), over.filter("height = 0").select("tree", "path"), "tree").select("tree", "carry", "path")
    deep = descend(levels, over).select("tree", "carry", "path") if levels else single.limit(0)
    found = with_owner(union_all([single, deep]), over.select("tree", "subroot"), "tree")
    names = dict(zip(kept, keep or {}))
    found = found.select(F.col("carry.id").alias(id_column), F.col("carry.leaf").alias("leaf"), hexed(F.col("subroot")).alias("subroot"), "path", *[F.col(f"carry.{k}").alias(n) for k, n in names.items()])
    root = roots.select(hexed(F.col("digest"))).first()
    return Manifest(found, root[0] if root else None)
