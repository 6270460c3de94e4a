"""Places in a global order and joins with owners, without one task for a hot key.

A window over a hot key is one task. Here rows are dealt by ranges of the whole order, stored once,
and numbered within their part; what a part adds is one number per part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.tables import BROADCAST_BYTES, checkpointed, private

ROWS_PER_PART = 1_000_000
HEAVY_SHARE = 1_000  # a key with more than 1 / HEAVY_SHARE of the rows is heavy: fewer than that many keys are
_ROW_BITS = 33  # monotonically_increasing_id: part number above, row within the part below


def parts_for(df: DataFrame, n_rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / ROWS_PER_PART))


def ordered(df: DataFrame, order: Sequence[Column], n_rows: int, index: str = "index", part: str | None = None) -> DataFrame:
    """Stored ``df`` with each row's place, from 0, in ``order``; equal rows get places in any order.

    ``order`` must be narrow: a sample of it defines the ranges. ``part`` also keeps the number of
    the row's range, for ``running_before``.
    """
    raw = private("row")
    dealt = df.repartitionByRange(parts_for(df, n_rows), *order).sortWithinPartitions(*order)
    stored = checkpointed(dealt.withColumn(raw, F.monotonically_increasing_id()))
    of = F.shiftright(F.col(raw), _ROW_BITS).cast("int")
    counts = sorted((r["p"], r["n"]) for r in stored.groupBy(of.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = list(zip([p for p, _ in counts], accumulate([n for _, n in counts], initial=0)))  # one row per part
    first = private("first")
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{raw}_p int, {first} bigint")
    placed = stored.join(F.broadcast(offsets), of == F.col(f"{raw}_p"))
    out = placed.withColumn(index, F.col(first) + F.col(raw).bitwiseAND((1 << _ROW_BITS) - 1))
    if part:
        out = out.withColumn(part, of)
    return out.drop(raw, f"{raw}_p", first)


def running_before(rows: DataFrame, group: str, index: str, part: str, totals: dict[str, Column], n_rows: int) -> DataFrame:
    """``rows`` of ``ordered`` (by ``group`` first) with aggregates over the earlier rows of their group; NULL where there is none.

    Within a part it is a window over one group's rows there; a group that spans parts gets the totals of its
    earlier parts, of which there are at most two per part, so they are broadcast.
    """
    inside = Window.partitionBy(part, group).orderBy(index)
    before = rows.select("*", *[v.over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_in") for n, v in totals.items()])
    sums = rows.groupBy(F.col(group).alias("_g"), F.col(part).alias("_p")).agg(*[v.alias(n) for n, v in totals.items()])
    spread = Window.partitionBy("_g")
    spans = sums.withColumn("_n", F.count("*").over(spread)).filter("_n > 1")
    earlier = spread.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    combine = {n: (F.bit_xor if "xor" in n else F.sum)(n) for n in totals}
    carried = checkpointed(spans.select("_g", "_p", *[v.over(earlier).alias(f"{n}_carry") for n, v in combine.items()]))
    joined = before.join(F.broadcast(carried), (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")), "left")
    out = joined.drop("_g", "_p")
    for n in totals:
        both = [F.col(f"{n}_in"), F.col(f"{n}_carry")]
        added = F.coalesce(both[0], F.lit(0)).bitwiseXOR(F.coalesce(both[1], F.lit(0))) if "xor" in n else F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0))
        out = out.withColumn(n, added).drop(f"{n}_in", f"{n}_carry")
    return out


def with_owner(rows: DataFrame, owners: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with the stored ``owners``, which hold a key once.

    Few owners are broadcast. Beyond that, keys with more than a thousandth of the rows, of which there are
    fewer than a thousand, meet their owners by broadcast, all others by a shuffle.
    """
    if owners.count() * (24 + 16 * len(owners.columns)) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(owners), key, how)
    counts = checkpointed(rows.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = checkpointed(counts.filter(F.col("n") * HEAVY_SHARE > total).select(key))
    if heavy.isEmpty():
        return rows.join(owners, key, how)
    hot = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(owners.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return hot.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(owners, key, how))
