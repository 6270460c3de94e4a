"""Tables in the shared folder: intermediate results, size checks, lists that stay bounded."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import checkpointed, new_dir

BROADCAST_BYTES = 32 << 20
ROWS_PER_BATCH = 1_000

__all__ = ["checkpointed", "connected", "fits", "flag_bits", "flag_count", "new_dir", "private", "require", "table", "with_partners", "with_small_batches", "within"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_small_batches(job):
    """A registered query or stage whose Arrow batches hold ``ROWS_PER_BATCH`` rows.

    Texts are long: ten thousand of them, Spark's default, are tens of MB on both sides of every
    Python worker. Results are read later, so the setting stays on the session; it changes
    memory only. Operators do not set it.
    """

    @functools.wraps(job)
    def run(spark: SparkSession, *args):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
        return job(spark, *args)

    return run


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}")


def private(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def fits(few: DataFrame) -> bool:
    """Whether the counted rows of a stored table of keys and numbers stay below ``BROADCAST_BYTES``."""
    return few.count() * (16 + 8 * len(few.columns)) <= BROADCAST_BYTES


def within(rows: DataFrame, few: DataFrame, column: str | list[str], how: str) -> DataFrame:
    """Join wide rows with a stored table of keys and numbers: broadcast where it fits, a shuffle join beyond."""
    return rows.join(F.broadcast(few) if fits(few) else few, column, how)


def with_partners(rows: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """``within`` as a left join that shuffles only rows that may have a partner; one bit per partner tells them from the rest."""
    if fits(few):
        return within(rows, few, column, "left")
    slot = F.pmod(F.xxhash64(column), F.lit(flag_count(few.count()))) + 1
    bucket, bits = private("bucket"), private("bits")
    flags = few.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias(bits))
    marked = rows.join(F.broadcast(checkpointed(flags)), F.bitmap_bucket_number(slot) == F.col(bucket), "left")
    place = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    meets = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    alone = marked.filter(~meets).select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name != column))
    return marked.filter(meets).select(*rows.columns).join(few, column, "left").unionByName(alone)


def flag_count(n: int) -> int:
    """Bits for flags of ``n`` keys: 64 for each, but 2^24 at least and 2^28 at most."""
    return 1 << min(28, max(24, math.ceil(math.log2(64 * max(1, n)))))


def flag_bits(keys: DataFrame, column: str, n_bits: int) -> bytes:
    """One bit per value of ``column`` modulo ``n_bits`` (a multiple of 32,768): at most n_bits / 8
    bytes reach the driver, however many keys there are. Others may share a bit."""
    slot = F.pmod(F.col(column), F.lit(n_bits)) + 1  # bit 1 is the first bit of bucket 1
    rows = (
        keys.select(slot.alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .collect()
    )
    flags = bytearray(n_bits // 8)
    for row in rows:
        start = (row["bucket"] - 1) * 4096
        flags[start : start + 4096] = row["bits"]
    return bytes(flags)


def connected(links: DataFrame, columns: Sequence[str] = ("a", "b")) -> DataFrame:
    """``node, root`` of every node of the stored ``links``: root is its component's smallest node.

    Alternating star contraction: every node's larger neighbours are tied to the smallest one
    around it (large star), then the smaller ones are (small star), until only stars are left. Each
    round writes its edges, so lost executors repeat at most one round. Minima are combined
    before the shuffle; the joins read stored tables, so Spark can split a hot node.
    """
    a, b = columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))
        lowest = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(tied.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        counts = edges.groupBy("u").agg(F.count("*").alias("n"))
        deeper = edges.join(counts.select(F.col("u").alias("v")), "v", "left_semi").select("v")
        if counts.filter("n > 1").select("u").unionByName(deeper.select(F.col("v").alias("u"))).isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
