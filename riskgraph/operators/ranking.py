"""Order-preserving dedup, top-n and latest-row operators.

All of them reduce rows before the shuffle: ``row_number() <= n`` is pruned per input
partition by Spark's window group limit, and the grouped forms combine map-side.  A key
that holds a large share of the rows therefore reaches its task as a few rows only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import as_of_lit

RN = "__rn"


def _order(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_n(df: DataFrame, keys: list[str], order, n: int) -> DataFrame:
    """First n rows per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn(RN, F.row_number().over(w)).where(F.col(RN) <= n).drop(RN)


def dedup_first(df: DataFrame, keys: list[str], order) -> DataFrame:
    """First row per key."""
    return top_n(df, keys, order, 1)


#: Rows of 64 bits of the bitmap that spares wide rows a sort; its size is fixed, the exact ranking follows it.
BITMAP_SLOTS = 1 << 19


def sifted(df: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """All rows of ``df`` whose ``keys`` are among those of ``chosen``, and few others: nothing is shuffled or sorted.

    The keys' hashes set the bits of a bitmap of at most ``BITMAP_SLOTS`` rows, which is broadcast."""
    slot, bit = F.shiftright("__h", 6).bitwiseAND(F.lit(BITMAP_SLOTS - 1)).alias("__slot"), "CAST(__h & 63L AS INT)"
    hashed = chosen.select(F.xxhash64(*keys).alias("__h"))
    bits = hashed.select(slot, F.expr(f"shiftleft(1L, {bit})").alias("__bit")).groupBy("__slot").agg(
        F.bit_or("__bit").alias("__bits"))
    met = df.withColumn("__h", F.xxhash64(*keys)).withColumn("__slot", slot).join(F.broadcast(bits), "__slot")
    return met.where(F.expr(f"(shiftrightunsigned(__bits, {bit}) & 1L) = 1")).select(*df.columns)


def with_rank(df: DataFrame, keys: list[str], order, name: str = "rank", limit: int | None = None
              ) -> DataFrame:
    """1-based position within the key; with a limit only that many are ranked."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    out = df.withColumn(name, F.row_number().over(w))
    return out if limit is None else out.where(F.col(name) <= limit)


def latest_valid(df: DataFrame, keys: list[str], as_of: datetime, expires: str = "expires_at",
                 created: str = "created_at", tie: str | None = None) -> DataFrame:
    """Newest row per key that has not expired."""
    order = [F.desc(created)] + ([F.desc(tie)] if tie else [])
    return top_n(df.where(F.col(expires) > as_of_lit(as_of)), keys, order, 1)


def latest_per_key(df: DataFrame, keys: list[str], seq: str, payload: list[str]) -> DataFrame:
    """Latest payload per key, kept at the position of the key's first row."""
    return df.groupBy(*keys).agg(
        F.min(seq).alias("first_seq"),
        F.max_by(F.struct(*payload), seq).alias("__p"),
    ).select(*keys, "first_seq", "__p.*")


def page(df: DataFrame, order, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered list: limit 1..100, offset >= 0."""
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return df.orderBy(*_order(order)).offset(offset).limit(limit)


def concat_ranked(frames: list[DataFrame], rank: str = "source_rank") -> DataFrame:
    """Ordered lists after each other: the list number becomes a rank column."""
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn(rank, F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
