"""Joins in which one key may hold a large share of the rows.

Keys that alone hold more than a part's share of the rows are found by a sketch aggregate (approximate top-k over the key's
hash: one map-side pass, at most ``MOST_HEAVY`` rows out). Their rows are dealt over as many parts as their share asks
for, and the other side's rows of these keys are repeated once for each part; all other keys join as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Keys told apart as heavy, at most, and items the sketch tracks for it.
MOST_HEAVY, TRACKED = 1000, 20_000
#: Parts for each shuffle partition: small enough that parts which fall together by hash stay near a task's average.
PARTS_PER_TASK = 16


def heavy_keys(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(hash, parts) of the keys with more than a ``parts``-th of all rows; empty where there are none."""
    return _heavy(_top(rows, keys), parts)


def heavy_and_count(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``heavy_keys`` and the number of rows, from one pass that is made at once."""
    top = cut_lineage(_top(rows, keys))
    return _heavy(top, None), top.first()["n"]


def _top(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(F.xxhash64(*keys).alias("hash")).agg(
        F.expr(f"approx_top_k(hash, {MOST_HEAVY}, {TRACKED})").alias("top"), F.count("*").alias("n"))


def _heavy(found: DataFrame, parts: int | None) -> DataFrame:
    parts = parts or PARTS_PER_TASK * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.ceil(F.col("top.count") * parts / F.col("n")).cast("int")
    return found.select("n", F.explode("top").alias("top")).select(
        F.col("top.item").alias("hash"), F.least(share, F.lit(parts)).alias("parts")).where("parts > 1")


def in_parts(many: DataFrame, keys: list[str], spread: Column, heavy: DataFrame) -> DataFrame:
    """``many`` with a column ``part``: 0, or for heavy keys one of their parts by ``spread``."""
    return many.withColumn("hash", F.xxhash64(*keys)).join(F.broadcast(heavy), "hash", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")).cast("int"), F.lit(0))).drop("hash", "parts")


def for_parts(few: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``few`` with a column ``part``: rows of heavy keys once for each of their parts."""
    return few.withColumn("hash", F.xxhash64(*keys)).join(F.broadcast(heavy), "hash", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hash", "parts")


def split_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, heavy: DataFrame | None = None,
               how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``, heavy keys of ``many`` in parts by ``spread``.

    Each row of ``many`` meets each row of ``few`` with its key exactly once, so inner, left and left_semi joins give what a
    plain join gives. ``heavy`` (at most MOST_HEAVY rows) may come from an earlier look at the same rows; ``tasks`` is the
    number of shuffle partitions."""
    heavy = heavy_keys(many, keys) if heavy is None else heavy
    dealt = in_parts(many, keys, spread, heavy)
    if tasks is not None:
        dealt = dealt.repartition(tasks, *keys, "part")
    return dealt.join(for_parts(few, keys, heavy), [*keys, "part"], how).drop("part")
