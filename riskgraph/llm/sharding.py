"""Consistent-hash ring with virtual nodes and bounded loads, on DataFrame functions only.

Every shard owns ``vnodes`` points of a ring of 2**32 positions. A key belongs to the arc that ends at the next point
clockwise and wants that point's shard. Loads are bounded: a shard takes rows only up to its quota, in rounds; what
it has no room for continues clockwise to the next shard of the ring. Keys of one arc have the same way around the
ring, so the rounds need only the number of rows in each arc (``shards * vnodes`` numbers, whatever the data). The rows
then look up their arc's plan by their rank in the arc, which also gives the gapless slot in the shard.

With ``slack=0`` the quotas are the row count dealt evenly, so counts are at most one apart; a larger slack leaves
shards less even and moves fewer rows when a shard joins. Quotas depend on all rows, so a new shard also moves
some rows between old ones.

Null ids and repeated ids are keys like others; a null text has no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_of, utf8

RING_BITS = 32
#: The ring is cut into so many equal cells for the lookup of a position's arc: a table of bounded size.
CELL_BITS = 12
#: An arc's rows are ranked in so many parts, so that no part holds many rows.
PARTS = 16


def position(key: Column) -> Column:
    """Place on the ring, the same for equal keys; null has one too."""
    return F.xxhash64(key, F.lit("ring")).bitwiseAND(F.lit((1 << RING_BITS) - 1))


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) clockwise; a shard's points don't depend on the number of shards."""
    points = spark.range(shards).select("id", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    points = points.select(position(F.concat_ws("/", F.lit("shard"), "id", "v")).alias("at"), "id")
    return sorted((r["at"], r["id"]) for r in points.collect())


def _arcs(points: list[tuple[int, int]]) -> list[dict]:
    """Pieces (cell, lo, hi, arc) of the ring; arc i ends at point i, the last one wraps to point 0."""
    width = 1 << (RING_BITS - CELL_BITS)
    edges = sorted({0, 1 << RING_BITS, *(at + 1 for at, _ in points), *range(0, 1 << RING_BITS, width)})
    pieces, arc = [], 0
    for lo, hi in zip(edges, edges[1:], strict=False):
        while arc < len(points) and points[arc][0] < lo:
            arc += 1
        pieces.append({"cell": lo // width, "lo": lo, "hi": hi, "arc": arc % len(points)})
    return pieces


def quotas(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: even shares to the row, or ``1 + slack`` times the mean."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bounded_loads(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int]]:
    """(arc, shard, rows): what each arc puts into each shard. Rounds: every arc offers what it has left to the next
    shard of its way, shards take it in ring order until they are full."""
    room, left, n = list(room), dict(counts), len(points)
    ways = {}
    for arc in left:
        ways[arc] = list(dict.fromkeys(points[(arc + i) % n][1] for i in range(n)))
    placed = []
    for step in range(len(room)):
        for arc in sorted(left):
            shard = ways[arc][step]
            take = min(left[arc], room[shard])
            if take:
                placed.append((arc, shard, take))
                room[shard] -= take
                left[arc] -= take
        left = {a: c for a, c in left.items() if c}
        if not left:
            break
    return placed


def assign(docs: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = 32, slack: float = 0.0) -> DataFrame:
    """Adds ``arc``, ``shard`` and ``slot`` (gapless from 0 in each shard) to the rows of ``docs``.

    Ties (equal keys) are ranked by all other columns, so equal rows are interchangeable.
    """
    spark = docs.sparkSession
    points = ring_points(spark, shards, vnodes)
    arcs = rows_of(spark, "cell INT, lo BIGINT, hi BIGINT, arc INT", _arcs(points))
    names = docs.columns
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    keyed = docs.select(*own, position(F.col(f"`{key}`")).alias("at"))
    keyed = keyed.withColumn("cell", F.shiftright("at", RING_BITS - CELL_BITS).cast("int"))
    # the lookup has at most 2**CELL_BITS + shards * vnodes rows, whatever the data
    in_arc = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    keyed = keyed.join(F.broadcast(arcs), "cell").filter(in_arc).drop("cell", "lo", "hi")
    cells = [f"c{i}" for i in range(len(names))]
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64(*cells), F.lit(PARTS)).cast("int"))

    sizes = {(r["arc"], r["part"]): r["count"] for r in keyed.groupBy("arc", "part").count().collect()}
    counts, bases = {}, []
    for arc, part in sorted(sizes):
        bases.append({"arc": arc, "part": part, "base": counts.get(arc, 0)})
        counts[arc] = counts.get(arc, 0) + sizes[arc, part]
    plan, upto, filled = [], {}, {}
    for arc, shard, rows in bounded_loads(counts, points, quotas(sum(counts.values()), shards, slack)):
        start = upto.get(arc, 0)
        plan.append({"arc": arc, "from": start, "to": start + rows, "shard": shard,
                     "shift": filled.get(shard, 0) - start})
        upto[arc], filled[shard] = start + rows, filled.get(shard, 0) + rows

    in_part = W.partitionBy("arc", "part").orderBy("at", *cells)
    ranked = (
        keyed.withColumn("rank", F.row_number().over(in_part) - 1)
        .join(F.broadcast(rows_of(spark, "arc INT, part INT, base BIGINT", bases)), ["arc", "part"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    steps = rows_of(spark, "arc INT, `from` BIGINT, `to` BIGINT, shard INT, `shift` BIGINT", plan)
    fits = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    out = ranked.join(F.broadcast(steps), "arc").filter(fits)
    return out.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "arc", "shard",
        (F.col("rank") + F.col("shift")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 32, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    raw = utf8(F.col("text"))
    sized = docs.select(
        "doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = assign(sized, "doc_id", shards, vnodes, slack)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
