"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

A document's ids end with the end id; only longer ones are cut into full sequences, the first piece holding the
remainder. A full piece is a sequence of its own. Of the others only their lengths matter, at most
``capacity - 1`` different ones, so best-fit decreasing runs over the number of pieces of each length: a segment
tree over remaining capacities finds the tightest open sequence in logarithmic time, and one step places a run of
equal pieces into a run of equal sequences, exactly as one by one. The plan's size depends on the capacity, not on
the data. Each piece finds its place by its rank among the pieces of its length; ranks are counted in parts, so a
length that a third of all documents share isn't ranked by one task.

A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batches, rows_of, stored

END_ID = 2
CAPACITY = 1024
PARTS = 32
#: Texts encoded before their pieces are handed on.
CHUNK = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of 32-bit ids) and ids (little-endian, 16-bit where they fit)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(tokenizer)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                out: list[list] = [[] for _ in range(6)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = enc.encode(text or "") + end
                    for i, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                        ids = raw[4 * start:4 * (start + n)]
                        crc = zlib.crc32(ids)
                        if narrow:
                            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                        for column, v in zip(out, (doc_id, i, start, n, crc, ids), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return by_batches(docs.select("doc_id", "text"), encode, PIECES)


class OpenSequences:
    """Segment tree over remaining capacities: which of them an open run of sequences has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]  # (first id, number)

    def _set(self, left: int) -> None:
        at = self.size + left
        self.tree[at] = int(bool(self.runs[left]))
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def put(self, left: int, first: int, number: int) -> None:
        if number and left:
            self.runs[left].append((first, number))
            self._set(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop(0)
        self._set(left)
        return run

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least ``need`` that is open."""
        at = self.size + need
        if self.tree[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[dict]:
    """Runs of the plan: pieces ``from..to`` (ranks) of a ``length`` go, ``each`` to a sequence, into sequences from
    ``sequence`` on, the first of a sequence at ``at``."""
    opened, plan, n = OpenSequences(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = opened.tightest(length)
            if left is None:
                left, first, number = capacity, n, -(-todo // (capacity // length))
                n += number
            else:
                first, number = opened.take(left)
            each = left // length  # a sequence is the tightest until nothing fits
            full = min(number, todo // each)
            rest = min(todo - full * each, each - 1) if full < number else 0
            placed = full * each + rest
            plan.append({"length": length, "from": rank, "to": rank + placed, "each": each, "sequence": first,
                         "at": capacity - left})
            opened.put(left - each * length, first, full)
            if rest:
                opened.put(left - rest * length, first + full, 1)
            opened.put(left, first + full + bool(rest), number - full - bool(rest))
            rank, todo = rank + placed, todo - placed
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (they are read twice)."""
    spark = pieces.sparkSession
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int"))
    # at most capacity * PARTS numbers
    sizes = {(r["length"], r["part"]): r["count"] for r in rest.groupBy("length", "part").count().collect()}
    counts, bases = {}, []
    for length, part in sorted(sizes):
        bases.append({"length": length, "part": part, "base": counts.get(length, 0)})
        counts[length] = counts.get(length, 0) + sizes[length, part]
    plan = best_fit_decreasing(counts, capacity)

    in_part = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    ranked = (
        rest.withColumn("rank", F.row_number().over(in_part) - 1)
        .join(F.broadcast(rows_of(spark, "length BIGINT, part INT, base BIGINT", bases)), ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    steps = rows_of(
        spark, "length BIGINT, `from` BIGINT, `to` BIGINT, each BIGINT, sequence BIGINT, `at` BIGINT", plan)
    fits = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    nth = F.col("rank") - F.col("from")
    placed = ranked.join(F.broadcast(steps), "length").filter(fits).select(
        *pieces.columns,
        ((F.col("sequence") + F.floor(nth / F.col("each"))) * 2).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))
    return whole.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and places; the pieces are written once to the shared folder."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
