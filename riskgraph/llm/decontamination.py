"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. A running Karp-Rabin hash over windows of ``LEAST`` words gives the
seeds of benchmark items and documents; documents put out only windows whose hash is in a bitmap of the items' windows
(fixed size, whatever the benchmark; exactness comes from the join that follows), and joining equal hashes gives
the places where a document and an item agree. For each pair of document and item the tiling marks the longest match
of unmarked words first, cuts what it overlaps out of the other matches, and goes on until no match of ``LEAST`` words is
left. Tiles may stand in any order, so reordered passages count. A document is contaminated if its tiles cover at
least ``THRESHOLD`` of an item's words.

Items and documents of fewer than ``LEAST`` words match nothing; a null text has no words. Rows with equal id and text
are treated alike; repeated items count once per item id and text. Empty tables give clean documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, in_worker

LEAST = 5
THRESHOLD = 0.75
#: Bits of the bitmap of seeds.
BITMAP_BITS = 22
#: Words whose hash one worker remembers.
REMEMBERED = 1 << 16
NO_ID = -(1 << 63)
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < REMEMBERED:
            self[word] = h
        return h



def word_hashes(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(in_worker("window words", _WordHashes).__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of every window of ``LEAST`` words, by Horner's rule over all windows at once."""
    n = len(h) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(LEAST):
        total = total * _BASE + h[i:n + i]
    return total ^ (total >> np.uint64(29))


def seeds(items: DataFrame) -> DataFrame:
    """item_id, copy (which text of that id), words, place, seed of every window of the items."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(text)
                w = windows(h)
                n = len(w)
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * n, pa.int64()), pa.array([version] * n, pa.int64()), pa.array([len(h)] * n, pa.int32()),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(w.view(np.int64))],
                    ["item_id", "version", "words", "place", "seed"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    return by_batches(
        texts.dropDuplicates(["item_id", "version"]),
        cut, "item_id long, version long, words int, place int, seed long")


def _bitmap(found: DataFrame) -> np.ndarray:
    """Which residues of the seeds occur; its size is fixed."""
    bits = np.zeros(1 << BITMAP_BITS, bool)
    residues = found.select(F.col("seed").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("r")).distinct()
    bits[residues.toArrow()["r"].to_numpy()] = True
    return np.packbits(bits)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"), F.xxhash64(text).alias("th"),
        text.alias("text"))


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """at, th, word, seed: windows of documents that may be seeds."""
    packed = _bitmap(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                which, word, seed = [], [], []
                for i, v in enumerate(rows.column(2)):
                    w = windows(word_hashes(v.as_py()))
                    hit = np.flatnonzero(bits[(w & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)])
                    which.append(np.full(len(hit), i))
                    word.append(hit.astype(np.int32))
                    seed.append(w[hit].view(np.int64))
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(1).take(at), pa.array(np.concatenate(word)), pa.array(np.concatenate(seed))],
                    ["at", "th", "word", "seed"])

    return by_batches(keyed(docs), scan, "at long, th long, word int, seed long")


def tiles(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(document word, item word, length) of the greedy tiles for places where windows agree."""
    runs, queue = [], []
    for d, i in sorted(set(places), key=lambda p: (p[0] - p[1], p[0])):
        if runs and runs[-1][0] + runs[-1][2] == d and runs[-1][1] + runs[-1][2] == i:
            runs[-1][2] += 1
        else:
            runs.append([d, i, 1])
    for d, i, n in runs:
        heapq.heappush(queue, (-(n + LEAST - 1), i, d))
    used_d, used_i, out = set(), set(), []
    while queue:
        n, i, d = heapq.heappop(queue)
        free = [d + k not in used_d and i + k not in used_i for k in range(-n)]
        if all(free):
            out.append((d, i, -n))
            used_d.update(range(d, d - n))
            used_i.update(range(i, i - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= LEAST:
                    heapq.heappush(queue, (start - k, i + start, d + start))
                start = None
    return out


def coverage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """at, th, item_id, covered (share of the item's words) and tiles of every document and item that share a window."""
    found = seeds(items)
    places = hits(docs, found).join(found, "seed").groupBy("at", "th", "item_id", "version", "words").agg(
        F.collect_list(F.struct("word", "place")).alias("places"))  # of one document and one item
    kind = pa.list_(pa.struct([("word", pa.int32()), ("place", pa.int32()), ("length", pa.int32())]))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, spans = [], []
            for words, pairs in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                got = tiles([(p["word"], p["place"]) for p in pairs])
                share.append(sum(t[2] for t in got) / words)
                spans.append([{"word": d, "place": i, "length": n} for d, i, n in got])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(share, pa.float64()), pa.array(spans, kind)],
                ["at", "th", "item_id", "covered", "tiles"])

    return by_batches(
        places.select("at", "th", "item_id", "words", "places"),
        tile, "at long, th long, item_id long, covered double, tiles array<struct<word: int, place: int, length: int>>")


def decisions(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """at, th, item_id (covered most, then smallest id), covered, items (how many reach the threshold)."""
    found = coverage(docs, items).groupBy("at", "th").agg(
        F.min(F.struct((-F.col("covered")).alias("less"), "item_id")).alias("best"),
        F.countDistinct(F.when(F.col("covered") >= threshold, F.coalesce("item_id", F.lit(NO_ID)))).cast("int").alias("items"))
    return found.select("at", "th", F.col("best.item_id").alias("item_id"), (-F.col("best.less")).alias("covered"), "items")


def mark(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, covered, items and contaminated of every row of ``docs``."""
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    out = rows.join(decisions(docs, items, threshold), ["at", "th"], "left")
    count = F.coalesce("items", F.lit(0))
    return out.select(
        "doc_id", "item_id", F.coalesce("covered", F.lit(0.0)).alias("covered"), count.alias("items"),
        (count > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, with their columns."""
    names = docs.columns
    own = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    bad = decisions(docs, items, threshold).filter("items > 0").select("at", "th")
    return own.join(bad, ["at", "th"], "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
