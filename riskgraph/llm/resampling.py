"""Importance resampling towards a target text: hashed n-gram counts, log-ratio gains, a seeded draw without replacement.

Texts are lower-cased in A-Z only; a word is a run of ASCII letters and digits and of bytes above 0x7F. Features are all
runs of one to ``max_n`` consecutive words of a document, joined by one space, repeats counted; a feature's bucket is the
crc32 of its bytes modulo ``buckets``. A block of texts is joined with a sentinel byte between them, one pass of the
pattern finds all its words, and the documents' offsets, searched for the words' places, tell which runs would cross from
one document into the next; the rest is counted by bincount. A block is bounded in bytes; a longer text is a block alone.

Two passes read the texts: counts of both tables (one vector per task, summed by bucket), then each document's sum of
gains. Only the ``buckets`` gains pass through the driver. Documents with at least ``least_words`` words are drawn by
weight plus Gumbel noise from the id, which equals drawing without replacement by exp(weight / 1000). Ranks are counted
inside score ranges cut at quantiles, so no task orders all rows, and equal rows are ranked as one with a count.

A null or empty text has no features and weight 0. Ties go to the smaller id, rows without id last; such a row's noise
comes from an empty id. Repeated rows are documents of their own and have ranks one after another. An empty table gives
an empty result; an empty target counts 0 everywhere. Other columns of both tables are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_of, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"
BUCKETS, MAX_N = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of texts joined at once.
BLOCK_BYTES = 1 << 20
#: Words whose crc32 one worker remembers.
REMEMBERED = 500_000
#: Score ranges that ranks are counted in: about so many rows each, within these numbers of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 50_000, 64, 4096
#: Repeated rows given their ranks at once.
RUN = 4096


class _Crcs(dict):
    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        if len(self) < REMEMBERED:
            self[word] = crc
        return crc


_crcs = _Crcs()


def features(texts: list[bytes], max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of each feature, its text's number, words of each text) of texts joined into one."""
    data = SENTINEL.join(texts).lower()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    found = list(WORD.finditer(data))
    words = [m.group() for m in found]
    of = np.searchsorted(begins, np.fromiter((m.start() for m in found), np.int64, len(found)), "right") - 1
    crcs = [np.fromiter(map(_crcs.__getitem__, words), np.uint32, len(words))]
    owners = [of]
    ends, run = np.arange(len(words)), crcs[0]  # last word of each run, and the run's crc32
    for _ in range(1, max_n):
        inside = (ends + 1 < len(words)) & (of[np.minimum(ends + 1, len(words) - 1)] == of[ends])
        ends = ends[inside] + 1
        run = np.fromiter(
            (zlib.crc32(b" " + words[e], c) for e, c in zip(ends.tolist(), run[inside].tolist(), strict=True)), np.uint32, len(ends))
        crcs.append(run)
        owners.append(of[ends])
    return np.concatenate(crcs), np.concatenate(owners), np.bincount(of, minlength=len(texts))


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) of neighbouring texts, so many bytes together or one."""
    texts: list[bytes] = []
    first = size = 0
    for i, value in enumerate(column):
        text = (value.as_py() or "").encode("utf-8", "surrogatepass")
        if texts and size + len(text) > most:
            yield first, texts
            texts, first, size = [], i, 0
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield first, texts


def counts(table: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, n) of the features of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in blocks(batch.column(0), block_bytes):
                total += np.bincount(features(texts, max_n)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return table.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(table: DataFrame, max_n: int, buckets: int, block_bytes: int) -> list[int]:
    out = [0] * buckets
    for r in counts(table, max_n, buckets, block_bytes).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Of each bucket: thousandths of the log ratio of the smoothed shares, rounded down."""
    size, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
        for s, t in zip(source, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1), block_bytes):
                crcs, of, n_words = features(texts, max_n)
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, of, gain[crcs % np.uint32(len(gain))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n_words, pa.int64()),
                     pa.array(np.bincount(of, minlength=len(texts)), pa.int64()), pa.array(total)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the id's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, able: Column, percent: int = PERCENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``rank``: of the rows that are able to, the place of the best ``percent`` hundredths by score, else null."""
    n = scored.filter(able).count()
    drawn = percent * n // 100
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, drawn // range_rows))
    share = drawn / n
    accuracy = max(10_000, math.ceil(20 * ranges / share))
    places = [1 - share * i / ranges for i in range(1, ranges + 1)] + [1 - share - 3 / accuracy]
    cuts = scored.filter(able).agg(F.percentile_approx(
        "score", [max(0.0, p) for p in places], F.lit(accuracy)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts), reverse=True)
    # range i holds the scores from cut i up to the cut before it, the last what is below all cuts
    steps = F.array(*map(F.lit, cuts))
    placed = scored.withColumn("range", F.when(able, F.size(F.filter(steps, lambda c: c > F.col("score")))))
    sizes = {r["range"]: r["count"] for r in placed.filter("range IS NOT NULL").groupBy("range").count().collect()}
    before, offsets = 0, []
    for i in range(len(cuts) + 1):
        if before < drawn and sizes.get(i):
            offsets.append({"range": i, "before": before})
        before += sizes.get(i, 0)
    last = offsets[-1]["range"]

    columns = scored.columns
    groups = placed.filter(F.col("range") <= last).groupBy("range", *columns).agg(F.count("*").alias("copies"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *(c for c in columns if c not in ("score", "doc_id"))]
    in_range = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    small = rows_of(scored.sparkSession, "range int, before long", offsets)  # MOST_RANGES rows at most
    placed_groups = groups.withColumn("earlier", F.coalesce(F.sum("copies").over(in_range), F.lit(0))).join(
        F.broadcast(small), "range").withColumn("first", F.col("before") + F.col("earlier") + 1)
    runs = placed_groups.select(*columns, "first", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN))).alias("at"))
    ranks = runs.select(*columns, F.explode(F.sequence(
        F.col("first") + F.col("at"), F.col("first") + F.least("copies", F.col("at") + RUN) - 1)).alias("rank"))
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = placed.filter(F.col("range").isNull() | (F.col("range") > last)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranks.unionByName(others)


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    gain = gains(_vector(docs, max_n, buckets, block_bytes), _vector(target, max_n, buckets, block_bytes))
    scored = weights(docs, gain, max_n, block_bytes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(stored(scored, "scored"), F.col("n_words") >= least_words, percent)


#: For DuckDB; crc32 by its table of 256 remainders, made from its polynomial.
ORACLE_SQL = r"""
WITH remainders AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS nth, doc_id, text FROM documents UNION ALL
  SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, nth, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
bytes AS (
  SELECT word, list_transform(range(len(h) // 2), lambda k: 16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1)
                              + instr('0123456789ABCDEF', h[2 * k + 2]) - 1) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words))),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295)) % 10000 AS bucket
  FROM bytes, remainders),
per_bucket AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM words JOIN hashed USING (word) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM per_bucket),
w AS (
  SELECT nth, count(*) AS n_features, sum(g) AS weight
  FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY nth),
scored AS (
  SELECT nth, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         list_reduce(list_transform(string_split(substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8), ''),
                                    lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, x: a * 16 + x) AS h
  FROM texts LEFT JOIN w USING (nth) WHERE kind = 0),
drawn AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM placed"""
