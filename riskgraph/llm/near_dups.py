"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Words are lower-cased (A-Z) runs of other bytes than ASCII white space; a document's set holds its distinct five-word
shingles, or its whole shorter sequence. Equal sets form one class, represented by its smallest id, so a group of
copies costs one row from there on. Classes that share a band of minima are candidates; of the minima only the low two
bits are kept, packed into words, and a candidate pair's similarity is estimated from the bits that agree, corrected for
chance agreement. Pairs whose estimate isn't far below the threshold are confirmed on the full sets.

Classes of one band are held against a pivot of the band, not against each other: first the smallest, then random
ones, always leaving out what is already in the pivot's component. Of what still shares a band across components, a
set's shingles that no other such set has can't count for any link, so sets with too many of them are done; the others
of like size are held against each other. Each pair is first estimated from a longer signature made with the sets, and only
pairs that aren't below the threshold there get their sets. A pair at 0.75 is dropped by it with probability below 1e-5. With
``BANDS`` bands of ``ROWS`` minima a pair at similarity 0.75 shares none with probability below 1e-5.

A text of any length is one row and one set. Ties at the threshold are links. A null or empty text has an empty set and is linked with nothing. Rows with one id are one document. Rows without
id take part, but a component of only such rows has no id, and of them only those are kept that have no other
document's id to give way to. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batches, in_worker, stored
from .components import components
from .lines import bitmap, maybe

WORDS = 5
THRESHOLD = 75  # hundredths of the union
BANDS, ROWS = 60, 6
BITS = 2
#: Estimates below this are dropped without confirming: five standard deviations under the threshold.
SCREEN = 0.60
#: Minima of the longer signature of classes whose sets are fetched, and the estimate from it below which a pair is dropped
#: before it gets any set: 4.3 standard deviations under the threshold.
LONG_ROWS, LONG_SCREEN = 2048, 0.70
RANDOM_ROUNDS = 3
#: Words whose hash one worker remembers.
REMEMBERED = 1 << 16
#: Ids of classes without any id start here.
UNNAMED = 1 << 62
SET_ROWS = "id long, found array<long>, long array<long>"

_MULTIPLY = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h



def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit digests of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(in_worker("shingle words", _WordHashes).__getitem__, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total + h[i:n - width + 1 + i]) * _MULTIPLY[i % len(_MULTIPLY)]
    return np.unique(_mix(total))


def _seeds(n: int = BANDS * ROWS, start: int = 2024) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(start)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minima(found: np.ndarray, times: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        out = np.minimum(out, ((x[at:at + 256, None] ^ flip) * times).min(0))
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = _mix(total + rows[:, i]) * _MULTIPLY[i % len(_MULTIPLY)]
    return _mix(total).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 32 of them in a 64-bit word."""
    low = ((m ^ (m >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    low = np.concatenate([low, np.zeros(-len(low) % 32, np.uint64)]).reshape(-1, 32)
    return (low << np.arange(0, 64, 2, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _unnamed(digest: int) -> int:
    return (digest & ((1 << 61) - 1)) + UNNAMED


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), d1 and d2 (digest of the set), bands, packed."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["doc_id", "th", "n", "d1", "d2", "bands", "packed"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, flip = _seeds()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for v in part.column(2):
                    found = shingles(v.as_py())
                    out[0].append(len(found))
                    out[1].append(_digest(found))
                    out[2].append(int(np.bitwise_xor.reduce(_mix(found + _MULTIPLY[1])).view(np.int64)) if len(found) else 0)
                    m = minima(found, times, flip) if len(found) else None
                    out[3].append(band_keys(m) if m is not None else [])
                    out[4].append(packed(m) if m is not None else [])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return by_batches(
        docs.select("doc_id", _text_hash().alias("th"), "text"),
        sign, "doc_id long, th long, n long, d1 long, d2 long, bands array<long>, packed array<long>")


def estimate(a: str, b: str, rows: int = BANDS * ROWS) -> Column:
    """Similarity from packed bits of so many minima: share of equal ones, less what agrees by chance."""
    pairs = 0x5555555555555555
    differing = F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {pairs}L)), 0, (s, v) -> s + v)")
    chance = 1 / (1 << BITS)
    return ((1 - differing / rows) - chance) / (1 - chance)


def _digest(found: np.ndarray) -> int:
    return int(_mix(found).sum(dtype=np.uint64).view(np.int64)) if len(found) else 0


def _of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with one row per wanted key; a bitmap of fixed size keeps most others out of the shuffle."""
    hashed = rows.filter(F.col(key).isNotNull()).withColumn("hash", F.xxhash64(key))
    names = rows.columns
    some = maybe(hashed, "hash", bitmap(wanted.select(F.xxhash64(key).alias("hash")), "hash")).filter("maybe")
    return some.join(wanted, key).select(*names, *(c for c in wanted.columns if c != key))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found, long): full sets of the classes that pairs ask for, and the low bits of ``LONG_ROWS`` other minima."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, flip = _seeds(LONG_ROWS, 7)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(v.as_py()) for v in part.column(1)]
                names = [_unnamed(_digest(f)) if k is None else k for k, f in zip(part.column(0).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
                     pa.array([packed(minima(f, times, flip)) for f in found], pa.list_(pa.int64()))],
                    ["id", "found", "long"])

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    ids = stored(ids, "asked")
    named = by_batches(_of(texts, "id", ids), build, SET_ROWS)
    others = by_batches(texts.filter("id IS NULL"), build, SET_ROWS).join(ids, "id", "left_semi")
    return named.unionByName(others)


class _Groups:
    """Components of the links confirmed so far, and the sets fetched for confirming."""

    def __init__(self, docs: DataFrame, classes: DataFrame) -> None:
        self.docs, self.sides, self.sets = docs, classes.select("id", "n", "packed"), None
        self.labels = docs.sparkSession.createDataFrame([], "id long, component long")

    def screen(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose estimate isn't far below the threshold."""
        sides = self.sides
        near = pairs.join(sides.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a").join(
            sides.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")
        return near.filter(estimate("pa", "pb") >= SCREEN).select("a", "b")

    def fetch(self, asked: DataFrame) -> DataFrame:
        """Full sets of at least these ids."""
        if self.sets is not None:
            asked = asked.join(self.sets, "id", "left_anti")
        more = stored(_sets(self.docs, asked), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def confirm(self, near: DataFrame) -> None:
        """Confirm screened pairs on full sets and join the components that they link."""
        near = stored(near, "screened")
        sets = self.fetch(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        close = near
        for end in ("a", "b"):
            close = close.join(sets.select(F.col("id").alias(end), F.col("long").alias(f"long_{end}")), end)
        close = stored(close.filter(estimate("long_a", "long_b", LONG_ROWS) >= LONG_SCREEN).select("a", "b"), "close")
        checked = close.join(sets.select(F.col("id").alias("a"), F.col("found").alias("fa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("found").alias("fb")), "b")
        both = F.size(F.array_intersect("fa", "fb"))
        union = F.size("fa") + F.size("fb") - both
        links = stored(checked.filter(both * 100 >= union * THRESHOLD).select("a", "b"), "links")
        if links.isEmpty():
            return
        # only components that are linked anew take part
        for end in ("a", "b"):
            links = links.join(self.labels.withColumnsRenamed({"id": end, "component": "of"}), end, "left").withColumn(
                end, F.coalesce("of", end)).drop("of")
        joined = components(links.filter("a <> b").distinct())
        renamed = joined.select(F.col("component").alias("to"), F.col("id").alias("component"))
        moved = self.labels.join(renamed, "component", "left").select(
            "id", F.coalesce("to", "component").alias("component"))
        self.labels = stored(moved.unionByName(joined.join(self.labels, "id", "left_anti")), "components")


#: For DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
c AS (SELECT a AS doc_id, min(least(a, b)) AS component FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id,
       coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    named = signed.filter("n > 0").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    unnamed = F.col("d1").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(UNNAMED)
    classes = stored(named.withColumn("id", F.coalesce("least", unnamed)), "classes")

    keys = classes.select("id", F.explode("bands").alias("key"))
    live = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).filter("pivot <> other")
    live = stored(live.select("key", "pivot"), "live-bands")
    shared = stored(_of(keys, "key", live), "bands")

    found = _Groups(docs, classes)
    found.confirm(found.screen(shared.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()))

    def open_bands() -> DataFrame:
        """Rows of bands that still hold several components."""
        rows = shared.select("key", "id").join(found.labels, "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
        several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        return stored(rows.join(several.select("key"), "key", "left_semi"), "open")

    for turn in range(RANDOM_ROUNDS):
        rows = open_bands()
        die = F.xxhash64("id", F.lit(turn))  # one for all bands, so that bands of one group share pivots
        pivots = rows.groupBy("key").agg(F.min(F.struct(die.alias("die"), "id", "component")).alias("p")).select(
            "key", F.col("p.id").alias("b"), F.col("p.component").alias("other"))
        pairs = rows.join(pivots, "key").filter("component <> other")
        found.confirm(found.screen(pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()))
    # what is left, pair by pair: only where what either set shares with any other is enough for a link
    rows = open_bands()
    ids = stored(rows.select("id").distinct(), "open-ids")
    full = found.fetch(ids).join(ids, "id", "left_semi")
    owned = full.select("id", F.explode("found").alias("shingle"))
    alone = owned.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    sides = found.sides.join(ids, "id", "left_semi").join(alone, "id", "left").withColumn(
        "most", F.col("n") - F.coalesce("alone", F.lit(0))).filter(F.col("most") * 100 >= F.col("n") * THRESHOLD)
    own_bands = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    sides = stored(sides.drop("packed").join(full.select("id", "long"), "id").join(own_bands, "id"), "open-classes")
    rows = rows.join(sides, "id")
    left = rows.select("key", *(F.col(c).alias(f"{c}_a") for c in ("component", "n", "most", "long", "keys")), F.col("id").alias("a"))
    right = rows.select("key", *(F.col(c).alias(f"{c}_b") for c in ("component", "n", "most", "long", "keys")), F.col("id").alias("b"))
    like = (F.least("most_a", "most_b") * (100 + THRESHOLD) >= (F.col("n_a") + F.col("n_b")) * THRESHOLD) & (
        estimate("long_a", "long_b", LONG_ROWS) >= LONG_SCREEN) & (
        F.array_min(F.array_intersect("keys_a", "keys_b")) == left["key"])  # of the bands that two share, one puts them out
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") > F.col("b")) & (F.col("component_a") != F.col("component_b")) & like)
    found.confirm(pairs.select("a", "b").distinct())
    labels = found.labels

    # one small row per class back onto the documents
    of_class = classes.select("n", "d1", "d2", "id").join(labels, "id", "left").select(
        "n", "d1", "d2", "id", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "th", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    label = F.when(F.col("component") < UNNAMED, F.col("component")).otherwise(
        F.when(F.col("component").isNull(), F.col("doc_id")))
    kept = F.when(F.col("component") < UNNAMED, F.col("doc_id").eqNullSafe(F.col("component"))).otherwise(
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), label.alias("component_id"), kept.alias("kept"))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    return groups(docs).drop("th")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns."""
    names = docs.columns
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    own = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), id_of.alias("at"), _text_hash().alias("th"))
    gone = groups(docs).filter("NOT kept").select(id_of.alias("at"), "th").distinct()
    return own.join(gone, ["at", "th"], "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
