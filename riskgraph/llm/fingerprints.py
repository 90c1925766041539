"""Document fingerprints as invertible Bloom lookup sketches, on DataFrame functions only.

A text is a set of paragraph digests: its lines, long ones cut at sentence ends. A sketch throws every digest into one
cell of each of three tables; a cell holds how many came, the xor of their digests and the xor of their checks. Two
sketches of one size subtract cell by cell: what both texts have cancels out. A cell left with one digest (its check
fits) is peeled: the digest is recovered and taken out of its other cells, which frees more. When nothing is left, the
recovered digests are exactly the paragraphs that differ; when cells stay stuck the sketch was too small, and that
pair is sketched again at twice the size, ``TRIES`` times at most; then its digests are counted from the sets. The likeness of two texts is (a + b - d) / (a + b + d) with their numbers of
paragraphs and of differing paragraphs.

The printed fingerprint is the sketch of a fixed small size with the number of paragraphs, so equal texts have equal
ones. Peeling runs as aggregations over (pair, cell), all rows of a pair in one partition.

``near_edited`` and ``near_next`` come from sketches of each pair's own size, which decode; the printed ones are too small
for that. A text of any length is one row; its digests grow with it. A null text is empty; two texts without paragraphs are alike (1.0). The document after the last is the first; a
single document follows itself. Rows without id come first, repeated ids stand in the order of their texts' hashes. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

TABLES = 3
#: Cells of each table in the printed fingerprint.
PRINTED = 4
#: A paragraph's pieces: at least so many characters of a line, then up to the next sentence end or so many more.
PIECE = r"[^\n]{1,30}[^\n.!?]{0,170}[\n.!?]*"
ROUNDS = 10
#: First size of a pair's sketch: cells of a table for each paragraph of both texts.
NEAR, FAR = 0.25, 0.62
LEAST_CELLS = 8
TRIES = 8
ROWS_PER_BUCKET = 1024
#: Buckets, and so first rows that are broadcast; above 268 million rows buckets hold more, sorted outside memory.
MOST_BUCKETS = 1 << 18
#: Quantiles of the ids that buckets are cut at.
CELLS = 256
NO_ID = -(1 << 63)


def digests(text: Column) -> Column:
    """Distinct paragraph digests."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def check_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def printed(found: Column) -> Column:
    """Number of digests, then count, key and check of each cell in hexadecimal."""
    def cell(c: Column) -> Column:
        table, place = F.floor(c / PRINTED).cast("int"), (c % PRINTED).cast("long")
        mine = F.filter(found, lambda d: F.pmod(F.shiftright(d, 7) + table * F.shiftright(d, 29), F.lit(PRINTED)) == place)
        key = F.aggregate(mine, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))
        check = F.aggregate(mine, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(check_of(d)))
        return F.concat(F.hex(F.size(mine)), F.lit("."), F.lpad(F.hex(key), 16, "0"), F.lit("."), F.lpad(F.hex(check), 8, "0"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(TABLES * PRINTED - 1)), cell)
    return F.lower(F.concat(F.size(found).cast("string"), F.lit(":"), F.array_join(cells, "-")))


def _place(key: Column, table: Column, third: Column, attempt: int) -> Column:
    """Cell of a digest in one of the three tables of ``third`` cells."""
    return (table * third + F.pmod(F.xxhash64(key, table, F.lit(attempt)), third)).cast("int")


PAIR = ["pair", "kind", "third"]


def subtracted(pairs: DataFrame, within: list[str], attempt: int) -> DataFrame:
    """Cells of sketch a minus sketch b for rows (within, pair, kind, third, n_a, both): ``both`` holds the digests of a,
    of which there are ``n_a``, then those of b."""
    keys = [*within, *PAIR]
    thrown = pairs.select(*keys, "n_a", F.posexplode("both").alias("at", "key")).select(
        *keys, "key", F.when(F.col("at") < F.col("n_a"), 1).otherwise(-1).alias("count"))
    thrown = thrown.select(*keys, "key", "count", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table"))
    return _summed(thrown.select(
        *keys, _place(F.col("key"), F.col("table"), F.col("third"), attempt).alias("cell"), "count", "key",
        check_of(F.col("key")).alias("check"), F.lit(0).alias("found")), keys)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.groupBy(*keys, "cell").agg(
        F.sum("count").cast("int").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"),
        F.sum("found").cast("int").alias("found"))
    return out.filter("count <> 0 OR key <> 0 OR found <> 0")


def peel(cells: DataFrame, within: list[str], attempt: int, rounds: int = ROUNDS) -> DataFrame:
    """(within, pair, kind, differing, stuck): the number of recovered digests, and whether cells are left."""
    keys = [*within, *PAIR]
    for _ in range(rounds):
        pure = (F.abs("count") == 1) & (F.col("check") == check_of(F.col("key")))
        moves = cells.withColumn("move", F.explode(F.sequence(F.lit(0), F.when(pure, TABLES).otherwise(0))))
        own = F.col("move") == 0
        to = _place(F.col("key"), F.col("move") - 1, F.col("third"), attempt)
        moves = moves.select(
            *keys, F.when(own, F.col("cell")).otherwise(to).alias("cell"),
            F.when(~own, F.col("key")).alias("taken"),
            F.when(own, F.col("count")).otherwise(-F.col("count")).alias("count"), "key", "check",
            F.when(own, F.col("found")).otherwise((F.col("move") == 1).cast("int")).alias("found"))
        # a digest alone in several of its cells is taken out once
        once = moves.groupBy(*keys, "cell", "taken").agg(
            F.max("count").alias("count"), F.max("key").alias("key"), F.max("check").alias("check"),
            F.max("found").alias("found"))
        cells = _summed(once, keys)
    return cells.groupBy(*within, "pair", "kind").agg(
        F.sum("found").alias("differing"), F.max((F.col("count") != 0) | (F.col("key") != 0)).alias("stuck"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differing) / (a + b + differing))


def _buckets(rows: DataFrame, rows_per_bucket: int) -> tuple[Callable[[Column, Column], Column], int]:
    """Bucket of (at, th), rising with both, and the number of buckets: ranges of ids between quantiles, cut evenly where
    there are more buckets than ``CELLS``; an id that fills several ranges alone is cut by its texts' hashes."""
    n = rows.count()
    wanted = max(1, min(MOST_BUCKETS, -(-n // rows_per_bucket)))
    cells = min(CELLS, wanted)
    each = -(-wanted // cells)
    found = rows.agg(
        F.percentile_approx("at", [i / cells for i in range(cells)], F.lit(100 * CELLS)).alias("cuts"), F.max("at").alias("hi")).first()
    cuts = Counter(found["cuts"] or [0])
    starts = sorted(cuts)
    ends = [*starts[1:], (found["hi"] or 0) + 1]
    alone = [cuts[x] * each if cuts[x] > 1 else 0 for x in starts]
    bases = [sum(alone[:k]) + k * each for k in range(len(starts))]

    def bucket(at: Column, th: Column) -> Column:
        k = F.greatest(F.size(F.filter(F.lit(starts), lambda c: c <= at)), F.lit(1))
        start, end, heavy, base = (F.element_at(F.lit(x), k) for x in (starts, ends, alone, bases))
        inside = F.least(F.floor((at.cast("double") - start) / (end.cast("double") - start) * each), F.lit(each - 1))
        by_hash = F.least(F.floor((th / F.lit(2.0**64) + 0.5) * heavy), heavy - 1)
        place = base + F.when((heavy > 0) & (at == start), by_hash).otherwise(heavy + F.greatest(inside, F.lit(0)))
        # never null, or the join below would filter one of two equal exchanges and neither could be reused
        return F.coalesce(place.cast("int"), F.lit(0))

    return bucket, bases[-1] + alone[-1] + each


def ordered(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """at (the id; ``NO_ID`` for none), text, bucket, place in the bucket, and what follows by ascending doc_id.

    Buckets are ranges of ids; the first row of each is copied behind the last of the bucket before it.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, buckets = _buckets(rows.select("at"), rows_per_bucket)
    rows = rows.withColumn("th", F.xxhash64("text"))
    firsts = rows.select("at", "th", bucket(F.col("at"), F.col("th")).alias("bucket")).groupBy("bucket").agg(
        F.min(F.struct("at", "th")).alias("first"))
    order = W.orderBy("bucket")  # a row per bucket
    last = F.max("bucket").over(W.partitionBy())
    firsts = firsts.select("first.at", "first.th", F.coalesce(F.lag("bucket").over(order), last, F.lit(0)).alias("before"))
    own = rows.select("at", "text", "th", bucket(F.col("at"), F.col("th")).alias("bucket"), F.lit(0).alias("copy"))
    copies = rows.join(F.broadcast(firsts), ["at", "th"]).select(
        "at", "text", "th", F.col("before").alias("bucket"), F.lit(1).alias("copy"))
    rows = own.unionByName(copies).repartition(buckets, "bucket")  # firsts: about MOST_BUCKETS rows at most
    w = W.partitionBy("bucket").orderBy("copy", "at", "th")
    return rows.select(
        "at", "text", "bucket", "copy", F.row_number().over(w).alias("pair"), F.lead("text").over(w).alias("next"),
        F.lead(digests(F.col("text"))).over(w).alias("next_set")).filter("copy = 0").drop("copy")


@contextmanager
def _dealt_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Joins on (bucket, pair) of rows that are dealt by bucket already need no shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _counted(stuck: DataFrame) -> DataFrame:
    """Rows that no size of sketch settled, their differing digests counted from the sets they carry."""
    def near(other: str) -> Column:
        differing = F.size(F.array_except("own_set", other)) + F.size(F.array_except(other, "own_set"))
        return likeness(F.size("own_set"), F.size(other), differing)

    return stuck.withColumn("near_edited", near("edited_set")).withColumn("near_next", near("next_set"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = ordered(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    rows = rows.select(
        "at", "bucket", "pair", n.cast("long").alias("n_chars"), edited.alias("edited"),
        digests(F.col("text")).alias("own_set"), digests(edited).alias("edited_set"), "next_set")

    def pairs_of(sets: DataFrame, grown: int) -> DataFrame:
        def first_size(other: str, share: float) -> Column:
            both = F.size("own_set") + F.size(other)
            return F.greatest(F.lit(LEAST_CELLS), F.ceil(both * share)).cast("int") * grown

        made = F.array(
            F.struct(F.lit(0).alias("kind"), first_size("edited_set", NEAR).alias("third"), F.concat("own_set", "edited_set").alias("both")),
            F.struct(F.lit(1).alias("kind"), first_size("next_set", FAR).alias("third"), F.concat("own_set", "next_set").alias("both")))
        return sets.select("bucket", "pair", F.size("own_set").alias("n_a"), F.inline(made))

    def compared(sets: DataFrame, attempt: int) -> DataFrame:
        cells = subtracted(pairs_of(sets, 1 << attempt), ["bucket"], attempt)
        done = peel(cells, ["bucket"], attempt)
        one = {k: F.col("kind") == k for k in (0, 1)}
        return done.groupBy("bucket", "pair").agg(
            F.max(F.when(one[0], F.col("differing"))).alias("edited_differing"),
            F.max(F.when(one[1], F.col("differing"))).alias("next_differing"), F.max("stuck").alias("stuck"))

    sets = ["own_set", "edited_set", "next_set"]
    base = rows.select(
        F.when(F.col("at") != NO_ID, F.col("at")).alias("doc_id"), "bucket", "pair", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("own_set")).alias("fingerprint"), printed(F.col("edited_set")).alias("edited_fingerprint"), *sets)

    def near(out: DataFrame) -> DataFrame:
        sizes = [F.size(s) for s in sets]
        return out.select(
            "doc_id", "bucket", "pair", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(sizes[0], sizes[1], F.coalesce("edited_differing", F.lit(0))).alias("near_edited"),
            likeness(sizes[0], sizes[2], F.coalesce("next_differing", F.lit(0))).alias("near_next"),
            F.coalesce("stuck", F.lit(False)).alias("stuck"),
            *(F.when(F.col("stuck"), F.col(s)).alias(s) for s in sets))

    with _dealt_by_bucket(docs.sparkSession):
        result = stored(near(base.join(compared(rows.select("bucket", "pair", *sets), 0), ["bucket", "pair"], "left")), "fingerprints")
    done = [result.filter("NOT stuck")]
    for attempt in range(1, TRIES + 1):
        failed = result.filter("stuck")
        if failed.isEmpty():
            break
        again = failed.drop("near_edited", "near_next", "stuck")
        split = again.select("bucket", "pair", *sets).repartition("bucket")
        with _dealt_by_bucket(docs.sparkSession):
            result = stored(near(again.join(compared(split, attempt), ["bucket", "pair"], "left")), "fingerprints")
        done.append(result.filter("NOT stuck"))
    else:
        done.append(_counted(result.filter("stuck")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
