"""Line deduplication within one edit by a deletion-neighbourhood join, on DataFrame functions only.

A line goes if an earlier line of the corpus (by document id, then place) equals it or is within one edit
(Levenshtein distance 1 on characters), whether or not that earlier line stays itself. Lines of fewer than
``LEAST_CHARS`` characters are too short to tell and stay.

Equal lines are aggregated first, and bitmaps of fixed size keep documents and lines that can't be concerned out of the
later shuffles. Two lines within one edit agree before and after some segment of the line, so every
distinct line puts out the hash of "all but segment i" for its few segments, under both lengths the shorter line of a
pair may have; a hash with one line needs nothing more. For the others the segment's deletion neighbourhood is put out:
the segment itself and every variant with one character deleted, as hashed keys. Equal keys with a deletion at the same
place are a substitution, and all such lines are within one edit of each other, so each is held against the earliest
only; a segment equal to another's variant is an insertion. Such groups are bounded by the alphabet and the segment's
length. The pairs found are verified by edit distance.

A text of any length is split into its lines, a line of any length into segments of at most ``SEGMENT`` characters. Of lines
equal to the earliest nothing else breaks a tie, as their places differ. A null text is one empty line. Rows with equal id and text stand for one document and are treated alike; documents
without id come first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LEAST_CHARS = 20
#: Lines have two segments, longer ones as many as it takes to keep a segment within so many characters.
SEGMENT = 500
NO_ID = -(1 << 63)
#: Rows of 64 bits of a bitmap that spares rows a shuffle; its size is fixed, an exact join follows it.
BITMAP_SLOTS = 1 << 17
LINE_END = "\n"
#: A character that isn't white space.
SEEN = r"[^\s\p{Z}]"


def _keyed(docs: DataFrame) -> DataFrame:
    """at, th and text: what tells documents apart and orders them."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"), F.xxhash64(text).alias("th"),
        text.alias("text"))


def occurrences(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """at, th, pos and line of every line that is long enough."""
    rows = _keyed(docs).select("at", "th", F.posexplode(F.split("text", LINE_END)).alias("pos", "line"))
    return rows.filter(F.char_length("line") >= least)


def _line_id() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("line")).alias("h2")]


def _segments(length: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(length / SEGMENT).cast("int"))


def _width(length: Column) -> Column:
    return F.ceil(length / _segments(length)).cast("int")


def _suffix(length: Column, i: Column) -> Column:
    """Characters after segment ``i`` of a line whose pair's shorter line has ``length``."""
    return F.greatest(F.lit(0), length - (i + 1) * _width(length))


def _segment_keys() -> Column:
    """Hashes of all but segment i of ``line`` (``n`` characters), first for a pair whose shorter line has n - 1
    characters, then for n."""
    line, n = F.col("line"), F.col("n")

    def halves(length: Column) -> list[Column]:
        width = F.ceil(length / 2).cast("int")
        return [F.xxhash64(F.right(line, length - width), length, F.lit(0)),
                F.xxhash64(F.substring(line, F.lit(1), width), length, F.lit(1))]

    def many(length: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _segments(length) - 1), lambda i: F.xxhash64(
            F.substring(line, F.lit(1), i * _width(length)), F.lit("|"), F.right(line, _suffix(length, i)), length, i))

    def either(length: Column) -> Column:
        return F.when(length <= 2 * SEGMENT, F.array(*halves(length))).otherwise(many(length))

    return F.when(n <= 2 * SEGMENT, F.array(*halves(n - 1), *halves(n))).otherwise(F.concat(either(n - 1), either(n)))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, first (at, th, pos), times, n and segment keys of every distinct line."""
    rows = lines.withColumn("n", F.char_length("line")).select(
        *_line_id(), F.struct("at", "th", "pos").alias("place"), "n", _segment_keys().alias("keys"))
    return rows.groupBy("h1", "h2").agg(
        F.min("place").alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def bitmap(hashes: DataFrame, name: str) -> DataFrame:
    """(slot, bits): which residues of the hashes occur, in at most ``BITMAP_SLOTS`` rows."""
    slot = F.shiftright(name, 6).bitwiseAND(F.lit(BITMAP_SLOTS - 1))
    bit = F.expr(f"shiftleft(1L, CAST({name} & 63L AS INT))")
    return hashes.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def maybe(rows: DataFrame, name: str, bits: DataFrame) -> DataFrame:
    """Adds ``maybe``: false only for rows whose hash isn't in the bitmap; no row is shuffled for it."""
    slot = F.shiftright(name, 6).bitwiseAND(F.lit(BITMAP_SLOTS - 1))
    hit = F.expr(f"shiftrightunsigned(coalesce(bits, 0L), CAST({name} & 63L AS INT)) & 1L") == 1
    return rows.withColumn("slot", slot).join(F.broadcast(bits), "slot", "left").withColumn("maybe", hit).drop("slot", "bits")


def live_keys(distinct: DataFrame) -> DataFrame:
    """Segment keys that at least two distinct lines have."""
    keys = distinct.select(F.explode("keys").alias("key"), "h1")
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")


def candidates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, h1, h2, first, middle): distinct lines with a live key, and the segment that may differ."""
    live = stored(live_keys(distinct), "live-keys")
    keys = distinct.select("h1", "h2", "first", "n", F.posexplode("keys").alias("j", "key"))
    wanted = maybe(keys, "key", bitmap(live, "key")).filter("maybe").join(live, "key")
    shorter = _segments(F.col("n") - 1)
    wanted = wanted.select(
        "key", "h1", "h2", "first", F.when(F.col("j") < shorter, F.col("n") - 1).otherwise(F.col("n")).alias("length"),
        F.when(F.col("j") < shorter, F.col("j")).otherwise(F.col("j") - shorter).alias("i"))
    wanted = stored(wanted.withColumn("doc", F.xxhash64("first.at", "first.th")), "wanted-lines")
    of_doc = wanted.groupBy(F.col("first.at").alias("at"), F.col("first.th").alias("th")).agg(
        F.collect_list(F.struct("key", "length", "i", "h1", "h2", "first")).alias("wanted"))  # lines of one document
    some = maybe(_keyed(docs).withColumn("doc", F.xxhash64("at", "th")), "doc", bitmap(wanted, "doc")).filter("maybe")
    found = some.dropDuplicates(["at", "th"]).join(of_doc, ["at", "th"]).select(
        F.split("text", LINE_END).alias("lines"), F.explode("wanted").alias("w"))
    line = F.expr("lines[w.first.pos]")
    start = F.col("w.i") * _width(F.col("w.length"))
    rest = F.char_length(line) - start - _suffix(F.col("w.length"), F.col("w.i"))
    return found.select("w.key", "w.h1", "w.h2", "w.first", F.substring(line, start + 1, rest).alias("middle"))


def within_one_edit(found: DataFrame) -> DataFrame:
    """(h1, h2) of candidates that an earlier one is within one edit of, verified."""
    n = F.char_length("middle")
    variants = found.select(
        "key", "h1", "h2", "first", "middle",
        F.explode(F.sequence(F.lit(0), n)).alias("deleted"))
    shorter = F.when(F.col("deleted") == 0, F.col("middle")).otherwise(F.concat(
        F.substring("middle", F.lit(1), F.col("deleted") - 1), F.right("middle", n - F.col("deleted"))))
    variants = variants.select(
        "key", F.xxhash64(shorter).alias("variant"), "deleted",
        F.struct("first", "h1", "h2").alias("line"))
    same_variant = W.partitionBy("key", "variant")
    same_place = W.partitionBy("key", "variant", "deleted")
    whole = F.when(F.col("deleted") == 0, F.col("line"))
    cut = F.when(F.col("deleted") > 0, F.col("line"))
    joined = variants.select(
        "key", "line", "deleted", F.min(whole).over(same_variant).alias("whole"), F.min(cut).over(same_variant).alias("cut"),
        F.min("line").over(same_place).alias("beside"))
    partners = F.when(F.col("deleted") == 0, F.array("cut")).otherwise(F.array("whole", "beside"))
    pairs = joined.select("key", "line", F.explode(partners).alias("earlier")).filter("earlier.first < line.first")
    pairs = pairs.select(
        "key", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"), F.col("earlier.h1").alias("e1"),
        F.col("earlier.h2").alias("e2")).distinct()
    text = found.select("key", "h1", "h2", "middle")
    before = found.select("key", F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("middle").alias("earlier"))
    checked = pairs.join(text, ["key", "h1", "h2"]).join(before, ["key", "e1", "e2"])
    return checked.filter(F.levenshtein("middle", "earlier", 1) >= 0).select("h1", "h2").distinct()


def removals(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """at, th, gone and near_lines: the places of lines that go, and how many of them go as nearly equal."""
    lines = occurrences(docs, least)
    distinct = stored(distinct_lines(lines), "lines")
    near = stored(within_one_edit(stored(candidates(docs, distinct), "candidates")), "near-lines").withColumn("near", F.lit(True))
    verdicts = stored(
        distinct.filter("times > 1").select("h1", "h2", "first").join(near, ["h1", "h2"], "full"), "verdicts")
    places = maybe(lines.select("at", "th", "pos", *_line_id()), "h1", bitmap(verdicts, "h1")).filter("maybe")
    gone = places.join(verdicts, ["h1", "h2"])
    gone = gone.filter(F.coalesce("near", F.lit(False)) | (F.struct("at", "th", "pos") != F.col("first")))
    return gone.groupBy("at", "th").agg(
        F.collect_set("pos").alias("gone"), F.countDistinct(F.when(F.col("near"), F.col("pos"))).alias("near_lines"))


def _changed(docs: DataFrame, least: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1 and so on, ``text`` less the lines that go; at and th of the text as it was, and
    n_lines, equal_lines, near_lines. Texts are shuffled only for documents that change."""
    names = docs.columns
    changes = stored(removals(docs.select("doc_id", "text"), least), "removals").withColumn("doc", F.xxhash64("at", "th"))
    own = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("at"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    text = f"c{names.index('text')}"
    own = maybe(own.withColumn("doc", F.xxhash64("at", "th")), "doc", bitmap(changes, "doc")).drop("doc")
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)

    def result(rows: DataFrame, remaining: Column, equal: Column, near: Column) -> DataFrame:
        return rows.select(
            *((remaining if f"c{i}" == text else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))), "at", "th",
            F.size(lines).alias("n_lines"), equal.cast("int").alias("equal_lines"), near.cast("int").alias("near_lines"))

    same = result(own.filter("NOT maybe"), F.coalesce(text, F.lit("")), F.lit(0), F.lit(0))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    near = F.coalesce("near_lines", F.lit(0))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), LINE_END)
    changed = own.filter("maybe").join(changes.drop("doc"), ["at", "th"], "left")
    return same.unionByName(result(changed, kept, F.size(gone) - near, near))


def without_stubs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with ``text`` less the lines that go, less the documents that lost lines and have nothing of their own left.

    Of those only short and blank lines are left, and each of the short ones stands in an earlier document too. Other
    columns keep their names and values, whatever they are called; a null text becomes empty.
    """
    names, lost = docs.columns, "equal_lines + near_lines > 0"
    text = f"c{names.index('text')}"
    found = _changed(docs, least)
    long = F.exists(F.split(text, LINE_END), lambda x: (F.char_length(x) >= least) & x.rlike(SEEN))
    stubs = stored(found.filter(lost).filter(~long), "stubs")
    shorts = _keyed(docs).select("at", "th", F.explode(F.split("text", LINE_END)).alias("line"))
    shorts = shorts.filter((F.char_length("line") < least) & F.col("line").rlike(SEEN)).withColumn("h", F.xxhash64("line"))
    left = bitmap(stubs.select(F.explode(F.split(text, LINE_END)).alias("line")).select(F.xxhash64("line").alias("h")), "h")
    firsts = maybe(shorts, "h", left).filter("maybe").groupBy("line").agg(F.min(F.struct("at", "th")).alias("first"))
    owners = firsts.select("first.at", "first.th").distinct()
    kept = stubs.join(owners, ["at", "th"], "left_semi")
    return found.filter(F.expr(f"NOT ({lost})") | long).unionByName(kept).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, equal_lines, near_lines and the remaining text of every document."""
    return _changed(docs.select("doc_id", "text"), LEAST_CHARS).select(
        F.col("c0").alias("doc_id"), "n_lines", "equal_lines", "near_lines", F.col("c1").alias("text"))


#: For DuckDB: halves instead of segments, all pairs that share one, distance 1 or equality, earlier by (doc_id, pos).
ORACLE_SQL = f"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM raw),
d AS (SELECT line, min((doc_id, pos)) AS f, count(*) AS times, length(line) AS n FROM lines
      WHERE length(line) >= {LEAST_CHARS} GROUP BY line),
k AS (SELECT line, f, n AS l, unnest([left(line, n // 2) || '<', '>' || right(line, n - n // 2)]) AS key FROM d
      UNION ALL
      SELECT line, f, n - 1, unnest([left(line, (n - 1) // 2) || '<', '>' || right(line, n - 1 - (n - 1) // 2)]) FROM d),
near AS (SELECT DISTINCT b.line FROM k a JOIN k b ON a.key = b.key AND a.l = b.l AND a.f < b.f
         WHERE abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
v AS (SELECT l.doc_id, l.pos, l.line, near.line IS NOT NULL AS is_near,
             coalesce(d.times > 1 AND d.f <> (l.doc_id, l.pos), false) AS is_equal
      FROM lines l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines,
       CAST(count(*) FILTER (is_equal AND NOT is_near) AS INTEGER) AS equal_lines,
       CAST(count(*) FILTER (is_near) AS INTEGER) AS near_lines,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_near AND NOT is_equal), '') AS text
FROM v GROUP BY doc_id"""
