"""URL verdicts by a trie over reversed host labels, then path segments; the longest rule that fits wins.

A rule is (verdict, host, path). It fits its host and every subdomain if the URL's path starts with the rule's, also in
the middle of a segment. Of several that fit, the one of the longest host wins, then of the longest path, then block over
allow. A rule without host fits every host, one without path every path of its host. A URL that no rule fits gets the default.

The host stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased, with its port or
user if it has them; the path follows up to ``?``, ``#`` or the end. A URL that is null or has no ``://`` has neither, and
only a rule without host and path can fit it. URLs of any length are cut by expressions. Equal rules count once, rows of
``pages`` are independent of each other: repeated ones and those without id each give a row. An empty table gives an empty
result; without rules all get the default. Other columns of both tables are not looked at.

The trie is broadcast up to ``TRIE_BYTES`` of rules. A larger rule table is joined instead, by host suffix and the
path's whole segments, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest text of a rule table that is broadcast.
TRIE_BYTES = 32 << 20
#: Parts of a hot key when the rules are joined.
SALTS = 32
ALLOW, BLOCK = "allow", "block"
RULE = "verdict string, host string, path string"


class _Paths:
    """Rules of one host below some whole segments: further segments, and the beginnings of the next one."""

    __slots__ = ("below", "sizes", "tails")

    def __init__(self) -> None:
        self.below: dict[str, _Paths] = {}
        self.tails: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, path: str, found: tuple[str, str]) -> None:
        node = self
        *whole, tail = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, _Paths())
        if found[1] == BLOCK or tail not in node.tails:
            node.tails[tail] = found
        node.sizes = sorted({len(t) for t in node.tails}, reverse=True)

    def longest(self, segments: list[str]) -> tuple[str, str] | None:
        node, found = self, None
        for segment in segments:
            for n in node.sizes:
                if segment[:n] in node.tails and n <= len(segment):
                    found = node.tails[segment[:n]]
                    break
            node = node.below.get(segment)
            if node is None:
                break
        return found


class HostTrie:
    """Labels from the right; a node may hold rules of its host."""

    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, HostTrie] = {}
        self.paths: _Paths | None = None

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str, str]]) -> HostTrie:
        root = cls()
        for verdict, host, path in rules:
            node = root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, cls())
            node.paths = node.paths or _Paths()
            node.paths.add(path, (host + path, verdict))
        return root

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, passed = self, [self.paths]
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            passed.append(node.paths)
        segments = path.split("/")
        for paths in reversed(passed):
            found = paths.longest(segments) if paths else None
            if found:
                return found
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where there is no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A rule table of a short list."""
    return rows_of(spark, RULE, [{"verdict": v, "host": h, "path": p} for v, h, p in rules])


def _plain(rules: DataFrame) -> DataFrame:
    return rules.select(
        "verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path")).filter(F.col("verdict").isin(ALLOW, BLOCK)).distinct()


def _by_trie(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(HostTrie.build(tuple(r) for r in rules.collect()))  # below TRIE_BYTES

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Candidates of each distinct (host, path): its host's suffixes times the beginnings of its path that end in a slash.

    A suffix such as ``com`` is common to most URLs and a (host, path) may be that of a third of all rows, so both joins
    deal their large side over ``SALTS`` parts, with the small side once in each."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    split = rules.select(
        "verdict", "host", "path", F.regexp_extract("path", r"(?s)^(.*/)?", 1).alias("head"), salts).withColumn(
        "tail", F.expr("substring(path, char_length(head) + 1)"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(0), F.size(labels)), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parts = F.split("path", "/", -1)
    heads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(
        F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    asked = urls.select("host", "path").distinct()
    asked = asked.select(
        F.col("host").alias("of"), F.col("path").alias("at"), F.explode(F.array_distinct(suffixes)).alias("host"), heads.alias("heads"))
    asked = asked.select("of", "at", "host", F.explode("heads").alias("head")).withColumn(
        "salt", F.pmod(F.xxhash64("of", "at"), F.lit(SALTS)).cast("int"))
    fits = asked.join(split, ["host", "head", "salt"]).filter(F.expr("startswith(substring(at, char_length(head) + 1), tail)"))
    best = fits.groupBy("of", "at").agg(F.max(F.struct(
        F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.", -1))).alias("labels"),
        F.char_length("path").alias("long"), (F.col("verdict") == BLOCK).alias("blocks"),
        F.concat("host", "path").alias("rule"), "verdict")).alias("best"))
    best = best.select(F.col("of").alias("host"), F.col("at").alias("path"), "best", salts)
    dealt = urls.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(best, ["host", "path", "salt"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decided, else null) and verdict of every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = _plain(rules)
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16).alias("n")).first()["n"] or 0
    return (_by_trie if size <= trie_bytes else _by_join)(urls, rules, default)


#: The production rules: (verdict, host, path).
RULES = [
    (ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]

#: For DuckDB.
ORACLE_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS nth, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
  ('block', 'com', '/de/')),
f AS (
  SELECT nth, verdict, rule_host || rule_path AS rule,
         row_number() OVER (PARTITION BY nth ORDER BY length(rule_host) DESC, length(rule_path) DESC, verdict DESC) AS k
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.nth = p.nth AND f.k = 1"""
