"""Importance resampling against plain counting, for runs of several words, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from compare import compare

from riskgraph.llm import resampling
from riskgraph.llm.queries import QUERIES, SQL


def plain_features(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k:k + n]).encode() for n in range(1, max_n + 1) for k in range(len(words) - n + 1)]


def plain_resample(docs, target, max_n, buckets, least_words, percent, seed):
    bucket = lambda f: zlib.crc32(f) % buckets
    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, plain_features(text, max_n)[1]))
    for text in target:
        wanted.update(map(bucket, plain_features(text, max_n)[1]))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = plain_features(text, max_n)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    rank = Counter()
    out = []
    for k, r in enumerate(able):
        out.append((*r, k + 1 if k < percent * len(able) // 100 else None))
    rank.update(out)
    rank.update((*r, None) for r in rows if r[1] < least_words)
    return rank


def texts(rng, n):
    words = ["Apple", "b", "ÄÖ", "c3", "x", "día", "end"]
    return [rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), "a\x00b, c-d\n\nE" * 9]) for _ in range(n)]


@pytest.mark.parametrize("max_n,block", [(1, 1 << 20), (3, 50)])
def test_equals_plain_counting(spark, max_n, block):
    rng = random.Random(max_n)
    docs = [*enumerate(texts(rng, 300)), (7, "same words " * 30), (None, "no id " * 30), (None, "no id " * 30)]
    docs += [(9000, "repeated row of some words " * 8)] * 40  # equal in every column
    docs.append((5000, "very long " * 40_000))
    target = texts(rng, 20)
    wide = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, range int, rank int, score int")
    small = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resampling.resample(wide, small, max_n, 97, 5, 30, 7, block).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got) == plain_resample(
        docs, target, max_n, 97, 5, 30, 7)


def test_no_run_crosses_documents():
    crcs, of, n = resampling.features([b"a b", b"", b"c", b"d\x00e f"], 2)
    assert Counter(zip(of.tolist(), crcs.tolist(), strict=True)) == Counter(
        (i, zlib.crc32(f)) for i, f in [(0, b"a"), (0, b"b"), (0, b"a b"), (2, b"c"), (3, b"d"), (3, b"e"), (3, b"f"), (3, b"d e"), (3, b"e f")])
    assert n.tolist() == [2, 0, 1, 3]


@pytest.mark.parametrize("range_rows", [1, 3, 10**6])
def test_ranks_over_many_ranges(spark, monkeypatch, range_rows):
    rng = random.Random(range_rows)
    monkeypatch.setattr(resampling, "LEAST_RANGES", 1)
    rows = [(rng.choice([None, rng.randint(-50, 50)]), rng.randint(0, 9), rng.choice([5, 5, 5, rng.randint(-9, 99)])) for _ in range(500)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
    for percent in (0, 1, 37, 100):
        got = resampling.ranked(scored, resampling.F.col("n_words") >= 3, percent, range_rows).collect()
        able = sorted((r for r in rows if r[1] >= 3), key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
        want = Counter((*r, k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able))
        want.update((*r, None) for r in rows if r[1] < 3)
        assert Counter(tuple(r) for r in got) == want


def test_sql_on_awkward_tables(spark, edge_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{edge_dir}/{t}.parquet')")
    name = "op11_batch_concatenation"
    assert compare(spark, con, edge_dir, QUERIES[name], SQL[name]) == []
