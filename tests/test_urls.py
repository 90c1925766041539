"""The fast form of URL canonicalisation against the general one."""

import random

from pyspark.sql import functions as F

from riskgraph.functions import urls as U


def test_fast_form_equals_general_form(spark):
    rng = random.Random(8)
    hosts = ["a.com", "A.com", "x-1.b.vn:8080", "u@a.com", "[::1]", "b.vn:443"]
    paths = ["", "/", "/a", "/a/../b", "/.well/x", "/a/.b", "/é", "/a b", "/a%20b/", "/x.pdf", "/a//b", "/a/.", "/..."]
    keys = ["a", "utm_source", "gclid", "source", "sourcex", "xutm_a", "q", "ei", "b%5B"]
    values = ["", "1", "x+y", "a%2Fb", "é", "z.z_-*", "=", "a=b"]
    rows = []
    for _ in range(1500):
        pairs = "&".join(f"{rng.choice(keys)}={rng.choice(values)}" for _ in range(rng.randint(0, 4)))
        query = rng.choice(["", "?" + pairs, "?" + pairs + "&", "?&" + pairs, "?" + pairs + "&flag"])
        rows.append((rng.choice(["http://", "https://", "HTTPS://", ""]) + rng.choice(hosts)
                     + rng.choice(paths) + query + rng.choice(["", "#f", "#f?x=1&gclid=2"]),))
    for _ in range(700):
        pairs = "&".join(f"{rng.choice(keys[:-1])}={rng.choice(['', '1', 'z.z_-*'])}"
                         for _ in range(rng.randint(1, 4)))
        rows.append((f"https://a.com{rng.choice(['/', '/a', '/a/b.html', '/a/'])}"
                     f"{rng.choice(['', '?' + pairs])}{rng.choice(['', '#f'])}",))
    df = spark.createDataFrame(rows, "u string").select(
        "u", U.canonicalize_url("u").alias("fast"), U._canonical_any("u").alias("slow"))
    assert df.where(~F.col("fast").eqNullSafe(F.col("slow"))).limit(5).collect() == []
    assert df.where(F.col("u").rlike(U._PLAIN)).count() > 500
    twice = df.select("u", "fast", U.canonicalize_url("fast").alias("again"))
    assert twice.where("fast <> again").limit(5).collect() == []


def test_path_and_host(spark):
    rows = [(" https://A.com/x ", "a.com", "/x"), ("https://a.com?x", "a.com", "/"),
            ("https://a.com\\b\\c", "a.com", "/b/c"), ("https:///a.com/y", "a.com", "/y"),
            ("https://a b.com/", None, None), ("http://", None, None), ("https://a.com:80x/", None, None),
            ("https://a.com/a/./b/..", "a.com", "/a/"), ("https://u:p@h.vn:1/ x", "h.vn", "/%20x")]
    df = spark.createDataFrame(rows, "u string, h string, p string")
    got = df.select("u", U.url_host("u"), U.url_path("u")).collect()
    assert [tuple(r) for r in got] == rows
