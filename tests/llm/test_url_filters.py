"""URL verdicts against a plain search over all rules, by trie and by join."""

import random

import pytest
from compare import compare

from riskgraph.llm import url_filters
from riskgraph.llm.queries import QUERIES, SQL

SCHEMA = "page_id long, url string, host string, salt int, verdict string"


def plain(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:min(ends, default=len(rest))])
        rest = rest[min(ends, default=len(rest)):]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h.count(".") + 1 if h else 0, len(p), v == "block", h + p, v) for v, h, p in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def made(spark, urls):
    return spark.createDataFrame([(i, u, "clash", 1, "allow") for i, u in enumerate(urls)], SCHEMA)


@pytest.mark.parametrize("trie_bytes", [url_filters.TRIE_BYTES, 0])
def test_equals_plain_search(spark, trie_bytes):
    rng = random.Random(5)
    labels, segments = ["a", "b", "com", "org", ""], ["x", "xy", "x1", "", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(0, n)))
    path = lambda n: "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, n)))
    urls = [rng.choice(["http://", "HTTP://", "x://", "", "a:/"]) + rng.choice([host(4), host(3).upper()]) + path(4)
            + rng.choice(["", "?q=/x", "#f/x", "/?://a"]) for _ in range(400)]
    urls += [None, "", "://", "http://com", "http://com/", "http://A.com:80/x", "http://u@com/x", "http://a.com./x",
             "line\n://b.com/x\ny", "http://org/" + "x/" * 5000, "http://" + "a." * 2000 + "com/xy"] + ["http://org/x"] * 3
    rules = [("block", "", "/x1"), ("allow", "com", ""), ("block", "com", "/x"), ("block", "a.com", "/x/x"), ("allow", "a.com", "/x/x"),
             ("allow", "a.com", "/x/xy/"), ("block", "b.a.org", "/"), ("allow", "ORG", "/x"), ("block", "org", "/"), ("allow", "com", "/é")]
    lowered = [(v, h.lower(), p) for v, h, p in rules]
    got = url_filters.judge(made(spark, urls), url_filters.rule_table(spark, rules), "block", trie_bytes).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]], lowered, "block"), urls[r["page_id"]]


@pytest.mark.parametrize("trie_bytes", [url_filters.TRIE_BYTES, -1])
def test_without_rules_or_pages(spark, trie_bytes):
    none = url_filters.rule_table(spark, [])
    got = url_filters.judge(made(spark, ["http://a/b", None]), none, trie_bytes=trie_bytes).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "allow")] * 2
    some = url_filters.rule_table(spark, url_filters.RULES)
    assert url_filters.judge(made(spark, []), some, trie_bytes=trie_bytes).count() == 0


def test_sql_on_awkward_tables(spark, edge_dir):
    name = "op13_url_trie"
    assert compare(spark, duck_of(edge_dir), edge_dir, QUERIES[name], SQL[name]) == []


def duck_of(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    return con
