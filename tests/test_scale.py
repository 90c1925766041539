"""What keeps shuffles narrow and tasks small: numbers for ids, tasks by rows."""

from pyspark.sql import functions as F

from riskgraph import session
from riskgraph.operators import graph
from riskgraph.operators.numbers import numbered, seeded_hash


def _links(spark, pairs):
    rows = [(min(a, b), max(a, b), "co_mentioned", float(n)) for n, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "subject_a_id string, subject_b_id string, link_type string, strength double")


def test_numbers_are_distinct(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")

    def weak(seed, column):
        return seeded_hash(seed, column) if seed > 1 else F.lit(7).cast("bigint")

    names, number = numbered(ids, weak)
    assert {r["id"]: r["n"] for r in names.collect()} == {
        r["id"]: r["n"] for r in ids.where("id IS NOT NULL").select("id", number("id").alias("n")).collect()}
    assert names.select("n").distinct().count() == 2
    assert ids.where("id IS NULL").select(number("id")).first()[0] is None


def test_links_get_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    mentions = spark.range(2000).select(
        (F.col("id") % 500).alias("evidence_id"), F.concat(F.lit("s"), F.col("id") % 40).alias("subject_id"),
        F.lit("url").alias("subject_type"), F.concat(F.lit("v"), F.col("id") % 50).alias("value"))
    subjects = spark.range(50).select(
        F.lit("url").alias("subject_type"), F.concat(F.lit("v"), F.col("id")).alias("value"),
        F.concat(F.lit("u"), F.col("id")).alias("id"))
    links = graph.co_mention_links(mentions, subjects)
    assert links.rdd.getNumPartitions() >= 100
    want = {(s, f"u{v[1:]}"): n for s, v, n in mentions.groupBy("subject_id", "value").agg(
        F.count_distinct("evidence_id")).collect()}
    assert {(r["subject_a_id"], r["subject_b_id"]): r["strength"] for r in links.collect()} == want


def test_one_value_in_all_evidence_is_counted_once_a_pair(spark):
    """The parts of a hot value add up, evidence that repeats in a part counts once."""
    mentions = spark.range(4000).select(
        (F.col("id") % 1000).alias("evidence_id"), F.lit("s").alias("subject_id"), F.lit("url").alias("subject_type"),
        F.lit("v").alias("value"))
    subjects = spark.createDataFrame([("url", "v", "u")], "subject_type string, value string, id string")
    assert [tuple(r) for r in graph.co_mention_links(mentions, subjects).collect()] == [("s", "u", "co_mentioned", 1000.0)]


def test_reach_sorts_and_shuffles_numbers_only(spark):
    """No id text is shuffled by the hops; nodes keep their ids, also a root without a link."""
    links = _links(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "x")])
    roots = spark.createDataFrame([("a",), ("lone",)], "root_id string")
    around = graph._around(links, roots, 3)
    assert [f.dataType.simpleString() for f in around.nodes.schema] == ["bigint", "bigint", "int"]
    assert {tuple(r) for r in graph.reached(links, roots, 3).collect()} == {
        ("a", "a", 0), ("a", "b", 1), ("a", "x", 1), ("a", "c", 2), ("a", "d", 3), ("lone", "lone", 0)}


def test_equal_ranks_keep_the_order_of_ids(spark):
    links = _links(spark, [("h", x) for x in "cab"]).withColumn("strength", F.lit(1.0))
    subjects = spark.createDataFrame(
        [(x, x, "phone", 0.1, "low", 5) for x in "bca"],
        "id string, value string, subject_type string, risk_score double, risk_level string, last_seen_at int")
    got = graph.neighbours(subjects, links, n=2).select("subject_id", "other_id").collect()
    assert {tuple(r) for r in got} == {("h", "a"), ("h", "b")}


def test_edges_between_nodes_of_one_depth(spark):
    """A link is found whichever of its ends more roots have."""
    links = _links(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e")])
    nodes = spark.createDataFrame(
        [("r", x) for x in "abc"] + [("q", x) for x in "cd"] + [("p", "c")], "root_id string, id string")
    got = graph.network_edges(links, nodes).select("root_id", "subject_a_id", "subject_b_id").collect()
    assert {tuple(r) for r in got} == {("r", "a", "b"), ("r", "a", "c"), ("r", "b", "c"), ("q", "c", "d")}


def test_per_row_work_gets_tasks_by_rows(spark, sf_dir, monkeypatch):
    """Pages made of a one-file table are dealt, listing pages as well as posts."""
    from riskgraph.sources import driver_tables

    monkeypatch.setattr(driver_tables, "ROWS_DEALT", 10)
    for name, make in (("orders", driver_tables.order_posts), ("customer", driver_tables.listing_pages),
                       ("supplier", driver_tables.card_pages), ("supplier", driver_tables.detail_pages)):
        rows = driver_tables.table(spark, sf_dir, name).count()
        assert make(spark, sf_dir).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-rows // 10))


def test_reports_sort_one_copy_of_a_page(spark, monkeypatch):
    """Repeats of a page go before their contents are sorted; first pages and their order stay, rows without position first."""
    from riskgraph.operators import pages, ranking

    rows = [(q, p, f"u{u}", "t", "c the", "") for q in range(3) for u in range(30) for p in range(u, u + 600, 20)]
    rows += [(0, None, "u7", "t", "c the", ""), (1, 5, None, "t", "the", ""), (None, 1, "u1", "t", "the", "")]
    found = spark.createDataFrame(
        rows, "query_id long, pos long, url string, title string, content string, date string")
    queries = spark.createDataFrame([(0, " The"), (1, "the"), (2, "zzz")], "query_id long, query string")
    sifted, sorted_rows = ranking.sifted, []

    def seen(*args):
        out = sifted(*args)
        sorted_rows.append(out.count())
        return out

    monkeypatch.setattr(pages, "sifted", seen)
    got = pages.reports_for_queries(queries, found, found.limit(0), limit=4)
    assert sorted_rows[0] <= 20 and sorted_rows[1] == 0
    assert sorted((r["query_id"], -1 if r["pos"] is None else r["pos"], r["url"]) for r in got.collect()) == [
        (0, -1, "u7"), (0, 0, "u0"), (0, 1, "u1"), (0, 2, "u2"), (1, 0, "u0"), (1, 1, "u1"), (1, 2, "u2"), (1, 3, "u3")]


def test_long_texts_are_screened_by_their_start(spark):
    """Cuts and signatures of long texts come from the start where that is enough; all screens give what whole texts give."""
    import re

    from riskgraph.functions import base as B
    from riskgraph.functions import fixed_values as V
    from riskgraph.functions import text as FT

    words = ["  \t", "word ", "a" * 700, " ", "", "Ā b", "SCAM", "LỪA ĐẢO", "lừa đảo", "sKam cooKies",
             "COOKIES", "Phone_Mentions", "İ tİmeout", "a1-", "x " * 400, " " * 900, "Ω̂ΣAΣ", "𝔸 𝔸", "\n"]
    texts = words + [a + b for a in words for b in words] + ["y" + " " * 2000 + "z 1", "w " * 24, "w " * 25, "m" * 320, "m" * 321]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r["i"]: r for r in rows.select(
        "i", "t", FT.collapse_truncate("t", 320).alias("cut"), FT.text_signature("t").alias("sig"),
        FT.is_schema_leak("t").alias("leak"), FT.has_technical_noise("t").alias("noise"),
        B.contains_any_folded("t", V.SCAM_KEYWORDS).alias("scam")).collect()}
    lower = str.maketrans(B.UPPER, B.LOWER)
    for i, t in enumerate(texts):
        flat, low = re.sub(r"\s+", " ", t).strip(" "), t.translate(lower)
        want = (flat[:320] + "..." if len(flat) > 320 else flat,
                " ".join(re.sub("[^a-z0-9]+", " ", low).strip().split(" ")[:24]),
                not t.strip() or any(w in low for w in V.SCHEMA_FIELD_MARKERS),
                any(w in low for w in V.TECHNICAL_MARKERS), any(w in low for w in V.SCAM_KEYWORDS))
        assert tuple(got[i])[2:] == want, t
    assert tuple(got[len(texts)])[2:] == (None,) * 5
    for words in (V.SCHEMA_FIELD_MARKERS, V.TECHNICAL_MARKERS, V.SCAM_KEYWORDS):
        assert all(w == w.translate(lower) and w == w.strip() for w in words)
    # no letter of a whole text is looked up in a map
    assert "translate" not in rows.select(FT.has_technical_noise("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_of_a_checkpoint_are_removed(spark):
    """Once it is written its shuffle files are gone; the rows, the setting and the frame it was made of stay."""
    import os
    import time

    def shuffled():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in folder for base, _, files in os.walk(top) for f in files
                if f.startswith("shuffle_") and f.endswith(".data")}

    rows = spark.range(5000).select((F.col("id") % 700).alias("k")).groupBy("k").count()
    setting, before = spark.conf.get(session.FREE_SHUFFLES, None), shuffled()
    cut = session.cut_lineage(rows)
    end = time.time() + 10  # files go in the background
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting
    for _ in range(2):
        assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, rows.collect()))
    assert shuffled() - before  # a frame that is collected keeps its own, so the look above sees them
