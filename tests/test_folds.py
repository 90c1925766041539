"""Set-based jobs against plain Python folds of the same rule on random inputs."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskgraph.functions.subjects import classify_value
from riskgraph.operators import graph, kb, prefix, triage
from riskgraph.streaming import admission, reports

T0 = datetime(2024, 1, 1)


def test_upsert_links_matches_row_by_row(spark):
    rng = random.Random(1)
    batches = [[(f"s{rng.randint(0, 4)}", f"s{rng.randint(5, 9)}", f"e{rng.randint(0, 12)}")
                for _ in range(60)] for _ in range(3)]
    batches[2] = batches[1] + batches[2][:5]
    strength, known = {}, defaultdict(set)
    for batch in batches:
        for a, b, e in batch:
            if (a, b) not in strength:
                strength[a, b] = 1.0
            elif e not in known[a, b]:
                strength[a, b] += 1
            known[a, b].add(e)
    from riskgraph import schemas as S

    links = spark.createDataFrame([], S.LINKS)
    ev = spark.createDataFrame([], S.LINK_EVIDENCE)
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame(
            [(a, b, "co_mentioned", e) for a, b, e in batch], S.LINK_EVIDENCE)
        links, ev = graph.upsert_links(
            links, ev, rows, F.lit(f"2024-01-0{i + 1}").cast("timestamp"))
    got = {(r["subject_a_id"], r["subject_b_id"]): r["strength"] for r in links.collect()}
    assert got == strength
    assert ev.count() == sum(len(v) for v in known.values())


def test_links_without_evidence_stay_at_one(spark):
    from riskgraph import schemas as S

    links = spark.createDataFrame([], S.LINKS)
    ev = spark.createDataFrame([], S.LINK_EVIDENCE)
    rows = spark.createDataFrame([("a", "b", "mentioned_together", None)] * 2, S.LINK_EVIDENCE)
    for _ in range(2):
        links, ev = graph.upsert_links(links, ev, rows, F.lit("2024-01-01").cast("timestamp"))
    assert [r["strength"] for r in links.collect()] == [1.0] and ev.count() == 0


def bfs(edges, root, depth):
    seen, frontier = {root: 0}, [root]
    for d in range(1, depth + 1):
        frontier = [y for x in frontier for y in edges[x] if y not in seen]
        for y in frontier:
            seen.setdefault(y, d)
    return seen


def test_network_matches_bfs(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)}
    pairs |= {(0, i) for i in range(1, 20)}  # a hub, and cycles
    edges = defaultdict(set)
    for a, b in pairs:
        edges[a].add(b)
        edges[b].add(a)
    ids = [f"n{i:02d}" for i in range(40)]
    links = spark.createDataFrame(
        [(ids[a], ids[b], "co_mentioned", 1.0) for a, b in pairs]
        + [(ids[a], ids[b], "mentioned_together", 1.0) for a, b in list(pairs)[:5]],
        "subject_a_id string, subject_b_id string, link_type string, strength double")
    subjects = spark.createDataFrame(
        [(i, i, "phone", "low", 0.1) for i in ids],
        "id string, value string, subject_type string, risk_level string, risk_score double")
    roots = spark.createDataFrame([(ids[0],), (ids[21],), (ids[39],), ("gone",)], "root_id string")
    for depth in (1, 2, 3, 9):
        nodes = graph.network_nodes(subjects, links, roots, depth)
        got = defaultdict(dict)
        for r in nodes.collect():
            got[r["root_id"]][r["id"]] = r["depth"]
        want = {ids[r]: {ids[k]: v for k, v in bfs(edges, r, min(depth, 3)).items()}
                for r in (0, 21, 39)}
        assert dict(got) == want
    got = {(r["root_id"], r["subject_a_id"], r["subject_b_id"], r["link_type"])
           for r in graph.network_edges(links, nodes).collect()}
    assert got == {
        (root, r["subject_a_id"], r["subject_b_id"], r["link_type"])
        for r in links.collect() for root, reach in want.items()
        if r["subject_a_id"] in reach and r["subject_b_id"] in reach}


def naive_admission(rows):
    state, out = defaultdict(list), {}
    for event, at, reporter, subject in sorted(rows, key=lambda r: (r[1], r[0])):
        live = [(t, s) for t, s in state[reporter] if t > at - timedelta(hours=24)]
        if len(live) >= 5:
            out[event] = "rate_limited"
        elif any(s == subject for _, s in live):
            out[event] = "duplicate"
        else:
            out[event] = "accepted"
            live.append((at, subject))
        state[reporter] = live
    return out


def submissions(spark, rows):
    return spark.createDataFrame(
        [(e, at, f"8.8.8.{r}", None, f"0900{s:06d}", "phone", "text", None)
         for e, at, r, s in rows],
        "event_id long, created_at timestamp, peer_ip string, forwarded_for string, value string, "
        "subject_type string, description string, category string")


def random_submissions(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for e in range(n):
        # reporter 0 sends half of everything; some gaps are exactly 24 hours
        reporter = 0 if rng.random() < 0.5 else rng.randint(1, 6)
        at = T0 + timedelta(hours=rng.choice([0, 24, 48, 500]) + rng.randint(0, 30),
                            minutes=rng.choice([0, 0, 30]))
        rows.append((e, at, reporter, rng.randint(0, 9)))
    return rows


def test_admission_matches_fold(spark):
    rows = random_submissions(3)
    got = {r["event_id"]: r["outcome"]
           for r in admission.admit_reports_batch(submissions(spark, rows)).collect()}
    assert got == naive_admission(rows)
    assert set(got.values()) == {"accepted", "duplicate", "rate_limited"}


def test_busy_reporters_match_fold(spark):
    rows = random_submissions(5, 900)
    # times on both sides of midnight and equal times within the day
    rows += [(1000 + i, T0 + timedelta(hours=20, seconds=i // 3), 7, i % 11) for i in range(60)]
    rows += [(2000 + i, T0 + timedelta(hours=44, seconds=i // 3), 7, (i * 7) % 13) for i in range(60)]
    want = naive_admission(rows)
    for busy in (1, 150):  # all reporters, and only the busiest
        got = {r["event_id"]: r["outcome"]
               for r in admission.admit_reports_batch(submissions(spark, rows), busy).collect()}
        assert got == want
    # each second day nothing; a day's last entry expires in a later day without reports
    one = [(i, T0 + timedelta(days=2 * (i // 40), minutes=17 * (i % 40)), 1, i % 9) for i in range(160)]
    got = {r["event_id"]: r["outcome"] for r in admission.admit_reports_batch(submissions(spark, one), 1).collect()}
    assert got == naive_admission(one)


def test_a_busy_reporter_uses_all_tasks(spark):
    """All rows of one reporter on one day: every stage over them has several tasks with work."""
    rows = spark.range(200_000).select(
        F.col("id").alias("event_id"), F.lit("r").alias("reporter_ip_hash"),
        F.concat(F.lit("s"), F.col("id") % 5000).alias("subject_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 100_000).alias("created_at"),
        (F.lit(1_700_000_000_000_000) + F.col("id") * 100_000).alias("__us"))
    keep = ["event_id", "reporter_ip_hash", "subject_id", "created_at"]
    out = admission._settle_days(rows, ["r"], keep)
    got = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert got == {"accepted": 5, "rate_limited": 199_995}
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_admission_rejects_and_touches(spark):
    df = submissions(spark, [(1, T0, 1, 1), (2, T0 + timedelta(minutes=1), 1, 1)])
    bad = df.withColumn("description", F.lit("đ" * 1001)).withColumn("event_id", F.col("event_id") + 10)
    out = admission.admit_reports_batch(df.unionByName(bad))
    got = {r["event_id"]: r["outcome"] for r in out.collect()}
    assert got == {1: "accepted", 2: "duplicate", 11: "invalid:description_too_long",
                   12: "invalid:description_too_long"}
    seen = admission.touched_subjects(out).collect()
    assert [r["seen_at"] for r in seen] == [T0 + timedelta(minutes=1)]


def test_failure_state_matches_fold(spark):
    rng = random.Random(4)
    log = [(f"u{rng.choice([0, 0, 0, 1, 2])}", T0 + timedelta(minutes=13 * i), rng.random() < 0.3, "p", f"m{i}")
           for i in range(200)]
    open_, done = {}, []
    for url, at, ok, phase, message in log:
        if ok:
            for row in done:
                if row["url"] == url:
                    row["updated"] = at
            if url in open_:
                row = open_.pop(url)
                row.update(resolved=True, updated=at)
                done.append(row)
        elif url in open_:
            open_[url].update(retry=open_[url]["retry"] + 1, message=message, updated=at)
        else:
            open_[url] = dict(url=url, retry=0, message=message, resolved=False, created=at, updated=at)
    want = {(r["url"], r["created"], r["retry"], r["message"], r["resolved"], r["updated"])
            for r in done + list(open_.values())}
    df = spark.createDataFrame(log, "url string, ts timestamp, ok boolean, phase string, message string")
    got = {(r["url"], r["created_at"], r["retry_count"], r["error_message"], r["resolved"], r["updated_at"])
           for r in kb.failure_state(df).collect()}
    assert got == want


def test_value_at_rank(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.choice([0, 1, -3, 7, rng.randint(-500, 9000)])))
            for k in "ab" for _ in range(rng.randint(50, 400))] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for ratio in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for k in "abc":
            v = sorted(x for key, x in rows if key == k)
            want[k] = v[min(len(v) - 1, int(len(v) * ratio))]
        got = {r["k"]: r["x"] for r in prefix.value_at_rank(df, ["k"], "v", ratio, "x").collect()}
        assert got == want


def test_chunks_match_fold(spark):
    rng = random.Random(6)
    rows = [(f"i{i}", s, f"<{s}>", rng.random() < 0.1, rng.random() < 0.2)
            for i in range(30) for s in range(rng.randint(1, 15))]
    text, closed = {}, set()
    for inv, _, chunk, done, replace in rows:
        if inv in closed:
            continue
        text[inv] = chunk if replace else text.get(inv, "") + chunk
        if done:
            closed.add(inv)
    df = spark.createDataFrame(
        rows, "investigation_id string, seq long, chunk string, done boolean, replace boolean")
    got = {r["investigation_id"]: (r["text"], r["complete"])
           for r in reports.assemble_reports_batch(df).collect()}
    assert got == {k: (v, k in closed) for k, v in text.items()}


def test_long_report_is_one_row(spark):
    df = spark.range(25_000).select(
        F.lit("i").alias("investigation_id"), (F.col("id") + 7_000).alias("seq"),
        F.lit("x").alias("chunk"), F.lit(False).alias("done"), F.lit(False).alias("replace"))
    [row] = reports.assemble_reports_batch(df).collect()
    assert (row["text"], row["n_chunks"]) == ("x" * 25_000, 25_000)


def candidates(spark, rows):
    return spark.createDataFrame(
        rows, "query_id long, rank int, title string, url string, snippet string")


def test_fallback_targets(spark):
    rows = [(1, 1, "A", "https://x.com/post?srsltid=aaa", "one"),
            (1, 2, "B", "https://x.com/post?srsltid=bbb&utm_source=x", "two"),
            (1, 3, "C", "https://x.com/file.pdf?srsltid=ccc", "three"),
            (1, 4, "a", "https://y.com/other", "ONE"),
            (1, 5, "Hướng dẫn", "https://z.com/", "cách")]
    got = triage.fallback_targets(candidates(spark, rows)).collect()
    assert [(r["url"], r["priority"]) for r in got] == [("https://x.com/post?srsltid=aaa", 1)]


def test_chosen_targets_reserve_their_url(spark):
    cand = candidates(spark, [
        (1, 1, "same", "https://a.com/1", "text"), (1, 2, "same", "https://b.com/1", "text"),
        (1, 3, "other", "https://c.com/1", "x"), (2, 1, "only", "https://d.com/1", "y")])
    chosen = spark.createDataFrame(
        [(1, 1, "https://b.com/1#x", "m"), (1, 2, "https://a.com/1", "m"),
         (1, 3, "https://not-listed.com/", "m"), (2, 1, "https://not-listed.com/", "m")],
        "query_id long, pos int, url string, reason string")
    got = triage.select_targets(cand, chosen).orderBy("query_id", "priority").collect()
    assert [(r["query_id"], r["url"], r["reason"], r["priority"]) for r in got] == [
        (1, "https://b.com/1#x", "m", 1), (2, "https://d.com/1", "fallback", 1)]


def test_engines(spark):
    results = spark.createDataFrame(
        [(1, 1, 0, "0926408013 lừa", "https://a.com/x", ""), (1, 1, 1, "chung", "https://b.com/x", ""),
         (1, 2, 0, "0926408013", "https://c.com/x", ""), (1, 2, 1, "0926408013", "https://a.com/x#f", "")],
        "query_id long, engine int, pos int, title string, url string, snippet string")
    queries = spark.createDataFrame([(1, "0926408013", "phone")],
                                    "query_id long, query string, query_type string")
    got = triage.select_candidates(results, queries).orderBy("rank").collect()
    assert [(r["engine"], r["url"]) for r in got] == [(1, "https://a.com/x"), (2, "https://c.com/x")]


def test_investigation_mentions(spark):
    df = spark.sql("""SELECT 'me' AS subject_id, '0912345678' AS query, 'phone' AS query_type,
      array(named_struct('phone_mentions', array('0912 345 678', '84 912 345 679', 'x'))) AS summaries,
      array(named_struct('related_numbers', array('12345678', '1234 5678', 'https://A.vn/'))) AS extractions""")
    got = {(r["subject_type"], r["value"]) for r in graph.investigation_mentions(df).collect()}
    assert got == {("phone", "84912345679"), ("bank", "12345678"), ("url", "https://a.vn")}
    assert spark.range(1).select(classify_value(F.lit("x")).alias("c")).first()["c"] is None


def test_hub_join_equals_plain_join_in_even_tasks(spark):
    from pyspark.sql import functions as F

    from riskgraph.operators.hubs import heavy_keys, split_join

    rng = random.Random(8)
    rows = [("hub", f"d{k}") for k in range(20_000)] + [(f"k{rng.randrange(4000)}", f"d{k}") for k in range(20_000)] + [(None, "x")]
    many = spark.createDataFrame(rows, "src string, dst string")
    few = spark.createDataFrame(
        [("hub", 1), ("hub", 2)] + [(f"k{k}", k) for k in range(0, 4000, 2)] + [("absent", 0), (None, 5)], "src string, root int")
    assert [r["hash"] for r in heavy_keys(many, ["src"]).collect()] == [
        r[0] for r in spark.range(1).select(F.xxhash64(F.lit("hub"))).collect()]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = split_join(many, few, ["src"], F.col("dst"))
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
        for how in ("inner", "left", "left_semi"):
            got = split_join(many, few, ["src"], F.col("dst"), how=how)
            want = many.join(few, "src", how)
            assert got.columns == want.columns
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    empty = many.limit(0)
    assert heavy_keys(empty, ["src"]).count() == 0 and split_join(empty, few, ["src"], F.col("dst")).count() == 0
