"""Ingest plans, snapshots, reuse: repeatable, resumable, correct risk."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph import schemas as S
from riskgraph.functions.subjects import subject_id
from riskgraph.operators import history, kb, models, risk, summaries
from riskgraph.plans import ingest_blacklist as IB
from riskgraph.plans import ingest_posts as IP
from riskgraph.plans import investigate as INV
from riskgraph.sources import change_log, readers
from riskgraph.sources.snapshots import (
    read_snapshot, read_tables, versions, write_snapshot, write_tables,
)
from riskgraph.streaming import ingest

NOW = datetime(2024, 3, 1)


@pytest.fixture
def empty(spark):
    return {n: spark.createDataFrame([], s) for n, s in S.TABLES.items()}


def post(i, phone, account, image="a", count=6):
    html = (f'<p>Chủ tk: An. STK: {account} SĐT: {phone} Ngân hàng: ACB Hạng mục: x đã bị cảnh báo '
            f'{count} lần</p><a class="gallery" href="https://checkscam.vn/wp-content/uploads/{image}.jpg">i</a>')
    return (i, f"https://checkscam.vn/p{i}/", "t", html, "2024-01-01")


def posts(spark, *rows):
    return spark.createDataFrame(rows, "id long, link string, title string, html string, date string")


def files(spark, *names):
    return spark.createDataFrame(
        [(f"https://checkscam.vn/wp-content/uploads/{n}.jpg", f"m/{n}", "image/jpeg", 10) for n in names],
        "original_url string, file_path string, content_type string, file_size_bytes long")


def rows(df, *cols, drop_time=True):
    return sorted(map(tuple, df.select(*cols).collect()))


def saved(spark, tables, base):
    write_tables(tables, base)
    return read_tables(spark, base)


def test_posts_twice_equals_once(spark, empty, tmp_path):
    batch = posts(spark, post(1, "0912345678", "123456"), post(2, "0912345678", "999999", "b", 1),
                  (3, "l3", "t", "<p>nothing", "2024-01-01"))
    out, stats = IP.ingest_posts(empty, batch, NOW, files(spark, "a"))
    first = saved(spark, out, str(tmp_path / "kb"))
    s = stats.first()
    assert (s["posts_discovered"], s["posts_processed"], s["posts_skipped"], s["subjects_upserted"]) == (
        3, 2, 1, 4)
    assert (s["evidence_inserted"], s["evidence_updated"], s["media_downloaded"], s["media_attached"]) == (
        4, 0, 2, 2)
    again, stats = IP.ingest_posts(first, batch, NOW + timedelta(days=1), files(spark, "a", "b"))
    second = saved(spark, again, str(tmp_path / "kb2"))
    s = stats.first()
    assert (s["evidence_inserted"], s["evidence_updated"], s["media_attached"]) == (0, 4, 2)
    for table, cols in {
        "subjects": ["id", "value", "risk_score", "risk_level", "first_seen_at"],
        "evidence": ["id", "subject_id", "data", "created_at"],
        "subject_links": ["subject_a_id", "subject_b_id", "strength"],
        "link_evidence": ["subject_a_id", "subject_b_id", "evidence_id"],
    }.items():
        assert rows(first[table], *cols) == rows(second[table], *cols), table
    got = {r["value"]: (r["risk_score"], r["risk_level"]) for r in first["subjects"].collect()}
    assert got == {"0912345678": (0.75, "high"), "123456": (0.75, "high"), "999999": (0.35, "medium")}
    assert {r["strength"] for r in first["subject_links"].collect()} == {2.0}
    assert first["media"].count() == 2 and second["media"].count() == 4
    assert first["crawl_log"].where(~F.col("ok")).count() == 1
    queue = kb.retry_queue(kb.failure_state(first["crawl_log"])).collect()
    assert [r["url"] for r in queue] == ["https://checkscam.vn/wp-content/uploads/b.jpg"]


def test_failed_posts_are_tried_again(spark, empty, tmp_path, monkeypatch):
    gone = (2, "https://checkscam.vn/p2/", "STK 123456789", None, "2024-01-01")
    batch = posts(spark, post(1, "0912345678", "123456"), gone, (3, "https://checkscam.vn/p3/", "t", None, "2024-01-01"))
    out, stats = IP.ingest_posts(empty, batch, NOW, files(spark, "a"))
    s = stats.first()
    assert (s["posts_discovered"], s["posts_processed"], s["post_errors"]) == (3, 1, 1 + 1)
    # both subjects of the post name each other in their evidence, and both get a new risk
    assert (s["links_created"], s["risk_updated"]) == (2, 2)
    first = saved(spark, out, str(tmp_path / "kb"))
    assert rows(kb.retry_queue(kb.failure_state(first["crawl_log"])), "url", "retry_count") == [
        ("https://checkscam.vn/p2/", 0), ("https://checkscam.vn/p3/", 0)]
    now = posts(spark, post(1, "0999999999", "777777"), post(2, "0987654321", "999999"), post(4, "0988888888", "888888"))
    later = NOW + timedelta(days=1)
    for named in (IP.NAMED_URLS, 1):  # in the filter, and joined
        monkeypatch.setattr(IP, "NAMED_URLS", named)
        tables, counts = IP.retry_failures(first, now, later, files(spark, "a"))
        assert tuple(counts.first()) == (1, 1)
        # only the failed post was read: nothing of the others is new
        assert {r["value"] for r in tables["subjects"].collect()} == {"0912345678", "123456", "0987654321", "999999"}
        got = rows(kb.failure_state(tables["crawl_log"]), "url", "retry_count", "resolved")
        assert got == [("https://checkscam.vn/p2/", 0, True), ("https://checkscam.vn/p3/", 1, False)]
    second = saved(spark, tables, str(tmp_path / "kb2"))
    tables, counts = IP.retry_failures(second, posts(spark, post(3, "0977777777", "666666")), later + timedelta(days=1),
                                       files(spark, "a"))
    assert tuple(counts.first()) == (1, 0)
    assert kb.retry_queue(kb.failure_state(tables["crawl_log"])).count() == 0


def test_resume_skips_complete_posts(spark, empty, tmp_path):
    batch = posts(spark, post(1, "0912345678", "123456"), post(2, "0987654321", "999999", "b"))
    out, _ = IP.ingest_posts(empty, batch, NOW, files(spark, "a"))
    stored = saved(spark, out, str(tmp_path / "kb"))
    _, stats = IP.ingest_posts(stored, batch, NOW, resume=True, dry_run=True)
    s = stats.first()
    # the picture of the second post is missing
    assert (s["posts_processed"], s["posts_skipped"]) == (1, 1)


def test_blacklist_twice_equals_once(spark, empty, tmp_path):
    records = spark.createDataFrame(
        [("HTTP://Bad.vn/", "web", None, "Đã xử lý", None, "ACB", None, None, "p1"),
         ("http://bad.vn", "web", None, "Mới", None, "Chưa xác định", None, None, "p2")],
        "fake_url string, fake_type string, detected_at string, status_text string, status_class string, "
        "org_name string, org_detail_url string, org_logo_url string, listing_page string")
    out, stats = IB.ingest_blacklist(empty, records, NOW)
    first = saved(spark, out, str(tmp_path / "kb"))
    assert tuple(stats.first()) == (2, 2, 2, 1)
    second = saved(spark, IB.ingest_blacklist(first, records, NOW)[0], str(tmp_path / "kb2"))
    for table in ("subjects", "evidence", "subject_links"):
        assert first[table].count() == second[table].count()
    got = {(r["value"], r["subject_type"]): (r["risk_score"], r["risk_level"])
           for r in second["subjects"].collect()}
    assert got == {("http://bad.vn", "url"): (0.95, "critical"), ("ACB", "organization"): (0.0, "unknown")}
    assert second["evidence"].count() == 2
    assert IB.ingest_blacklist(first, records, NOW, dry_run=True)[0] is first


def finished(spark, *items):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame(
        items, "investigation_id string, query string, query_type string, risk_level string, confidence double, ok boolean, mention string")
    summary = F.struct(F.lit("A").alias("source"), F.lit("s").alias("summary"), none.alias("key_facts"),
                       F.array("mention").alias("phone_mentions"), F.array(F.lit("r")).alias("risk_signals"),
                       none.alias("evidence_urls"))
    result = F.struct(
        F.lit("A").alias("source"), F.col("query").alias("query"), F.col("ok").alias("success"),
        F.array().cast(S.SOURCE_RESULT["reports"].dataType).alias("reports"),
        F.array().cast(S.SOURCE_RESULT["search_results"].dataType).alias("search_results"),
        F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("raw_html"),
        F.lit(1).cast("bigint").alias("duration_ms"), F.lit(None).cast("string").alias("error"))
    return df.select(
        "investigation_id", "query", "query_type", "risk_level", "confidence",
        F.lit(1).alias("sources_analyzed"), F.lit(9).cast("bigint").alias("duration_ms"),
        F.array(summary).alias("summaries"),
        F.array().cast(S.INVESTIGATION_RESULT["extractions"].dataType).alias("extractions"),
        F.lit("# report").alias("detective_markdown"), F.array(result).alias("scraped_results"))


def test_investigations(spark, empty, tmp_path):
    batch = finished(spark, ("i1", "0912345678", "phone", "high", 0.9, True, "0987654321"),
                     ("i2", "0911111111", "phone", "high", 0.1, False, "0987654321"))
    out = INV.ingest_investigations(empty, batch, NOW)
    first = saved(spark, out, str(tmp_path / "kb"))
    got = {r["value"]: (r["risk_score"], r["risk_level"], r["investigation_count"])
           for r in first["subjects"].collect()}
    # the second one fails the quality gate
    assert got == {"0912345678": (0.8, "critical", 1), "0987654321": (0.0, "unknown", 0)}
    assert [tuple(r) for r in first["subject_links"].select("link_type", "strength").collect()] == [
        ("mentioned_together", 1.0)]
    doubled = INV.ingest_investigations(empty, batch.unionByName(batch), NOW)
    for name in ("subjects", "investigations", "evidence", "subject_links"):
        assert sorted(map(str, doubled[name].collect())) == sorted(map(str, out[name].collect())), name
    again = INV.ingest_investigations(first, batch, NOW)
    assert again["evidence"].count() == 1 and again["investigations"].count() == 1
    assert again["subjects"].agg(F.sum("investigation_count")).first()[0] == 1


def test_stream_ingest(spark, empty, tmp_path):
    base, src = str(tmp_path / "kb"), str(tmp_path / "in")
    write_tables(empty, base)
    finished(spark, ("i1", "0912345678", "phone", "high", 0.9, True, "0987654321")).write.json(src)
    for _ in range(2):
        ingest.ingest_stream(spark, src, base, str(tmp_path / "cp"), lambda: NOW).awaitTermination(120)
        finished(spark, ("i2", "0912345678", "phone", "low", 0.9, True, "x")).write.mode("append").json(src)
    tables = read_tables(spark, base)
    assert tables["subjects"].where(F.col("value") == "0912345678").first()["investigation_count"] == 2
    # handing over the first batch again adds nothing
    ingest.ingest_batch(base, lambda: NOW)(
        finished(spark, ("i1", "0912345678", "phone", "high", 0.9, True, "0987654321")), 0)
    assert read_tables(spark, base)["investigations"].count() == 2


def test_snapshots_ignore_unfinished_versions(spark, tmp_path):
    base = str(tmp_path)
    write_snapshot(spark.range(3), base, "t")
    write_snapshot(spark.range(5), base, "t")
    (tmp_path / "t" / "v000009").mkdir()
    assert versions(spark, base, "t") == [1, 2]
    assert read_snapshot(spark, base, "t").count() == 5
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, base, "none")


def test_tables_change_together(spark, empty, tmp_path):
    base = str(tmp_path)
    subjects = spark.createDataFrame([("s", "v", "url", 0.5, "medium", 0, 0, NOW, NOW)], S.SUBJECTS)
    write_tables({"subjects": subjects, "media": empty["media"]}, base)
    # a job that died before its manifest
    write_snapshot(empty["subjects"], base, "subjects")
    assert read_tables(spark, base)["subjects"].count() == 1
    write_tables({"subjects": subjects.unionByName(subjects)}, base)
    tables = read_tables(spark, base)
    assert tables["subjects"].count() == 2 and tables["media"].count() == 0
    assert versions(spark, base, "subjects") == [1, 2, 3]


def test_floors_are_lost_unless_asked(spark, empty):
    subjects = spark.createDataFrame(
        [("s", "v", "url", 0.95, "critical", 0, 0, NOW, NOW)], S.SUBJECTS)
    evidence = spark.createDataFrame(
        [("e", "s", None, "checkscam_crawl", "x", '{"report_count": "12"}', [], [], NOW)], S.EVIDENCE)
    args = (subjects, empty["investigations"], empty["user_reports"])
    assert risk.recalculate_risk(*args).first()["risk_score"] == 0.0
    kept = risk.recalculate_risk(*args, evidence=evidence, with_floors=True).first()
    assert (kept["risk_score"], kept["risk_level"]) == (0.9, "critical")


def test_history_payload(spark, empty):
    import json

    subjects = spark.createDataFrame(
        [(i, i, "phone", 0.5, "medium", 0, 1, NOW, NOW) for i in "ab"], S.SUBJECTS)
    reports = spark.createDataFrame(
        [(f"r{i}", "a", "h", f"d{i}", None, "approved", None, None, NOW + timedelta(hours=i))
         for i in range(7)], S.REPORTS)
    links = spark.createDataFrame([("a", "b", "co_mentioned", 2.0, NOW, NOW)], S.LINKS)
    evidence = spark.createDataFrame(
        [("e", "a", None, "x", "x", "{}", [f"s{i:02d}" for i in range(20)], [], NOW)], S.EVIDENCE)
    out = history.history_payload(subjects, empty["investigations"], reports, links, evidence)
    a = json.loads(out.where("id = 'a'").first()["payload"])
    assert a["summary"]["approved_reports"] == 7 and a["summary"]["last_risk_level"] == "medium"
    assert [r["description"] for r in a["approved_reports"]] == ["d6", "d5", "d4", "d3", "d2"]
    assert [x["value"] for x in a["linked_subjects"]] == ["b"]
    assert a["risk_signals"] == [f"s{i:02d}" for i in range(12)]
    b = json.loads(out.where("id = 'b'").first()["payload"])
    assert b["approved_reports"] == [] and b["risk_signals"] == []
    q = spark.createDataFrame([(1, "a", "phone"), (2, "zz", "phone")], "query_id int, query string, query_type string")
    q = q.withColumn("query", F.lit("1"))
    known = subjects.withColumn("value", F.lit("1")).where("id = 'a'")
    assert history.with_history(q, known, out).where("payload IS NOT NULL").count() == 2


def test_scoring_retries_and_isolates(spark):
    reuse = spark.createDataFrame([], S.REUSE)
    inputs = spark.createDataFrame(
        [(str(i), "a", "p", "bad" if i == 3 else f"in{i}") for i in range(6)],
        "query string, agent_name string, prompt_hash string, input string").coalesce(1)

    def fn(pdf):
        if (pdf["input"] == "bad").any():
            raise ValueError("no")
        return pdf.assign(result=['{"x":1}'] * len(pdf))

    scored, stored = models.score_with(inputs, fn, reuse, NOW)
    got = {r["query"]: r["result"] for r in scored.collect()}
    assert got.pop("3") is None and set(got.values()) == {'{"x":1}'}
    again, _ = models.score_with(inputs, fn, stored, NOW + timedelta(minutes=30))
    assert {r["query"] for r in again.where("reused").collect()} == set(got)
    late, _ = models.score_with(inputs, fn, stored, NOW + timedelta(hours=1))
    assert late.where("reused").count() == 0


def test_refresh_job_stores_and_retires(spark, empty, tmp_path):
    base = str(tmp_path / "store")
    cache = spark.createDataFrame(
        [("q", "a", "p", "h", "{}", NOW, NOW + timedelta(hours=h)) for h in (-1, 1)], S.REUSE)
    write_tables({"analysis_cache": cache}, base)
    for _ in range(4):
        ingest.run_refresh(spark, base, NOW, keep=2)
    assert read_tables(spark, base)["analysis_cache"].count() == 1
    assert len(versions(spark, base, "analysis_cache")) == 2


def test_model_runs_once_per_key(spark, tmp_path):
    """400 inputs, two query ids per key: each key is scored once whatever is done with the outputs."""
    log = tmp_path / "calls"
    log.write_text("")
    inputs = spark.createDataFrame(
        [(i, str(i % 200), "a", "p", f"in{i % 200}", "x") for i in range(400)],
        "query_id long, query string, agent_name string, prompt_hash string, input string, result_note string")
    reuse = spark.createDataFrame([], S.REUSE)

    def fn(pdf):
        with open(log, "a") as f:
            f.write("".join(f"{q}\n" for q in pdf["query"]))
        return pdf.assign(result=[f'{{"q":{q}}}' for q in pdf["query"]])

    scored, stored = models.score_with(inputs, fn, reuse, NOW)
    rows = scored.collect()
    assert stored.count() == 200 and len(rows) == 400
    assert {(r["query_id"], r["result"], r["result_note"]) for r in rows} == {
        (i, f'{{"q":{i % 200}}}', "x") for i in range(400)}
    assert len(log.read_text().split()) == 200


def test_model_output_readings(spark):
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.IntegerType()),
                           T.StructField("items", T.ArrayType(T.StringType()))])
    cases = {
        '{"url": "a", "n": 1}': ("a", 1, None), '{"other": 1}': None,
        '{"url": "a", "n": "no"}': None, '{"url": "a \\" {[", "items": ["x"], "n"': ('a " {[', None, ["x"]),
        '{"url": "a", "items": ["x", "]': ("a", None, ["x"]), '{"url": "a", "items": ["x"': None,
        '{"url": "a",}': ("a", None, None), "none": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in models.parse_model_output(df, "raw", schema).collect():
        got = r["parsed"] and tuple(r["parsed"])
        assert got == cases[r["raw"]], r["raw"]


def test_compact_payload(spark):
    cases = {
        '{"b": "  x  y ", "a": [1, 2, 3], "c": 1}': '{"a":["1","2"],"b":"x y"}',
        '{"a": {"x": {"y": "z"}}}': '{"a":{"x":"{\\"y\\":\\"z\\"..."}}',
        '["q\\"uote", null, 3]': '["q\\"uote",null]', '"toolongtext"': '"toolongt..."', "5": "5", "no json": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["out"] for r in summaries.compact_payload(df, "p", 8, 2, 2, "out").collect()}
    assert got == cases


def test_media_files(spark, tmp_path):
    for name, data in [("a.jpg", b"1"), ("b.png", b"1"), ("c.gif", b"22")]:
        (tmp_path / name).write_bytes(data)
    got = readers.read_media(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["ext"], r["file_size_bytes"]) for r in got] == [("jpg", 1), ("gif", 2)]
    assert all(r["file_path"].endswith(r["ext"]) and len(r["sha"]) == 64 for r in got)


def test_post_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(
        '[{"id":2,"link":"l2","title":{"rendered":"T2"},"content":{"rendered":"<title>P</title>x"},"date":"2024-01-02"},'
        '{"id":1,"link":"l1","title":{"rendered":"T1"},"content":{"rendered":"y"},"date":"2024-01-01"}]')
    (tmp_path / "2.json").write_text("[]")
    assert readers.read_posts(spark, str(tmp_path)).count() == 2
    assert readers.read_posts(spark, str(tmp_path), max_posts=1).first()["id"] == 1
    assert readers.read_posts(spark, str(tmp_path), url="l2").first()["title"] == "P"


def test_listing_range(spark):
    df = spark.createDataFrame([("web", i) for i in range(1, 9)] + [("social", 1)], "fake_type string, page int")
    assert readers.listing_range(df, "web", 3, 2).count() == 2
    assert readers.listing_range(df).count() == 9


def test_cascades(spark, empty):
    tables = {**empty,
              "subjects": spark.createDataFrame([("a", "a", "phone", 0.0, "low", 0, 0, NOW, NOW)], S.SUBJECTS),
              "subject_links": spark.createDataFrame([("a", "b", "x", 1.0, NOW, NOW)], S.LINKS),
              "evidence": spark.createDataFrame(
                  [("e", "z", "i", "s", "t", "{}", [], [], NOW)], S.EVIDENCE)}
    ids = spark.createDataFrame([("a",)], "id string")
    out = kb.drop_subjects(tables, ids)
    assert out["subjects"].count() == 0 and out["subject_links"].count() == 0 and out["evidence"].count() == 1
    gone = kb.drop_investigations(tables, spark.createDataFrame([("i",)], "id string"))
    assert gone["evidence"].first()["investigation_id"] is None


def test_investigate_without_models(spark):
    results = spark.createDataFrame(
        [(1, "Google", "0926408013", True, [], [("0926408013 bị tố", "https://a.com/x/y", "lừa đảo")], None, 5, None),
         (1, "CheckScam", "0926408013", True, [("T", "https://c/1", "Nội dung", None)], [], '{"report_count": 4}', 5, None),
         (1, "AdminVN", "0926408013", False, [], [], None, 5, "x")],
        "query_id long, source string, query string, success boolean, "
        "reports array<struct<title:string,url:string,content:string,date:string>>, "
        "search_results array<struct<title:string,url:string,snippet:string>>, metadata string, "
        "duration_ms long, error string")
    queries = spark.createDataFrame([(1, "0926408013", "phone")], "query_id long, query string, query_type string")
    pages = spark.createDataFrame([("https://a.com/x/y", "<body>text</body>"), ("https://b/", "x")],
                                  "url string, html string")
    out = INV.investigate(queries, results, pages)
    assert [r["url"] for r in out["targets"].collect()] == ["https://a.com/x/y"]
    assert [r["content"] for r in out["page_texts"].collect()] == ["text"]
    v = out["verdicts"].first()
    assert (v["total_found"], v["ok_sources"], v["risk_level"], v["confidence"]) == (5, 2, "high", 0.75)
    assert out["summaries"].count() == 2
    base = {r["source"]: r for r in summaries.baseline_summaries(results).collect()}
    assert base["CheckScam"]["summary"].startswith("Nguồn CheckScam ghi nhận 4 mục liên quan.")
    assert base["CheckScam"]["risk_signals"] == ["Nguồn CheckScam có 4 mục liên quan cần điều tra sâu hơn."]


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def many_investigations(spark, first, n):
    return finished(spark, *((f"i{k}", f"09{k:08d}", "phone", "high", 0.9, True, f"08{k % 50:08d}") for k in range(first, first + n)))


def test_change_log_grows_by_its_changes(spark, empty, tmp_path):
    base = str(tmp_path / "log")
    ingest.ingest_changes(base, lambda: NOW)(many_investigations(spark, 0, 3000), 0)
    large = folder_bytes(tmp_path / "log")
    at = change_log.state(spark, base)
    assert at["version"] == 1 and at["streams"] == {"investigations": 0}
    later = NOW + timedelta(days=1)
    ingest.ingest_changes(base, lambda: later)(many_investigations(spark, 3000, 5), 1)
    assert folder_bytes(tmp_path / "log") - large < 0.2 * large
    # the same rows as one plan over whole tables, also once compacted
    step = INV.ingest_investigations(saved(spark, INV.ingest_investigations(
        empty, many_investigations(spark, 0, 3000), NOW), str(tmp_path / "kb")), many_investigations(spark, 3000, 5), later)
    changed = ("subjects", "investigations", "evidence", "subject_links", "link_evidence")
    want = {n: sorted(map(str, step[n].select(*S.TABLES[n].fieldNames()).collect())) for n in changed}
    for _ in range(2):
        got = change_log.read_all(spark, base)
        assert {n: sorted(map(str, got[n].collect())) for n in changed} == want
        change_log.compact(spark, base, 1)
    assert change_log.state(spark, base)["version"] == 3
    buckets = [change_log.read(spark, base, "subjects", buckets=[b]).count() for b in range(change_log.BUCKETS)]
    assert sum(buckets) == len(want["subjects"]) and max(buckets) < 0.1 * sum(buckets)
    # a batch that comes again changes nothing
    before = change_log.state(spark, base)
    ingest.ingest_changes(base, lambda: later + timedelta(days=9))(many_investigations(spark, 3000, 5), 1)
    assert change_log.state(spark, base) == before


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    base, keys = str(tmp_path / "log"), {"t": ["id"]}
    row = lambda i, v, gone=False: {"t": spark.createDataFrame([(i, v, gone)], "id long, v string, gone boolean")}
    change_log.commit(spark, base, 0, row(1, "a"), keys)
    with pytest.raises(change_log.Conflict):
        change_log.commit(spark, base, 0, row(2, "late"), keys)
    # both have read version 1; the other's entry comes between this one's look and its own entry
    real = change_log.state
    seen = real(spark, base)
    change_log.commit(spark, base, 1, row(1, "b"), keys)
    monkeypatch.setattr(change_log, "state", lambda *_: seen)
    with pytest.raises(change_log.Conflict):
        change_log.commit(spark, base, 1, row(3, "lost"), keys)
    monkeypatch.setattr(change_log, "state", real)
    assert [tuple(r) for r in change_log.read(spark, base, "t", keys=["id"]).collect()] == [(1, "b")]
    assert not [f for f in (tmp_path / "log" / "_log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    change_log.commit(spark, base, 2, row(1, None, True), keys)
    assert change_log.read(spark, base, "t", keys=["id"]).count() == 0


def test_stream_into_a_change_log(spark, tmp_path):
    base, src = str(tmp_path / "log"), str(tmp_path / "in")
    for k in range(2):
        finished(spark, (f"i{k}", "0912345678", "phone", "high", 0.9, True, "0987654321")).write.mode("append").json(src)
        ingest.ingest_stream(spark, src, base, str(tmp_path / "cp"), lambda: NOW, batch=ingest.ingest_changes).awaitTermination(120)
    tables = change_log.read_all(spark, base)
    assert tables["investigations"].count() == 2
    assert tables["subjects"].where(F.col("value") == "0912345678").first()["investigation_count"] == 2


def test_links_of_two_halves_equal_one_pass(spark, empty):
    import random

    rng = random.Random(5)
    value = lambda i: f"09{i:08d}"
    ids = {i: spark.range(1).select(subject_id(F.lit("phone"), F.lit(value(i)))).first()[0] for i in range(12)}
    subjects = spark.createDataFrame(
        [(ids[i], value(i), "phone", 0.0, "unknown", 0, 0, NOW, NOW) for i in range(12)], S.SUBJECTS)
    evidence = spark.createDataFrame(
        [(f"e{k}", ids[rng.randrange(12)], None, "checkscam_crawl" if k % 9 else "other", "external_report",
          f'{{"report_count": "{rng.randrange(15)}"}}', [],
          [f"phone:{value(rng.randrange(15))}" for _ in range(rng.randrange(4))], NOW) for k in range(200)], S.EVIDENCE)
    reports = spark.createDataFrame(
        [(f"r{i}", ids[i], "h", "d", "c", "approved", None, None, NOW) for i in range(0, 12, 2)], S.REPORTS)
    stored = {**empty, "user_reports": reports}
    whole = IP.link_pass({**stored, "subjects": subjects, "evidence": evidence}, NOW)
    # the second half brings evidence and subjects, and replaces some of the first half's rows
    early = F.substring("id", 2, 9).cast("int") < 120
    again = F.substring("id", 2, 9).cast("int").between(100, 110)
    old = evidence.where(early).withColumn(
        "mentioned_subjects", F.when(again, F.array().cast("array<string>")).otherwise(F.col("mentioned_subjects")))
    known = subjects.where(F.col("value") < value(8))
    fresh = subjects.where(F.col("value") >= value(8))
    nothing = IP.with_indexes(stored)
    first = IP.link_changes({**nothing, "subjects": known}, old, known, NOW)
    first = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in first.items()}
    del first["evidence"]
    second = IP.link_changes(
        {**first, "subjects": first["subjects"].unionByName(fresh)}, evidence.where(~early | again), fresh, NOW)
    for table in ("subjects", "subject_links", "link_evidence"):
        assert sorted(map(str, second[table].collect())) == sorted(map(str, whole[table].collect())), table
    assert whole["subject_links"].count() > 30
    want = IP.with_indexes({**stored, "evidence": evidence})
    for name in S.INDEXES:
        assert sorted(map(str, second[name].collect())) == sorted(map(str, want[name].collect())), name


def test_posts_with_indexes_equal_posts_without(spark, empty):
    halves = [posts(spark, post(1, "0912345678", "123456"), post(2, "0912345678", "999999", "b", 1)),
              posts(spark, post(3, "0987654321", "123456", "c", 9), post(1, "0912345678", "123456", "a", 12))]
    plain, indexed = empty, IP.with_indexes(empty)
    for half in halves:
        plain, _ = IP.ingest_posts(plain, half, NOW, files(spark, "a"))
        indexed, _ = IP.ingest_posts(indexed, half, NOW, files(spark, "a"))
        plain, indexed = ({n: spark.createDataFrame(t.collect(), t.schema) for n, t in k.items()} for k in (plain, indexed))
    for table in ("subjects", "evidence", "subject_links", "link_evidence"):
        assert sorted(map(str, indexed[table].select(*S.TABLES[table].fieldNames()).collect())) == sorted(
            map(str, plain[table].select(*S.TABLES[table].fieldNames()).collect())), table


def test_ingest_of_investigations_compiles(spark, sf_dir):
    """The code of every stage fits: without the way back to interpreted stages, one that doesn't would fail."""
    from riskgraph.plans.checks import QUERIES

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("ingest_investigations", "link_mentions"):
            assert QUERIES[name](spark, sf_dir).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_media_types_by_leading_bytes(spark, tmp_path):
    contents = {
        "a.txt": bytes.fromhex("FFD8FFE000104A46"), "b": bytes.fromhex("89504E470D0A1A0A00"), "c.bin": b"BM12",
        "d": b"\0\0\0\x1cftypavif", "e": b"RIFF1234WEBPVP8 ", "f.png": b"RIFF1234WAVE", "g": b"", "h": b"B",
        "i.jpg": bytes.fromhex("FFD8FFE000104A46")}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    from riskgraph.sources.readers import media_facts, read_media

    out = read_media(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["content_type"], r["file_size_bytes"]) for r in out.collect()}
    none = "application/octet-stream"
    assert got == {"a.txt": ("image/jpeg", 8), "b": ("image/png", 9), "c.bin": ("image/bmp", 4), "d": ("image/avif", 12),
                   "e": ("image/webp", 16), "f.png": (none, 12), "h": (none, 1)}
    stored = out.where(F.col("content_type") == none).select("sha")
    assert read_media(spark, str(tmp_path), stored=stored).count() == 5
    rows_ = spark.createDataFrame([("https://x/a", 0, b""), ("https://x/b", 3, None)], "path string, length long, content binary")
    assert [(r["path"], r["content_type"]) for r in media_facts(rows_).collect()] == [("https://x/a", none)]
