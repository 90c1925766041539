"""Domain tables read from the star-schema parquet tables.

Every function maps whole tables; nothing is sampled or cut.  Customers, suppliers and parts
become phone, bank and url subjects; events become investigations, reports, evidence, fetch and
failure logs; conversations become report chunks; pages become search results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import lookup
from ..functions.risk import level_to_score, quality_score, score_to_level
from ..functions.subjects import sha256_hex, subject_id

AS_OF = datetime(2024, 1, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes of a table before per-row work.
ROWS_DEALT = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a one-file table dealt before per-row work: over all cores, and to more tasks where there are more rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_DEALT)))


def _pad(c: Column | str, prefix: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 8, "0"))


def phone(c) -> Column:
    return _pad(c, "09")


def account(c) -> Column:
    return _pad(c, "1903")


def part_url(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("https://shop.example.com/p/"), c.cast("string"))


def phone_id(c) -> Column:
    return subject_id(F.lit("phone"), phone(c))


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", k())


def _subjects(df: DataFrame, key: str, kind: str, value: Column, balance: str) -> DataFrame:
    score = F.round(F.least(F.greatest(F.col(balance) / 10000, F.lit(0.0)), F.lit(1.0)), 6)
    seen = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    return df.select(
        subject_id(F.lit(kind), value).alias("id"), value.alias("value"),
        F.lit(kind).alias("subject_type"), score.alias("risk_score"),
        score_to_level(score).alias("risk_level"), F.lit(0).alias("report_count"),
        F.lit(0).alias("investigation_count"), seen.alias("first_seen_at"),
        (seen + F.make_dt_interval(mins=F.col(key).cast("int"))).alias("last_seen_at"))


def customers(spark, sf_dir) -> DataFrame:
    """Customers as phone subjects."""
    return _subjects(table(spark, sf_dir, "customer"), "c_custkey", "phone", phone("c_custkey"),
                     "c_acctbal")


def parts(spark, sf_dir) -> DataFrame:
    """Parts as url subjects."""
    return _subjects(table(spark, sf_dir, "part"), "p_partkey", "url", part_url("p_partkey"),
                     "p_retailprice")


def subjects(spark, sf_dir) -> DataFrame:
    return customers(spark, sf_dir).unionByName(parts(spark, sf_dir))


def order_mentions(spark, sf_dir) -> DataFrame:
    """An order is evidence about its customer that mentions the ordered parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("evidence_id"), phone_id("o_custkey").alias("subject_id"),
        F.lit("url").alias("subject_type"), part_url("l_partkey").alias("value"))


def investigations(spark, sf_dir) -> DataFrame:
    """Purchases as investigations of the user."""
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    level = (F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 60, "high")
             .when(F.col("value") >= 30, "medium").when(F.col("value") >= 10, "low")
             .otherwise("unknown"))
    ratio = (F.col("event_id") % 10) / 10.0
    conf = F.least(F.col("value") / 200, F.lit(1.0))
    return e.select(
        F.concat(F.lit("inv"), F.col("event_id").cast("string")).alias("id"),
        phone_id("user_id").alias("subject_id"), phone("user_id").alias("query"),
        F.lit("phone").alias("query_type"), level.alias("risk_level"),
        level_to_score(level).alias("risk_score_numeric"), conf.alias("confidence"),
        ratio.alias("sources_success_ratio"),
        quality_score(ratio, conf, F.col("k") % 7, F.col("k") % 4).alias("quality_score"),
        F.col("ts").alias("created_at"))


def user_reports(spark, sf_dir) -> DataFrame:
    """Errors and sign-ups as reports by the user about subject k."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    status = lookup(F.col("event_id") % 3, {0: "pending", 1: "approved"}, "rejected")
    return e.select(
        F.concat(F.lit("rep"), F.col("event_id").cast("string")).alias("id"),
        phone_id("k").alias("subject_id"),
        sha256_hex(F.col("user_id").cast("string")).alias("reporter_ip_hash"),
        F.concat_ws(" ", "event_type", F.col("value").cast("int").cast("string")).alias("description"),
        F.col("event_type").alias("category"), status.alias("status"),
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.col("ts").alias("created_at"))


def evidence(spark, sf_dir) -> DataFrame:
    """Every event as evidence about its user that mentions subject k."""
    data = F.to_json(F.struct(
        F.concat(F.lit("https://src.example.com/"), F.col("k").cast("string")).alias("source_url"),
        (F.col("k") % 15).cast("string").alias("report_count"),
        F.when(F.col("k") % 2 == 0, "web").otherwise("social").alias("fake_type")))
    mentions = F.when(
        F.col("k") != F.col("user_id"), F.array(F.concat(F.lit("phone:"), phone("k")))
    ).otherwise(F.array().cast("array<string>"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
        phone_id("user_id").alias("subject_id"), F.lit(None).cast("string").alias("investigation_id"),
        F.col("event_type").alias("source"), F.lit("external_report").alias("evidence_type"),
        data.alias("data"),
        F.array(F.concat(F.lit("signal:"), (F.col("k") % 20).cast("string")),
                F.concat(F.lit("type:"), F.col("event_type"))).alias("risk_signals"),
        mentions.alias("mentioned_subjects"), F.col("ts").alias("created_at"))


def media(spark, sf_dir) -> DataFrame:
    """Views and clicks as pictures of their evidence."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    key = F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit("m"), key).alias("id"), F.lit("evidence").alias("entity_type"),
        F.concat(F.lit("ev"), key).alias("entity_id"),
        F.concat(F.lit("media/"), key).alias("file_path"), image_url("k").alias("original_url"),
        F.lit("image/jpeg").alias("content_type"),
        (F.col("value") * 100).cast("bigint").alias("file_size_bytes"),
        F.col("ts").alias("created_at"))


def image_url(c) -> Column:
    return F.concat(F.lit("https://img.example.com/"), F.col(c).cast("string"), F.lit(".jpg"))


def fetch_log(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("entry"), "ts",
        (F.col("value") > 20).alias("success"), F.floor("value").cast("double").alias("duration_ms"),
        (F.col("value") < 5).alias("blocked"))


def failure_log(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("https://site.example.com/"), F.col("k").cast("string")).alias("url"), "ts",
        F.col("event_type").isin("view", "click").alias("ok"), F.col("event_type").alias("phase"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("message"))


def submissions(spark, sf_dir) -> DataFrame:
    """Errors and sign-ups as submissions; some are invalid."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.lit("127.0.0.1").alias("peer_ip"),
        F.concat_ws(", ", F.concat(F.lit("203.0.113."), F.col("user_id").cast("string")),
                    F.lit("10.0.0.1")).alias("forwarded_for"),
        F.concat(F.lit(" 09"), F.lit(" "), F.lpad((F.col("k") % 12).cast("string"), 8, "0")).alias(
            "value"),
        lookup(F.col("event_id") % 11, {0: "email"}, "phone").alias("subject_type"),
        F.when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias(
            "description"),
        F.col("event_type").alias("category"))


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("investigation_id"), F.col("turn").alias("seq"),
        F.col("text").alias("chunk"), ((F.col("role") == "assistant") & (F.col("turn") >= 5)).alias(
            "done"),
        ((F.col("role") == "user") & (F.col("turn") > 0)).alias("replace"))


def _repeat(c: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_repeat(c, n)).otherwise(F.array().cast("array<string>"))


def event_log(spark, sf_dir) -> DataFrame:
    """Events as investigation events of the user."""
    kind = (
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "complete")
        .otherwise(lookup("event_type", {
            "view": "phase_start", "error": "source_status", "click": "summary_result",
            "signup": "extraction_result", "purchase": "detective_stream"})))
    tag = F.col("k").cast("string")
    return events(spark, sf_dir).withColumn("type", kind).select(
        F.col("user_id").cast("string").alias("investigation_id"), F.col("event_id").alias("seq"),
        "type", F.when(F.col("type") == "phase_start", F.col("k") % 5 + 1).alias("phase"),
        F.when(F.col("type").isin("source_status", "summary_result"),
               F.concat(F.lit("s"), (F.col("k") % 7).cast("string"))).alias("source"),
        F.when(F.col("value") > 30, "done").otherwise("error").alias("status"),
        F.when(F.col("type") == "extraction_result",
               F.concat(F.lit("u"), (F.col("k") % 13).cast("string"))).alias("url"),
        F.when(F.col("type") == "detective_stream", tag).alias("chunk"),
        (F.col("k") % 10 == 0).alias("replace"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        (F.col("k") % 3 > 0).alias("recoverable"),
        _repeat(tag, F.col("k") % 4).alias("risk_signals"),
        F.array(F.concat(F.lit("p"), (F.col("k") % 11).cast("string"))).alias("phone_mentions"),
        F.array(F.concat(F.lit("n"), (F.col("k") % 17).cast("string"))).alias("related_numbers"))


def pages(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "pages"))


def documents(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def page_titles(spark, sf_dir) -> DataFrame:
    """Pages with title and advert text cut out of the markup."""
    return pages(spark, sf_dir).select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1).alias("snippet"))


def queries(spark, sf_dir) -> DataFrame:
    """Benchmark items as queries: their first word, phone and url types in turn."""
    word = F.lower(F.regexp_extract("text", "^([A-Za-z]*)", 1))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), word.alias("query"),
        F.when(F.col("item_id") % 2 == 0, "phone").otherwise("url").alias("query_type"))


def search_rows(spark, sf_dir) -> DataFrame:
    """Pages as search results of the query their id points to."""
    n_queries = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    return page_titles(spark, sf_dir).select(
        (F.col("page_id") % n_queries).alias("query_id"),
        F.when(F.col("page_id") % 3 == 0, 2).otherwise(1).alias("engine"),
        F.col("page_id").alias("pos"), "title", "url", "snippet")


def source_results(spark, sf_dir) -> DataFrame:
    """Documents as source results: one report (first line, whole text), one search result.

    The document source decides the domain source; short documents count as failed.
    """
    names = ["AdminVN", "CheckScam", "TinNhiemMang", "ChongLuaDao", "TrangTrang", "Google",
             "DuckDuckGo"]
    line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rest = F.regexp_extract("text", r"^[^\n]*\n([^\n]*)", 1)
    url = F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    report = F.struct(line.alias("title"), url.alias("url"), F.col("text").alias("content"),
                      F.lit(None).cast("string").alias("date"))
    result = F.struct(line.alias("title"), F.concat(url, F.lit("/s")).alias("url"),
                      rest.alias("snippet"))
    has_report, has_result = F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 != 1
    none_r = F.array().cast("array<struct<title:string,url:string,content:string,date:string>>")
    none_s = F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    return documents(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 7).alias("query_id"),
        lookup(F.col("doc_id") % 7, dict(enumerate(names))).alias("source"),
        phone(F.floor(F.col("doc_id") / 7)).alias("query"), (F.col("n_chars") >= 200).alias("success"),
        F.when(has_report, F.array(report)).otherwise(none_r).alias("reports"),
        F.when(has_result, F.array(result)).otherwise(none_s).alias("search_results"),
        F.concat(F.lit('{"report_count": '), (F.col("doc_id") % 6).cast("string"), F.lit("}")).alias(
            "metadata"),
        F.col("n_chars").cast("double").alias("duration_ms"))


def order_posts(spark, sf_dir) -> DataFrame:
    """Orders as incident posts: the text names phone, account, bank and a report count."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n = (key % 14).cast("string")
    body = F.concat(
        F.lit("<html><body><h2>Thông tin cảnh báo:</h2><div>Chủ tk: Khach "), cust.cast("string"),
        F.lit(". <b>STK: "), account(key % 997), F.lit("</b> SĐT: "), phone(cust),
        F.lit(" Ngân hàng: Bank "), (key % 9).cast("string"), F.lit(" Hạng mục: "),
        F.col("o_orderpriority"), F.lit(" đã bị cảnh báo "), n, F.lit(" lần"),
        F.when(key % 5 == 0, F.lit(" Nội dung cảnh báo: không giao hàng, ____"))
        .otherwise(F.lit("")),
        F.lit('</div><a class="gallery" href="https://checkscam.vn/wp-content/uploads/'),
        (key % 50).cast("string"), F.lit('.jpg?v=1">x</a><p>#s1 more</p></body></html>'))
    return dealt(table(spark, sf_dir, "orders")).select(
        key.alias("id"), F.concat(F.lit("https://checkscam.vn/post-"), key.cast("string"), F.lit("/"))
        .alias("link"), F.concat(F.lit("Order "), key.cast("string")).alias("title"),
        body.alias("html"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


def listing_pages(spark, sf_dir) -> DataFrame:
    """One listing page per customer: a fake site that impersonates the customer's segment."""
    key = F.col("c_custkey").cast("string")
    org = F.when(F.col("c_custkey") % 4 == 0, F.lit("Chưa xác định")).otherwise(
        F.concat(F.lit("Mạo danh tổ chức: "), F.col("c_mktsegment")))
    html = F.concat(
        F.lit('<ul><li class="item1"><div class="meta"><span class="webkit-box-2">\n HTTP://Fake'), key,
        F.lit('.example.com/ </span></div><span class="date">Đã phát hiện ngày 01/02/2024</span>'),
        F.lit('<div class="org"><img src="/logo/'), key, F.lit('.png"><a href="org/'), key, F.lit('">'),
        org, F.lit('</a></div><div class="status"><div class="red big">Đã xử lý</div></div></li></ul>'),
        F.lit('<div class="pagination"><a class="page-link" href="?p=2">'),
        (F.col("c_custkey") % 30 + 1).cast("string"),
        F.lit('</a><span class="page-link">»</span></div>'))
    kind = F.when(F.col("c_custkey") % 2 == 0, "web").otherwise("social")
    return dealt(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("page"), kind.alias("fake_type"),
        F.concat(F.lit("https://list.example.com/?page="), key).alias("listing_page"),
        html.alias("html"))


def card_pages(spark, sf_dir) -> DataFrame:
    """One search-card page per supplier."""
    key = F.col("s_suppkey").cast("string")
    cells = [F.lit("x"), F.format_string("%.2f", "s_acctbal"), phone("s_suppkey"),
             account("s_suppkey"), F.concat(F.lit("Bank: "), F.col("s_nationkey").cast("string")),
             (F.col("s_suppkey") % 100).cast("string"), F.lit("2024-01-01")]
    columns = F.concat(*[
        F.concat(F.lit('<div class="scam-column"> '), c, F.lit(" </div>")) for c in cells])
    html = F.concat(
        F.lit('<div class="alert alert-danger">Có '), (F.col("s_suppkey") % 7).cast("string"),
        F.lit(' kết quả</div><div class="scam-card"><div class="scam-title"><span class="limit">'),
        F.col("s_name"), F.lit("</span></div>"), columns,
        F.lit('<a class="btn stretched-link" href="/scams/'), key, F.lit('">go</a></div>'))
    return dealt(table(spark, sf_dir, "supplier")).select(F.col("s_suppkey").alias("page_id"),
                                                          html.alias("html"))


def detail_pages(spark, sf_dir) -> DataFrame:
    """One detail page per supplier; every fifth lacks owner, account and complaint."""
    key = F.col("s_suppkey").cast("string")

    def item(icon: str, value: Column) -> Column:
        return F.concat(
            F.lit('<div class="information-item"><div class="information-item_title"><img src="/i/'),
            F.lit(icon), F.lit('.png"></div><div class="information-item_value">'), value,
            F.lit("</div></div>"))

    full = F.concat(item("user", F.col("s_name")), item("credit", account("s_suppkey")),
                    item("content", F.lit("không giao  hàng")))
    html = F.concat(
        F.lit("<html><head><title>Tố cáo: "), key,
        F.lit('</title><meta property="article:published_time" content="2024-01-02"></head><body>'),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(full),
        item("bank", F.concat(F.lit("Bank "), F.col("s_nationkey").cast("string"))),
        item("price", F.format_string("%.2f", "s_acctbal")),
        F.lit('<a data-fancybox="scammer-images" href="/img/'), key,
        F.lit('.png">x</a><span class="information-item_vote__approved">'),
        (F.col("s_suppkey") % 9).cast("string"), F.lit(" phiếu</span></body></html>"))
    return dealt(table(spark, sf_dir, "supplier")).select(
        F.col("s_suppkey").alias("page_id"),
        F.concat(F.lit("https://admin.vn/scams/"), key).alias("url"), html.alias("html"))


def result_pages(spark, sf_dir) -> DataFrame:
    """Each page as the first entry of a result page, either layout, before two more and one without an address."""
    t = page_titles(spark, sf_dir)
    encoded, key = F.url_encode("url"), F.col("page_id").cast("string")

    def heading(href, title, snippet):
        return F.concat(
            F.lit('<div class="MjjYud"><div><a href="'), href, F.lit('"><div><h3> '), title, F.lit("</h3></div></a>"),
            snippet, F.lit("</div></div>"))

    def block(href, title, snippet):
        return F.concat(
            F.lit('<div class="result"><h2 class="result__title"><a href="'), href, F.lit('">'), title,
            F.lit("</a></h2>"), snippet, F.lit("</div>"))

    more, none = F.concat(F.lit("https://more.example/"), key), F.lit("")
    own = F.concat(F.lit("own "), key)
    headings = F.concat(
        heading(F.concat(F.lit("/url?q="), encoded, F.lit("&amp;sa=U")), F.col("title"), F.concat(
            F.lit('<div class="BNeawe s3v9rd"> '), F.col("snippet"), F.lit("</div>"))),
        heading(more, F.lit("More"), none), heading(F.lit("/relative"), F.lit("Relative"), none),
        heading(F.concat(more, F.lit("/own")), F.lit("Own"), F.concat(
            F.lit('<span class="aCOpRe">'), own, F.lit("</span>"))))
    blocks = F.concat(
        block(F.concat(F.lit("//duckduckgo.com/l/?uddg="), encoded, F.lit("&amp;rut=1")), F.col("title"), F.concat(
            F.lit('<a class="result__snippet">'), F.col("snippet"), F.lit("</a>"))),
        block(more, F.lit("More"), none), F.lit('<div class="result">no link</div>'),
        block(F.concat(more, F.lit("/own")), F.lit("Own"), F.concat(
            F.lit('<a class="result__snippet">'), own, F.lit("</a>"))))
    return t.select("page_id", headings.alias("headings"), blocks.alias("blocks"))


def feeds(spark, sf_dir) -> DataFrame:
    """Customers as JSON feeds with two items, one without data."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit('[{"name":'),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("null")).otherwise(
            F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))),
        F.lit(',"source":"feed","data":{"id":'), key, F.lit("}},"),
        F.lit('{"name":"empty","data":null}]'))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("feed"))


def reuse_table(spark, sf_dir) -> DataFrame:
    """Labelled documents as stored model results; odd quality expires early."""
    made = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("query"), F.lit("length").alias("agent_name"),
        F.lit("p1").alias("prompt_hash"),
        sha256_hex(F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("input_hash"),
        F.concat(F.lit('{"n":'), F.col("toxic").cast("string"), F.lit("}")).alias("result"),
        made.alias("created_at"),
        (made + F.make_dt_interval(days=F.when(F.col("quality") == 1, 30).otherwise(5))).alias(
            "expires_at"))


def score_inputs(spark, sf_dir) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return documents(spark, sf_dir).select(
        key.alias("query"), F.lit("length").alias("agent_name"), F.lit("p1").alias("prompt_hash"),
        F.concat(F.lit("doc "), key).alias("input"))


