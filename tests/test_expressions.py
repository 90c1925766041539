"""Column expressions on literal inputs."""

import pytest
from pyspark.sql import functions as F

import riskgraph.functions as R


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0]["x"]


def cases():
    return [
        # subjects
        (R.normalize_subject(F.lit(" 0912 345-678 "), F.lit("phone")), "0912345678"),
        (R.normalize_subject(F.lit("12 34 *5"), F.lit("bank")), "1234*5"),
        (R.normalize_subject(F.lit(" HTTPS://A.vn/X/// "), F.lit("url")), "https://a.vn/x"),
        (R.normalize_subject(F.lit(" Org "), F.lit("organization")), "Org"),
        (R.normalize_subject_crawl(F.lit("0912 345 678"), F.lit("phone")), "0912345678"),
        (R.normalize_subject_crawl(F.lit("1234 5678 90"), F.lit("bank")), "1234567890"),
        (R.normalize_subject_crawl(F.lit("12*34"), F.lit("bank")), "1234"),
        (R.classify_value(F.lit("https://x")), "url"),
        (R.classify_value(F.lit("0912345678")), "phone"),
        (R.classify_value(F.lit("84912345678")), "phone"),
        (R.classify_value(F.lit("12345678")), "bank"),
        (R.classify_value(F.lit("1234567")), None),
        (R.infer_subject_type(F.lit("0912345678")), "phone"),
        (R.infer_subject_type(F.lit("123456789012")), "bank"),
        (R.parse_mention(F.lit("bank:09 1")), ("bank", "09 1")),
        (R.parse_mention(F.lit("org:0912345678")), ("phone", "org:0912345678")),
        (R.valid_subject_type(F.lit("email")), False),
        (R.valid_subject_type(F.lit("")), False),
        (R.valid_subject_type(F.lit("url")), True),
        (R.default_subject_type(F.lit(None).cast("string")), "phone"),
        (R.reporter_address(F.lit("10.0.0.1"), F.lit(" 1.2.3.4 , 5.6.7.8")), "1.2.3.4"),
        (R.reporter_address(F.lit("8.8.8.8"), F.lit("1.2.3.4")), "8.8.8.8"),
        (R.reporter_address(F.lit("::1"), F.lit(" ")), "::1"),
        (R.reporter_address(F.lit("172.32.0.1"), F.lit("1.2.3.4")), "172.32.0.1"),
        (R.plain_number_query(F.lit(" 12345678 ")), ["12345678"]),
        (R.plain_number_query(F.lit("1234567")), []),
        # text
        (R.collapse_truncate(F.lit("  a\n b c "), 10), "a b c"),
        (R.collapse_truncate(F.lit("abcdef"), 3), "abc..."),
        (R.truncate(F.lit("đảo chính"), 3), "đảo"),
        (R.text_signature(F.lit("LỪA đảo ABC-12")), "l a o abc 12"),
        (R.ascii_lower(F.lit("LỪA ĐẢO Abc")), "lỪa ĐẢo abc"),
        (R.is_schema_leak(F.lit("  ")), True),
        (R.is_schema_leak(F.lit("Summary: x")), True),
        (R.has_technical_noise(F.lit("HTTP Status 500")), True),
        (R.has_technical_noise(F.lit("bình thường")), False),
        (R.normalize_org(F.lit("Mạo danh tổ chức:  ACB ")), "ACB"),
        (R.normalize_org(F.lit("Mạo danh tổ chức: ")), None),
        (R.is_known_org(F.lit("Chưa xác định")), False),
        (R.slugify(F.lit(" Đã xử lý! ")), "đã-xử-lý"),
        (R.slugify(F.lit("a - b")), "a--b"),
        (R.digits_to_number(F.lit("Có 12 kết 3")), 123),
        (R.digits_to_number(F.lit("none")), 0),
        (R.strip_embedded_noise(F.lit(" mất tiền, <script>x")), "mất tiền"),
        (R.decode_entities(F.lit("&#233;&amp;x&#x1F600;5&apos;")), "é&x😀5'"),
        (R.decode_entities(F.lit("a&#zz;b")), "a&#zz;b"),
        (R.parse_verdict_footer(F.lit("x\nRISK_LEVEL: high\nCONFIDENCE: 1.7")), ("high", 1.7)),
        (R.parse_verdict_footer(F.lit(" RISK_LEVEL: high\nCONFIDENCE: ?")), ("unknown", 0.5)),
        (R.strip_footer(F.lit("a\n\n\n\nb\n**Kết luận:** tốt\nRISK_LEVEL: low")),
         "a\n\nb\n## Kết luận\ntốt"),
        (R.carrier(F.lit("mạng Vinaphone và Viettel")), "Vinaphone"),
        (R.risk_label(F.lit("high")), "cao"),
        (R.risk_label(F.lit("?")), "chưa rõ"),
        # urls
        (R.canonicalize_url(F.lit("https://www.adda247.com/jobs/file.pdf?srsltid=aaa&utm_source=foo")),
         "https://www.adda247.com/jobs/file.pdf"),
        (R.canonicalize_url(F.lit("HTTP://Ex.com:80?b=1&a=%20x#f")), "http://ex.com/?b=1&a=+x"),
        (R.canonicalize_url(F.lit("https://a.com/x y/é?q=%zz")), "https://a.com/x%20y/%C3%A9?q=%25zz"),
        (R.canonicalize_url(F.lit("not a url")), "not a url"),
        (R.url_host(F.lit("https://u@H.com:8080/a")), "h.com"),
        (R.is_search_page(F.lit("https://html.duckduckgo.com/html/?q=a")), True),
        (R.is_search_page(F.lit("https://www.google.com/url?q=a")), True),
        (R.is_search_page(F.lit("https://google.com/maps")), False),
        (R.is_low_value_target(F.lit("https://a.com/b.DOCX?x=1")), True),
        (R.is_article_like(F.lit("https://a.com/")), False),
        (R.is_article_like(F.lit("https://a.com/news/")), True),
        (R.is_article_like(F.lit("https://a.com/a/b")), True),
        (R.is_known_source_domain(F.lit("https://feeds.chongluadao.vn/a")), True),
        (R.is_known_source_domain(F.lit("https://xcheckscam.vn/a")), False),
        (R.is_social_url(F.lit("https://www.facebook.com/x")), True),
        (R.is_social_url(F.lit("facebook.com/page")), False),
        (R.is_social_url(R.ensure_scheme(F.lit("facebook.com/page"))), True),
        (R.is_social_url(F.lit("https://example.com/post/1")), False),
        (R.unwrap_redirect(F.lit("/url?q=https://example.com/path%3Fa%3D1%26b%3D2&sa=U&ved=2ah")),
         "https://example.com/path?a=1&b=2"),
        (R.unwrap_result_link(F.lit("/l/?uddg=https%3A%2F%2Fx.com%2F")), "https://x.com/"),
        (R.absolute_url("https://t.vn/filterObj?x", F.lit("org/1")), "https://t.vn/org/1"),
        (R.absolute_url("https://t.vn/a/b", F.lit("../c")), "https://t.vn/c"),
        (R.absolute_url("https://t.vn/a/b", F.lit("//cdn.x/y")), "https://cdn.x/y"),
        (R.absolute_url("https://t.vn/a/b", F.lit("  ")), None),
        (R.post_slug(F.lit("https://x.vn/abc//")), "abc"),
        (R.file_extension(F.lit("image/svg+xml; a"), F.lit("x")), "svg"),
        (R.file_extension(F.lit("text/html"), F.lit("https://a/b.JPEG?x")), "jpg"),
        (R.file_extension(F.lit(None).cast("string"), F.lit("https://a/b")), "img"),
        # risk
        (R.score_to_level(F.lit(0.8)), "critical"),
        (R.score_to_level(F.lit(0.1) + F.lit(0.7)), "critical"),
        (R.score_to_level(F.lit(0.6)), "high"),
        (R.score_to_level(F.lit(0.3)), "medium"),
        (R.score_to_level(F.lit(0.0)), "unknown"),
        (R.crawl_floor(F.lit(0)), 0.2), (R.crawl_floor(F.lit(1)), 0.35),
        (R.crawl_floor(F.lit(6)), 0.75), (R.crawl_floor(F.lit(12)), 0.9),
        (R.report_signal(F.lit(6)), 0.72), (R.report_signal(F.lit(7)), 0.72),
        (R.combine_risk(F.lit(0.0), F.lit(2)), 0.24),
        (R.combine_risk(F.lit(0.5), F.lit(6)), 0.544),
        (R.combine_risk(F.lit(0.8), F.lit(0)), 0.8),
        (R.found_count(F.array(F.lit(1)), F.array().cast("array<int>"),
                       F.lit('{"report_count": 5}')), 5),
        (R.found_count(F.array(F.lit(1)), F.array(F.lit(2)), F.lit("no json")), 2),
        # pages and search
        (R.engine_block_kind(F.lit("<script>var hasCaptchaSupport=true;</script>")), None),
        (R.engine_block_kind(F.lit("<div class='G-recaptcha'>")), "captcha"),
        (R.engine_block_kind(F.lit("/httpservice/retry/enablejs"), F.lit(3)), None),
        (R.second_engine_block_kind(F.lit("Bots use DuckDuckGo too")), "anomaly"),
        (R.is_cdn_blocked(F.lit("Just a moment")), False),
        (R.is_cdn_blocked(F.lit("Cloudflare Ray ID")), True),
        (R.mentions_query(F.lit("Số 0912"), F.lit(""), F.lit("https://a.b"), F.lit("0912"),
                          F.lit("phone")), True),
        (R.mentions_query(F.lit("x"), F.lit(""), F.lit("https://evil.example/a"),
                          F.lit("https://evil.example/path?a=1"), F.lit("url")), True),
        (R.mentions_query(F.lit("x"), F.lit(""), F.lit("https://a.b"), F.lit("  "), F.lit("phone")), False),
        (R.has_scam_signal(F.lit("lừa đảo 0912"), F.lit(""), F.lit("u"), F.lit("0912")), True),
        (R.has_scam_signal(F.lit("LỪA ĐẢO 0912"), F.lit(""), F.lit("u"), F.lit("0912")), False),
        (R.has_scam_signal(F.lit("LỪA ĐẢO 0912"), F.lit(""), F.lit("u"), F.lit("0912"), True), True),
    ]


def test_expressions(spark):
    todo, wrong = cases(), []
    for start in range(0, len(todo), 25):
        part = todo[start:start + 25]
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(part)]).first()
        for i, (got, (_, want)) in enumerate(zip(row, part, strict=True)):
            if isinstance(want, tuple):
                got = tuple(got)
            if got != (pytest.approx(want) if isinstance(want, float) else want):
                wrong.append((start + i, got, want))
    assert wrong == []


def test_incident_fields(spark):
    quick = ("Họ Tên: Nguyen A. , SĐT: 0912 345 678 , STK: 12*345 , Ngân hàng: ACB , Lừa cọc #s1 "
             "đã bị cảnh báo 7 lần")
    f = one(spark, R.incident_fields(F.lit(quick)))
    assert tuple(f) == ("Nguyen A. ".strip().strip("."), "0912 345 678", "12*345", "ACB",
                        "Lừa cọc", "7")
    single = ("Chủ tk: B. STK: 123456 SĐT: 0987654321 Ngân hàng: VCB Hạng mục: x "
              "Nội dung cảnh báo: mất tiền ____")
    f = one(spark, R.incident_fields(F.lit(single)))
    assert tuple(f) == ("B", "0987654321", "123456", "VCB", "mất tiền", None)
