"""Queries on pages, texts, search results, posts, and the ingest plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import base as B
from ..functions import fixed_values as V
from ..functions import pages as FP
from ..functions import search as FS
from ..functions import subjects as FJ
from ..functions import text as FT
from ..functions import urls as FU
from ..operators import kb, models, pages, risk, summaries, triage
from ..session import cut_lineage
from ..sources import driver_tables as D
from ..sources.html_nodes import page_nodes
from ..sources.readers import media_facts as media_facts_of
from ..streaming import ingest
from . import ingest_blacklist as IB
from . import ingest_posts as IP
from . import investigate as INV
from .checks_tables import K, q_account, q_level, q_phone, q_pid
from .registry import check

# --- SQL pieces ---------------------------------------------------------------------------
SPACE = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q_lower(x: str) -> str:
    return f"translate({x}, '{B.UPPER}', '{B.LOWER}')"


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def q_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def q_cut(x: str, n: int) -> str:
    c = q_collapse(x)
    return f"(CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END)"


def q_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def q_noise(x: str) -> str:
    return q_any(q_lower(x), V.TECHNICAL_MARKERS)


def q_leak(x: str) -> str:
    return f"({q_strip(x)} = '' OR {q_any(q_lower(x), V.SCHEMA_FIELD_MARKERS)})"


def q_signature(x: str) -> str:
    words = f"string_split(trim(regexp_replace({q_lower(x)}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_slice({words}, 1, 24), ' ')"


def q_decode(x: str) -> str:
    for name, value in [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                        ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{value}')"
    return x


def q_text(template: str, *parts: str) -> str:
    """SQL concatenation from a %s / %d template."""
    out, rest = [], template
    for part in parts:
        at = min(i for i in (rest.find("%s"), rest.find("%d")) if i >= 0)
        text = rest[:at].replace("'", "''")
        out += [f"'{text}'", f"CAST({part} AS VARCHAR)"]
        rest = rest[at + 2:]
    text = rest.replace("'", "''")
    return "(" + " || ".join([*out, f"'{text}'"]) + ")"


Q_TITLES = """titles AS (SELECT page_id, url,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS snippet FROM pages)"""


def q_canonical(u: str) -> str:
    """Enough for the stored page URLs: lower-case hosts, plain query values."""
    pairs = (f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), "
             "lambda p: p <> '' AND NOT starts_with(p, 'utm_'))")
    query = f"array_to_string({pairs}, '&')"
    return (f"(regexp_extract({u}, '^[^?#]*') || CASE WHEN {query} = '' THEN '' "
            f"ELSE '?' || {query} END)")


# --- urls ---------------------------------------------------------------------------------
@check("canonical_urls", """WITH b AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN base || '.pdf' WHEN 1 THEN base || '?a=1&b=x+y'
  WHEN 2 THEN base WHEN 3 THEN base || '/?q=%2B&r=' ELSE base END AS canonical,
  regexp_extract(base, '^https?://([^/]+)', 1) AS host, page_id % 5 = 0 AS low_value FROM b""")
def canonical_urls(spark, d):
    base = F.regexp_extract("url", "^[^?#]*", 0)
    n = F.col("page_id") % 5
    u = (F.when(n == 0, F.concat(base, F.lit(".pdf?utm_source=x&gclid=1")))
         .when(n == 1, F.concat(base, F.lit("?a=1&fbclid=9&b=x y#top")))
         .when(n == 2, F.concat(base, F.lit("#frag")))
         .when(n == 3, F.concat(base, F.lit("/?&q=%2B&r&srsltid=z")))
         .otherwise(F.regexp_replace(base, "^http", "HTTP")))
    return D.pages(spark, d).withColumn("u", u).select(
        "page_id", FU.canonicalize_url("u").alias("canonical"), FU.url_host("u").alias("host"),
        FU.is_low_value_target("u").alias("low_value"))


@check("url_flags", """SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN 'www.facebook.com' WHEN 1 THEN 'duckduckgo.com' WHEN 2 THEN
    'www.google.com' WHEN 3 THEN 'feeds.chongluadao.vn' WHEN 4 THEN NULL
    ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS host,
  page_id % 6 IN (1, 2) AS search_page, page_id % 6 = 0 AS social, page_id % 6 = 3 AS known_source,
  page_id % 6 = 3 OR (page_id % 6 = 5 AND
    len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'),
                    lambda s: s <> '')) >= 2) AS article_like FROM pages""")
def url_flags(spark, d):
    n = F.col("page_id") % 6
    u = (F.when(n == 0, F.lit("https://www.facebook.com/x")).when(n == 1, F.lit(
        "https://duckduckgo.com/html/?q=1")).when(n == 2, F.lit("https://www.google.com/search?q=1"))
        .when(n == 3, F.lit("https://feeds.chongluadao.vn/post/1")).when(n == 4, F.lit("not a url"))
        .otherwise(F.col("url")))
    return D.pages(spark, d).withColumn("u", u).select(
        "page_id", FU.url_host("u").alias("host"), FU.is_search_page("u").alias("search_page"),
        FU.is_social_url("u").alias("social"), FU.is_known_source_domain("u").alias("known_source"),
        FU.is_article_like("u").alias("article_like"))


@check("link_forms", """SELECT page_id, url AS redirect, url AS result_link,
  'https://admin.vn/a/' || page_id AS absolute, 'https://' || regexp_extract(url, '//(.*)', 1) AS schemed,
  CAST(page_id AS VARCHAR) AS slug, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'img' END
  AS ext FROM pages""")
def link_forms(spark, d):
    key = F.col("page_id").cast("string")
    n = F.col("page_id") % 3
    file_url = F.concat(F.lit("https://x.example/f"), F.when(n == 1, F.lit(".JPEG")).otherwise(F.lit(".b")))
    ctype = F.when(n == 0, F.lit("image/png; q=1")).otherwise(F.lit("text/html"))
    return D.pages(spark, d).select(
        "page_id",
        FU.unwrap_redirect(F.concat(F.lit("/url?q="), F.url_encode("url"), F.lit("&sa=U"))).alias(
            "redirect"),
        FU.unwrap_result_link(F.concat(
            F.lit("//duckduckgo.com/l/?rut=2&uddg="), F.url_encode("url"))).alias("result_link"),
        FU.absolute_url("https://admin.vn/scams", F.concat(F.lit("/x/../a/"), key)).alias("absolute"),
        FU.ensure_scheme(F.regexp_extract("url", "//(.*)", 1)).alias("schemed"),
        FU.post_slug(F.concat(F.lit("https://checkscam.vn/"), key, F.lit("//"))).alias("slug"),
        FU.file_extension(ctype, file_url).alias("ext"))


# --- values and texts -----------------------------------------------------------------------
@check("subject_values", f"""SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN '84' || lpad(CAST({K} AS VARCHAR), 9, '0')
    WHEN 1 THEN '1903*' || {K} WHEN 2 THEN 'http://x.example/a' ELSE 'abc' END AS normal,
  CASE event_id % 4 WHEN 0 THEN '84' || lpad(CAST({K} AS VARCHAR), 9, '0')
    WHEN 1 THEN '1903' || {K} WHEN 2 THEN 'HTTP://x.example/A//' ELSE 'abc' END AS crawled,
  CASE event_id % 4 WHEN 0 THEN 'phone' ELSE NULL END AS class,
  CASE event_id % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'bank' ELSE 'bank' END AS inferred,
  CASE event_id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'bank' ELSE CASE WHEN
    length(CAST(event_id AS VARCHAR)) >= 9 THEN 'phone' ELSE 'bank' END END AS mention_type,
  CASE event_id % 3 WHEN 2 THEN 'org:' || event_id ELSE CAST(event_id AS VARCHAR) END AS mention_value
FROM events""")
def subject_values(spark, d):
    n, k = F.col("event_id") % 4, F.col("k").cast("string")
    kind = F.when(n == 0, "phone").when(n == 1, "bank").when(n == 2, "url").otherwise("organization")
    raw = (F.when(n == 0, F.concat(F.lit("+84 "), F.lpad(k, 9, "0")))
           .when(n == 1, F.concat(F.lit(" 19 03*"), k))
           .when(n == 2, F.lit(" HTTP://x.example/A// ")).otherwise(F.lit(" abc\t")))
    tag = F.when(F.col("event_id") % 3 == 0, "phone:").when(F.col("event_id") % 3 == 1, "bank:").otherwise(
        "org:")
    m = FJ.parse_mention(F.concat(tag, F.col("event_id").cast("string")))
    return D.events(spark, d).select(
        "event_id", FJ.normalize_subject(raw, kind).alias("normal"),
        FJ.normalize_subject_crawl(raw, kind).alias("crawled"),
        FJ.classify_value(raw).alias("class"), FJ.infer_subject_type(raw).alias("inferred"),
        m["subject_type"].alias("mention_type"), m["value"].alias("mention_value"))


@check("text_screens", f"""SELECT doc_id, {q_cut('text', 320)} AS cut, {q_signature('text')} AS signature,
  {q_leak('text')} AS leak, {q_noise('text')} AS noise,
  {q_any(q_lower('text'), V.SCAM_KEYWORDS)} AS scam_words, substring(text, 1, 2000) AS head,
  sha256(text) AS hash FROM documents""")
def text_screens(spark, d):
    return D.documents(spark, d).select(
        "doc_id", FT.collapse_truncate("text", 320).alias("cut"),
        FT.text_signature("text").alias("signature"), FT.is_schema_leak("text").alias("leak"),
        FT.has_technical_noise("text").alias("noise"),
        B.contains_any_folded("text", V.SCAM_KEYWORDS).alias("scam_words"),
        FT.truncate("text", 2000).alias("head"), FJ.sha256_hex("text").alias("hash"))


@check("text_forms", r"""WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)
SELECT doc_id, replace(trim(regexp_replace(lower(line), '[^\p{L}\p{N}]', '-', 'g'), '-'), '--', '-') AS slug,
  coalesce(TRY_CAST(regexp_replace(line, '[^0-9]', '', 'g') AS BIGINT), 0) AS number,
  CASE doc_id % 3 WHEN 0 THEN 'ACB' WHEN 1 THEN NULL ELSE 'Chưa xác định' END AS org,
  doc_id % 3 = 0 AS known_org,
  CASE doc_id % 2 WHEN 0 THEN 'Viettel' ELSE 'Unknown' END AS carrier,
  'é & <b> 😀' || doc_id AS decoded FROM t""")
def text_forms(spark, d):
    n = F.col("doc_id") % 3
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    org = F.when(n == 0, F.lit(" Mạo danh tổ chức:  ACB ")).when(n == 1, F.lit("Mạo danh tổ chức:")).otherwise(
        F.lit("Chưa xác định"))
    carrier = F.when(F.col("doc_id") % 2 == 0, F.lit("so Viettel, Reddi")).otherwise(F.lit("none"))
    coded = F.concat(F.lit("&#233; &amp; &lt;b&gt; &#x1F600;"), F.col("doc_id").cast("string"))
    return D.documents(spark, d).select(
        "doc_id", FT.slugify(line).alias("slug"), FT.digits_to_number(line).alias("number"),
        FT.normalize_org(org).alias("org"), FT.is_known_org(FT.normalize_org(org)).alias("known_org"),
        FT.carrier(carrier).alias("carrier"), FT.decode_entities(coded).alias("decoded"))


@check("verdict_footers", f"""SELECT conv_id, turn, role AS level, turn / 10.0::DOUBLE AS confidence,
  {q_strip("regexp_replace(text, '(\\n){3,}', chr(10) || chr(10), 'g')")} AS body,
  CASE WHEN turn >= 9 THEN 'x' ELSE role END = role AS plain FROM conversations""")
def verdict_footers(spark, d):
    md = F.concat("text", F.lit("\nRISK_LEVEL: "), "role", F.lit(" \nCONFIDENCE: 0."),
                  F.col("turn").cast("string"), F.lit("\n"))
    f = FT.parse_verdict_footer(md)
    return D.table(spark, d, "conversations").select(
        "conv_id", "turn", f["level"].alias("level"), f["confidence"].alias("confidence"),
        FT.strip_footer(md).alias("body"), (f["level"] == F.col("role")).alias("plain"))


@check("flag_repetitive", f"""WITH l AS (SELECT doc_id, {q_strip('line')} AS line FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents)),
long AS (SELECT * FROM l WHERE strlen(line) >= 20),
n AS (SELECT doc_id, count(*) AS n_lines FROM long GROUP BY 1),
r AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, {q_signature('line')} AS sig, count(*) AS c
        FROM long GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
  coalesce(n_lines >= 6 AND m >= 4, false) AS repetitive
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)""")
def flag_repetitive(spark, d):
    return triage.flag_repetitive(D.documents(spark, d), "doc_id", "text")


@check("drop_near_duplicates", f"""SELECT min(doc_id) AS doc_id FROM documents GROUP BY {q_signature('text')}""")
def drop_near_duplicates(spark, d):
    return triage.drop_near_duplicates(
        D.documents(spark, d).select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@check("compact_payload", """SELECT event_id, '{"k":' || regexp_extract(props, '[0-9]+') || ',"t":"' ||
  substring(event_type, 1, 4) || CASE WHEN length(event_type) > 4 THEN '...' ELSE '' END || '"}' AS preview
FROM events""")
def compact_payload(spark, d):
    payload = F.concat(F.lit('{"z": [1, 2], "t": " '), F.col("event_type"), F.lit('", "k": '),
                       F.get_json_object("props", "$.k"), F.lit("}"))
    return summaries.compact_payload(
        D.events(spark, d).select("event_id", payload.alias("p")), "p", 4, 2, 2, "preview"
    ).select("event_id", "preview")


@check("parse_model_output", f"""SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE 'u' || {K} END
  AS url, CASE event_id % 6 WHEN 3 THEN 1 WHEN 0 THEN 2 END AS n_entities FROM events""")
def parse_model_output(spark, d):
    n = F.col("event_id") % 6
    u = F.concat(F.lit('{"url": "u'), F.col("k").cast("string"), F.lit('"'))
    raw = (F.when(n == 0, F.concat(u, F.lit(', "entities": ["a", "b"]}')))
           .when(n == 1, F.concat(F.lit("```json\n"), u, F.lit("}\n```")))
           .when(n == 2, F.concat(F.lit("<think>x { </think> Answer: "), u, F.lit("} done")))
           .when(n == 3, F.concat(u, F.lit(', "entities": ["a"], "summary": "t')))
           .when(n == 4, F.concat(u, F.lit(",}"))).otherwise(F.lit("no json")))
    out = models.parse_model_output(
        D.dealt(D.events(spark, d)).select("event_id", raw.alias("raw")), "raw", S.EXTRACTION)
    return out.select("event_id", F.col("parsed.url").alias("url"), F.when(
        F.col("parsed.entities").isNotNull(), F.size("parsed.entities")).alias("n_entities"))


# --- pages ----------------------------------------------------------------------------------
Q_BODY = r"""regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1),
  '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""


@check("main_text", f"""SELECT page_id, url, substring({q_collapse(q_decode(Q_BODY))}, 1, 2000) AS content
FROM pages""")
def main_text(spark, d):
    return pages.main_text(page_nodes(D.pages(spark, d), keep_html=True))


def q_result_rows(first: str, second: str) -> str:
    """Three results a page with the snippets of the first two; the second has none of its own."""
    return f"""WITH {Q_TITLES}, t AS (SELECT page_id, url, {q_strip(q_decode('title'))} AS title,
  {q_strip(q_decode('snippet'))} AS snippet, 'https://more.example/' || page_id AS more, 'own ' || page_id AS own
  FROM titles)
SELECT page_id, 1 AS pos, title, url, {first} AS snippet FROM t
UNION ALL SELECT page_id, 2, 'More', more, {second} FROM t
UNION ALL SELECT page_id, 3, 'Own', more || '/own', own FROM t"""


Q_FIRST_SNIPPET = "CASE WHEN snippet = '' THEN own ELSE snippet END"  # a heading without one takes the page's first


@check("search_results", q_result_rows(Q_FIRST_SNIPPET, Q_FIRST_SNIPPET))
def search_results(spark, d):
    return pages.search_results(page_nodes(D.result_pages(spark, d), "headings", ["page_id"]))


@check("search_results_blocks", q_result_rows("snippet", "''"))
def search_results_blocks(spark, d):
    return pages.search_results(
        page_nodes(D.result_pages(spark, d), "blocks", ["page_id"]), "blocks")


Q_POSTS = f"""posts AS (SELECT o_orderkey AS id, 'https://checkscam.vn/post-' || o_orderkey || '/' AS link,
  {q_phone('o_custkey')} AS phone, {q_account('(o_orderkey % 997)')} AS account,
  'Khach ' || o_custkey AS owner, 'Bank ' || (o_orderkey % 9) AS bank,
  CASE WHEN o_orderkey % 5 = 0 THEN 'không giao hàng' END AS warning,
  CAST(o_orderkey % 14 AS INTEGER) AS report_count,
  'https://checkscam.vn/wp-content/uploads/' || (o_orderkey % 50) || '.jpg' AS image,
  strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)"""


@check("post_entities", f"""WITH {Q_POSTS}
SELECT id, phone AS phones, account AS accounts, owner, bank, warning, report_count, image AS images,
  owner || ' - ' || account || ' - ' || bank AS title, date AS post_date FROM posts""")
def post_entities(spark, d):
    return IP.parse_posts(D.order_posts(spark, d)).select(
        "id", F.array_join("phones", "|").alias("phones"),
        F.array_join("bank_accounts", "|").alias("accounts"), "owner", "bank", "warning",
        "report_count", F.array_join("image_urls", "|").alias("images"),
        F.col("parsed_title").alias("title"), "post_date")


@check("post_evidence", f"""WITH {Q_POSTS}, s AS (
  SELECT *, 'phone' AS subject_type, phone AS value, 'bank:' || account AS mentions FROM posts
  UNION ALL SELECT *, 'bank', account, 'phone:' || phone FROM posts)
SELECT sha256(subject_type || '|' || value) AS subject_id, link AS source_url, mentions,
  'checkscam_report|' || CASE WHEN warning IS NULL THEN '' ELSE 'checkscam_warning_present|' END ||
  'checkscam_report_count:' || report_count || '|checkscam_images_present' AS signals,
  owner AS json_owner, CAST(report_count AS VARCHAR) AS json_count FROM s""")
def post_evidence(spark, d):
    rows = IP.post_evidence(IP.parse_posts(D.order_posts(spark, d)))
    return rows.select(
        "subject_id", "source_url", F.array_join("mentioned_subjects", "|").alias("mentions"),
        F.array_join("risk_signals", "|").alias("signals"),
        F.get_json_object("data", "$.owner").alias("json_owner"),
        F.get_json_object("data", "$.report_count").alias("json_count"))


def _empty_tables(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in S.TABLES.items()}


@check("ingest_posts", f"""WITH {Q_POSTS}, s AS (
  SELECT 'phone' AS t, phone AS v, report_count FROM posts
  UNION ALL SELECT 'bank', account, report_count FROM posts),
f AS (SELECT t, v, max(CASE WHEN report_count >= 10 THEN 0.9 WHEN report_count >= 5 THEN 0.75
    WHEN report_count >= 2 THEN 0.55 WHEN report_count >= 1 THEN 0.35 ELSE 0.2 END)::DOUBLE AS score
  FROM s GROUP BY 1, 2)
SELECT sha256(t || '|' || v) AS id, v AS value, t AS subject_type, score AS risk_score,
  {q_level('score')} AS risk_level FROM f""")
def ingest_posts(spark, d):
    out, _ = IP.ingest_posts(_empty_tables(spark), D.order_posts(spark, d), D.AS_OF)
    return out["subjects"].select("id", "value", "subject_type", "risk_score", "risk_level")


@check("media_facts", """WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'GIF89a' WHEN 1 THEN '%PDF-'
    WHEN 2 THEN 'RIFF0000WEBP' WHEN 3 THEN 'RIFF0000WAVE' WHEN 4 THEN '<svg' ELSE '' END || html AS content,
  'https://checkscam.vn/f/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '' END AS path
  FROM pages WHERE html IS NOT NULL)
SELECT sha256(content) AS sha, min(path) AS path, any_value(strlen(content)) AS file_size_bytes,
  any_value(CASE page_id % 6 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/webp'
    WHEN 4 THEN 'image/svg+xml' ELSE 'application/octet-stream' END) AS content_type FROM f GROUP BY 1""")
def media_facts(spark, d):
    """Pages as downloaded files behind the leading bytes of some formats, each file twice."""
    n = F.col("page_id") % 6
    head = B.lookup(n, {0: "GIF89a", 1: "%PDF-", 2: "RIFF0000WEBP", 3: "RIFF0000WAVE", 4: "<svg"}, "")
    path = F.concat(F.lit("https://checkscam.vn/f/"), F.col("page_id").cast("string"))
    content = F.encode(F.concat(head, "html"), "UTF-8")
    files = D.pages(spark, d).select(
        F.concat(path, F.when(F.col("page_id") % 2 == 0, ".png").otherwise("")).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    again = files.withColumn("path", F.concat("path", F.lit("~copy")))
    return media_facts_of(files.unionByName(again)).select("sha", "path", "file_size_bytes", "content_type")


@check("retry_failures", """SELECT 'https://checkscam.vn/post-' || o_orderkey || '/' AS url,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS retry_count, o_custkey % 3 <> 0 AS resolved
FROM orders WHERE o_custkey % 4 = 0""")
def retry_failures(spark, d):
    """Posts of every fourth customer failed; a third of the customers' posts still has no page."""
    orders = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    posts = D.order_posts(spark, d).join(orders, "id")
    failed = posts.where(F.col("o_custkey") % 4 == 0).select(
        F.col("link").alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(False).alias("ok"),
        F.lit("detail_fetch").alias("phase"), F.lit("timeout").alias("message"))
    empty = _empty_tables(spark)
    tables = {**empty, "crawl_log": empty["crawl_log"].unionByName(failed)}
    again = posts.withColumn("html", F.when(F.col("o_custkey") % 3 != 0, F.col("html"))).drop("o_custkey")
    out, _ = IP.retry_failures(tables, again, D.AS_OF)
    return kb.failure_state(out["crawl_log"]).where(F.col("url").contains("/post-")).select(
        "url", "retry_count", "resolved")


@check("ingest_posts_links", f"""WITH {Q_POSTS}, p AS (
  SELECT sha256('phone|' || phone) AS x, sha256('bank|' || account) AS y, id FROM posts)
SELECT least(x, y) AS subject_a_id, greatest(x, y) AS subject_b_id, 'co_mentioned' AS link_type,
  CAST(2 * count(DISTINCT id) AS DOUBLE) AS strength FROM p GROUP BY 1, 2""")
def ingest_posts_links(spark, d):
    out, _ = IP.ingest_posts(_empty_tables(spark), D.order_posts(spark, d), D.AS_OF)
    return out["subject_links"].select("subject_a_id", "subject_b_id", "link_type", "strength")


@check("dry_run_stats", f"""WITH {Q_POSTS} SELECT count(*) AS posts_discovered, CAST(count(*) AS BIGINT) AS
  posts_processed, CAST(0 AS BIGINT) AS posts_skipped, CAST(2 * count(*) AS BIGINT) AS subjects_upserted,
  CAST(2 * count(*) AS BIGINT) AS media_wanted FROM posts""")
def dry_run_stats(spark, d):
    return IP.ingest_posts(
        _empty_tables(spark), D.order_posts(spark, d), D.AS_OF, dry_run=True)[1]


Q_RECORDS = """records AS (SELECT c_custkey AS page, CASE WHEN c_custkey % 2 = 0 THEN 'web' ELSE 'social'
    END AS fake_type, 'HTTP://Fake' || c_custkey || '.example.com/' AS fake_url,
  '01/02/2024' AS detected_at, 'Đã xử lý' AS status_text, 'red big' AS status_class,
  CASE WHEN c_custkey % 4 = 0 THEN 'Chưa xác định' ELSE c_mktsegment END AS org_name,
  'https://tinnhiemmang.vn/org/' || c_custkey AS org_detail_url,
  'https://tinnhiemmang.vn/logo/' || c_custkey || '.png' AS org_logo_url FROM customer)"""


@check("blacklist_records", f"WITH {Q_RECORDS} SELECT * FROM records")
def blacklist_records(spark, d):
    return pages.blacklist_records(page_nodes(D.listing_pages(spark, d))).drop("pos", "listing_page")


@check("listing_last_page", "SELECT c_custkey AS page, CAST(c_custkey % 30 + 1 AS INTEGER) AS last_page FROM customer")
def listing_last_page(spark, d):
    return page_nodes(D.listing_pages(spark, d)).select(
        "page", pages.listing_last_page("nodes").alias("last_page"))


def _records(spark, d) -> DataFrame:
    return pages.blacklist_records(page_nodes(D.listing_pages(spark, d)))


@check("ingest_blacklist", f"""WITH {Q_RECORDS}, s AS (
  SELECT 'url' AS t, 'http://fake' || page || '.example.com' AS v, 0.95::DOUBLE AS score FROM records
  UNION SELECT 'organization', org_name, 0.0 FROM records WHERE org_name <> 'Chưa xác định')
SELECT sha256(t || '|' || v) AS id, v AS value, t AS subject_type, score AS risk_score,
  {q_level('score')} AS risk_level FROM s""")
def ingest_blacklist(spark, d):
    out, _ = IB.ingest_blacklist(_empty_tables(spark), _records(spark, d), D.AS_OF)
    return out["subjects"].select("id", "value", "subject_type", "risk_score", "risk_level")


@check("ingest_blacklist_links", f"""WITH {Q_RECORDS}, p AS (
  SELECT sha256('url|http://fake' || page || '.example.com') AS x, sha256('organization|' || org_name) AS y
  FROM records WHERE org_name <> 'Chưa xác định')
SELECT least(x, y) AS subject_a_id, greatest(x, y) AS subject_b_id, 'impersonates' AS link_type,
  1.0::DOUBLE AS strength FROM p""")
def ingest_blacklist_links(spark, d):
    out, _ = IB.ingest_blacklist(_empty_tables(spark), _records(spark, d), D.AS_OF)
    return out["subject_links"].select("subject_a_id", "subject_b_id", "link_type", "strength")


@check("blacklist_signals", f"""WITH {Q_RECORDS}
SELECT sha256('url|http://fake' || page || '.example.com') AS subject_id, fake_url AS source_url,
  'tinnhiemmang_blacklist|tinnhiemmang_type:' || fake_type || '|tinnhiemmang_status:đã-xử-lý' AS signals,
  org_name AS json_org FROM records""")
def blacklist_signals(spark, d):
    return IB.record_evidence(_records(spark, d)).select(
        "subject_id", "source_url", F.array_join("risk_signals", "|").alias("signals"),
        F.get_json_object("data", "$.impersonated_org_name").alias("json_org"))


@check("scam_cards", f"""SELECT s_suppkey AS page_id, s_name AS title,
  'https://admin.vn/scams/' || s_suppkey AS url, printf('%.2f', s_acctbal) AS amount,
  {q_phone('s_suppkey')} AS phone, {q_account('s_suppkey')} AS account_number,
  'Bank ' || s_nationkey AS bank, CAST(s_suppkey % 100 AS VARCHAR) AS views, '2024-01-01' AS date,
  CAST(s_suppkey % 7 AS BIGINT) AS n_reports FROM supplier""")
def scam_cards(spark, d):
    nodes = page_nodes(D.card_pages(spark, d))
    counted = nodes.withColumn("n_reports", pages.card_report_count("nodes"))
    return pages.scam_cards(counted).drop("pos")


@check("scam_details", f"""SELECT s_suppkey AS page_id, 'https://admin.vn/scams/' || s_suppkey AS url,
  'Tố cáo ' || s_suppkey AS title, s_name AS owner_name, {q_account('s_suppkey')} AS account_number,
  'không giao hàng' AS complaint, '2024-01-02' AS published_at,
  'https://admin.vn/img/' || s_suppkey || '.png' AS evidence,
  'Chu TK: ' || s_name || '; STK: ' || {q_account('s_suppkey')} || '; Ngan hang: Bank ' || s_nationkey ||
  '; So tien: ' || printf('%.2f', s_acctbal) || '; Hang muc: ; Noi dung: không giao hàng; Bang chung: 1; ' ||
  'Tan thanh: ' || (s_suppkey % 9) || '; Khong tan thanh: 0' AS content
FROM supplier WHERE s_suppkey % 5 <> 0""")
def scam_details(spark, d):
    return pages.scam_details(page_nodes(D.detail_pages(spark, d))).select(
        "page_id", "url", "title", "owner_name", "account_number", "complaint", "published_at",
        F.array_join("evidence_urls", "|").alias("evidence"), "content")


@check("slug_links", """SELECT o_orderkey AS id, 'post-' || o_orderkey AS slug, 'Post ' || o_orderkey AS title
FROM orders""")
def slug_links(spark, d):
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<a href="https://checkscam.vn/lien-he/">c</a><a href="https://checkscam.vn/wp-admin">w</a>'
              '<a href="https://checkscam.vn/a/b">n</a><a href="https://checkscam.vn/post-'), key,
        F.lit('/"> Post '), key, F.lit('</a><a href="https://checkscam.vn/post-'), key,
        F.lit('">again</a><a href="https://checkscam.vn/?s=1">q</a>'))
    posts = D.dealt(D.table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), html.alias("html"))
    return pages.slug_links(page_nodes(posts)).select("id", "slug", "title")


@check("result_links", """SELECT o_orderkey AS id, CAST(0 AS INTEGER) AS pos,
  'https://checkscam.vn/r' || o_orderkey AS href FROM orders""")
def result_links(spark, d):
    key = F.col("o_orderkey").cast("string")
    link = F.concat(F.lit('<div class="ct"><div class="ct1"><a href="https://checkscam.vn/r'), key,
                    F.lit('">x</a></div></div>'))
    html = F.concat(
        F.lit('<div class="pst">'), link, link,
        F.lit('<div class="ct"><div class="ct1"><a href="https://checkscam.vn/?qh_ss=1">q</a></div></div>'
              '<a href="https://checkscam.vn/outside">o</a></div><div class="pst">'
              '<div class="ct"><div class="ct1"><a href="https://checkscam.vn/second">s</a></div></div></div>'))
    posts = D.dealt(D.table(spark, d, "orders")).select(F.col("o_orderkey").alias("id"), html.alias("html"))
    return pages.result_links(page_nodes(posts))


@check("page_list_items", """SELECT page_id,
  CAST(least(10, 2 * len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS n_first FROM pages""")
def page_list_items(spark, d):
    rows = pages.list_items(page_nodes(D.pages(spark, d)), min_bytes=-1)
    counts = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return D.pages(spark, d).select("page_id").join(counts, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("n_first"))


@check("reports_for_queries", """WITH c AS (SELECT doc_id // 7 AS query_id, doc_id AS pos, doc_id % 3 = 0 AS direct,
    contains(lower(text), CASE (doc_id // 7) % 2 WHEN 0 THEN 'the' ELSE 'zzz' END) AS hit FROM documents),
d AS (SELECT query_id, pos, 'direct' AS origin FROM c WHERE direct AND hit)
SELECT * FROM d UNION ALL SELECT query_id, pos, 'slug' FROM c WHERE NOT direct
  AND query_id NOT IN (SELECT query_id FROM d)""")
def reports_for_queries(spark, d):
    key = F.col("doc_id")
    docs = D.documents(spark, d).select(
        F.floor(key / 7).alias("query_id"), key.alias("pos"),
        F.concat(F.lit("https://checkscam.vn/"), key.cast("string")).alias("url"),
        F.lit("").alias("title"), F.col("text").alias("content"), F.lit("").alias("date"))
    q = docs.select("query_id").distinct().withColumn(
        "query", F.when(F.col("query_id") % 2 == 0, " The").otherwise("zzz"))
    # every candidate comes 60 times in front of its successors: the limit counts pages, not rows
    direct = docs.where(F.col("pos") % 3 == 0).withColumn("pos", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("pos") * 60 + i)))
    return pages.reports_for_queries(
        q, direct, docs.where(F.col("pos") % 3 != 0)
    ).select("query_id", F.when(F.col("origin") == "direct", F.col("pos") / 60).otherwise(
        F.col("pos")).cast("long").alias("pos"), "origin")


@check("feed_items", """SELECT c_custkey, 0 AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'feed' ELSE c_name END AS title,
  '{"id":' || c_custkey || '}' AS content FROM customer""")
def feed_items(spark, d):
    return pages.read_feed(D.feeds(spark, d), "feed")


@check("screen_counts", """WITH k AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  CASE page_id % 6 WHEN 0 THEN 'cdn' WHEN 1 THEN 'captcha' WHEN 2 THEN 'enablejs' WHEN 3 THEN 'anomaly'
  ELSE 'usable' END AS kind FROM pages) SELECT host, kind, count(*) AS n_pages FROM k GROUP BY 1, 2""")
def screen_counts(spark, d):
    n = F.col("page_id") % 6
    mark = (F.when(n == 0, "Cloudflare: Attention Required").when(n == 1, '<div class="G-Recaptcha">')
            .when(n == 2, "/httpservice/retry/enablejs").when(n == 3, "anomaly.js")
            .when(n == 4, "just a moment").otherwise("hasCaptchaSupport=true"))
    return triage.screen_counts(
        D.pages(spark, d).withColumn("html", F.concat("html", mark)))


@check("serp_status", f"""SELECT event_id, CASE WHEN {K} % 3 > 0 THEN 'serp' WHEN {K} % 2 = 0 THEN 'captcha'
  ELSE 'unknown' END AS status, CASE WHEN {K} % 3 = 0 THEN 'unknown' WHEN {K} % 5 > 0 THEN 'has_results'
  ELSE 'empty_results' END AS content_status,
  CASE {K} % 4 WHEN 0 THEN 'google returned captcha challenge' WHEN 1 THEN 'boom' WHEN 2 THEN
    CASE WHEN {K} % 5 = 0 THEN 'google returned empty serp' ELSE 'google returned unusable status: serp' END
  ELSE CASE WHEN {K} % 5 = 0 THEN 'google returned no usable results' ELSE
    'google returned unusable payload' END END AS reason FROM events""")
def serp_status(spark, d):
    k = F.col("k")
    s = FP.serp_status(k % 3, F.when(k % 2 == 0, "captcha"), k % 5)
    meta = (F.when(k % 4 == 0, '{"google_status":"captcha"}').when(k % 4 == 1, '{"error":" boom "}')
            .when(k % 4 == 2, '{"google_status":"serp"}').otherwise("{}"))
    return D.events(spark, d).select(
        "event_id", s["status"].alias("status"), s["content_status"].alias("content_status"),
        FP.failure_reason(meta, k % 5).alias("reason"))


# --- search triage ---------------------------------------------------------------------------
Q_CAND = f"""{Q_TITLES}, q AS (SELECT item_id AS query_id, lower(regexp_extract(text, '^[A-Za-z]*')) AS query,
  CASE WHEN item_id % 2 = 0 THEN 'phone' ELSE 'url' END AS query_type FROM benchmark),
rows AS (SELECT page_id % (SELECT count(*) FROM benchmark) AS query_id,
  CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS engine, page_id AS pos, title, url, snippet,
  {q_canonical('url')} AS canonical, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM titles),
ok AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, canonical ORDER BY engine, pos) AS rn
  FROM rows r JOIN q USING (query_id) WHERE query <> '' AND (
    contains({q_lower("title || ' ' || snippet || ' ' || url")}, query)
    OR (query_type = 'url' AND (contains(query, host) OR contains(host, query))))),
cand AS (SELECT * FROM (SELECT query_id, engine, pos, title, url, snippet, canonical,
  row_number() OVER (PARTITION BY query_id ORDER BY engine, pos) AS rank FROM ok WHERE rn = 1)
  WHERE rank <= 30)"""
Q_GENERIC = q_any(q_lower("title || ' ' || snippet || ' ' || url"), V.GENERIC_KEYWORDS)


def _candidates(spark, d) -> DataFrame:
    return cut_lineage(triage.select_candidates(D.search_rows(spark, d), D.queries(spark, d)))


@check("select_candidates", f"""WITH {Q_CAND}
SELECT query_id, engine, pos, title, url, snippet, canonical, CAST(rank AS INTEGER) AS rank FROM cand""")
def select_candidates(spark, d):
    return _candidates(spark, d)


Q_TARGETS = f"""gen AS (SELECT *, {q_signature("title || ' ' || snippet")} AS signature FROM cand
  WHERE NOT {Q_GENERIC}),
u1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, canonical ORDER BY rank) AS r1
  FROM gen) WHERE r1 = 1),
u2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, signature ORDER BY rank) AS r2
  FROM u1) WHERE r2 = 1),
fallback AS (SELECT query_id, url, 'fallback' AS reason, pr AS priority FROM (SELECT *, CAST(row_number()
  OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS pr FROM u2) WHERE pr <= 10)"""


@check("fallback_targets", f"WITH {Q_CAND}, {Q_TARGETS} SELECT * FROM fallback")
def fallback_targets(spark, d):
    return triage.fallback_targets(_candidates(spark, d))


Q_CHOSEN = f"""listed AS (SELECT * FROM (SELECT query_id, url || CASE WHEN contains(url, '?') OR contains(url, '#')
    THEN '' ELSE '?utm_medium=x' END AS url, canonical, row_number() OVER (PARTITION BY query_id
    ORDER BY rank DESC) AS pos FROM cand WHERE query_id % 4 <> 3) WHERE pos <= 10),
known AS (SELECT l.query_id, l.url, l.pos, l.canonical, c.title, c.snippet, c.url AS cu FROM listed l
  JOIN cand c ON c.query_id = l.query_id AND c.canonical = l.canonical),
kept AS (SELECT *, {q_signature("title || ' ' || snippet")} AS signature FROM known
  WHERE NOT {Q_GENERIC.replace("url", "cu")}),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, signature ORDER BY pos) AS r2
  FROM kept) WHERE r2 = 1),
picked AS (SELECT query_id, url, 'model' AS reason, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY pos) AS INTEGER) AS priority FROM s2)"""


@check("select_targets", f"""WITH {Q_CAND}, {Q_TARGETS}, {Q_CHOSEN}
SELECT * FROM picked UNION ALL
SELECT * FROM fallback WHERE query_id NOT IN (SELECT query_id FROM picked)""")
def select_targets(spark, d):
    """Chosen: the candidates from the last to the first, with a tracking key added."""
    c = _candidates(spark, d)
    tagged = F.when(F.col("url").rlike("[?#]"), F.col("url")).otherwise(
        F.concat("url", F.lit("?utm_medium=x")))
    chosen = c.where(F.col("query_id") % 4 != 3).select(
        "query_id", (-F.col("rank")).alias("pos"), tagged.alias("url"), F.lit("model").alias("reason"))
    return triage.select_targets(c, chosen)


@check("merge_result_pages", f"""WITH {Q_CAND}, stop AS (SELECT query_id, min(pos) FILTER (WHERE pos % 17 = 16) AS p
  FROM rows GROUP BY 1),
o AS (SELECT r.* FROM rows r JOIN stop USING (query_id) WHERE p IS NULL OR pos < p),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, canonical ORDER BY pos) AS rn FROM o)
SELECT query_id, page, url, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, pos AS page, url, row_number() OVER (
  PARTITION BY query_id ORDER BY pos) AS rank FROM f WHERE rn = 1) WHERE rank <= 30""")
def merge_result_pages(spark, d):
    rows = D.search_rows(spark, d).select(
        "query_id", F.col("pos").alias("page"), (F.col("pos") % 17 == 16).alias("blocked"),
        F.array(F.struct("title", "url", "snippet")).alias("results"))
    return triage.merge_result_pages(rows).select("query_id", "page", "url", "rank")


@check("url_features", f"""WITH {Q_CAND} SELECT c.query_id, CAST(rank AS INTEGER) AS rank, {q_cut('title', 140)} AS title,
  {q_cut('snippet', 260)} AS snippet, regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain,
  true AS mentions_query, {Q_GENERIC} AS generic_or_low_signal,
  {q_any(q_lower("title || ' ' || snippet || ' ' || url"), V.SCAM_KEYWORDS)} AND
    contains({q_lower("title || ' ' || snippet || ' ' || url")}, query) AS direct_scam_signal,
  len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'),
      lambda s: s <> '')) >= 2 AS article_like
FROM cand c JOIN q USING (query_id)""")
def url_features(spark, d):
    return summaries.url_features(_candidates(spark, d), D.queries(spark, d)).drop(
        "url", "known_source_domain")


@check("expand_queries", """WITH q AS (SELECT item_id AS query_id, lower(regexp_extract(text, '^[A-Za-z]*')) AS query,
  item_id % 2 AS t FROM benchmark),
x AS (SELECT query_id, unnest(CASE WHEN t = 0 THEN [query, '"' || query || '"', query || ' lừa đảo',
    '"' || query || '" lừa đảo'] ELSE [query, '"' || query || '"', '"' || query || '" cảnh báo lừa đảo'] END)
    AS search_text, unnest(CASE WHEN t = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS pos FROM q)
SELECT query_id, pos, search_text FROM x""")
def expand_queries(spark, d):
    return triage.expand_queries(D.queries(spark, d))


# --- sources and summaries ---------------------------------------------------------------------
NAMES = ["AdminVN", "CheckScam", "TinNhiemMang", "ChongLuaDao", "TrangTrang", "Google", "DuckDuckGo"]
Q_SRC = f"""src AS (SELECT doc_id, doc_id // 7 AS query_id, {NAMES!r}[doc_id % 7 + 1] AS source,
  n_chars >= 200 AS success, text, string_split(text, chr(10))[1] AS line,
  coalesce(regexp_extract(text, '^[^\\n]*\\n([^\\n]*)', 1), '') AS rest,
  'https://docs.example.com/' || doc_id AS url, doc_id % 3 = 0 AS has_report, doc_id % 4 <> 1 AS has_result,
  greatest(doc_id % 6, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 <> 1 THEN 1
    ELSE 0 END) AS found FROM documents)"""


def q_titles(n: int) -> str:
    return (f"list_concat(CASE WHEN has_report THEN [{q_cut('line', n)}] ELSE [] END, "
            f"CASE WHEN has_result THEN [{q_cut('line', n)}] ELSE [] END)")


def q_signals(template: str, *args: str) -> str:
    return (f"CASE WHEN has_result AND {q_cut('rest', 180)} <> '' THEN {q_cut('rest', 180)} "
            f"WHEN found > 0 THEN {q_text(template, *args)} ELSE '' END")


Q_URLS = """array_to_string(list_concat(CASE WHEN has_report THEN [url] ELSE [] END,
  CASE WHEN has_result THEN [url || '/s'] ELSE [] END), '|')"""
Q_BASE_SUMMARY = f"""CASE
  WHEN has_report THEN {q_cut(q_text(V.BASELINE_REPORT, 'source', 'found', 'text'), 320)}
  WHEN has_result THEN {q_cut(q_text(V.BASELINE_RESULT, 'source', 'found', 'line', 'rest'), 320)}
  ELSE {q_text(V.BASELINE_EMPTY, 'source')} END"""


@check("baseline_summaries", f"""WITH {Q_SRC} SELECT query_id, source, CAST(found AS BIGINT) AS found,
  {Q_BASE_SUMMARY} AS summary,
  array_to_string(list_filter({q_titles(140)}, lambda t: t <> ''), '|') AS key_facts,
  {q_phone('(doc_id // 7)')} AS phone_mentions,
  {q_signals(V.BASELINE_SIGNAL, 'source', 'found')} AS risk_signals, {Q_URLS} AS evidence_urls FROM src""")
def baseline_summaries(spark, d):
    return _flat(summaries.baseline_summaries(D.source_results(spark, d)))


def _flat(df: DataFrame) -> DataFrame:
    lists = ["key_facts", "phone_mentions", "risk_signals", "evidence_urls"]
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


Q_RAW = f"""CASE WHEN has_report AND NOT {q_noise(q_cut('text', 220))} THEN {q_cut('text', 220)}
  WHEN has_result AND NOT {q_noise(q_cut("line || ' ' || rest", 220))} THEN {q_cut("line || ' ' || rest", 220)}
  ELSE '' END"""


@check("fallback_summaries", f"""WITH {Q_SRC}, r AS (SELECT *, {Q_RAW} AS raw FROM src)
SELECT query_id, source, CASE WHEN raw = '' THEN {q_text(V.FALLBACK_EMPTY, 'source')} ELSE
    {q_cut(q_text(V.FALLBACK_SUMMARY, 'source', 'raw'), 320)} END AS summary,
  array_to_string({q_titles(120)}, '|') AS key_facts, '' AS phone_mentions,
  {q_signals(V.FALLBACK_SIGNAL, 'source')} AS risk_signals, {Q_URLS} AS evidence_urls FROM r""")
def fallback_summaries(spark, d):
    return _flat(summaries.fallback_summaries(D.source_results(spark, d)))


@check("sanitise_summaries", f"""WITH {Q_SRC}, b AS (SELECT *, {Q_BASE_SUMMARY} AS bs FROM src),
c AS (SELECT *, CASE WHEN {q_leak('bs')} OR {q_noise('bs')} THEN '' ELSE bs END AS base FROM b)
SELECT query_id, source, CASE doc_id % 3 WHEN 0 THEN 'fine  summary' ELSE base END AS summary,
  CASE WHEN doc_id % 2 = 0 THEN 'a|b' ELSE array_to_string(list_distinct(list_filter({q_titles(140)},
    lambda t: t <> '' AND NOT {q_noise('t')} AND NOT {q_leak('t')})), '|') END AS key_facts
FROM c""".replace("fine  summary", "fine summary"))
def sanitise_summaries(spark, d):
    src = D.source_results(spark, d)
    docs = D.documents(spark, d)
    n3, n2 = F.col("doc_id") % 3, F.col("doc_id") % 2
    names = B.lookup(F.col("doc_id") % 7, dict(enumerate(NAMES)))
    none = F.array().cast("array<string>")
    model = docs.select(
        F.floor(F.col("doc_id") / 7).alias("query_id"), names.alias("source"),
        F.when(n3 == 0, " fine  summary").when(n3 == 1, "risk_signals: x").otherwise(
            "a proxy failed").alias("summary"),
        F.when(n2 == 0, F.array(F.lit("a"), F.lit(" a "), F.lit("timeout"), F.lit("b"), F.lit(" ")))
        .otherwise(F.array(F.lit("raw html"))).alias("key_facts"),
        none.alias("phone_mentions"), none.alias("risk_signals"))
    return summaries.sanitise_summaries(model, summaries.baseline_summaries(src)).select(
        "query_id", "source", "summary", F.array_join("key_facts", "|").alias("key_facts"))


@check("sanitise_extractions", f"""SELECT doc_id, CASE WHEN {q_noise(q_cut('text', 320))} OR {q_leak(q_cut('text', 320))}
  THEN 'Không có thông tin liên quan' ELSE {q_cut('text', 320)} END AS summary, lang AS entities FROM documents""")
def sanitise_extractions(spark, d):
    e = D.documents(spark, d).select(
        "doc_id", F.col("text").alias("summary"),
        F.array("lang", F.lit("captcha"), "lang").alias("entities"),
        F.array().cast("array<string>").alias("risk_signals"),
        F.array().cast("array<string>").alias("related_numbers"))
    return summaries.sanitise_extractions(e).select(
        "doc_id", "summary", F.array_join("entities", "|").alias("entities"))


@check("model_inputs", f"""WITH {Q_SRC} SELECT query_id, source,
  CASE WHEN has_report THEN {q_cut('text', 700)} END AS content,
  CASE WHEN has_result THEN {q_cut('rest', 240)} END AS snippet FROM src WHERE success""")
def model_inputs(spark, d):
    rows = summaries.model_inputs(D.source_results(spark, d))
    return rows.select(
        "query_id", "source", F.get_json_object("input", "$.reports[0].content").alias("content"),
        F.get_json_object("input", "$.search_results[0].snippet").alias("snippet"))


Q_VERDICT = f"""{Q_SRC}, v AS (SELECT query_id, sum(found) AS total, count(*) FILTER (WHERE success) AS ok,
  count(*) AS n, bool_or(source IN ('AdminVN', 'CheckScam', 'ChongLuaDao') AND found > 0) AS ded,
  sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS sig FROM src GROUP BY 1),
w AS (SELECT *, CASE WHEN total >= 8 OR (ded AND total >= 3) OR sig >= 4 OR total >= 5 THEN 'high'
    WHEN sig >= 2 OR total >= 2 OR ded THEN 'medium' WHEN ok = 0 THEN 'unknown' ELSE 'low' END AS lvl,
  CASE WHEN ok = 0 THEN 0.1 WHEN total >= 8 THEN 0.85 WHEN total >= 5 OR (ded AND total >= 3) THEN 0.75
    WHEN sig >= 4 OR total >= 3 THEN 0.6 WHEN sig >= 2 OR total >= 2 THEN 0.5 ELSE 0.3 END AS conf FROM v)"""


def _verdicts(spark, d) -> DataFrame:
    signals = D.documents(spark, d).groupBy(F.floor(F.col("doc_id") / 7).alias("query_id")).agg(
        F.sum(F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n_signals"))
    return risk.fallback_verdict(D.source_results(spark, d), signals)


@check("fallback_verdict", f"""WITH {Q_VERDICT} SELECT query_id, CAST(total AS BIGINT) AS total_found,
  ok AS ok_sources, n AS n_sources, ded AS dedicated, CAST(sig AS BIGINT) AS n_signals,
  lvl AS risk_level, conf::DOUBLE AS confidence FROM w""")
def fallback_verdict(spark, d):
    return _verdicts(spark, d)


Q_OWN_SIGNALS = Q_VERDICT.replace(
    "sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)", "count(*) FILTER (WHERE success AND found > 0)")


@check("investigate", f"""WITH {Q_OWN_SIGNALS}, q AS (SELECT DISTINCT doc_id // 7 AS query_id FROM documents)
SELECT query_id, {q_phone('query_id')} AS query, CAST(total AS BIGINT) AS total_found, ok AS ok_sources,
  n AS n_sources, CAST(sig AS BIGINT) AS n_signals, lvl AS risk_level, conf::DOUBLE AS confidence,
  CAST(ok AS BIGINT) AS n_summaries FROM q JOIN w USING (query_id)""")
def investigate(spark, d):
    """Whole investigations without models: candidates, targets, summaries, and the verdict from their signals."""
    results = D.source_results(spark, d)
    queries = results.select("query_id", "query", F.lit("phone").alias("query_type")).distinct()
    out = INV.investigate(queries, results)
    n = out["summaries"].groupBy("query_id").agg(F.count(F.lit(1)).alias("n_summaries"))
    return out["verdicts"].join(n, "query_id", "left").select(
        "query_id", "query", "total_found", "ok_sources", "n_sources",
        F.coalesce("n_signals", F.lit(0)).cast("bigint").alias("n_signals"), "risk_level", "confidence",
        F.coalesce("n_summaries", F.lit(0)).alias("n_summaries"))


Q_REPORT = q_text(
    V.FALLBACK_REPORT, "'Số điện thoại đang tra cứu'", q_phone("query_id"), "ok", "n", "'s1; s2'",
    "'không có'", "'f1; f2; f3; f4; f5'", "'không có'",
    "CASE lvl WHEN 'high' THEN 'cao' WHEN 'medium' THEN 'trung bình' WHEN 'low' THEN 'thấp' "
    "ELSE 'chưa rõ' END", "lvl", "printf('%.2f', conf::DOUBLE)")


@check("fallback_reports", f"WITH {Q_VERDICT} SELECT query_id, {Q_REPORT} AS report FROM w")
def fallback_reports(spark, d):
    def items(*values):
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    rows = _verdicts(spark, d).withColumns({
        "query": D.phone("query_id"), "query_type": F.lit("phone"),
        "summary_signals": items("s1", "s2"), "extraction_signals": items(),
        "key_facts": items("f1", "f2", "f3", "f4", "f5", "f6"), "entities": items()})
    return summaries.fallback_reports(rows).select("query_id", "report")


@check("source_success_ratio", f"""WITH {Q_SRC} SELECT query_id, round(avg(CAST(success AS INTEGER)), 6)
  AS success_ratio FROM src GROUP BY 1""")
def source_success_ratio(spark, d):
    return risk.source_success_ratio(D.source_results(spark, d)).withColumn(
        "success_ratio", F.round("success_ratio", 6))


@check("source_plan", f"""WITH {Q_SRC}, q AS (SELECT DISTINCT query_id, CASE query_id % 3 WHEN 0 THEN 'phone'
    WHEN 1 THEN 'bank' ELSE 'url' END AS t FROM src),
p AS (SELECT query_id, unnest(CASE WHEN t = 'phone' THEN ['AdminVN', 'CheckScam', 'TinNhiemMang', 'ChongLuaDao',
    'TrangTrang', 'Google'] ELSE ['AdminVN', 'CheckScam', 'TinNhiemMang', 'Google'] END) AS source FROM q),
r AS (SELECT query_id, source, success FROM src WHERE doc_id % 10 <> 0),
m AS (SELECT p.query_id, p.source, coalesce(success, false) AS success FROM p LEFT JOIN r USING (query_id, source)),
d AS (SELECT m.query_id, 'DuckDuckGo' AS source, coalesce(r.success, false) AS success FROM m LEFT JOIN r
  ON r.query_id = m.query_id AND r.source = 'DuckDuckGo' WHERE m.source = 'Google' AND NOT m.success),
b AS (SELECT * FROM m UNION ALL SELECT * FROM d)
SELECT query_id, source, success, false AS synthetic FROM b UNION ALL
SELECT query_id, 'DuckDuckGo', false, true FROM b GROUP BY 1 HAVING NOT bool_or(success)""")
def source_plan(spark, d):
    res = D.documents(spark, d).select("doc_id").where(F.col("doc_id") % 10 != 0).select(
        F.floor(F.col("doc_id") / 7).alias("query_id"),
        B.lookup(F.col("doc_id") % 7, dict(enumerate(NAMES))).alias("source")
    ).join(D.source_results(spark, d), ["query_id", "source"]).withColumn("error", F.lit(""))
    q = D.source_results(spark, d).select("query_id").distinct().withColumn(
        "query_type", B.lookup(F.col("query_id") % 3, {0: "phone", 1: "bank"}, "url"))
    return triage.source_plan(q.withColumn("query", F.lit("x")), res).select(
        "query_id", "source", "success", "synthetic")


@check("fetch_attempts", f"""SELECT event_id, 2 AS n_attempts, CAST(1 AS BIGINT) AS n_success,
  CASE WHEN {K} % 3 = 0 THEN 'duckduckgo returned anomaly challenge' WHEN {K} % 3 = 1 THEN 'e' || {K}
  ELSE 'duckduckgo returned empty results' END AS message FROM events""")
def fetch_attempts(spark, d):
    k = F.col("k")
    second = (F.when(k % 3 == 0, F.lit('"blocked":"anomaly"'))
              .when(k % 3 == 1, F.concat(F.lit('"error":"e'), k.cast("string"), F.lit('"')))
              .otherwise(F.lit('"error":" "')))
    meta = F.concat(
        F.lit('{"attempts":[{"strategy":"a","success":true,"result_count":3},{"strategy":"b","success":false,'),
        second, F.lit("}]}"))
    return triage.attempt_failures(
        D.events(spark, d).select("event_id", meta.alias("metadata")), ["event_id"])


# --- finished investigations -----------------------------------------------------------------
def _finished(spark, d) -> DataFrame:
    """Documents as finished investigations of phone subjects."""
    key = F.col("doc_id")
    none = F.array().cast("array<string>")
    summary = F.struct(
        F.lit("AdminVN").alias("source"), F.lit("s").alias("summary"), none.alias("key_facts"),
        F.array(F.concat(F.lit(" "), D.phone(key + 1)), D.phone(key)).alias("phone_mentions"),
        F.slice(F.array(*[F.lit(f"r{i}") for i in range(3)]), F.lit(1), (key % 4).cast("int")).alias(
            "risk_signals"),
        F.array(F.lit("https://e.example/")).alias("evidence_urls"))
    extraction = F.struct(
        F.col("source").alias("url"), F.lit("x").alias("summary"), none.alias("entities"),
        none.alias("risk_signals"), F.array(D.account(key % 50)).alias("related_numbers"))
    reports = F.array().cast("array<struct<title:string,url:string,content:string,date:string>>")
    found = F.array().cast("array<struct<title:string,url:string,snippet:string>>")

    def result(name: str, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("source"), D.phone(key).alias("query"), ok.alias("success"),
            reports.alias("reports"), found.alias("search_results"),
            F.concat(F.lit('{"report_count":'), (key % 3).cast("string"), F.lit("}")).alias("metadata"),
            F.lit(None).cast("string").alias("raw_html"), F.lit(5).cast("bigint").alias("duration_ms"),
            F.lit(None).cast("string").alias("error"))

    level = B.lookup(key % 5, {0: "critical", 1: "high", 2: "medium", 3: "low"}, "unknown")
    return D.documents(spark, d).select(
        key.cast("string").alias("investigation_id"), D.phone(key).alias("query"),
        F.lit("phone").alias("query_type"), level.alias("risk_level"),
        (key % 10 / 10.0).alias("confidence"), F.lit(2).alias("sources_analyzed"),
        F.col("n_chars").alias("duration_ms"), F.array(summary).alias("summaries"),
        F.array(extraction).alias("extractions"), F.col("lang").alias("detective_markdown"),
        F.array(result("AdminVN", key % 3 > 0), result("Google", key % 4 > 0)).alias("scraped_results"))


Q_FIN = f"""fin AS (SELECT doc_id, {q_pid('doc_id')} AS subject_id,
  CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS score,
  (CASE WHEN doc_id % 3 > 0 THEN 0.5 ELSE 0 END + CASE WHEN doc_id % 4 > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS ratio
  FROM documents),
kept AS (SELECT *, ratio * 0.4 + (doc_id % 10 / 10.0) * 0.3 + least(doc_id % 4, 3) / 10.0 * 0.2
    + 0.1 * 0.2 + 0.1 AS quality FROM fin
  WHERE round(ratio * 0.4 + (doc_id % 10 / 10.0) * 0.3 + least(doc_id % 4, 3) / 10.0 * 0.2 + 0.1 * 0.2 + 0.1, 6)
    >= 0.3)"""


@check("ingest_investigations", f"""WITH {Q_FIN}, s AS (
  SELECT 'phone' AS t, {q_phone('doc_id')} AS v, score, 1 AS n FROM kept
  UNION ALL SELECT 'phone', {q_phone('doc_id + 1')}, NULL, 0 FROM kept
  UNION ALL SELECT 'phone', NULL, NULL, 0 FROM kept WHERE false
  UNION ALL SELECT 'bank', {q_account('(doc_id % 50)')}, NULL, 0 FROM kept),
g AS (SELECT t, v, coalesce(max(score), 0.0)::DOUBLE AS score, CAST(sum(n) AS INTEGER) AS investigation_count
  FROM s GROUP BY 1, 2)
SELECT sha256(t || '|' || v) AS id, v AS value, t AS subject_type, round(score, 6) AS risk_score,
  {q_level('score')} AS risk_level, investigation_count FROM g""")
def ingest_investigations(spark, d):
    out = INV.ingest_investigations(_empty_tables(spark), _finished(spark, d), D.AS_OF)
    return out["subjects"].select(
        "id", "value", "subject_type", "risk_score", "risk_level", "investigation_count")


@check("link_mentions", f"""WITH {Q_FIN}, p AS (
  SELECT subject_id AS x, {q_pid('doc_id + 1')} AS y FROM kept
  UNION ALL SELECT subject_id, sha256('bank|' || {q_account('(doc_id % 50)')}) FROM kept)
SELECT DISTINCT least(x, y) AS subject_a_id, greatest(x, y) AS subject_b_id,
  'mentioned_together' AS link_type, 1.0::DOUBLE AS strength FROM p""")
def link_mentions(spark, d):
    out = INV.ingest_investigations(_empty_tables(spark), _finished(spark, d), D.AS_OF)
    return out["subject_links"].select("subject_a_id", "subject_b_id", "link_type", "strength")


@check("agent_evidence", f"""WITH {Q_FIN}
SELECT {q_pid('doc_id')} AS subject_id, 'agent_summary' AS evidence_type, 'AdminVN' AS source,
  CAST(least(doc_id % 4, 3) AS INTEGER) AS n_signals, 2 AS n_mentions FROM kept
UNION ALL SELECT {q_pid('doc_id')}, 'agent_extraction', source, 0, 1 FROM kept JOIN documents USING (doc_id)""")
def agent_evidence(spark, d):
    out = INV.ingest_investigations(_empty_tables(spark), _finished(spark, d), D.AS_OF)
    return out["evidence"].select(
        "subject_id", "evidence_type", "source", F.size("risk_signals").alias("n_signals"),
        F.size("mentioned_subjects").alias("n_mentions"))


@check("replay_events", """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS investigation_id, lang FROM documents)
SELECT investigation_id, CAST(seq AS BIGINT) AS seq, type, message, chunk FROM (
  SELECT investigation_id, unnest([0, 3, 5, 7, 9]) AS seq, 'phase_start' AS type, NULL AS message, NULL AS chunk FROM d
  UNION ALL SELECT investigation_id, 1, 'source_status', CASE WHEN doc_id % 3 = 0
    THEN 'Không lấy được dữ liệu từ Admin.vn.' ELSE 'Tìm thấy ' || (doc_id % 3) || ' kết quả liên quan.' END, NULL FROM d
  UNION ALL SELECT investigation_id, 2, 'source_status', CASE WHEN doc_id % 4 = 0
    THEN 'Không lấy được dữ liệu từ Google.' WHEN doc_id % 3 = 0 THEN 'Đã kiểm tra nhưng chưa thấy kết quả cụ thể.'
    ELSE 'Tìm thấy ' || (doc_id % 3) || ' kết quả liên quan.' END, NULL FROM d
  UNION ALL SELECT investigation_id, 4, 'summary_result', NULL, NULL FROM d
  UNION ALL SELECT investigation_id, 6, 'url_assessment', NULL, NULL FROM d
  UNION ALL SELECT investigation_id, 8, 'extraction_result', NULL, NULL FROM d
  UNION ALL SELECT investigation_id, 10, 'detective_stream', NULL, lang FROM d
  UNION ALL SELECT investigation_id, 11, 'complete', NULL, NULL FROM d)""")
def replay_events(spark, d):
    return ingest.replay_events(_finished(spark, d)).select(
        "investigation_id", "seq", "type", "message", "chunk")


@check("scam_signals", f"""WITH {Q_CAND} SELECT r.query_id, pos,
  {q_any(q_lower("title || ' ' || snippet || ' ' || url"), V.SCAM_KEYWORDS)}
  AND contains({q_lower("title || ' ' || snippet || ' ' || url")}, query) AS scam,
  {Q_GENERIC} AS generic FROM rows r JOIN q USING (query_id)""")
def scam_signals(spark, d):
    args = ("title", "snippet", "url")
    return D.search_rows(spark, d).join(D.queries(spark, d), "query_id").select(
        "query_id", "pos", FS.has_scam_signal(*args, "query").alias("scam"),
        FS.is_generic_result(*args).alias("generic"))


@check("page_comments", f"""SELECT doc_id, coalesce(nullif(regexp_extract(
    CASE WHEN doc_id % 2 = 0 THEN 'Reddi' ELSE 'x' END || text, '({"|".join(V.CARRIERS)})', 1), ''), 'Unknown')
  AS carrier, CASE WHEN strlen({q_strip('text')}) > 10 THEN {q_strip('text')} ELSE '' END AS comments
FROM documents""")
def page_comments(spark, d):
    """Documents as the comment of a page."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit("<main>"), F.when(F.col("doc_id") % 2 == 0, "Reddi").otherwise("x"),
        F.lit('<div class="user-comment">'), escaped, F.lit("</div></main>"))
    rows = pages.comment_items(page_nodes(D.documents(spark, d).select("doc_id", html.alias("html"))))
    return rows.withColumn("comments", F.array_join("comments", "|"))


@check("label_texts", f"""SELECT event_id, CASE WHEN value >= 85 THEN 'Hệ thống khá chắc chắn về nhận định này: '
    WHEN value >= 65 THEN 'Hệ thống có độ chắc chắn tương đối tốt về nhận định này: ' WHEN value >= 45
    THEN 'Nhận định này ở mức tham khảo, độ chắc chắn khoảng ' ELSE 'Dữ liệu còn hạn chế, độ chắc chắn hiện khoảng '
  END || CAST(CAST(floor(value / 100 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%.' AS text,
  CASE event_type WHEN 'view' THEN 'Số điện thoại đang tra cứu' WHEN 'click' THEN 'Tài khoản đang tra cứu'
  ELSE 'Địa chỉ đang tra cứu' END AS label, 'cao' AS level FROM events""")
def label_texts(spark, d):
    kind = B.lookup("event_type", {"view": "phone", "click": "bank"}, "url")
    return D.events(spark, d).select(
        "event_id", FT.confidence_text(F.col("value") / 100).alias("text"),
        FT.query_label(kind).alias("label"), FT.risk_label(F.lit("high")).alias("level"))
