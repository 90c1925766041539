"""Page rules on small literal pages."""

import random

from pyspark.sql import functions as F

from riskgraph.operators import pages as P
from riskgraph.plans.ingest_posts import parse_posts
from riskgraph.sources.html_nodes import page_nodes


def nodes(spark, *html, keep_html=False, url="https://example.com/a"):
    rows = [(i, url, h) for i, h in enumerate(html)]
    return page_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"),
                      keep_html=keep_html)


def test_structure(spark):
    n = nodes(spark, "<p>a<p>b<ul><li>1<li>2</ul><br>c</div>", "plain", "", None).collect()
    tags = [e["tag"] for e in n[0]["nodes"]["list"]]
    assert tags == ["html", "head", "body", "p", "p", "ul", "li", "li", "br"]
    assert n[0]["nodes"]["text"] == "ab12c"
    assert n[0]["nodes"]["spaced"] == "a b 1 2 c"
    ul = n[0]["nodes"]["list"][5]
    assert (ul["last"], ul["up"], ul["depth"], ul["t0"], ul["t1"]) == (7, 2, 2, 2, 4)
    assert n[1]["nodes"]["text"] == "plain" and n[1]["nodes"]["list"][2]["t1"] == 5
    assert [len(r["nodes"]["list"]) for r in n[2:]] == [3, 3]


def test_deep_pages_keep_their_tree(spark):
    deep = ('<div class="outer">' + "<div>" * 5000 + '<a href="https://e.x/1"><h3>t</h3></a><p>one<p>two'
            + '<div class="VwiC3b">near</div>' + "</div>" * 5000 + '</div><div class="VwiC3b">far</div>y')
    n = nodes(spark, deep)
    page = n.first()["nodes"]
    assert page["text"] == "tonetwonearfary" and max(e["depth"] for e in page["list"]) > 5000
    for e in page["list"][1:]:
        up = page["list"][e["up"]]
        assert up["id"] < e["id"] <= e["last"] <= up["last"] and up["depth"] == e["depth"] - 1
    assert [(r["url"], r["snippet"]) for r in P.search_results(n).collect()] == [("https://e.x/1", "near")]
    inside = n.select(F.transform(P.elements(F.col("nodes"), lambda e: e["tag"] == "h3"), lambda h: F.struct(
        P.under(F.col("nodes"), h, "outer"), P.under(F.col("nodes"), h, "outer", "outer"))).alias("x")).first()["x"]
    assert [tuple(x) for x in inside] == [(True, False)]
    # very deep nesting takes time in proportion to the page
    far = nodes(spark, "<div>" * 100_000 + "x" + "</div>" * 100_000 + "y").first()["nodes"]
    assert far["text"] == "xy" and far["list"][-1]["depth"] == 100_001


def naive_nearest(page, h):
    """The first snippet inside the closest ancestor that holds one."""
    snips = [e for e in page["list"] if " VwiC3b " in e["cls"] and page["text"][e["t0"]:e["t1"]].strip()]
    at = h["up"]
    while at is not None:
        a = page["list"][at]
        inside = [s for s in snips if a["id"] < s["id"] <= a["last"]]
        if inside:
            return page["text"][inside[0]["t0"]:inside[0]["t1"]].strip()
        at = a["up"]
    return ""


def test_nearest_snippets_and_positions(spark):
    rng = random.Random(7)
    html = []
    for _ in range(40):
        parts, open_ = [], 0
        for i in range(rng.randint(0, 60)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(["<div>", '<div class="VwiC3b">']))
                open_ += 1
            elif kind < 0.65 and open_:
                parts.append("</div>")
                open_ -= 1
            elif kind < 0.85:
                parts.append(f'<a href="https://e.x/{i}"><h3>t{i}</h3></a>')
            else:
                parts.append(f'<div class="VwiC3b">{rng.choice(["", f"s{i}"])}</div>')
        html.append("".join(parts))
    n = nodes(spark, *html).select("page_id", "nodes")
    got = {}
    for r in P.search_results(n).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append((r["pos"], r["title"], r["snippet"]))
    want = {}
    for r in n.collect():
        page = r["nodes"]
        heads = [h for h in page["list"] if h["tag"] == "h3"][:30]
        if heads:
            want[r["page_id"]] = [(i + 1, page["text"][h["t0"]:h["t1"]], naive_nearest(page, h))
                                  for i, h in enumerate(heads)]
    assert got == want and any(s for rows in want.values() for _, _, s in rows)


def test_slugs_once_without_a_shuffle(spark):
    links = ["b/", "a", "wp-x", "b", "a/", "c/d", "c", "b"]
    html = "".join(f'<a href="https://checkscam.vn/{s}">{i}</a>' for i, s in enumerate(links))
    out = P.slug_links(nodes(spark, html, "", html))
    assert [(r["page_id"], r["slug"], r["title"]) for r in out.collect()] == [
        (p, s, t) for p in (0, 2) for s, t in [("b", "0"), ("a", "1"), ("c", "6")]]
    for rows in (out, P.search_results(nodes(spark, html)), P.search_results(nodes(spark, html), "blocks")):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_main_text(spark):
    html = ("<html><head><title>t</title></head><body><nav>menu</nav><main><p>long</p>\n"
            "<p>text here</p></main><script>s</script></body></html>")
    out = P.main_text(nodes(spark, html, keep_html=True)).first()
    assert out["content"] == "menu long text here s"
    quiet = page_nodes(
        spark.createDataFrame([("https://e.x/", html)], "url string, html string"), keep_html=True,
        with_scripts=False)
    assert P.main_text(quiet).first()["content"] == "menu long text here"
    assert P.main_text(nodes(spark, "<img>", keep_html=True)).first()["content"] == "<img>"
    cut = P.main_text(nodes(spark, "<p>" + "é" * 3000, keep_html=True)).first()["content"]
    assert cut == "é" * 2000


def test_social_text(spark):
    url = "https://www.facebook.com/x"
    og = '<meta property="og:description" content="A long enough &amp;#273; description">'
    assert P.main_text(nodes(spark, og, keep_html=True, url=url)).first()["content"] == (
        "A long enough đ description")
    story = '<div data-ft="1">' + "story text " * 5 + "</div><p>other</p>"
    assert P.main_text(nodes(spark, story, keep_html=True, url=url)).first()["content"] == (
        ("story text " * 5).strip())
    assert P.main_text(nodes(spark, "<div data-ft>short</div>", keep_html=True, url=url)
                       ).first()["content"] == ""


def test_result_layouts(spark):
    one = ('<div class="MjjYud"><div><a href="/url?q=https://example.com/report&sa=U&ved=2ah"><div>'
           "<h3>Cảnh báo giao dịch</h3></div></a>"
           '<div class="VwiC3b">Nội dung snippet thử nghiệm.</div></div></div>')
    two = ('<html><body><div><a href="/url?q=https://site.example/nguyen-24/&sa=U"><h3>Nguyen 0562015037'
           '</h3></a><div class="BNeawe s3v9rd">Canh bao so 0562015037</div></div>'
           "<h3>no link</h3><a href='/rel'><h3>relative</h3></a></body></html>")
    rows = P.search_results(nodes(spark, one, two)).orderBy("page_id").collect()
    assert [(r["pos"], r["title"], r["url"], r["snippet"]) for r in rows] == [
        (1, "Cảnh báo giao dịch", "https://example.com/report", "Nội dung snippet thử nghiệm."),
        (1, "Nguyen 0562015037", "https://site.example/nguyen-24/", "Canh bao so 0562015037")]
    many = "".join(f'<a href="https://e.x/{i}"><h3>t{i}</h3></a>' for i in range(40))
    assert P.search_results(nodes(spark, many)).count() == 30


def test_gallery(spark):
    html = """<a class="gallery" href="https://checkscam.vn/wp-content/uploads/2026/05/e-1.jpg?v=123">x</a>
      <a class="gallery" href="https://checkscam.vn/wp-content/themes/site/logo.png">x</a>
      <a class="gallery" href="https://cdn.example.com/wp-content/uploads/external.jpg">x</a>
      <a data-fancybox href="https://checkscam.vn/wp-content/uploads/2026/05/e-2.webp">x</a>
      <img src="https://checkscam.vn/wp-content/uploads/2025/10/S.png">"""
    got = nodes(spark, html).select(P.evidence_images("nodes").alias("x")).first()["x"]
    assert got == ["https://checkscam.vn/wp-content/uploads/2026/05/e-1.jpg",
                   "https://checkscam.vn/wp-content/uploads/2026/05/e-2.webp"]


def test_incident_post(spark):
    html = ("<h1> Lừa đảo </h1><time> 01/02 </time>"
            "<p>Chủ tk: An. STK: 123456789 SĐT: 0909 888 777 Ngân hàng: ACB Hạng mục: x</p>"
            '<div class="sclq"><div class="b"><div class="c"><a>Cũ 1</a><a>Xem thêm</a></div></div></div>'
            '<div class="b"><div class="c"><a>ngoài</a></div></div>')
    posts = spark.createDataFrame(
        [(1, "l1", "t", html, "2024-01-01"),
         (2, "l2", "STK 987654321 và sdt 0912345678", "<p>không có gì #s1 rest", "2024-01-02")],
        "id long, link string, title string, html string, date string")
    a, b = parse_posts(posts).orderBy("id").collect()
    assert (a["parsed_title"], a["parsed_date"], a["phones"], a["bank_accounts"], a["owner"]) == (
        "Lừa đảo", "01/02", ["0909888777"], ["123456789"], "An")
    assert a["parsed_content"].endswith("Lịch sử phản ánh cùng STK: Cũ 1")
    assert (b["phones"], b["bank_accounts"], b["parsed_content"], b["post_date"]) == (
        ["0912345678"], ["987654321", "0912345678"], "không có gì", "2024-01-02")
    kept, empty = P.split_empty_posts(parse_posts(posts.limit(0)))
    assert kept.count() == 0 and empty.count() == 0


def test_feed(spark):
    df = spark.createDataFrame([(1, '[{"name":"A","data":{"x": 1}},{"source":"B","data":[1]},'
                                    '{"data":"s"},{"name":"C","data":null},{"name":"D"}]')],
                               "id int, j string")
    rows = P.read_feed(df, "j").orderBy("pos").collect()
    assert [(r["title"], r["content"]) for r in rows] == [
        ("A", '{"x":1}'), ("B", "[1]"), ("chongluadao", "s")]


def test_slugs_and_detail_urls(spark):
    urls = ["https://checkscam.vn/abc/", "https://checkscam.vn/bio/x", "https://checkscam.vn/",
            "https://checkscam.vn/?qh_ss=1", "https://other.vn/abc"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.where(P.is_detail_url("u")).collect()] == [urls[0]]


def test_comments(spark):
    html = '<body>Viettel <p class="user-comment"> a long comment </p><p class="review">short</p></body>'
    r = P.comment_items(nodes(spark, html)).first()
    assert (r["carrier"], r["comments"]) == ("Viettel", ["a long comment"])


def test_site_count(spark):
    assert spark.range(1).select(P.site_report_count(F.lit("không")).alias("x")).first()["x"] == 0
    assert spark.range(1).select(P.site_report_count(F.lit("Có 12 cảnh báo")).alias("x")).first()["x"] == 12


def test_plain_markup_has_its_own_path(spark, monkeypatch):
    """Whatever the spelling, the elements are those of the standard parser; plain pages don't go through it."""
    from html.parser import HTMLParser

    from riskgraph.sources import html_nodes as H

    class Standard(H._Nodes):
        feed = HTMLParser.feed

    def tree(kind, html, with_scripts):
        page = kind(with_scripts)
        page.feed(html)
        page.finish()
        attrs = [[tuple(a) for a in pairs] for pairs in page.attrs]
        return page.tags, attrs, page.up, page.depth, page.last, page.t0, page.t1, page.s0, page.s1, page.pieces

    bits = [
        "<p>", "</p>", '<P Class="a  b">', "<div id=x>", "<div id=\"x\" id='y' checked>", "</div >", "</div>", "<br/>", "<br />",
        "<img src=\"a&amp;b\" alt='<>\"'/>", "text", "a &amp; b", "&", "&am", "&#65;", "<", "<3", " < ", "<!-- c -->", "<!-- a-b -->",
        "<!--x", "-->", "<!DOCTYPE html>", '<!doctype x "[>', "<?pi?>", "<script>", "if(a<b){}</p>", "</script>", "<style>", "</style>",
        "<title>", "</title>", "<textarea>", "</textarea>", "<ul>", "<li>", '<li a="1"b="2">', "</ul>", "<table>", "<tr>", "<td>",
        "</table>", '<html lang="v">', "<head>", "</head>", '<body class="q">', "</body>", "</html>", "  \n", '<a href="x"y>',
        '<a href = "x">', '<a\thref="x"\n>', '<a/href="x">', "<a-b c='d'>", "</a-b>", '<x y="&lt;&quot;">', "ấ", "\x00",
        '<a \x0b b="c">', "<noscript>", '<a href="open', '<a href="">', "<![CDATA[x]]>", '<a b="c" //>', "</>", "</ p>", "<p\r\n>"]
    rng = random.Random(3)
    for _ in range(4000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        for with_scripts in (True, False):
            assert tree(H._Nodes, html, with_scripts) == tree(Standard, html, with_scripts), html

    def refuse(*args):
        raise AssertionError("the standard parser was asked")

    monkeypatch.setattr(HTMLParser, "parse_starttag", refuse)
    monkeypatch.setattr(HTMLParser, "parse_endtag", refuse)
    page = '<!DOCTYPE html><html><body><!-- c --><h2 class="a b">T &amp; t</h2><a href=\'x?a=1&amp;b\' checked>x</a><br/>y</body></html>z'
    tags, attrs, *_, pieces = tree(H._Nodes, page, True)
    assert tags == ["html", "head", "body", "h2", "a", "br"] and pieces == ["T & t", "x", "y", "z"]
    assert attrs[4] == [("href", "x?a=1&b"), ("checked", "")]
