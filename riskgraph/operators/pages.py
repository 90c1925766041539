"""Rules over node arrays: page text, search results, posts, cards, listings.

Each rule is a Column expression on ``nodes`` (see ``sources/html_nodes.py``), so a
whole table of pages is handled inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.base import (
    ascii_lower, col, collapse, contains_any, non_empty, strip,
)
from ..functions.subjects import normalize_subject_crawl
from ..functions.text import (
    carrier, decode_entities, digits_to_number, incident_fields, normalize_org,
    strip_embedded_noise, truncate,
)
from ..functions.urls import (
    absolute_url, is_social_url, unwrap_redirect, unwrap_result_link,
)
from .ranking import dedup_first, sifted, top_n

ALL = 2**31 - 1


# --- node helpers ---------------------------------------------------------------
# A lambda variable is evaluated once per element, so a chain of F.transform calls serves
# as "let": what a later step reads several times is computed in an earlier one.
def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_class(node: Column, *names: str) -> Column:
    """All the classes, as in '.a.b'."""
    out = F.lit(True)
    for name in names:
        out = out & node["cls"].contains(f" {name} ")
    return out


def any_class(node: Column, *names: str) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | has_class(node, name)
    return out


def elements(nodes: Column, test) -> Column:
    return F.filter(nodes["list"], test)


def node_at(nodes: Column, position: Column) -> Column:
    return F.try_element_at(nodes["list"], position + 1)


def parent(nodes: Column, node: Column, up: int = 1) -> Column:
    for _ in range(up):
        node = node_at(nodes, node["up"])
    return node


def climb(nodes: Column, node: Column, start: Column, step) -> Column:
    """Folds the ancestors of an element, the closest first: ``step(state, ancestor)`` is the next state."""
    way = F.aggregate(
        F.array_repeat(F.lit(0), node["depth"]),
        F.struct(node["up"].alias("at"), start.alias("state")),
        lambda w, _: F.struct(
            node_at(nodes, w["at"])["up"].alias("at"), step(w["state"], node_at(nodes, w["at"])).alias("state")))
    return way["state"]


def descendants(nodes: Column, node: Column, test) -> Column:
    return F.filter(
        F.slice(nodes["list"], node["id"] + 2, node["last"] - node["id"]), test)


def under(nodes: Column, node: Column, *classes: str) -> Column:
    """node lies below elements with these classes, outermost first."""
    wanted = F.array(*[F.lit(f" {c} ") for c in reversed(classes)])
    matched = climb(nodes, node, F.lit(0), lambda n, e: F.when(
        (n < len(classes)) & e["cls"].contains(F.get(wanted, n)), n + 1).otherwise(n))
    return matched == len(classes)


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def text_of(nodes: Column, node: Column) -> Column:
    """Text pieces of the element put together."""
    return F.substr(nodes["text"], node["t0"] + 1, node["t1"] - node["t0"])


def words_of(nodes: Column, node: Column) -> Column:
    """Text pieces of the element with a blank between them."""
    return F.substr(nodes["spaced"], node["s0"] + 1, node["s1"] - node["s0"])


def page_text(nodes: Column | str) -> Column:
    return collapse(col(nodes)["spaced"])


def _rows(df: DataFrame, array: Column, carry: list[str] | None = None) -> DataFrame:
    """One row per array item: the other columns, ``pos`` and the fields of the item.

    The outer form keeps the optimizer from computing the array a second time for an
    inferred filter.
    """
    others = [c for c in df.columns if c != "nodes" and c not in (carry or [])]
    exploded = df.withColumn("__items", array).select(
        *others, *(carry or []), F.posexplode_outer("__items").alias("pos", "__r"))
    return exploded.where(F.col("pos").isNotNull())


def _fields(rows: DataFrame, *drop: str) -> DataFrame:
    keep = [c for c in rows.columns if c != "__r" and c not in drop]
    return rows.select(*keep, "__r.*")


# --- main text --------------------------------------------------------------------
def _longest_text(nodes: Column, test) -> Column:
    texts = F.transform(elements(nodes, test), lambda e: collapse(words_of(nodes, e)))
    return F.aggregate(
        texts,
        F.lit(""),
        lambda best, t: F.when(F.octet_length(t) > F.octet_length(best), t).otherwise(best),
    )


def main_text(nodes: DataFrame, cap: int = 2000) -> DataFrame:
    """Longest text of main, article and body; social pages use their own description.

    ``nodes`` needs the columns ``url``, ``html`` and ``nodes``.  Pages without text give their HTML.
    """
    n = F.col("nodes")
    plain = _longest_text(n, lambda e: e["tag"].isin("main", "article", "body"))
    described = first(elements(
        n, lambda e: (e["tag"] == "meta") & (attr(e, "property") == "og:description")))
    story = _longest_text(
        n,
        lambda e: ((e["tag"] == "div") & (has_class(e, "story_body_container")
                                          | attr(e, "data-ft").isNotNull()))
        | (e["tag"] == "article"),
    )
    social = F.col("__social")
    staged = nodes.withColumn("__social", is_social_url("url")).withColumns({
        "__plain": F.when(~social, non_empty(plain)),
        "__og": F.when(social, decode_entities(attr(described, "content"))),
        "__story": F.when(social, non_empty(story)),
    }).withColumn("__story", F.coalesce("__story", "html"))
    og = F.when(F.octet_length("__og") >= 20, F.col("__og"))
    story = F.when(F.octet_length("__story").between(40, 4999), F.col("__story"))
    content = F.when(social, F.coalesce(og, story, F.lit(""))).otherwise(
        F.coalesce("__plain", "html"))
    others = [c for c in nodes.columns if c not in ("nodes", "html")]
    return staged.select(*others, truncate(content, cap).alias("content"))


# --- search results -----------------------------------------------------------------
def _is_snippet(n: Column) -> Column:
    return (
        ((n["tag"] == "div") & (any_class(n, "VwiC3b", "s3v9rd", "yXK7lf")
                                | (attr(n, "data-sncf") == "1")
                                | has_class(n, "uhHOwf", "BYbUcd")))
        | ((n["tag"] == "span") & has_class(n, "aCOpRe"))
    )


#: Steps of a binary search, enough for any array that fits in a row.
_HALVES = [1 << k for k in range(27, -1, -1)]


def _n_upto(sorted_ids: Column, bound: Column) -> Column:
    """How many of the ascending ids are at most bound, by binary search."""
    return F.aggregate(
        F.array(*[F.lit(h) for h in _HALVES]), F.lit(0),
        lambda n, h: F.when(F.get(sorted_ids, n + h - 1) <= bound, n + h).otherwise(n))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _heading_items(n: Column) -> Column:
    """Headings with link and nearest snippet: the first one in the closest ancestor that has any.

    Elements are in document order, so an ancestor holds a snippet just if it reaches the next one after the
    heading or begins before the last one ahead of it.  A heading costs its depth and two binary searches.
    """
    snippets = F.filter(
        F.transform(elements(n, _is_snippet), lambda s: F.struct(
            s["id"].alias("id"), strip(text_of(n, s)).alias("text"))),
        lambda s: s["text"] != "")

    def near(h: Column, snips: Column) -> Column:
        """Its title, the two snippets around it and its way up."""
        ahead = _n_upto(snips["id"], h["id"])
        return F.struct(
            h.alias("h"), F.get(snips["id"], ahead - 1).alias("before"), F.get(snips["id"], ahead).alias("after"))

    def way(r: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("href"), F.lit(None).cast("int").alias("holder"))
        return F.struct(strip(text_of(n, r["h"])).alias("title"), climb(n, r["h"], start, lambda w, e: F.struct(
            F.coalesce(w["href"], F.when(e["tag"] == "a", attr(e, "href"))).alias("href"),
            F.coalesce(w["holder"], F.when(
                (e["last"] >= r["after"]) | (e["id"] < r["before"]), e["id"])).alias("holder"))).alias("w"))

    def item(r: Column, snips: Column) -> Column:
        return F.struct(
            r["title"].alias("title"), unwrap_redirect(r["w"]["href"]).alias("url"),
            F.coalesce(F.get(snips, _n_upto(snips["id"], r["w"]["holder"]))["text"], F.lit("")).alias("snippet"))

    headings = elements(n, lambda e: e["tag"] == "h3")
    found = _let(snippets, lambda snips: F.transform(
        F.transform(F.transform(headings, lambda h: near(h, snips)), way), lambda r: item(r, snips)))
    return F.filter(found, lambda r: r["url"].rlike("^https?://"))


def _block_items(n: Column) -> Column:
    def pick(block: Column) -> Column:
        return F.struct(
            first(descendants(n, block, lambda a: has_class(a, "result__a") | (
                (a["tag"] == "a") & under(n, a, "result__title")))).alias("link"),
            first(descendants(n, block, lambda s: has_class(s, "result__snippet"))).alias("text"))

    blocks = F.slice(elements(n, lambda e: has_class(e, "result")), 1, V.CANDIDATE_LIMIT)
    picked = F.filter(F.transform(blocks, pick), lambda p: p["link"].isNotNull())
    return F.transform(picked, lambda p: F.struct(
        strip(text_of(n, p["link"])).alias("title"),
        F.coalesce(unwrap_result_link(attr(p["link"], "href")), F.lit("")).alias("url"),
        F.coalesce(strip(text_of(n, p["text"])), F.lit("")).alias("snippet")))


def search_results(nodes: DataFrame, layout: str = "headings") -> DataFrame:
    """One row per result with its 1-based position, at most 30 per page.

    Results are found, numbered and cut inside the page's row: no shuffle.  The page's own url, title or
    snippet column is kept as ``page_url`` and so on.
    """
    nodes = nodes.withColumnsRenamed({c: f"page_{c}" for c in ("url", "title", "snippet", "pos")})
    items = {"headings": _heading_items, "blocks": _block_items}[layout](F.col("nodes"))
    rows = _rows(nodes, F.slice(items, 1, V.CANDIDATE_LIMIT))
    others = [c for c in nodes.columns if c != "nodes"]
    return rows.select(*others, "__r.title", "__r.url", "__r.snippet", (F.col("pos") + 1).alias("pos"))


def result_links(nodes: DataFrame, domain: str = V.POST_SITE) -> DataFrame:
    """Links of the first results block, first occurrence of each."""
    n = F.col("nodes")
    block = F.slice(elements(n, lambda e: has_class(e, "pst")), 1, 1)

    def is_link(a: Column) -> Column:
        return ((a["tag"] == "a") & attr(a, "href").isNotNull()
                & has_class(parent(n, a), "ct1") & has_class(parent(n, a, 2), "ct"))

    hrefs = F.flatten(F.transform(block, lambda b: F.transform(
        descendants(n, b, is_link), lambda a: attr(a, "href"))))
    kept = F.array_distinct(F.filter(
        hrefs, lambda h: ~h.contains("qh_ss=") & h.contains(domain + "/")))
    return _rows(nodes, kept).withColumnRenamed("__r", "href")


def slug_links(nodes: DataFrame, domain: str = V.POST_SITE) -> DataFrame:
    """Post slugs linked from a page: not static, not nested, first occurrence of each."""
    n = F.col("nodes")
    links = F.transform(
        elements(n, lambda a: (a["tag"] == "a") & attr(a, "href").contains(domain + "/")),
        lambda a: F.struct(
            strip(F.regexp_replace(
                F.split_part(attr(a, "href"), F.lit(domain + "/"), F.lit(2)), "^/+|/+$", "")
            ).alias("slug"),
            attr(a, "href").alias("href"), strip(text_of(n, a)).alias("title")))
    valid = F.transform(
        F.filter(links, lambda r: valid_slug(r["slug"])),
        lambda r, i: F.struct(r["slug"].alias("slug"), i.alias("place"), r["href"].alias("href"), r["title"].alias("title")))
    # neighbours in the order of slug and place: the first of each slug stays, back in the order of the page
    once = _let(F.array_sort(valid), lambda by_slug: F.filter(
        by_slug, lambda r, i: ~r["slug"].eqNullSafe(F.get(by_slug, i - 1)["slug"])))
    kept = F.array_sort(F.transform(once, lambda r: F.struct(
        r["place"].alias("pos"), r["slug"].alias("slug"), r["href"].alias("href"), r["title"].alias("title"))))
    others = [c for c in nodes.columns if c not in ("nodes", "pos")]
    return _rows(nodes.drop("pos"), kept).drop("pos").select(*others, "__r.*")


def valid_slug(slug) -> Column:
    s = col(slug)
    return ~((s == "") | s.contains("?") | s.contains("/") | s.startswith("wp-")
             | s.isin(V.STATIC_SLUGS))


def is_detail_url(url, domain: str = V.POST_SITE) -> Column:
    """A post of the site: no service page, no search, a slug of its own."""
    u = F.lower(col(url))
    slug = F.element_at(F.split(F.regexp_replace(u, "/+$", ""), "/"), -1)
    return (
        u.contains(domain + "/") & ~contains_any(u, V.EXCLUDED_DETAIL_PATHS)
        & ~u.contains("qh_ss=") & (slug != "") & (slug != domain)
    )


def evidence_images(nodes: Column | str, domain: str = V.POST_SITE) -> Column:
    """Uploaded pictures linked from a gallery, without their query, first of each."""
    n = col(nodes)
    links = elements(
        n,
        lambda a: (a["tag"] == "a") & attr(a, "href").startswith("http")
        & (F.coalesce(attr(a, "class").contains("gallery"), F.lit(False))
           | attr(a, "data-fancybox").isNotNull()),
    )
    # one pass over each link: own host, upload folder in the path, picture suffix
    upload = (r"^(?i:https?://(?:[^/?#@]*@)?[^/?#:@]*" + domain.replace(".", r"\.")
              + r"(?::[0-9]*)?(?:/[^?#]*)?/wp-content/uploads/)")
    picture = r"(?i)[^/][.](" + "|".join(V.IMAGE_EXTENSIONS) + ")$"
    clean = F.transform(
        F.filter(links, lambda a: attr(a, "href").rlike(upload)),
        lambda a: F.split_part(attr(a, "href"), F.lit("?"), F.lit(1)))
    return F.array_distinct(F.filter(clean, lambda h: h.rlike(picture)))


# --- incident posts -------------------------------------------------------------------
def incident_posts(nodes: DataFrame, fallback_title: str = "title") -> DataFrame:
    """Adds title, content and date of each incident page (``parsed_*`` columns)."""
    n = F.col("nodes")
    heading = first(elements(n, lambda e: e["tag"].isin("h1", "h2")))
    dated = first(elements(
        n, lambda e: (e["tag"] == "time") | any_class(e, "entry-date", "meta-date")))
    history = F.filter(
        F.transform(
            elements(n, lambda a: (a["tag"] == "a")
                     & (under(n, a, "sclq", "b", "c") | under(n, a, "sclq2", "b", "c"))),
            lambda a: strip(text_of(n, a))),
        lambda t: (t != "") & (t != V.MORE_LABEL))
    staged = nodes.withColumns({"__h": heading, "__d": dated, "__text": page_text(n)}).select(
        "*", non_empty(strip(text_of(n, F.col("__h")))).alias("__ht"),
        non_empty(strip(text_of(n, F.col("__d")))).alias("parsed_date"),
        F.slice(history, 1, 6).alias("__history"))
    base = staged.withColumn(
        "__heading", F.when(F.col("__ht") != V.GENERIC_HEADING, F.col("__ht")))
    return _assemble_post(base.withColumn("__f", incident_fields("__text")), fallback_title)


def _assemble_post(base: DataFrame, fallback_title: str) -> DataFrame:
    f = F.col("__f")
    base = base.withColumn("__warning", non_empty(strip_embedded_noise(f["warning"])))
    named = F.when(
        f["owner"].isNotNull() & f["account"].isNotNull(),
        F.concat_ws(" - ", f["owner"], f["account"], f["bank"]),
    )
    lines = F.array_compact(F.array(
        F.concat(F.lit(V.OWNER_LINE), f["owner"]),
        F.concat(F.lit(V.PHONE_LINE), f["phone"]),
        F.concat(F.lit(V.ACCOUNT_LINE), f["account"]),
        F.concat(F.lit(V.BANK_LINE), f["bank"]),
        F.concat(F.lit(V.WARNING_LINE), F.col("__warning")),
        F.concat(F.lit(V.COUNT_LINE), f["report_count"]),
        F.when(F.size("__history") > 0,
               F.concat(F.lit(V.HISTORY_LINE), F.array_join("__history", "; "))),
    ))
    base = base.withColumn("__lines", lines)
    rest = strip(F.split_part(F.col("__text"), F.lit(V.BODY_END), F.lit(1)))
    return base.select(
        *[c for c in base.columns if not c.startswith("__")],
        F.coalesce(F.col("__heading"), named, col(fallback_title)).alias("parsed_title"),
        F.when(F.size("__lines") > 0, F.array_join("__lines", "\n")).otherwise(rest).alias(
            "parsed_content"),
    )


def incident_posts_from_text(texts: DataFrame, text: str, title: str) -> DataFrame:
    """The same for plain text without markup (title given, no history block)."""
    base = texts.select(
        "*", collapse(text).alias("__text"), F.lit(None).cast("string").alias("__heading"),
        F.lit(None).cast("string").alias("parsed_date"),
        F.array().cast("array<string>").alias("__history"),
    ).withColumn("__f", incident_fields("__text"))
    return _assemble_post(base, title)


def _all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def post_entities(posts: DataFrame) -> DataFrame:
    """Phones, accounts and case facts of parsed posts.

    Reads parsed_title, parsed_content, parsed_date, title, date; image_urls when present.
    """
    lines = F.filter(
        F.transform(F.split("parsed_content", r"\r?\n"), lambda s: strip(s)), lambda s: s != ""
    )

    def after(prefix: str) -> Column:
        hit = F.filter(F.col("__lines"), lambda s: s.startswith(prefix))
        return F.transform(hit, lambda s: strip(F.substring(s, len(prefix) + 1, ALL)))

    def last(prefix: str) -> Column:
        return F.try_element_at(after(prefix), F.lit(-1))

    def cleaned(items: Column, kind: str) -> Column:
        values = F.transform(items, lambda v: normalize_subject_crawl(v, F.lit(kind)))
        return F.filter(values, lambda v: v != "")

    title, raw_title = F.col("parsed_title"), F.col("title")
    none = F.array().cast("array<string>")
    folded = F.col("__folded")
    staged = posts.withColumns({"__lines": lines, "__folded": ascii_lower(title)}).withColumns({
        "__phones": cleaned(after(V.PHONE_LINE), "phone"),
        "__labelled": cleaned(_all_matches(title, V.TITLE_LABELLED_PHONE, 1), "phone"),
        "__raw": cleaned(_all_matches(raw_title, V.TITLE_LABELLED_PHONE, 1), "phone"),
        "__title_phones": F.when(
            contains_any(folded, V.PHONE_WORDS), _all_matches(title, "(?U)" + V.TITLE_PHONE, 0)
        ).otherwise(none),
        "__accounts": cleaned(after(V.ACCOUNT_LINE), "bank"),
        "__title_accounts": F.when(
            contains_any(folded, V.ACCOUNT_WORDS),
            _all_matches(title, "(?U)" + V.TITLE_ACCOUNT, 0)).otherwise(none),
        "__count": last(V.COUNT_LINE),
    })
    phones = (
        F.when(F.size("__phones") > 0, F.col("__phones"))
        .when(F.size("__labelled") > 0, F.col("__labelled"))
        .otherwise(F.coalesce("__raw", none))
    )
    accounts = F.when(F.size("__accounts") > 0, F.col("__accounts")).otherwise(
        F.col("__title_accounts"))
    out = staged.withColumns({
        "phones": F.array_distinct(F.concat(phones, F.col("__title_phones"))),
        "bank_accounts": F.array_distinct(accounts),
        "owner": last(V.OWNER_LINE),
        "bank": last(V.BANK_LINE),
        "warning": last(V.WARNING_LINE),
        "report_count": F.when(
            F.col("__count").rlike(r"^\+?[0-9]+$"), F.col("__count").try_cast("int")),
        "post_date": F.coalesce(F.col("parsed_date"), F.col("date")),
    })
    out = out.select(*[c for c in out.columns if not c.startswith("__")])
    if "image_urls" not in posts.columns:
        out = out.withColumn("image_urls", none)
    return out


def post_subjects(entities: DataFrame) -> DataFrame:
    """One row per subject of a post (phones first) with the others as mentions."""
    def typed(items: str, kind: str) -> Column:
        return F.transform(
            F.col(items),
            lambda v: F.struct(F.lit(kind).alias("subject_type"), v.alias("value")),
        )

    rows = (
        entities.withColumn(
            "__all", F.concat(typed("phones", "phone"), typed("bank_accounts", "bank")))
        .select("*", F.posexplode_outer("__all").alias("subject_pos", "__s"))
        .where(F.col("subject_pos").isNotNull())
    )
    others = F.transform(
        F.filter("__all", lambda s: s != F.col("__s")),
        lambda s: F.concat(s["subject_type"], F.lit(":"), s["value"]))
    return rows.withColumns({
        "subject_type": F.col("__s.subject_type"), "value": F.col("__s.value"),
        "mentioned_subjects": others}).drop("__all", "__s")


def split_empty_posts(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with a subject, posts without one)."""
    empty = (F.size("phones") == 0) & (F.size("bank_accounts") == 0)
    return entities.where(~empty), entities.where(empty)


def post_signals(warning, report_count, images) -> Column:
    return F.array_compact(F.array(
        F.lit("checkscam_report"),
        F.when(col(warning).isNotNull(), F.lit("checkscam_warning_present")),
        F.when(col(report_count).isNotNull(), F.concat(
            F.lit("checkscam_report_count:"), col(report_count).cast("string"))),
        F.when(F.size(col(images)) > 0, F.lit("checkscam_images_present")),
    ))


def build_evidence(subjects: DataFrame, source: str = V.POST_SOURCE) -> DataFrame:
    """Evidence payload of each post subject; null fields stay in the JSON."""
    payload = F.to_json(
        F.struct(
            F.col("link").alias("source_url"), F.col("parsed_title").alias("title"), "owner",
            "bank", "warning", "report_count", F.col("post_date").alias("date"),
            F.col("id").alias("wp_post_id"), "image_urls",
        ),
        {"ignoreNullFields": "false"},
    )
    return subjects.select(
        "subject_type", "value",
        F.lit(source).alias("source"),
        F.lit("external_report").alias("evidence_type"),
        F.col("link").alias("source_url"),
        payload.alias("data"),
        post_signals("warning", "report_count", "image_urls").alias("risk_signals"),
        "mentioned_subjects", "report_count", "image_urls",
        F.col("date").alias("post_date"), F.col("id").alias("post_id"),
    )


def matches_query(url, title, content, query) -> Column:
    """Query in url, title or content, compared in Unicode lower case; empty matches."""
    needle = F.lower(strip(query))
    hit = (F.lower(col(url)).contains(needle) | F.lower(col(title)).contains(needle)
           | F.lower(col(content)).contains(needle))
    return (needle == "") | hit


def reports_for_queries(queries: DataFrame, candidates: DataFrame, slugs: DataFrame,
                        limit: int = 100) -> DataFrame:
    """Reports of each query: matching candidates, else the pages listed by slug.

    queries(query_id, query); candidates and slugs(query_id, pos, url, title, content, date).
    Repeated URLs go first, then the first ``limit`` pages count.
    """
    def first_pages(rows: DataFrame) -> DataFrame:
        # found among the numbers first, so that repeats aren't sorted with their contents; no position comes first
        first = F.when(F.count("pos") == F.count(F.lit(1)), F.min("pos")).alias("pos")
        once = top_n(rows.groupBy("query_id", "url").agg(first), ["query_id"], ["pos"], limit)
        some = sifted(rows, ["query_id", "url", "pos"], once)
        return top_n(dedup_first(some, ["query_id", "url"], ["pos"]), ["query_id"], ["pos"], limit)

    direct = (
        first_pages(candidates).join(queries, "query_id")
        .where(matches_query("url", "title", "content", "query"))
        .drop("query").withColumn("origin", F.lit("direct"))
    )
    listed = first_pages(slugs).join(
        direct.select("query_id").distinct(), "query_id", "left_anti").withColumn("origin", F.lit("slug"))
    return direct.unionByName(listed)


def site_report_count(html) -> Column:
    return F.coalesce(
        F.regexp_extract(col(html), "(?U)" + V.SITE_COUNT_PATTERN, 1).try_cast("bigint"), F.lit(0))


# --- cards --------------------------------------------------------------------------
def _label(text: Column) -> Column:
    return strip(F.replace(collapse(text), F.lit(":"), F.lit("")))


def card_report_count(nodes: Column | str) -> Column:
    n = col(nodes)
    alert = F.transform(
        F.slice(elements(n, lambda e: has_class(e, "alert", "alert-danger")), 1, 1),
        lambda e: digits_to_number(_label(words_of(n, e))))
    return F.coalesce(first(alert), F.lit(0))


def scam_cards(nodes: DataFrame, base: str = V.CARD_SITE) -> DataFrame:
    """Search cards with their seven columns."""
    n = F.col("nodes")

    def pick(c: Column) -> Column:
        return F.struct(
            first(descendants(n, c, lambda a: (a["tag"] == "a") & has_class(
                a, "stretched-link"))).alias("link"),
            first(descendants(n, c, lambda t: has_class(t, "scam-title") | (
                has_class(t, "limit") & under(n, t, "scam-title")))).alias("title"),
            F.transform(descendants(n, c, lambda x: has_class(x, "scam-column")),
                        lambda x: _label(words_of(n, x))).alias("cells"))

    def texts(p: Column) -> Column:
        return F.struct(
            F.coalesce(_label(words_of(n, p["title"])), F.lit("")).alias("title"),
            attr(p["link"], "href").alias("href"), p["cells"].alias("cells"))

    cards = F.transform(F.transform(elements(n, lambda e: has_class(e, "scam-card")), pick), texts)
    rows = _fields(_rows(nodes, F.filter(cards, lambda c: c["href"].isNotNull())))
    named = rows.withColumn("url", absolute_url(base, "href")).where(F.col("url").isNotNull())
    names = ["amount", "phone", "account_number", "bank", "views", "date"]
    return named.withColumns({
        name: F.coalesce(F.try_element_at("cells", F.lit(i + 2)), F.lit(""))
        for i, name in enumerate(names)}).drop("cells", "href")


def scam_details(nodes: DataFrame, base: str = V.CARD_SITE) -> DataFrame:
    """Detail pages by the icon of each item; pages without owner, account and complaint go."""
    n = F.col("nodes")
    picked = F.transform(
        elements(n, lambda e: has_class(e, "information-item")),
        lambda i: F.struct(
            first(descendants(n, i, lambda v: has_class(v, "information-item_value"))).alias("v"),
            first(descendants(n, i, lambda g: (g["tag"] == "img") & under(
                n, g, "information-item_title"))).alias("g")))
    items = F.transform(picked, lambda p: F.struct(
        F.coalesce(_label(words_of(n, p["v"])), F.lit("")).alias("value"),
        F.regexp_extract(F.coalesce(attr(p["g"], "src"), F.lit("")),
                         "/(user|credit|bank|price|list|content)[.]png", 1).alias("icon")))

    def by_icon(name: str) -> Column:
        # the last item of an icon wins
        hit = F.try_element_at(
            F.filter(F.col("__items"), lambda i: i["icon"] == name), F.lit(-1))
        return F.coalesce(hit["value"], F.lit(""))

    def one(test, value) -> Column:
        return first(F.transform(F.slice(elements(n, test), 1, 1), value))

    def votes(name: str) -> Column:
        found = one(lambda e: has_class(e, name),
                    lambda e: digits_to_number(_label(words_of(n, e))))
        return F.coalesce(found, F.lit(0))

    proofs = F.transform(
        elements(n, lambda a: (a["tag"] == "a") & (attr(a, "data-fancybox") == "scammer-images")),
        lambda a: absolute_url(base, attr(a, "href")))
    out = nodes.withColumn("__items", items).select(
        *[c for c in nodes.columns if c != "nodes"],
        F.coalesce(one(lambda e: e["tag"] == "title", lambda e: _label(words_of(n, e))),
                   F.lit("admin.vn")).alias("title"),
        by_icon("user").alias("owner_name"), by_icon("credit").alias("account_number"),
        by_icon("bank").alias("bank"), by_icon("price").alias("amount"),
        by_icon("list").alias("category"), by_icon("content").alias("complaint"),
        F.array_compact(proofs).alias("evidence_urls"),
        votes("information-item_vote__approved").alias("approved_votes"),
        votes("information-item_vote__disapprove").alias("disapproved_votes"),
        one(lambda e: (e["tag"] == "meta") & (attr(e, "property") == "article:published_time"),
            lambda e: attr(e, "content")).alias("published_at"))
    filled = F.concat("owner_name", "account_number", "complaint") != ""
    return out.where(filled).withColumn("content", F.format_string(
        "Chu TK: %s; STK: %s; Ngan hang: %s; So tien: %s; Hang muc: %s; Noi dung: %s; "
        "Bang chung: %d; Tan thanh: %d; Khong tan thanh: %d",
        "owner_name", "account_number", "bank", "amount", "category", "complaint",
        F.size("evidence_urls"), "approved_votes", "disapproved_votes"))


# --- listings -------------------------------------------------------------------------
def blacklist_records(nodes: DataFrame, base: str = V.LISTING_URL) -> DataFrame:
    """Records of listing pages; needs ``fake_type`` and ``listing_page`` next to ``nodes``."""
    n = F.col("nodes")

    def pick(item: Column) -> Column:
        def one(test) -> Column:
            return first(descendants(n, item, test))

        return F.struct(
            one(lambda e: has_class(e, "webkit-box-2") & under(n, e, "meta")).alias("url"),
            one(lambda e: has_class(e, "date")).alias("date"),
            one(lambda e: (e["tag"] == "div") & has_class(parent(n, e), "status")).alias("status"),
            one(lambda e: (e["tag"] == "a") & (under(n, e, "org") | under(n, e, "code"))).alias(
                "org"),
            one(lambda e: (e["tag"] == "img") & under(n, e, "org")).alias("logo"))

    def texts(p: Column) -> Column:
        return F.struct(
            collapse(text_of(n, p["url"])).alias("fake_url"),
            collapse(text_of(n, p["date"])).alias("date_text"),
            F.coalesce(collapse(text_of(n, p["status"])), F.lit("")).alias("status_text"),
            attr(p["status"], "class").alias("status_class"),
            collapse(text_of(n, p["org"])).alias("org_text"),
            attr(p["org"], "href").alias("org_href"), attr(p["logo"], "src").alias("logo_src"))

    items = elements(n, lambda e: (e["tag"] == "li") & has_class(e, "item1"))
    rows = _fields(_rows(nodes, F.filter(
        F.transform(F.transform(items, pick), texts), lambda r: r["fake_url"] != "")))
    return rows.withColumns({
        "detected_at": F.when(
            F.col("date_text").startswith(V.DETECTED_PREFIX),
            F.substring("date_text", len(V.DETECTED_PREFIX) + 1, ALL)),
        "org_name": normalize_org("org_text"),
        "org_detail_url": absolute_url(base, "org_href"),
        "org_logo_url": absolute_url(base, "logo_src"),
    }).drop("date_text", "org_text", "org_href", "logo_src")


def listing_last_page(nodes: Column | str) -> Column:
    """Largest numeric page link of a listing, NULL without any."""
    n = col(nodes)
    links = elements(n, lambda e: e["tag"].isin("a", "span") & has_class(e, "page-link")
                     & under(n, e, "pagination"))
    return F.array_max(F.transform(links, lambda e: collapse(text_of(n, e)).try_cast("int")))


def list_items(nodes: DataFrame, cap: int = 10, min_bytes: int = 3) -> DataFrame:
    """Text and link of the first ``cap`` list-like elements longer than ``min_bytes``."""
    n = F.col("nodes")
    items = F.slice(
        elements(n, lambda e: e["tag"].isin("li", "a", "tr") | has_class(e, "result-item")), 1, cap)
    texts = F.transform(items, lambda e: F.struct(
        strip(text_of(n, e)).alias("content"),
        F.coalesce(attr(e, "href"), F.lit("")).alias("url")))
    return _fields(_rows(
        nodes, F.filter(texts, lambda r: F.octet_length(r["content"]) > min_bytes)))


def comment_items(nodes: DataFrame, cap: int = 5, min_bytes: int = 10) -> DataFrame:
    """First comments of a page longer than ``min_bytes``, with the carrier it names."""
    n = F.col("nodes")
    marked = elements(n, lambda e: e["cls"].rlike("comment|review|feedback"))
    texts = F.filter(
        F.transform(marked, lambda e: strip(text_of(n, e))),
        lambda t: F.octet_length(t) > min_bytes)
    main = F.transform(
        F.slice(elements(n, lambda e: e["tag"].isin("main", "article", "body")), 1, 1),
        lambda e: carrier(words_of(n, e)))
    return nodes.select(
        *[c for c in nodes.columns if c != "nodes"], first(main).alias("carrier"),
        F.slice(texts, 1, cap).alias("comments"))


def min_length_items(items: Column | str, min_bytes: int, cap: int) -> Column:
    return F.slice(F.filter(col(items), lambda t: F.octet_length(t) > min_bytes), 1, cap)


def read_feed(df: DataFrame, json_col: str, default_title: str = "chongluadao") -> DataFrame:
    """Items of a JSON feed whose data is not null."""
    item = "array<struct<name:string,source:string,data:string>>"
    others = [F.col(c) for c in df.columns if c != json_col]
    rows = df.select(*others, F.posexplode(F.from_json(json_col, item)).alias("pos", "i"))
    return rows.where(F.col("i.data").isNotNull()).select(
        *others, "pos",
        F.coalesce("i.name", "i.source", F.lit(default_title)).alias("title"),
        F.col("i.data").alias("content"))
