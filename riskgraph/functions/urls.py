"""URL expressions.

The splitting follows the WHATWG rules for the special schemes as far as stored
http(s) links need them: lower-case scheme and host, default port dropped, empty
path = '/', dot segments resolved, other characters percent-encoded.  All of it is
Column arithmetic, so it stays on the JVM inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .base import col, non_empty, strip

_URL = r"^(?i:(https?|wss?|ftp)):[/\\]*([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST = r"^(?:[^@]*@)?(\[[0-9a-fA-F:.]+\]|[^:@\[\]\s<>^|%]+)(?::([0-9]*))?$"
_ANY_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
# scheme and authority in one go: group 1 is the host
_START = (
    r"(?U)^\s*(?i:https?|wss?|ftp):[/\\]*(?:[^/?#\\]*@)?"
    r"(\[[0-9a-fA-F:.]+\]|[^:@\[\]\s<>^|%/?#\\]+)(?::[0-9]*)?(?=[/?#\\]|\s*$)"
)
_UNSAFE_PATH = r"[^\x21-\x7e]|[\"<>`{}]"
_DOTS = r"(^|/)\.{1,2}(/|$)"
# lower-case host, safe path without dot segments, plain key=value pairs: only the query can change
_PLAIN = (
    r"^https?://[a-z0-9.-]+/(?![.])(?:[A-Za-z0-9_~!$&'()*+,;=:@%.-]|/(?![.]))*"
    r"(?:[?][A-Za-z0-9*._-]+=[A-Za-z0-9*._-]*(?:&[A-Za-z0-9*._-]+=[A-Za-z0-9*._-]*)*)?(?:#.*)?$"
)
_TRACKED = r"(?<=[?&])(?:utm_[A-Za-z0-9*._-]*|" + "|".join(V.TRACKING_KEYS) + r")=[^&]*(?:&|$)"


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, _URL, group)


def url_scheme(url) -> Column:
    return non_empty(F.lower(_part(strip(url), 1)))


def url_host(url) -> Column:
    """Lower-case host, NULL when the text is not an absolute web URL."""
    return non_empty(F.lower(F.regexp_extract(col(url), _START, 1)))


def _encode_path(path: Column) -> Column:
    def one(ch: Column) -> Column:
        encoded = F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
        return F.when(ch.rlike(_UNSAFE_PATH), encoded).otherwise(ch)

    return F.when(
        path.rlike(_UNSAFE_PATH), F.array_join(F.transform(F.split(path, ""), one), "")
    ).otherwise(path)


def _resolve_dots(path: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)


def url_path(url) -> Column:
    """Path with at least '/', NULL when the URL does not parse."""
    u = col(url)
    raw = F.regexp_extract(u, _START + r"([^?#]*)", 2)
    trimmed = F.translate(strip(raw), "\\", "/")
    slow = F.when(trimmed == "", F.lit("/")).otherwise(_resolve_dots(_encode_path(trimmed)))
    path = F.when(raw == "", F.lit("/")).when(
        raw.rlike(_UNSAFE_PATH + r"|\\|" + _DOTS), slow).otherwise(raw)
    return F.when(u.rlike(_START), path)


def _origin(u: Column) -> Column:
    scheme = F.lower(_part(u, 1))
    authority = _part(u, 2)
    user = F.regexp_extract(authority, "^([^@]*@)", 1)
    port = F.regexp_extract(authority, _HOST, 2)
    default = (
        (scheme.isin("http", "ws") & (port == "80"))
        | (scheme.isin("https", "wss") & (port == "443"))
        | ((scheme == "ftp") & (port == "21"))
    )
    shown = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme, F.lit("://"), user, url_host(u), shown)


def _form_encode(text: Column) -> Column:
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.url_encode(F.coalesce(F.try_url_decode(text), plain))


def _pair(pair: Column) -> Column:
    key = F.regexp_extract(pair, "(?s)^([^=]*)", 1)
    value = F.regexp_replace(pair, "(?s)^[^=]*=?", "")
    return F.concat(_form_encode(key), F.lit("="), _form_encode(value))


def _is_tracking(pair: Column) -> Column:
    raw = F.regexp_extract(pair, "(?s)^([^=]*)", 1)
    key = F.coalesce(F.try_url_decode(raw), raw)
    return key.startswith("utm_") | key.isin(V.TRACKING_KEYS)


def _canonical_any(url) -> Column:
    """The general form: parse, filter and encode every pair again."""
    u = strip(url)
    pairs = F.filter(F.split(_part(u, 4), "&"), lambda p: (p != "") & ~_is_tracking(p))
    query = F.array_join(F.transform(pairs, _pair), "&")
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.when(
        url_host(u).isNotNull(), F.concat(_origin(u), url_path(u), tail)
    ).otherwise(col(url))


def canonicalize_url(url) -> Column:
    """No fragment, no tracking keys, other pairs kept in order and form-encoded again.

    Most stored URLs are plain already; for those three regular expressions do, and only the
    others go through the general form.
    """
    u = col(url)
    bare = F.regexp_replace(u, "#.*$", "")
    plain = F.when(
        F.instr(u, "?") > 0,
        F.regexp_replace(F.regexp_replace(bare, _TRACKED, ""), "[?&]$", ""),
    ).otherwise(bare)
    return F.when(u.rlike(_PLAIN), plain).otherwise(_canonical_any(u))


def is_search_page(url) -> Column:
    host, path = url_host(url), url_path(url)
    ddg = host.contains("duckduckgo.com")
    google = (host == "google.com") | host.startswith("google.") | host.startswith("www.google.")
    return F.coalesce(
        F.when(ddg, path.isin("/", "/html", "/html/")).when(google, path.isin("/search", "/url")),
        F.lit(False),
    )


def is_low_value_target(url) -> Column:
    pattern = "(?i)(" + "|".join(s.replace(".", r"\.") for s in V.DOCUMENT_SUFFIXES) + ")$"
    return F.coalesce(url_path(url).rlike(pattern), F.lit(False))


def is_article_like(url) -> Column:
    """A marker in the path, or at least two path segments."""
    path = url_path(url)
    return F.coalesce(path.rlike("(?i)" + "|".join(V.ARTICLE_MARKERS) + "|[^/]/+[^/]"), F.lit(False))


def _in_domains(host: Column, domains: list[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return F.coalesce(out, F.lit(False))


def is_known_source_domain(url, domains: list[str] | None = None) -> Column:
    return _in_domains(url_host(url), domains or V.KNOWN_SOURCE_DOMAINS)


def is_social_url(url) -> Column:
    return _in_domains(url_host(url), V.SOCIAL_DOMAINS)


def _query_value(url: Column, key: str) -> Column:
    """Decoded value of the first pair with this key, NULL when absent."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.startswith(key + "="))
    raw = F.regexp_replace(F.try_element_at(pairs, F.lit(1)), "(?s)^[^=]*=", "")
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrap_redirect(href) -> Column:
    """'/url?q=…' gives its target."""
    h = col(href)
    target = _query_value(F.concat(F.lit("https://www.google.com"), h), "q")
    return F.when(h.startswith("/url?q="), F.coalesce(target, h)).otherwise(h)


def unwrap_result_link(href) -> Column:
    """Absolute links stay; '//…' and '/…' give their 'uddg' target, else the joined URL."""
    h = col(href)
    joined = F.when(
        url_host(F.concat(F.lit("https:"), h)).isNotNull(), F.concat(F.lit("https:"), h)
    ).otherwise(F.concat(F.lit("https://duckduckgo.com"), h))
    target = _query_value(joined, "uddg")
    return F.when(h.startswith("http://") | h.startswith("https://"), h).otherwise(
        F.coalesce(target, joined)
    )


def absolute_url(base: str, href) -> Column:
    """Join a link with a fixed base page; empty gives NULL."""
    h = strip(href)
    scheme, rest = base.split("://", 1)
    host, _, path = rest.partition("/")
    path = "/" + path
    directory = path[: path.rindex("/") + 1]
    origin = f"{scheme}://{host}"

    def normal(u: Column) -> Column:
        query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)?", 1)
        fragment = F.regexp_extract(u, r"^[^#]*(#.*)?$", 1)
        return F.when(
            url_host(u).isNotNull(), F.concat(_origin(u), url_path(u), query, fragment)
        ).otherwise(u)

    joined = (
        F.when(h.rlike(_ANY_SCHEME), h)
        .when(h.startswith("//"), F.concat(F.lit(scheme + ":"), h))
        .when(h.startswith("/"), F.concat(F.lit(origin), h))
        .when(h.startswith("?") | h.startswith("#"), F.concat(F.lit(origin + path), h))
        .otherwise(F.concat(F.lit(origin + directory), h))
    )
    return F.when(h != "", normal(joined))


def ensure_scheme(url) -> Column:
    """Text that is no absolute URL gets 'https://' when that makes it one."""
    u = col(url)
    prefixed = F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", ""))
    parses = u.rlike(_ANY_SCHEME) & (url_host(u).isNotNull() | ~u.rlike("^(?i:https?|wss?|ftp):"))
    return F.when(parses, u).when(url_host(prefixed).isNotNull(), prefixed).otherwise(u)


def post_slug(url) -> Column:
    """Last path segment, NULL when empty."""
    return non_empty(F.element_at(F.split(F.regexp_replace(col(url), "/+$", ""), "/"), -1))


def url_extension(url) -> Column:
    """Lower-case suffix of the last path segment, NULL when there is none."""
    name = F.element_at(F.split(url_path(url), "/"), -1)
    return non_empty(F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))


def file_extension(content_type, url) -> Column:
    """By content type, then by URL path, else 'img'."""
    known = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "gif": "gif", "svg": "svg"}
    ctype = strip(F.split_part(col(content_type), F.lit(";"), F.lit(1)))
    ext = url_extension(url)
    by_type = by_url = None
    for key, value in V.IMAGE_TYPES.items():
        by_type = (F if by_type is None else by_type).when(ctype == key, F.lit(value))
    for key, value in known.items():
        by_url = (F if by_url is None else by_url).when(ext == key, F.lit(value))
    return F.coalesce(by_type, by_url, F.lit("img"))
