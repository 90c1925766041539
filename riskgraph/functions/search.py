"""Tests on one search result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .base import ascii_lower, col, contains_any, strip
from .urls import url_host


def haystack(title, snippet, url, unicode_fold: bool = False) -> Column:
    """title, snippet and url as one text; ASCII lower unless unicode_fold is set."""
    text = F.concat(col(title), F.lit(" "), col(snippet), F.lit(" "), col(url))
    return F.lower(text) if unicode_fold else ascii_lower(text)


def _needle(query, unicode_fold: bool) -> Column:
    q = strip(query)
    return F.lower(q) if unicode_fold else ascii_lower(q)


def mentions_query(title, snippet, url, query, query_type, unicode_fold: bool = False) -> Column:
    q = _needle(query, unicode_fold)
    host = url_host(url)
    in_text = haystack(title, snippet, url, unicode_fold).contains(q)
    by_host = (col(query_type) == "url") & (q.contains(host) | host.contains(q))
    return F.coalesce((q != "") & (in_text | F.coalesce(by_host, F.lit(False))), F.lit(False))


def has_scam_signal(title, snippet, url, query, unicode_fold: bool = False) -> Column:
    text = haystack(title, snippet, url, unicode_fold)
    return contains_any(text, V.SCAM_KEYWORDS) & text.contains(_needle(query, unicode_fold))


def is_generic_result(title, snippet, url) -> Column:
    return contains_any(haystack(title, snippet, url), V.GENERIC_KEYWORDS)
