"""Block pages and result-page status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .base import ascii_lower, col, contains_any, non_empty, strip


def is_cdn_blocked(html) -> Column:
    t = F.lower(col(html))
    return contains_any(t, V.CDN_VENDOR_MARKERS) & contains_any(t, V.CDN_BLOCK_PHRASES)


def engine_block_kind(html, n_results=None) -> Column:
    """captcha / blocked / enablejs, NULL for a usable page.

    With a result count, enablejs counts only when nothing was found.
    """
    t = ascii_lower(html)
    enablejs = contains_any(t, V.ENABLEJS_MARKERS)
    if n_results is not None:
        enablejs = enablejs & (col(n_results) <= 0)
    return (
        F.when(contains_any(t, V.CAPTCHA_MARKERS), "captcha")
        .when(contains_any(t, V.CONSENT_MARKERS), "blocked")
        .when(enablejs, "enablejs")
    )


def second_engine_block_kind(html) -> Column:
    t = ascii_lower(html)
    return F.when(contains_any(t, V.ANOMALY_MARKERS), "anomaly").when(
        t.contains("captcha"), "captcha"
    )


def block_kind(html, n_results=None) -> Column:
    """Any of the three tests, first that fires."""
    anomaly = contains_any(ascii_lower(html), V.ANOMALY_MARKERS)
    return F.coalesce(
        F.when(is_cdn_blocked(html), F.lit("cdn")),
        engine_block_kind(html, n_results),
        F.when(anomaly, F.lit("anomaly")),
    )


def serp_status(pages_succeeded, last_block, n_results) -> Column:
    """(status, content_status) of a multi-page search."""
    status = F.when(col(pages_succeeded) > 0, F.lit("serp")).otherwise(
        F.coalesce(col(last_block), F.lit("unknown"))
    )
    content = F.when(
        status == "serp",
        F.when(col(n_results) > 0, F.lit("has_results")).otherwise(F.lit("empty_results")),
    ).otherwise(F.lit("unknown"))
    return F.struct(status.alias("status"), content.alias("content_status"))


def failure_reason(metadata, n_results) -> Column:
    """Why a search gave nothing, from its metadata JSON."""
    error = non_empty(strip(F.get_json_object(col(metadata), "$.error")))
    status = F.get_json_object(col(metadata), "$.google_status")
    empty = col(n_results) == 0
    return F.coalesce(
        error,
        F.when(status == "enablejs", F.lit("google returned enablejs challenge"))
        .when(status == "captcha", F.lit("google returned captcha challenge"))
        .when(status == "blocked", F.lit("google blocked the request"))
        .when((status == "serp") & empty, F.lit("google returned empty serp"))
        .when(
            status.isNotNull(),
            F.concat(F.lit("google returned unusable status: "), status),
        )
        .when(empty, F.lit("google returned no usable results"))
        .otherwise(F.lit("google returned unusable payload")),
    )


def last_error_message(errors) -> Column:
    """Message from the last attempt error; a blank one counts as none."""
    errs = F.filter(col(errors), lambda e: e.isNotNull())
    last = F.try_element_at(errs, F.lit(-1))
    return F.when(
        F.coalesce(strip(last), F.lit("")) != "",
        F.concat(F.lit("google search failed: "), last),
    ).otherwise(F.lit("google search returned no usable results"))
