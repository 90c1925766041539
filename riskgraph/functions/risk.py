"""Scores and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .base import clamp, col, lookup


def quality_score(success_ratio, confidence, n_signals, n_urls) -> Column:
    rich = F.least((col(n_signals) + col(n_urls)) / 10.0, F.lit(1.0))
    return clamp(
        clamp(col(success_ratio)) * 0.4 + clamp(col(confidence)) * 0.3 + rich * 0.2 + 0.1
    )


def level_to_score(level) -> Column:
    return lookup(level, V.RISK_SCORES, 0.0)


def score_to_level(score) -> Column:
    """Thresholds on the score rounded to 6 places, so that 0.8 stays 0.8."""
    s = F.round(col(score), 6)
    out = None
    for bound, level in V.RISK_BOUNDS:
        out = (F if out is None else out).when(s >= bound, F.lit(level))
    return out.when(s > 0, F.lit("low")).otherwise(F.lit("unknown"))


def crawl_floor(report_count) -> Column:
    n = F.coalesce(col(report_count), F.lit(0))
    out = None
    for bound, score in V.CRAWL_FLOORS:
        out = (F if out is None else out).when(n >= bound, F.lit(score))
    return out.otherwise(F.lit(V.CRAWL_FLOOR_DEFAULT))


def report_signal(approved) -> Column:
    return F.least(col(approved) * V.REPORT_WEIGHT, F.lit(V.REPORT_WEIGHT_CAP))


def combine_risk(investigation_score, approved) -> Column:
    inv, rep = col(investigation_score), report_signal(approved)
    return F.round(
        clamp(F.when(inv <= 0, rep).otherwise(F.greatest(inv, inv * 0.8 + rep * 0.2))), 6
    )


def found_count(reports, results, metadata) -> Column:
    """Rows of a source, unless its metadata reports more."""
    rows = (
        F.coalesce(F.size(col(reports)), F.lit(0)) + F.coalesce(F.size(col(results)), F.lit(0))
    ).cast("bigint")
    stated = F.get_json_object(col(metadata), "$.report_count")
    stated = F.when(stated.rlike("^[0-9]+$"), stated).try_cast("bigint")
    return F.greatest(F.coalesce(stated, rows), rows)
