"""Risk per subject: investigations, approved reports, floors, verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.base import as_of_lit, col, count_if
from ..functions.risk import combine_risk, crawl_floor, found_count, score_to_level


def weighted_risk(investigations: DataFrame) -> DataFrame:
    """Quality-weighted mean score per subject, 0 when the weights sum to 0."""
    q = F.sum("quality_score")
    return investigations.groupBy("subject_id").agg(
        F.coalesce(
            F.sum(F.col("risk_score_numeric") * F.col("quality_score")) / F.nullif(q, F.lit(0.0)),
            F.lit(0.0),
        ).alias("investigation_score"))


def approved_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("subject_id").agg(
        count_if(F.col("status") == "approved").alias("approved"))


def crawl_floors(evidence: DataFrame, source: str | None = V.POST_SOURCE) -> DataFrame:
    """Floor of each subject with evidence of the source, by its largest report count."""
    kept = evidence if source is None else evidence.where(F.col("source") == source)
    return floors_of_counts(kept.select("subject_id", _report_count().alias("report_count")))


def _report_count() -> Column:
    count = F.nullif(F.get_json_object("data", "$.report_count"), F.lit("")).try_cast("int")
    return F.coalesce(count, F.lit(0))


def evidence_counts(evidence: DataFrame, source: str = V.POST_SOURCE) -> DataFrame:
    """(evidence_id, subject_id, report_count): all that floors need of the evidence."""
    return evidence.where(F.col("source") == source).select(
        F.col("id").alias("evidence_id"), "subject_id", _report_count().alias("report_count"))


def floors_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("subject_id").agg(
        F.max("report_count").alias("report_count_max")
    ).select("subject_id", crawl_floor("report_count_max").alias("floor"))


def apply_floors(subjects: DataFrame, floors: DataFrame, as_of: datetime | None = None
                 ) -> DataFrame:
    """Raise scores to their floor; the level follows only where the score rose."""
    f = floors.groupBy(F.col("subject_id").alias("id")).agg(F.max("floor").alias("__f"))
    low = F.col("risk_score") < F.col("__f")
    out = subjects.join(f, "id", "left").withColumns({
        "risk_level": F.when(low, score_to_level("__f")).otherwise(F.col("risk_level")),
        "risk_score": F.greatest("risk_score", "__f"),
    })
    if as_of is not None:
        out = out.withColumn("last_seen_at", F.when(
            F.col("__f").isNotNull(), as_of_lit(as_of)).otherwise(F.col("last_seen_at")))
    return out.drop("__f")


def recalculate_risk(subjects: DataFrame, investigations: DataFrame, reports: DataFrame,
                     subject_ids: DataFrame | None = None, evidence: DataFrame | None = None,
                     with_floors: bool = False, as_of: datetime | None = None) -> DataFrame:
    """Score, level and report count of all subjects, or of the given ids.

    Floors set by a crawl are not kept unless ``with_floors`` is set (evidence needed).
    """
    scores = weighted_risk(investigations).withColumnRenamed("subject_id", "id")
    counts = approved_counts(reports).withColumnRenamed("subject_id", "id")
    joined = subjects.join(scores, "id", "left").join(counts, "id", "left")
    if subject_ids is None:
        touched = F.lit(True)
    else:
        hit = subject_ids.select("id").distinct().withColumn("__hit", F.lit(True))
        joined = joined.join(hit, "id", "left")
        touched = F.coalesce(F.col("__hit"), F.lit(False))
    approved = F.coalesce("approved", F.lit(0))
    score = combine_risk(F.coalesce("investigation_score", F.lit(0.0)), approved)
    joined = joined.withColumn("__score", score)
    changes = {
        "risk_score": F.when(touched, F.col("__score")).otherwise(F.col("risk_score")),
        "risk_level": F.when(touched, score_to_level("__score")).otherwise(F.col("risk_level")),
        "report_count": F.when(touched, approved).otherwise(F.col("report_count")).cast("int"),
    }
    if as_of is not None:
        changes["last_seen_at"] = F.when(touched, as_of_lit(as_of)).otherwise(F.col("last_seen_at"))
    out = joined.withColumns(changes).select(*subjects.columns)
    if with_floors:
        floors = crawl_floors(evidence)
        if subject_ids is not None:
            ids = subject_ids.select(F.col("id").alias("subject_id")).distinct()
            floors = floors.join(ids, "subject_id", "left_semi")
        out = apply_floors(out, floors)
    return out


def touched_ids(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """Owners of linked evidence and both ends of the links."""
    return (
        evidence.select(F.col("subject_id").alias("id"))
        .unionByName(pairs.select(F.col("subject_a_id").alias("id")))
        .unionByName(pairs.select(F.col("subject_b_id").alias("id")))
        .distinct()
    )


def refresh_linked(subjects, investigations, reports, evidence, touched, as_of=None) -> DataFrame:
    """Recalculate the touched subjects, then lift them to their crawl floor again."""
    return recalculate_risk(
        subjects, investigations, reports, touched, evidence, with_floors=True, as_of=as_of)


def source_success_ratio(results: DataFrame, key: str = "query_id") -> DataFrame:
    return results.groupBy(key).agg(
        F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)).alias("success_ratio"))


def success_ratio(results: Column | str) -> Column:
    """The same on an array of results."""
    r = col(results)
    ok = F.size(F.filter(r, lambda x: x["success"]))
    return F.when(F.size(r) > 0, ok / F.size(r)).otherwise(F.lit(0.0))


def signal_totals(investigations: DataFrame) -> DataFrame:
    """Signal and evidence-URL totals over the nested summaries and extractions."""
    def total(array: str, field: str) -> Column:
        return F.aggregate(
            F.col(array), F.lit(0),
            lambda acc, x: acc + F.coalesce(F.size(x[field]), F.lit(0)))

    return investigations.withColumns({
        "n_signals": total("summaries", "risk_signals") + total("extractions", "risk_signals"),
        "n_urls": total("summaries", "evidence_urls"),
    })


def verdict_level(total, signals, ok, dedicated) -> Column:
    total, signals, ok, dedicated = map(col, (total, signals, ok, dedicated))
    high = (total >= 5) | (dedicated & (total >= 3)) | (signals >= 4)
    return (
        F.when(high, "high")
        .when((signals >= 2) | (total >= 2) | dedicated, "medium")
        .when(ok == 0, "unknown").otherwise("low")
    )


def verdict_confidence(total, signals, ok, dedicated) -> Column:
    total, signals, ok, dedicated = map(col, (total, signals, ok, dedicated))
    return (
        F.when(ok == 0, 0.1).when(total >= 8, 0.85)
        .when((total >= 5) | (dedicated & (total >= 3)), 0.75)
        .when((signals >= 4) | (total >= 3), 0.6)
        .when((signals >= 2) | (total >= 2), 0.5).otherwise(0.3)
    )


def fallback_verdict(results: DataFrame, signals: DataFrame, key: str = "query_id") -> DataFrame:
    """Level and confidence per investigation.

    results(key, source, success, reports, search_results, metadata); signals(key, n_signals).
    """
    found = found_count("reports", "search_results", "metadata")
    base = results.groupBy(key).agg(
        F.sum(found).alias("total_found"),
        count_if(F.col("success")).alias("ok_sources"),
        F.count(F.lit(1)).alias("n_sources"),
        F.max(F.col("source").isin(V.DEDICATED_SOURCES) & (found > 0)).alias("dedicated"),
    ).join(signals, key, "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
    args = ("total_found", "n_signals", "ok_sources", "dedicated")
    return base.withColumns({
        "risk_level": verdict_level(*args), "confidence": verdict_confidence(*args)})
