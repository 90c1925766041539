"""Questions on the stored tables: overview, history, moderation list, reuse."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_of_lit, count_if, hours_before
from ..functions.subjects import normalize_subject
from .graph import neighbours
from .ranking import latest_valid, top_n

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def overview(subjects: DataFrame, investigations: DataFrame) -> DataFrame:
    """All subject fields plus the time of the last investigation."""
    last = investigations.groupBy(F.col("subject_id").alias("id")).agg(
        F.max("created_at").alias("last_investigation_at"))
    return subjects.join(last, "id", "left")


def reports_with_subject(reports: DataFrame, subjects: DataFrame, status: str | None = None
                         ) -> DataFrame:
    """Moderation list rows."""
    kept = reports if status is None else reports.where(F.col("status") == status)
    named = subjects.select(
        F.col("id").alias("subject_id"), F.col("value").alias("subject_value"), "subject_type",
        F.col("risk_level").alias("subject_risk_level"))
    return kept.join(named, "subject_id")


def recent_duplicates(reports: DataFrame, incoming: DataFrame, as_of: datetime) -> DataFrame:
    """Incoming (reporter, subject) pairs with a stored report in the last 24 hours."""
    recent = reports.where(F.col("created_at") > hours_before(as_of, 24)).select(
        "reporter_ip_hash", "subject_id").distinct()
    return incoming.join(recent, ["reporter_ip_hash", "subject_id"], "left_semi")


def reports_last_24h(reports: DataFrame, as_of: datetime, max_per_day: int = 5) -> DataFrame:
    """Reports per reporter in the last 24 hours and whether another one is allowed."""
    recent = (F.col("created_at") > hours_before(as_of, 24)) & (
        F.col("created_at") <= as_of_lit(as_of))
    n = count_if(recent)
    return reports.groupBy("reporter_ip_hash").agg(
        n.alias("n_recent"), (n < max_per_day).alias("allowed"))


def lookup_subjects(subjects: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, query, query_type) -> the subject of each, by normalised value."""
    keyed = queries.select(
        "query_id", normalize_subject("query", "query_type").alias("value"),
        F.col("query_type").alias("subject_type")).where(F.col("value") != "")
    return keyed.join(subjects, ["value", "subject_type"])


def recent_investigations(investigations: DataFrame, n: int = 10) -> DataFrame:
    return top_n(investigations, ["subject_id"], [F.desc("created_at"), "id"], n)


def approved_reports(reports: DataFrame, n: int = 10) -> DataFrame:
    return top_n(reports.where(F.col("status") == "approved"), ["subject_id"],
                 [F.desc("created_at"), "id"], n)


def explode_signals(evidence: DataFrame) -> DataFrame:
    return evidence.select("subject_id", F.explode("risk_signals").alias("signal"))


def distinct_signals(evidence: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct signals per subject in text order, the first ``limit`` of them."""
    return top_n(explode_signals(evidence).distinct(), ["subject_id"], ["signal"], limit)


def subject_history(subjects: DataFrame, investigations: DataFrame, reports: DataFrame,
                    links: DataFrame, evidence: DataFrame, wanted: DataFrame, limit: int = 10
                    ) -> dict[str, DataFrame]:
    """The five parts of a history for the wanted subject ids (column ``id``)."""
    ids = wanted.select(F.col("id").alias("subject_id")).distinct()

    def only(df: DataFrame) -> DataFrame:
        return df.join(ids, "subject_id", "left_semi")

    return {
        "subject": subjects.join(ids.withColumnRenamed("subject_id", "id"), "id", "left_semi"),
        "recent_investigations": recent_investigations(only(investigations), limit),
        "approved_reports": approved_reports(only(reports), limit),
        "linked_subjects": neighbours(subjects, links, wanted, limit),
        "all_risk_signals": distinct_signals(only(evidence)),
    }


def history_snapshot(subjects: DataFrame, investigations: DataFrame, reports: DataFrame,
                     links: DataFrame, limit: int = 10) -> DataFrame:
    """Summary per subject: counts of returned rows (at most ``limit``) and full totals."""
    last = investigations.groupBy(F.col("subject_id").alias("id")).agg(
        F.max_by("risk_level", F.struct("created_at", "id")).alias("__level"))
    approved = reports.where(F.col("status") == "approved").groupBy(
        F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("__r"))
    ends = links.select(F.explode(F.array("subject_a_id", "subject_b_id")).alias("id"))
    linked = ends.groupBy("id").agg(F.count(F.lit(1)).alias("__l"))
    n_reports, n_links = F.coalesce("__r", F.lit(0)), F.coalesce("__l", F.lit(0))
    return (
        subjects.join(last, "id", "left").join(approved, "id", "left").join(linked, "id", "left")
        .select(
            "id", "investigation_count",
            F.coalesce("__level", "risk_level").alias("last_risk_level"),
            F.least(n_reports, F.lit(limit)).cast("int").alias("approved_reports"),
            F.least(n_links, F.lit(limit)).cast("int").alias("linked_subjects_count"),
            n_reports.alias("approved_reports_total"), n_links.alias("linked_subjects_total"),
            F.date_format("first_seen_at", RFC3339).alias("first_seen"),
            F.date_format("last_seen_at", RFC3339).alias("last_seen"))
    )


def history_payload(subjects: DataFrame, investigations: DataFrame, reports: DataFrame,
                    links: DataFrame, evidence: DataFrame, limit: int = 10) -> DataFrame:
    """One JSON text per subject: summary, 5 reports, 8 links, 12 signals at most."""
    def packed(rows: DataFrame, fields: list[str], order: list, name: str) -> DataFrame:
        # at most ``limit`` capped rows per subject reach the array
        ranked = rows.withColumn("__o", F.struct(*order))
        return ranked.groupBy(F.col("subject_id").alias("id")).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__o", F.struct(*fields).alias("v")))),
                lambda x: x["v"]).alias(name))

    r = packed(approved_reports(reports, 5), ["description", "category", "created_at"],
               [(-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id"],
               "approved_reports")
    ln = packed(
        neighbours(subjects, links, n=8), ["value", "subject_type", "risk_level", "strength"],
        [(-F.col("strength")).alias("s"),
         (-F.unix_micros(F.col("last_seen_at").cast("timestamp"))).alias("t"), "other_id"],
        "linked_subjects")
    s = distinct_signals(evidence, 12).groupBy(F.col("subject_id").alias("id")).agg(
        F.array_sort(F.collect_list("signal")).alias("risk_signals"))

    def some(name: str):
        return F.coalesce(F.col(name), F.array()).alias(name)

    summary = F.struct(
        "investigation_count", "last_risk_level", F.col("approved_reports_n").alias(
            "approved_reports"), "linked_subjects_count", "first_seen", "last_seen")
    head = history_snapshot(subjects, investigations, reports, links, limit)
    head = head.withColumnRenamed("approved_reports", "approved_reports_n")
    joined = head.join(r, "id", "left").join(ln, "id", "left").join(s, "id", "left")
    return joined.select(
        "id",
        F.to_json(F.struct(
            summary.alias("summary"), some("approved_reports"), some("linked_subjects"),
            some("risk_signals"))).alias("payload"))


def with_history(queries: DataFrame, subjects: DataFrame, payloads: DataFrame) -> DataFrame:
    """queries plus the payload of their subject, NULL for an unknown one."""
    found = lookup_subjects(subjects, queries).select("query_id", "id").join(payloads, "id")
    return queries.join(found.select("query_id", "payload"), "query_id", "left")


# --- reuse of model results ------------------------------------------------------------
REUSE_KEY = ["query", "agent_name", "prompt_hash", "input_hash"]


def reused_results(inputs: DataFrame, reuse: DataFrame, as_of: datetime) -> DataFrame:
    valid = latest_valid(reuse, REUSE_KEY, as_of, tie="result").select(*REUSE_KEY, "result")
    return inputs.join(valid, REUSE_KEY)


def rows_to_score(inputs: DataFrame, reuse: DataFrame, as_of: datetime) -> DataFrame:
    valid = reuse.where(F.col("expires_at") > as_of_lit(as_of)).select(*REUSE_KEY).distinct()
    return inputs.join(valid, REUSE_KEY, "left_anti")


def existing_evidence(keys: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """Oldest stored evidence id for each key row."""
    from .kb import oldest_evidence

    return keys.join(oldest_evidence(evidence, on), on)
