"""User reports: submission and moderation as jobs over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kb import append_reports, apply_decisions
from ..operators.risk import recalculate_risk
from ..session import cut_lineage
from ..streaming.admission import accepted_reports, admit_reports_batch, touched_subjects


def submit_reports(subjects: DataFrame, reports: DataFrame, submissions: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, reports, outcomes) after a batch of submissions.

    Accepted and duplicate reports move their subject's ``last_seen_at``; accepted ones become
    pending reports.  The outcomes are settled once, before both tables are built from them.
    """
    outcomes = cut_lineage(admit_reports_batch(submissions))
    seen = touched_subjects(outcomes).select(F.col("subject_id").alias("id"), F.col("seen_at").alias("__seen"))
    moved = subjects.join(seen, "id", "left").withColumn(
        "last_seen_at", F.greatest("last_seen_at", F.col("__seen").cast(subjects.schema["last_seen_at"].dataType))
    ).select(*subjects.columns)
    return moved, append_reports(reports, accepted_reports(submissions, outcomes)), outcomes


def moderate_reports(subjects: DataFrame, investigations: DataFrame, reports: DataFrame, decisions: DataFrame
                     ) -> tuple[DataFrame, DataFrame]:
    """(reports, new scores of the affected subjects) after moderators' decisions.

    Only subjects with a decided report are scored anew.
    """
    decided, affected = apply_decisions(reports, decisions)
    ids = cut_lineage(affected)

    def of_affected(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(ids.withColumnRenamed("id", key), key, "left_semi")

    scores = recalculate_risk(
        of_affected(subjects, "id"), of_affected(investigations, "subject_id"), of_affected(decided, "subject_id"))
    return decided, scores
