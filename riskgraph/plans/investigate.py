"""Investigations over collected material, and their ingest into the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.base import as_of_lit
from ..functions.risk import level_to_score, quality_score
from ..functions.subjects import normalize_subject, subject_id
from ..operators import graph, kb, pages, risk, summaries, triage
from ..operators.ranking import dedup_first
from ..session import cut_lineage
from ..sources.html_nodes import page_nodes

Tables = dict[str, DataFrame]


def engine_results(results: DataFrame) -> DataFrame:
    """Search results of the two engines as rows."""
    rows = results.where(F.col("source").isin(V.ENGINES)).select(
        "query_id",
        F.when(F.col("source") == V.ENGINES[0], 1).otherwise(2).alias("engine"),
        F.posexplode("search_results").alias("pos", "r"))
    return rows.select("query_id", "engine", "pos", "r.*")


def investigate(queries: DataFrame, results: DataFrame, collected: DataFrame | None = None,
                chosen: DataFrame | None = None, model_summaries: DataFrame | None = None,
                extractions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of an investigation; everything after the candidates is lazy.

    queries(query_id, query, query_type); results: source results (schemas.SOURCE_RESULT plus
    query_id); collected(url, html): fetched pages; chosen, model_summaries, extractions:
    model outputs where there are any, otherwise the rule-based fallbacks apply.
    """
    # read by every later step, so it is computed once
    candidates = cut_lineage(triage.select_candidates(engine_results(results), queries))
    targets = triage.select_targets(candidates, chosen)
    ok = results.where("success")
    baseline = summaries.baseline_summaries(ok)
    keys = ["query_id", "source"]
    fallback = summaries.fallback_summaries(ok)
    if model_summaries is None:
        summary = fallback
    else:
        cleaned = summaries.sanitise_summaries(model_summaries, baseline)
        summary = cleaned.unionByName(fallback.join(cleaned.select(*keys), keys, "left_anti"))
    out = {"candidates": candidates, "targets": targets, "baseline": baseline, "summaries": summary}
    signals = summary.select("query_id", F.size("risk_signals").alias("n"))
    if extractions is not None:
        out["extractions"] = summaries.sanitise_extractions(extractions)
        signals = signals.unionByName(
            out["extractions"].select("query_id", F.size("risk_signals").alias("n")))
    if collected is not None:
        nodes = page_nodes(
            collected.join(targets.select("url").distinct(), "url", "left_semi"), keep_html=True)
        out["page_texts"] = targets.join(pages.main_text(nodes), "url")
    n = signals.groupBy("query_id").agg(F.sum("n").alias("n_signals"))
    out["verdicts"] = queries.join(risk.fallback_verdict(results, n), "query_id")
    return out


def evidence_of(investigations: DataFrame) -> DataFrame:
    """Evidence rows of the summaries and extractions of stored investigations."""
    def rows(array: str, source: str, kind: str, mentions: str) -> DataFrame:
        return investigations.select(
            "subject_id", F.col("id").alias("investigation_id"), "created_at",
            F.posexplode(array).alias("pos", "x")
        ).select(
            F.sha2(F.concat_ws("|", "investigation_id", F.lit(kind), F.col("pos").cast("string")),
                   256).alias("id"),
            "subject_id", "investigation_id", F.col(f"x.{source}").alias("source"),
            F.lit(kind).alias("evidence_type"),
            F.to_json("x", {"ignoreNullFields": "false"}).alias("data"),
            F.col("x.risk_signals").alias("risk_signals"),
            F.col(f"x.{mentions}").alias("mentioned_subjects"), "created_at")

    return rows("summaries", "source", "agent_summary", "phone_mentions").unionByName(
        rows("extractions", "url", "agent_extraction", "related_numbers"))


def scored_investigations(finished: DataFrame, as_of: datetime) -> DataFrame:
    """Quality and ids of finished investigations that pass the gate."""
    ratio = risk.success_ratio("scraped_results")
    totals = risk.signal_totals(finished).withColumn("sources_success_ratio", ratio)
    scored = totals.withColumns({
        "quality_score": quality_score(
            "sources_success_ratio", "confidence", "n_signals", "n_urls"),
        "risk_score_numeric": level_to_score("risk_level"),
        "subject_id": subject_id("query_type", normalize_subject("query", "query_type")),
        "id": F.sha2(F.concat_ws("|", F.lit("investigation"), "investigation_id"), 256),
        "created_at": as_of_lit(as_of).cast("timestamp"),
        "detective_report": F.col("detective_markdown"),
    })
    return triage.ingest_gate(scored).where(normalize_subject("query", "query_type") != "")


def ingest_investigations(tables: Tables, finished: DataFrame, as_of: datetime) -> Tables:
    """finished: schemas.INVESTIGATION_RESULT rows.  Repeating a batch changes nothing."""
    now = as_of_lit(as_of).cast("timestamp")
    # a batch may repeat an id; the cut keeps the scoring out of the plan of every table
    rows = cut_lineage(dedup_first(
        scored_investigations(finished, as_of), ["id"], ["confidence", "detective_report"]))
    named = graph.investigation_mentions(rows)
    seen = rows.select(
        F.col("query").alias("value"), F.col("query_type").alias("subject_type"),
        now.alias("seen_at")
    ).unionByName(named.select("value", "subject_type", now.alias("seen_at")))
    subjects = cut_lineage(kb.upsert_subjects(tables["subjects"], seen)[0])
    columns = tables["investigations"].columns
    subjects, investigations = kb.append_investigations(
        subjects, tables["investigations"],
        rows.select(*[F.col(c).cast(tables["investigations"].schema[c].dataType) for c in columns]))
    evidence = evidence_of(rows)
    fresh = evidence.join(tables["evidence"].select("id"), "id", "left_anti")
    links, link_evidence = graph.upsert_links(
        tables["subject_links"], tables["link_evidence"], graph.mention_pairs(named), now)
    ids = rows.select(F.col("subject_id").alias("id")).distinct()
    subjects = risk.recalculate_risk(
        subjects, investigations, tables["user_reports"], ids, as_of=as_of)
    return {
        **tables, "subjects": subjects, "investigations": investigations,
        "evidence": tables["evidence"].unionByName(fresh),
        "subject_links": links, "link_evidence": link_evidence,
    }
