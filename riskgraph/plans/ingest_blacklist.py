"""Ingest of blacklist records: url subjects, evidence, organisations, links."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.base import as_of_lit, count_if
from ..functions.subjects import normalize_subject, subject_id
from ..functions.text import is_known_org, slugify
from ..operators import graph, kb, risk
from ..session import cut_lineage

Tables = dict[str, DataFrame]


def record_evidence(records: DataFrame, source: str = V.BLACKLIST_SOURCE) -> DataFrame:
    """Evidence payload, signals and subject ids of listing records."""
    data = F.to_json(F.struct(
        F.col("fake_url").alias("source_url"), "fake_type", "detected_at", "status_text",
        "status_class", F.col("org_name").alias("impersonated_org_name"),
        F.col("org_detail_url").alias("impersonated_org_url"), "org_logo_url", "listing_page",
    ), {"ignoreNullFields": "false"})
    signals = F.array(
        F.lit("tinnhiemmang_blacklist"),
        F.concat(F.lit("tinnhiemmang_type:"), F.col("fake_type")),
        F.concat(F.lit("tinnhiemmang_status:"), slugify("status_text")))
    url = normalize_subject("fake_url", F.lit("url"))
    org = normalize_subject("org_name", F.lit("organization"))
    return records.where(url != "").select(
        "*", url.alias("url_value"), subject_id(F.lit("url"), url).alias("subject_id"),
        F.when(is_known_org("org_name"), org).alias("org_value"),
        F.when(is_known_org("org_name"), subject_id(F.lit("organization"), org)).alias("org_id"),
        F.lit(source).alias("source"), F.lit("blacklist_record").alias("evidence_type"),
        F.col("fake_url").alias("source_url"), data.alias("data"),
        signals.alias("risk_signals"), F.array().cast("array<string>").alias("mentioned_subjects"),
        F.lit(None).cast("string").alias("investigation_id"))


def impersonation_pairs(stored: DataFrame) -> DataFrame:
    rows = stored.where(F.col("org_id").isNotNull()).select(
        "subject_id", F.col("org_id").alias("other_id"), F.col("id").alias("evidence_id"))
    return graph.ordered_pair(rows).select(
        "subject_a_id", "subject_b_id", F.lit("impersonates").alias("link_type"), "evidence_id")


def blacklist_stats(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_distinct("listing_page").alias("pages_fetched"),
        F.count(F.lit(1)).alias("records_seen"), F.count(F.lit(1)).alias("records_written"),
        count_if(is_known_org("org_name")).alias("links_created"))


def ingest_blacklist(tables: Tables, records: DataFrame, as_of: datetime, dry_run: bool = False
                     ) -> tuple[Tables, DataFrame]:
    """records as given by ``pages.blacklist_records``; later rows of a page win."""
    if dry_run:
        return tables, blacklist_stats(records)
    records = cut_lineage(records)  # every table below reads them, pages are parsed once
    stats = blacklist_stats(records)
    now = as_of_lit(as_of).cast("timestamp")
    changes = record_evidence(records)
    seen = changes.select(
        F.col("url_value").alias("value"), F.lit("url").alias("subject_type"), now.alias("seen_at")
    ).unionByName(changes.where(F.col("org_value").isNotNull()).select(
        F.col("org_value").alias("value"), F.lit("organization").alias("subject_type"),
        now.alias("seen_at")))
    subjects, _ = kb.upsert_subjects(tables["subjects"], seen)
    keys = ["subject_id", "source", "source_url", "fake_type"]
    order = [c for c in ("listing_page", "pos") if c in changes.columns]
    evidence, stored = kb.upsert_evidence(
        kb.with_json_keys(tables["evidence"]), changes, keys, order, now)
    floors = changes.select("subject_id", F.lit(V.BLACKLIST_SCORE).alias("floor"))
    links, link_evidence = graph.upsert_links(
        tables["subject_links"], tables["link_evidence"], impersonation_pairs(stored), now)
    return {
        **tables,
        "subjects": risk.apply_floors(subjects, floors, as_of),
        "evidence": evidence.select(*tables["evidence"].columns),
        "subject_links": links, "link_evidence": link_evidence,
    }, stats
