"""Schemas of the stored tables and of the transient records."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
    T.TimestampType())
_SA = T.ArrayType(_S)


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SUBJECTS = struct(
    id=_S, value=_S, subject_type=_S, risk_score=_D, risk_level=_S, report_count=_I,
    investigation_count=_I, first_seen_at=_TS, last_seen_at=_TS)
INVESTIGATIONS = struct(
    id=_S, subject_id=_S, query=_S, query_type=_S, risk_level=_S, risk_score_numeric=_D,
    confidence=_D, sources_analyzed=_I, sources_success_ratio=_D, quality_score=_D,
    duration_ms=_L, detective_report=_S, created_at=_TS)
EVIDENCE = struct(
    id=_S, subject_id=_S, investigation_id=_S, source=_S, evidence_type=_S, data=_S,
    risk_signals=_SA, mentioned_subjects=_SA, created_at=_TS)
LINKS = struct(
    subject_a_id=_S, subject_b_id=_S, link_type=_S, strength=_D, first_seen_at=_TS,
    last_seen_at=_TS)
LINK_EVIDENCE = struct(subject_a_id=_S, subject_b_id=_S, link_type=_S, evidence_id=_S)
REPORTS = struct(
    id=_S, subject_id=_S, reporter_ip_hash=_S, description=_S, category=_S, status=_S,
    reviewed_by=_S, reviewed_at=_TS, created_at=_TS)
MEDIA = struct(
    id=_S, entity_type=_S, entity_id=_S, file_path=_S, original_url=_S, content_type=_S,
    file_size_bytes=_L, created_at=_TS)
FAILURE_LOG = struct(url=_S, ts=_TS, ok=_B, phase=_S, message=_S)
REUSE = struct(
    query=_S, agent_name=_S, prompt_hash=_S, input_hash=_S, result=_S, created_at=_TS,
    expires_at=_TS)

TABLES = {
    "subjects": SUBJECTS, "investigations": INVESTIGATIONS, "evidence": EVIDENCE,
    "subject_links": LINKS, "link_evidence": LINK_EVIDENCE, "user_reports": REPORTS,
    "media": MEDIA, "crawl_log": FAILURE_LOG, "analysis_cache": REUSE,
}

# narrow frames beside the tables, from which links and floors follow without the stored evidence
INDEXES = {
    "mention_index": struct(evidence_id=_S, subject_id=_S, subject_type=_S, value=_S),
    "evidence_counts": struct(evidence_id=_S, subject_id=_S, report_count=_I),
}

POST = T.StructType([
    T.StructField("id", _L), T.StructField("link", _S),
    T.StructField("title", struct(rendered=_S)), T.StructField("content", struct(rendered=_S)),
    T.StructField("date", _S),
])
SUMMARY = struct(
    source=_S, summary=_S, key_facts=_SA, phone_mentions=_SA, risk_signals=_SA, evidence_urls=_SA)
EXTRACTION = struct(url=_S, summary=_S, entities=_SA, risk_signals=_SA, related_numbers=_SA)
SELECTED_URL = struct(url=_S, reason=_S, priority=T.ShortType())
REPORT_ITEM = struct(title=_S, url=_S, content=_S, date=_S)
SEARCH_ITEM = struct(title=_S, url=_S, snippet=_S)
SOURCE_RESULT = struct(
    source=_S, query=_S, success=_B, reports=T.ArrayType(REPORT_ITEM),
    search_results=T.ArrayType(SEARCH_ITEM), metadata=_S, raw_html=_S, duration_ms=_L, error=_S)
INVESTIGATION_RESULT = struct(
    investigation_id=_S, query=_S, query_type=_S, risk_level=_S, confidence=_D,
    sources_analyzed=_I, duration_ms=_L, summaries=T.ArrayType(SUMMARY),
    extractions=T.ArrayType(EXTRACTION), detective_markdown=_S,
    scraped_results=T.ArrayType(SOURCE_RESULT))

# one struct for the eleven tagged variants; absent fields are NULL
EVENT = struct(
    investigation_id=_S, seq=_L, ts=_TS, type=_S, phase=_I, label=_S, total_sources=_I, source=_S,
    status=_S, found=_L, message=_S, selected=_I, total=_I, urls=T.ArrayType(SELECTED_URL),
    url=_S, result=struct(
        source=_S, summary=_S, key_facts=_SA, phone_mentions=_SA, risk_signals=_SA,
        evidence_urls=_SA, url=_S, entities=_SA, related_numbers=_SA),
    investigation_count=_I, last_risk_level=_S, approved_reports=_I, linked_subjects_count=_I,
    first_seen=_S, last_seen=_S, chunk=_S, done=_B, replace=_B, risk_level=_S, confidence=_D,
    sources_analyzed=_I, duration_ms=_L, recoverable=_B)
CHUNK = struct(investigation_id=_S, seq=_L, ts=_TS, chunk=_S, done=_B, replace=_B)
SUBMISSION = struct(
    event_id=_L, created_at=_TS, peer_ip=_S, forwarded_for=_S, value=_S, subject_type=_S,
    description=_S, category=_S)
