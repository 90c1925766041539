"""Streaming ingest of finished investigations, periodic refresh, replay."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import fixed_values as V
from ..functions.base import lookup
from ..functions.risk import found_count
from ..operators import history, kb, triage
from ..plans.investigate import engine_results, ingest_investigations
from ..sources import change_log
from ..sources.snapshots import drop_old_versions, read_tables, write_tables


def ingest_batch(base: str, clock: Callable[[], datetime] | None = None):
    """foreachBatch function: read the newest tables, add the batch, write the next version.

    Ids are derived from the rows, so a batch that is delivered again adds nothing.
    """
    now = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    changed = ["subjects", "investigations", "evidence", "subject_links", "link_evidence"]

    def run(batch: DataFrame, _batch_id: int) -> None:
        tables = read_tables(batch.sparkSession, base)
        out = ingest_investigations(tables, batch, now())
        write_tables({name: out[name] for name in changed}, base)

    return run


def ingest_changes(base: str, clock: Callable[[], datetime] | None = None, name: str = "investigations", tries: int = 5):
    """foreachBatch function over a change log: only the rows that the batch adds or replaces are written.

    A batch of stream ``name`` that is delivered again changes nothing, whatever the clock says by then. If another
    writer commits meanwhile, the batch is worked out again from what that writer left."""
    now = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    changed = ["subjects", "investigations", "evidence", "subject_links", "link_evidence"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for left in reversed(range(tries)):
            at = change_log.state(spark, base)
            if at["streams"].get(name, -1) >= batch_id:
                return
            tables = change_log.read_all(spark, base, at)
            out = ingest_investigations(tables, batch, now())
            rows = {t: change_log.changes_between(tables[t], out[t], change_log.KEYS[t]) for t in changed}
            try:
                change_log.commit(spark, base, at["version"], rows, stream=(name, batch_id))
                return
            except change_log.Conflict:
                if not left:
                    raise

    return run


def ingest_stream(spark: SparkSession, source: str, base: str, checkpoint: str,
                  clock: Callable[[], datetime] | None = None, files_per_trigger: int = 100, batch=ingest_batch):
    """Start the ingest of JSON results; the caller stops or awaits the returned query.

    ``batch`` is ``ingest_batch`` (whole versions) or ``ingest_changes`` (a change log)."""
    stream = (spark.readStream.schema(S.INVESTIGATION_RESULT)
              .option("maxFilesPerTrigger", files_per_trigger).json(source))
    return (stream.writeStream.foreachBatch(batch(base, clock))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def refresh(tables: dict[str, DataFrame], as_of: datetime) -> dict[str, DataFrame]:
    """The scheduled work: rebuilt overview and stored results without the expired ones."""
    kept, purged = kb.purge_expired(tables["analysis_cache"], as_of)
    return {
        "overview": history.overview(tables["subjects"], tables["investigations"]),
        "analysis_cache": kept, "purged": purged,
    }


def run_refresh(spark: SparkSession, base: str, as_of: datetime, keep: int = 3) -> dict[str, str]:
    """The scheduled job: refresh the stored tables, put the result in force, retire old versions."""
    out = refresh(read_tables(spark, base), as_of)
    paths = write_tables({"analysis_cache": out["analysis_cache"], "overview": out["overview"]}, base)
    drop_old_versions(spark, base, keep)
    return paths


def replay_events(results: DataFrame, include_report: bool = True) -> DataFrame:
    """A stored result as the event rows it produced, in order (``seq`` from 0).

    Every part becomes rows of (part, pos); the sequence number follows from the array sizes,
    so no sort is needed.
    """
    key = "investigation_id"
    n_src, n_sum, n_ext = (
        F.size("scraped_results"), F.size("summaries"), F.size("extractions"))
    blank = {
        "phase": "int", "label": "string", "total_sources": "int", "source": "string",
        "status": "string", "found": "bigint", "message": "string", "selected": "int",
        "total": "int", "url": "string", "result": "string", "chunk": "string",
        "done": "boolean", "replace": "boolean", "risk_level": "string", "confidence": "double",
        "sources_analyzed": "int", "duration_ms": "bigint",
    }

    def rows(df: DataFrame, seq, kind: str, **fields) -> DataFrame:
        columns = [fields[c].cast(t).alias(c) if c in fields else F.lit(None).cast(t).alias(c)
                   for c, t in blank.items()]
        return df.select(key, seq.cast("bigint").alias("seq"), F.lit(kind).alias("type"), *columns)

    def phase(n: int, seq, total=None) -> DataFrame:
        extra = {"total_sources": total} if total is not None else {}
        return rows(results, seq, "phase_start", phase=F.lit(n), label=F.lit(V.PHASE_LABELS[n]),
                    **extra)

    def exploded(array: str) -> DataFrame:
        return results.select(
            key, n_src.alias("a"), n_sum.alias("b"), n_ext.alias("c"),
            F.posexplode(array).alias("pos", "x"))

    found = found_count(F.col("x.reports"), F.col("x.search_results"), F.col("x.metadata"))
    message = (
        F.when(~F.col("x.success"), F.format_string(
            V.STATUS_FAILED_TEXT, lookup("x.source", V.SOURCE_LABELS)))
        .when(found > 0, F.format_string(V.STATUS_FOUND_TEXT, found))
        .otherwise(F.lit(V.STATUS_NOTHING_TEXT)))
    a, b, pos = F.col("a"), F.col("b"), F.col("pos")
    queries = results.select(F.col(key).alias("query_id"), "query", "query_type")
    sources = results.select(F.col(key).alias("query_id"), F.explode("scraped_results").alias("x"))
    candidates = triage.select_candidates(
        engine_results(sources.select("query_id", "x.*").drop("query")), queries)
    totals = candidates.groupBy(F.col("query_id").alias(key)).agg(
        F.count(F.lit(1)).cast("int").alias("n_candidates"))
    chosen = results.join(totals, key, "left")
    base3 = n_src + n_sum + 2
    parts = [
        phase(1, F.lit(0), n_src),
        rows(exploded("scraped_results"), pos + 1, "source_status", source=F.col("x.source"),
             status=F.when(F.col("x.success"), "done").otherwise("error"), found=found,
             message=message),
        phase(2, n_src + 1, n_sum),
        rows(exploded("summaries"), a + 2 + pos, "summary_result", source=F.col("x.source"),
             result=F.to_json("x")),
        phase(3, base3),
        rows(chosen, base3 + 1, "url_assessment", selected=n_ext,
             total=F.coalesce("n_candidates", F.lit(0)),
             result=F.to_json(F.transform("extractions", lambda e, i: F.struct(
                 e["url"].alias("url"), F.lit("cached").alias("reason"),
                 (i + 1).alias("priority"))))),
        phase(4, base3 + 2, n_ext),
        rows(exploded("extractions"), a + b + 5 + pos, "extraction_result", url=F.col("x.url"),
             result=F.to_json("x")),
        phase(5, base3 + 3 + n_ext),
        rows(results, base3 + 5 + n_ext, "complete", risk_level=F.col("risk_level"),
             confidence=F.col("confidence"), sources_analyzed=F.col("sources_analyzed"),
             duration_ms=F.col("duration_ms")),
    ]
    if include_report:
        parts.append(rows(results, base3 + 4 + n_ext, "detective_stream",
                          chunk=F.col("detective_markdown"), done=F.lit(True),
                          replace=F.lit(True)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
