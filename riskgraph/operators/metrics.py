"""Counters and roll-ups: crawl statistics, fetch log, investigation events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_of_lit, count_if
from .prefix import value_at_rank
from .ranking import latest_per_key

COUNTERS = [
    "posts_discovered", "posts_processed", "posts_skipped", "post_errors", "subjects_upserted",
    "evidence_inserted", "evidence_updated", "media_attached", "media_reused", "media_downloaded",
    "links_created", "risk_updated",
]


def crawl_stats(outcomes: DataFrame) -> DataFrame:
    """Totals of the counters present in the outcome rows."""
    present = [c for c in COUNTERS if c in outcomes.columns]
    return outcomes.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in present])


# --- fetch log: source, entry, ts, success, duration_ms, blocked -------------------------
def entry_state(log: DataFrame, as_of: datetime, cooldown_seconds: int = 300) -> DataFrame:
    """State of each (source, entry) after its log: counts, last use, cooldown."""
    ok = F.col("success")
    last = F.max_by(F.struct("success", "duration_ms"), F.struct("ts", "success"))
    state = log.where(F.col("ts") <= as_of_lit(as_of)).groupBy("source", "entry").agg(
        count_if(ok).alias("successes"), count_if(~ok).alias("failures"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.max_by("duration_ms", F.when(ok, F.struct("ts", "duration_ms"))).alias("last_ms"),
        F.max("ts").alias("last_used_at"), last.alias("__l"))
    ready_at = F.col("last_used_at") + F.make_dt_interval(secs=F.lit(cooldown_seconds))
    cooling = ~F.col("__l.success") & (ready_at > as_of_lit(as_of))
    return state.withColumn("cooling_down", cooling).drop("__l")


def fetch_health(log: DataFrame, as_of: datetime, cooldown_seconds: int = 300) -> DataFrame:
    return entry_state(log, as_of, cooldown_seconds).groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), count_if(~F.col("cooling_down")).alias("healthy"),
        F.sum("successes").cast("bigint").alias("successes"),
        F.sum("failures").cast("bigint").alias("failures"))


def rank_sources(log: DataFrame, as_of: datetime, weights: dict[str, int] | None = None,
                 default_weight: int = 100, cooldown_seconds: int = 300) -> DataFrame:
    """Entries by score; cooling ones only when nothing else is left.

    The ranking runs over entries, one row each, not over the log.
    """
    from ..functions.base import lookup

    state = entry_state(log, as_of, cooldown_seconds)
    ms = F.coalesce(F.col("last_ms"), F.lit(0.0))
    slow = F.when(ms > 0, F.least(F.lit(20), F.floor(ms / 250 + 0.5))).otherwise(F.lit(0))
    base = lookup("source", weights, default_weight) if weights else F.lit(default_weight)
    score = (base + F.col("successes") * 20
             + F.when(F.col("last_success_at").isNotNull(), 5).otherwise(0)
             - F.col("failures") * 25 - slow).cast("bigint")
    scored = state.withColumn("score", score)
    any_ready = scored.agg(F.coalesce(F.bool_or(~F.col("cooling_down")), F.lit(False))).scalar()
    open_ = scored.where(~F.col("cooling_down") | ~any_ready)
    return open_.select("source", "entry", "score", "last_used_at").orderBy(
        F.desc("score"), "last_used_at", "entry", "source")


def fetch_success(log: DataFrame) -> DataFrame:
    return log.groupBy("source").agg(
        F.count(F.lit(1)).alias("tested"), count_if(F.col("success")).alias("successful"))


def fetch_latency(log: DataFrame, ratio: float = 0.95) -> DataFrame:
    """Success rate, jobs per second, mean, exact rank value and blocked count per source.

    Zero durations count as missing for the mean and the rank value.
    """
    d = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    span = (F.unix_micros(F.max("ts").cast("timestamp"))
            - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    totals = log.groupBy("source").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.round(F.when(span > 0, F.count(F.lit(1)) / span).otherwise(0.0), 2).alias("jobs_per_second"),
        F.coalesce(F.floor(F.avg(d) + 0.5), F.lit(0)).alias("avg_ms"),
        count_if(F.col("blocked")).alias("blocked_total"))
    ranked = value_at_rank(
        log.where(F.col("duration_ms") > 0), ["source"], "duration_ms", ratio, "p95_ms")
    return totals.join(ranked, "source", "left").withColumn(
        "p95_ms", F.coalesce("p95_ms", F.lit(0.0)))


def source_timings(results: DataFrame, key: str = "query_id") -> DataFrame:
    """Fastest, slowest, sum and speed-up of the sources of each query.

    The sources run in parallel, so the slowest is the elapsed time unless one is given.
    """
    elapsed = F.max("elapsed_ms") if "elapsed_ms" in results.columns else F.max("duration_ms")
    total = F.sum("duration_ms")
    return results.groupBy(key).agg(
        F.min("duration_ms").alias("fastest_ms"), F.max("duration_ms").alias("slowest_ms"),
        F.round(total, 6).alias("sum_ms"),
        F.round(F.when(elapsed > 0, total / elapsed), 6).alias("speed_up"))


# --- events -----------------------------------------------------------------------------
def _distinct_values(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select("investigation_id", F.explode(column).alias("v")).groupBy(
        "investigation_id").agg(F.count_distinct("v").alias(name))


def investigation_rollup(events: DataFrame) -> DataFrame:
    """Totals per investigation from the latest event of each source and URL.

    events(investigation_id, seq, type, source, status, url, risk_signals, phone_mentions,
    related_numbers).
    """
    def latest(kind: str, key: str, payload: list[str]) -> DataFrame:
        return latest_per_key(
            events.where(F.col("type") == kind), ["investigation_id", key], "seq", payload)

    sources = latest("source_status", "source", ["status"]).groupBy("investigation_id").agg(
        F.count(F.lit(1)).alias("total_sources"),
        count_if(F.col("status") == "done").alias("done_sources"),
        count_if(F.col("status") != "done").alias("failed_sources"))
    summaries = latest("summary_result", "source", ["risk_signals", "phone_mentions"])
    extractions = latest("extraction_result", "url", ["risk_signals", "related_numbers"])

    def signals(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("investigation_id").agg(
            F.sum(F.greatest(F.size("risk_signals"), F.lit(0))).cast("bigint").alias(name))

    out = events.select("investigation_id").distinct()
    for part in (
        sources, signals(summaries, "summary_signals"), signals(extractions, "extraction_signals"),
        _distinct_values(summaries, "phone_mentions", "n_phone_mentions"),
        _distinct_values(extractions, "related_numbers", "n_related_numbers"),
    ):
        out = out.join(part, "investigation_id", "left")
    return out.na.fill(0)


def progress(started: Column, any_summary: Column, any_text: Column, done: Column,
             confidence: Column) -> Column:
    running = F.least(F.lit(95), F.greatest(
        F.lit(8), started * 18 + F.when(any_summary, 6).otherwise(0)
        + F.when(any_text, 8).otherwise(0)))
    return F.when(done, F.floor(confidence * 100 + 0.5)).otherwise(running).cast("int")


def investigation_progress(events: DataFrame) -> DataFrame:
    """Progress percentage per investigation.

    events(investigation_id, seq, type, phase, chunk, replace, confidence).  Text counts from
    the last replacement on.
    """
    kind = F.col("type")
    chunk = kind == "detective_stream"
    last_reset = F.max(F.when(chunk & F.col("replace"), F.col("seq")))
    filled = F.max(F.when(chunk & (F.trim("chunk") != ""), F.col("seq")))
    done = F.coalesce(F.bool_or(kind == "complete"), F.lit(False))
    agg = events.groupBy("investigation_id").agg(
        F.count_distinct(F.when(kind == "phase_start", F.col("phase"))).alias("started_phases"),
        F.bool_or(kind == "summary_result").alias("__s"),
        F.coalesce(filled >= F.coalesce(last_reset, F.lit(-1)), F.lit(False)).alias("__t"),
        done.alias("complete"),
        F.max_by("confidence", F.when(kind == "complete", F.col("seq"))).alias("confidence"))
    return agg.select(
        "investigation_id", "started_phases", "complete",
        progress(F.col("started_phases"), F.col("__s"), F.col("__t"), F.col("complete"),
                 F.col("confidence")).alias("progress"))
