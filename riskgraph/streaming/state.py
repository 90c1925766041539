"""Investigation state from the event stream, and its status lifecycle."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.base import count_if
from ..operators.metrics import investigation_progress, investigation_rollup


def flat_events(events: DataFrame) -> DataFrame:
    """Tagged events with the nested result fields next to the others."""
    return events.select(
        "investigation_id", "seq", "ts", "type", "phase", "source", "status", "url", "chunk", "replace",
        "confidence", "recoverable", F.col("result.risk_signals").alias("risk_signals"),
        F.col("result.phone_mentions").alias("phone_mentions"),
        F.col("result.related_numbers").alias("related_numbers"))


def investigation_state_batch(events: DataFrame) -> DataFrame:
    """Roll-up, progress and terminal state per investigation."""
    rolled = investigation_rollup(events)
    progress = investigation_progress(events)
    failed = events.groupBy("investigation_id").agg(
        F.coalesce(F.bool_or((F.col("type") == "error") & ~F.col("recoverable")), F.lit(False))
        .alias("failed"))
    status = F.when(F.col("complete"), "complete").when(F.col("failed"), "failed").otherwise("running")
    return rolled.join(progress, "investigation_id").join(failed, "investigation_id").withColumn(
        "status", status).drop("failed", "complete")


def report_status_batch(writes: DataFrame, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """writes(investigation_id, ts, status): last status of the investigations still kept.

    Every write renews the time to live.
    """
    from ..functions.base import as_of_lit

    now = as_of_lit(as_of)
    last = writes.where(F.col("ts") <= now).groupBy("investigation_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.max("ts").alias("updated_at"))
    expires = F.col("updated_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return last.withColumn("expires_at", expires).where(F.col("expires_at") > now)


STATUS = T.StructType([
    T.StructField("investigation_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("updated_at", T.TimestampType())])
_STATUS_STATE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("us", T.LongType())])


def report_status(stream: DataFrame, ttl_seconds: int = 3600, watermark: str = "10 minutes"
                  ) -> DataFrame:
    """writes(investigation_id, ts, status) as a stream; 'expired' once nothing came for the TTL."""
    def step(key, frames, state):
        if state.hasTimedOut:
            _, us = state.get
            state.remove()
            yield pd.DataFrame({
                "investigation_id": [key[0]], "status": ["expired"],
                "updated_at": [pd.Timestamp(us, unit="us")]})
            return
        status, us = state.get if state.exists else (None, -1)
        for pdf in frames:
            for s, at in zip(pdf["status"], pdf["us"], strict=True):
                if (int(at), s) >= (us, status or ""):
                    status, us = s, int(at)
        state.update((status, us))
        state.setTimeoutTimestamp(
            max(us // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "investigation_id": [key[0]], "status": [status],
            "updated_at": [pd.Timestamp(us, unit="us")]})

    rows = stream.withWatermark("ts", watermark).select(
        "investigation_id", "status", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("investigation_id").applyInPandasWithState(
        step, STATUS, _STATUS_STATE, "update", "EventTimeTimeout")


def investigation_state(stream: DataFrame) -> DataFrame:
    """Live counters per investigation, kept by Spark's own streaming aggregation.

    Latest-per-source values need the last status of each source, so the stream keeps one row
    per (investigation, source or url); ``rollup_of_latest`` sums them up per query.
    """
    key = F.coalesce("source", "url", F.lit(""))
    return stream.groupBy("investigation_id", "type", key.alias("item")).agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("risk_signals", "seq").alias("risk_signals"),
        F.max("phase").alias("phase"), F.max("confidence").alias("confidence"),
        F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_events"))


def rollup_of_latest(latest: DataFrame) -> DataFrame:
    """Source and signal totals per investigation from ``investigation_state`` rows."""
    kind = F.col("type")
    signals = F.greatest(F.size("risk_signals"), F.lit(0))
    return latest.groupBy("investigation_id").agg(
        count_if(kind == "source_status").alias("total_sources"),
        count_if((kind == "source_status") & (F.col("status") == "done")).alias("done_sources"),
        F.sum(F.when(kind == "summary_result", signals).otherwise(0)).cast("bigint").alias(
            "summary_signals"),
        F.sum(F.when(kind == "extraction_result", signals).otherwise(0)).cast("bigint").alias(
            "extraction_signals"),
        F.coalesce(F.bool_or(kind == "complete"), F.lit(False)).alias("complete"))


LIVE_STATE = T.StructType([
    T.StructField("investigation_id", T.StringType()),
    *(T.StructField(name, T.LongType()) for name in (
        "total_sources", "done_sources", "failed_sources", "summary_signals", "extraction_signals",
        "n_phone_mentions", "n_related_numbers", "started_phases")),
    T.StructField("progress", T.IntegerType()), T.StructField("status", T.StringType()),
])
_LATEST = "seq long, ok boolean, signals long, named array<string>"
#: event type -> (map state, key column, column of named values)
_KINDS = {
    "source_status": ("sources", "source", None), "summary_result": ("summaries", "source", "phone_mentions"),
    "extraction_result": ("extractions", "url", "related_numbers")}


class _LiveState(StatefulProcessor):
    """Latest event of each source and URL as map entries, and one row of totals, per investigation."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {name: handle.getMapState(name, "item string", _LATEST) for name, _, _ in _KINDS.values()}
        self.totals = handle.getValueState(
            "totals", "phases array<int>, summary boolean, filled long, reset long, complete boolean, failed boolean, "
            "confidence double, confidence_seq long, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        known = self.totals.get() if self.totals.exists() else None
        phases, summary, filled, reset, complete, failed, confidence, at, last = known or (
            [], False, None, None, False, False, None, None, 0)
        phases = set(phases)
        latest: dict[tuple[str, str], tuple] = {}
        for pdf in rows:
            for e in pdf.itertuples(index=False):
                last = max(last, int(e.ms))
                if e.type in _KINDS:
                    name, by, named = _KINDS[e.type]
                    item = getattr(e, by)
                    entry = (name, "null" if item is None else f"={item}")
                    if entry not in latest or e.seq >= latest[entry][0]:
                        values = getattr(e, named) if named else None
                        signals = 0 if e.risk_signals is None else len(e.risk_signals)
                        latest[entry] = (int(e.seq), e.status == "done", signals,
                                         [] if values is None else sorted({v for v in values if v is not None}))
                    summary = summary or e.type == "summary_result"
                elif e.type == "phase_start" and e.phase >= 0:
                    phases.add(int(e.phase))
                elif e.type == "detective_stream":
                    if e.replace:
                        reset = int(e.seq) if reset is None else max(reset, int(e.seq))
                    if e.chunk is not None and e.chunk.strip(" "):
                        filled = int(e.seq) if filled is None else max(filled, int(e.seq))
                elif e.type == "complete":
                    complete = True
                    if at is None or e.seq >= at:
                        confidence, at = float(e.confidence), int(e.seq)
                elif e.type == "error" and not e.recoverable:
                    failed = True
        for (name, item), value in latest.items():
            before = self.maps[name].getValue((item,)) if self.maps[name].containsKey((item,)) else None
            if before is None or value[0] >= before[0]:
                self.maps[name].updateValue((item,), value)
        self.totals.update((sorted(phases), summary, filled, reset, complete, failed, confidence, at, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))

        sources, summaries, extractions = (list(self.maps[name].values()) for name, _, _ in _KINDS.values())
        done = sum(bool(s[1]) for s in sources)
        text = filled is not None and filled >= (-1 if reset is None else reset)
        if complete:
            shown = None if confidence is None or math.isnan(confidence) else math.floor(confidence * 100 + 0.5)
        else:
            shown = min(95, max(8, len(phases) * 18 + 6 * summary + 8 * text))
        yield pd.DataFrame({
            "investigation_id": [key[0]], "total_sources": [len(sources)], "done_sources": [done],
            "failed_sources": [len(sources) - done], "summary_signals": [sum(s[2] for s in summaries)],
            "extraction_signals": [sum(s[2] for s in extractions)],
            "n_phone_mentions": [len({v for s in summaries for v in s[3]})],
            "n_related_numbers": [len({v for s in extractions for v in s[3]})], "started_phases": [len(phases)],
            "progress": pd.array([shown], dtype="Int32"),
            "status": ["complete" if complete else "failed" if failed else "running"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in self.maps.values():
            state.clear()
        self.totals.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_investigation_state(stream: DataFrame, ttl_seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """``investigation_state_batch`` as a stream: the same columns, a row per investigation and micro-batch with events.

    Takes ``flat_events`` rows with ``ts``.  All state of an investigation goes once the watermark is ``ttl_seconds`` past
    its last event, finished or not; events that come within that time count, as in the batch.  Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).  Rows without seq or time are left out; a missing
    ``recoverable`` does not fail the investigation."""
    rows = stream.where(F.col("seq").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", watermark).select(
        "investigation_id", "seq", "type", "source", "url", "status", "ts", F.unix_millis("ts").alias("ms"),
        F.coalesce("phase", F.lit(-1)).alias("phase"), F.coalesce("confidence", F.lit(float("nan"))).alias("confidence"),
        "chunk", F.coalesce("replace", F.lit(False)).alias("replace"),
        F.coalesce("recoverable", F.lit(True)).alias("recoverable"), "risk_signals", "phone_mentions", "related_numbers")
    return rows.groupBy("investigation_id").transformWithStateInPandas(
        _LiveState(ttl_seconds * 1000), LIVE_STATE, "update", "EventTime")
