"""Report chunks: append, replace, done."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def live_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that make up the current text of each investigation.

    A replacing chunk drops everything before it; nothing counts after the first done chunk.
    The two positions are plain aggregates, joined back to the rows.
    """
    end = chunks.groupBy("investigation_id").agg(
        F.min(F.when(F.col("done"), F.col("seq"))).alias("end_seq"))
    upto = chunks.join(end, "investigation_id").where(
        F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    start = upto.groupBy("investigation_id").agg(
        F.max(F.when(F.col("replace"), F.col("seq"))).alias("start_seq"))
    return upto.join(start, "investigation_id").where(
        F.col("start_seq").isNull() | (F.col("seq") >= F.col("start_seq"))
    ).withColumn("complete", F.col("end_seq").isNotNull()).drop("end_seq", "start_seq")


def assemble_reports_batch(chunks: DataFrame) -> DataFrame:
    """Text of each investigation; ``live_chunks`` gives the same as rows."""
    return live_chunks(chunks).groupBy("investigation_id").agg(
        F.expr("listagg(chunk, '') WITHIN GROUP (ORDER BY seq)").alias("text"),
        F.bool_or("complete").alias("complete"),
        F.count(F.lit(1)).alias("n_chunks"))


REPORT = T.StructType([
    T.StructField("investigation_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("complete", T.BooleanType()),
    T.StructField("n_chunks", T.LongType()),
])
_STATE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("closed", T.BooleanType())])


def _assemble(key, frames, state):
    text, n, closed = state.get if state.exists else ("", 0, False)
    parts = [f for f in frames if len(f)]
    if parts and not closed:
        pdf = pd.concat(parts).sort_values("seq")
        for chunk, done, replace in zip(pdf["chunk"], pdf["done"], pdf["replace"], strict=True):
            text, n = (chunk, 1) if replace else (text + chunk, n + 1)
            if done:
                closed = True
                break
    state.update(("" if closed else text, n, closed))
    if parts:
        yield pd.DataFrame({
            "investigation_id": [key[0]], "text": [text], "complete": [closed], "n_chunks": [n]})


def assemble_reports(stream: DataFrame) -> DataFrame:
    """Running text per investigation, one row per micro-batch that brought chunks.

    Writes the whole text again each time and keeps it as state; ``chunk_deltas`` does neither.
    Chunks of one investigation arrive in the order of ``seq``.
    """
    rows = stream.select(
        "investigation_id", "seq", F.coalesce("chunk", F.lit("")).alias("chunk"),
        F.coalesce("done", F.lit(False)).alias("done"),
        F.coalesce("replace", F.lit(False)).alias("replace"))
    return rows.groupBy("investigation_id").applyInPandasWithState(
        _assemble, REPORT, _STATE, "update", "NoTimeout")


DELTA = T.StructType([
    T.StructField("investigation_id", T.StringType()),
    T.StructField("nth", T.LongType()),
    T.StructField("replace", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("complete", T.BooleanType()),
    T.StructField("n_chunks", T.LongType()),
])
_DELTA_STATE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("nth", T.LongType()),
    T.StructField("closed", T.BooleanType()), T.StructField("us", T.LongType())])


def chunk_deltas(stream: DataFrame, ttl_seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """What each micro-batch adds to an investigation's text: rows to append, one that replaces all before it is marked.

    The state holds counts only, never text, so the bytes out follow the bytes in.  It goes once the watermark is
    ``ttl_seconds`` past the last chunk; until then chunks after the done one are ignored.  Chunks of one investigation
    arrive in the order of ``seq``; a null chunk is an empty one, and chunks without a time count as the oldest.
    """
    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, nth, closed, us = state.get if state.exists else (0, 0, False, 0)
        parts = [f for f in frames if len(f)]
        if parts:
            pdf = pd.concat(parts).sort_values("seq", kind="stable")
            us = max(us, int(pdf["us"].max()))
            if not closed:
                done = pdf["done"].to_numpy().nonzero()[0]
                live = pdf.iloc[:done[0] + 1] if len(done) else pdf
                resets = live["replace"].to_numpy().nonzero()[0]
                if len(resets):
                    live, n = live.iloc[resets[-1]:], 0
                n, closed = n + len(live), len(done) > 0
                yield pd.DataFrame({
                    "investigation_id": [key[0]], "nth": [nth], "replace": [len(resets) > 0],
                    "text": ["".join(live["chunk"])], "complete": [closed], "n_chunks": [n]})
                nth += 1
        state.update((n, nth, closed, us))
        state.setTimeoutTimestamp(max(us // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", watermark).select(
        "investigation_id", "seq", "ts", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"),
        F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("done", F.lit(False)).alias("done"),
        F.coalesce("replace", F.lit(False)).alias("replace"))
    return rows.groupBy("investigation_id").applyInPandasWithState(
        step, DELTA, _DELTA_STATE, "append", "EventTimeTimeout")


def live_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas without those that a later one replaces."""
    start = deltas.groupBy("investigation_id").agg(F.max(F.when(F.col("replace"), F.col("nth"))).alias("start"))
    return deltas.join(start, "investigation_id").where(
        F.col("start").isNull() | (F.col("nth") >= F.col("start"))).drop("start")


def texts_of_deltas(deltas: DataFrame) -> DataFrame:
    """Text of each investigation, as ``assemble_reports_batch`` gives it."""
    return live_deltas(deltas).groupBy("investigation_id").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY nth)").alias("text"),
        F.bool_or("complete").alias("complete"), F.max_by("n_chunks", "nth").alias("n_chunks"))


def store_deltas(stream: DataFrame, path: str, checkpoint: str, **limits) -> StreamingQuery:
    """Start the sink of report chunks: Parquet files whose log takes each micro-batch once, however often it is tried.

    Returns the query; ``read_deltas`` gives the rows back."""
    return (chunk_deltas(stream, **limits).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Deltas that count, of committed micro-batches only."""
    return live_deltas(spark.read.schema(DELTA).parquet(path))
