"""Streams give what their batch twins give."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_folds import naive_admission, random_submissions

from riskgraph import schemas as S
from riskgraph.operators.metrics import investigation_rollup
from riskgraph.sources import readers
from riskgraph.streaming import admission, reports, state

T0 = datetime(2024, 1, 1)


def run(df, name, mode):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def write_slices(df, path, order, n, fmt="json"):
    """n files in order, one micro-batch each; later files get later times."""
    import time

    rows = df.orderBy(order).collect()
    size = (len(rows) + n - 1) // n
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        getattr(part.write.mode("append"), fmt)(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if os.stat(full).st_mtime > 1_600_000_000:
                os.utime(full, (1_000_000_000 + i, 1_000_000_000 + i))
        time.sleep(0.01)


def test_admission_stream(spark, tmp_path):
    rows = random_submissions(7, 300)
    df = spark.createDataFrame(
        [(e, at, f"8.8.8.{r}", None, f"0900{s:06d}", "phone", "text", None) for e, at, r, s in rows],
        S.SUBMISSION)
    path = str(tmp_path / "in")
    write_slices(df, path, ["created_at", "event_id"], 4)
    stream = readers.read_submissions(spark, path, streaming=True, files_per_trigger=1)
    got = run(admission.admit_reports(stream), "admitted", "append")
    assert {r["event_id"]: r["outcome"] for r in got.collect()} == naive_admission(rows)


def test_report_stream(spark, tmp_path):
    rows = [(f"i{i}", s, T0, f"<{i}.{s}>", s == 7, s in (3, 5) and i % 2 == 0)
            for s in range(10) for i in range(6)]
    df = spark.createDataFrame(rows, S.CHUNK)
    path = str(tmp_path / "in")
    write_slices(df, path, ["seq", "investigation_id"], 3, "parquet")
    out = run(reports.assemble_reports(readers.read_chunks(spark, path, True, 1)), "texts", "update")
    last = {}
    for r in out.collect():
        if r["investigation_id"] not in last or not last[r["investigation_id"]]["complete"]:
            if r["n_chunks"] > 0:
                last[r["investigation_id"]] = r
    want = {r["investigation_id"]: (r["text"], r["complete"])
            for r in reports.assemble_reports_batch(df).collect()}
    assert {k: (r["text"], r["complete"]) for k, r in last.items()} == want


def test_status_stream(spark, tmp_path):
    rows = [("a", T0, "running"), ("b", T0, "running"), ("a", T0 + timedelta(minutes=30), "complete"),
            ("c", T0 + timedelta(hours=5), "running"), ("c", T0 + timedelta(hours=5, minutes=1), "failed")]
    df = spark.createDataFrame(rows, "investigation_id string, ts timestamp, status string")
    path = str(tmp_path / "in")
    write_slices(df, path, ["ts"], 5)
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path))
    out = run(state.report_status(stream), "statuses", "update")
    got = {(r["investigation_id"], r["status"]) for r in out.collect()}
    assert {("a", "complete"), ("a", "expired"), ("b", "expired"), ("c", "failed")} <= got
    kept = state.report_status_batch(df, T0 + timedelta(hours=5, minutes=30)).collect()
    assert [(r["investigation_id"], r["status"]) for r in kept] == [("c", "failed")]


def test_state_stream(spark, tmp_path):
    events = [("i1", 1, "source_status", "A", "running", None), ("i1", 2, "source_status", "A", "done", None),
              ("i1", 3, "source_status", "B", "error", None), ("i1", 4, "summary_result", "A", None, ["r1", "r2"]),
              ("i1", 5, "summary_result", "A", None, ["r3"]), ("i2", 1, "complete", None, None, None)]
    df = spark.createDataFrame(
        events, "investigation_id string, seq long, type string, source string, status string, risk_signals array<string>")
    full = df.select(
        "*", F.lit(None).cast("int").alias("phase"), F.lit(None).cast("string").alias("url"),
        F.lit(0.5).alias("confidence"))
    path = str(tmp_path / "in")
    write_slices(full, path, ["seq"], 3)
    stream = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).json(path)
    latest = run(state.investigation_state(stream), "latest_state", "complete")
    got = {r["investigation_id"]: r for r in state.rollup_of_latest(latest).collect()}
    batch = investigation_rollup(full.withColumns({
        "phone_mentions": F.array().cast("array<string>"),
        "related_numbers": F.array().cast("array<string>")})).where("investigation_id = 'i1'").first()
    for c in ("total_sources", "done_sources", "summary_signals"):
        assert got["i1"][c] == batch[c]
    assert got["i1"]["total_sources"] == 2 and got["i1"]["done_sources"] == 1
    assert got["i2"]["complete"] and not got["i1"]["complete"]


def chunk_rows():
    rows = [(f"i{i}", s, T0 + timedelta(seconds=s), f"<{i}.{s}>" if s != 4 else None, s == 7, s in (3, 5) and i % 2 == 0)
            for s in range(10) for i in range(6) if i < 5 or s < 6]
    return [r if r[0] != "i4" else (*r[:4], False, r[5]) for r in rows]


def test_delta_stream(spark, tmp_path):
    df = spark.createDataFrame(chunk_rows(), S.CHUNK)
    path = str(tmp_path / "in")
    write_slices(df, path, ["seq", "investigation_id"], 4, "parquet")
    deltas = run(reports.chunk_deltas(readers.read_chunks(spark, path, True, 1)), "deltas", "append")
    deltas = spark.createDataFrame(deltas.collect(), reports.DELTA)  # a memory table can't be joined with itself
    want = sorted(map(tuple, reports.assemble_reports_batch(df).select("investigation_id", "text", "complete", "n_chunks").collect()))
    got = reports.texts_of_deltas(deltas).select("investigation_id", "text", "complete", "n_chunks")
    assert sorted(map(tuple, got.collect())) == want
    # every chunk's text leaves at most once
    assert sum(len(r["text"]) for r in deltas.collect()) <= sum(len(r[3] or "") for r in chunk_rows())


def test_delta_state_goes(spark, tmp_path):
    rows = [("a", 0, T0, "x", True, False), ("b", 0, T0 + timedelta(hours=3), "y", False, False),
            ("b", 1, T0 + timedelta(hours=3, minutes=1), "z", False, False), ("b", 2, T0 + timedelta(hours=3, minutes=2), "!", False, False)]
    path = str(tmp_path / "in")
    write_slices(spark.createDataFrame(rows, S.CHUNK), path, ["ts"], 4, "parquet")
    df = reports.chunk_deltas(readers.read_chunks(spark, path, True, 1))
    q = df.writeStream.format("noop").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) == 2 and totals[-1] == 1


def test_chunk_sink_after_a_crash(spark, tmp_path):
    """A batch that dies is tried again; no chunk is lost or doubled, and replaced ones don't come back."""
    df = spark.createDataFrame(chunk_rows(), S.CHUNK)
    path, out, cp, flag = (str(tmp_path / n) for n in ("in", "out", "cp", "broken"))
    write_slices(df, path, ["seq", "investigation_id"], 4, "parquet")
    open(flag, "w").close()

    @F.udf("string")
    def check(text):
        if text == "<2.6>" and os.path.exists(flag):
            raise RuntimeError("lost")
        return text

    def start():
        stream = readers.read_chunks(spark, path, True, 1).withColumn("chunk", check("chunk"))
        return reports.store_deltas(stream, out, cp)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination(180)
    committed = spark.read.schema(reports.DELTA).parquet(out).count()
    assert committed > 0
    os.unlink(flag)
    for _ in range(2):  # the last start finds nothing to do
        start().awaitTermination(180)
        want = sorted(map(tuple, reports.assemble_reports_batch(df).select("investigation_id", "text", "complete", "n_chunks").collect()))
        got = reports.texts_of_deltas(reports.read_deltas(spark, out))
        assert sorted(map(tuple, got.select("investigation_id", "text", "complete", "n_chunks").collect())) == want
    assert spark.read.schema(reports.DELTA).parquet(out).groupBy("investigation_id", "nth").count().where("count > 1").isEmpty()


def random_events(seed, n):
    rng = random.Random(seed)
    kinds = ["phase_start", "source_status", "summary_result", "extraction_result", "detective_stream", "error", "complete"]
    rows = []
    for s in range(n):
        kind = rng.choices(kinds, [5, 8, 8, 8, 5, 1, 1])[0]
        i = rng.randrange(9)
        if kind == "complete" and i < 4:
            kind = "error"
        rows.append((f"i{i}", s, T0 + timedelta(seconds=s), kind, rng.choice([1, 2, 3, 4, 5, None]),
                     rng.choice(["A", "B", "C", None]), rng.choice(["done", "error", "running"]), rng.choice(["u1", "u2", None]),
                     rng.choice(["text", " ", "", None]), rng.choice([True, False, None]), rng.random(), rng.choice([True, False]),
                     rng.choice([None, [], ["r1"], ["r1", "r2"]]), rng.choice([None, ["p1", "p2"], ["p2"]]), rng.choice([None, ["n1"], ["n1", "n3"]])))
    return rows


EVENTS = ("investigation_id string, seq long, ts timestamp, type string, phase int, source string, status string, url string, "
          "chunk string, replace boolean, confidence double, recoverable boolean, risk_signals array<string>, "
          "phone_mentions array<string>, related_numbers array<string>")


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_live_state_equals_batch(spark, tmp_path, rocksdb):
    df = spark.createDataFrame(random_events(3, 260), EVENTS)
    path = str(tmp_path / "in")
    write_slices(df, path, ["seq"], 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(path)
    out = state.live_investigation_state(stream).withColumn("at", F.current_timestamp())
    rows = run(out, "live_states", "update").collect()
    last = {r["investigation_id"]: r for r in sorted(rows, key=lambda r: r["at"])}
    want = state.investigation_state_batch(df)
    names = [f.name for f in state.LIVE_STATE]
    assert sorted(names) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in names) for r in last.values()) == sorted(map(tuple, want.select(*names).collect()))
    assert {r["status"] for r in last.values()} >= {"complete", "failed"}


def test_live_state_goes(spark, tmp_path, rocksdb):
    blank = (None,) * 11
    rows = [("a", 0, T0, "complete", *blank), ("b", 1, T0 + timedelta(hours=3), "phase_start", 1, *blank[1:]),
            ("b", 2, T0 + timedelta(hours=3, minutes=1), "phase_start", 2, *blank[1:]),
            ("a", 3, T0 + timedelta(hours=3, minutes=2), "phase_start", 1, *blank[1:])]
    path = str(tmp_path / "in")
    write_slices(spark.createDataFrame(rows, EVENTS), path, ["ts"], 4)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(path)
    got = run(state.live_investigation_state(stream), "gone_states", "update").collect()
    # a's state went three hours after it was complete, so its late event starts anew
    assert [(r["status"], r["started_phases"]) for r in got if r["investigation_id"] == "a"] == [("complete", 0), ("running", 1)]
