"""Report admission: 5 accepted reports per reporter and 24 hours, one per subject.

Whether a report is accepted depends on which earlier ones were, so the rule is a fold over
the reporter's reports in time order.  Its state is at most 5 (time, subject) pairs.

Most reporters are folded in one sorted run each.  A busy one, whose reports would keep one task
at work while the others wait, goes day by day instead: what a day accepts and where its outcomes
change follows from the first reports of a few subjects, which all tasks find together.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import REPORTS_PER_DAY
from ..functions.subjects import reporter_address, sha256_hex, subject_id
from ..operators.hubs import heavy_keys
from ..operators.ranking import dedup_first, top_n
from ..operators.triage import validate_reports
from ..session import checkpoint_dir, cut_lineage

DAY_US = 24 * 3600 * 1_000_000
#: Reports from which on a reporter is busy; a run of fewer is folded within seconds.
BUSY_REPORTS = 2_000_000


def prepared(submissions: DataFrame) -> DataFrame:
    """Validated submissions with reporter hash and subject id."""
    checked = validate_reports(submissions)
    return checked.withColumns({
        "reporter_ip_hash": sha256_hex(reporter_address("peer_ip", "forwarded_for")),
        "subject_id": F.when(
            F.col("reject_reason").isNull(), subject_id("subject_type", "normalized")),
    })


def decide(state: list[tuple[int, str]], at: int, subject: str) -> tuple[str, list[tuple[int, str]]]:
    """One step of the fold: (outcome, new state); times in microseconds."""
    live = [(t, s) for t, s in state if t > at - DAY_US]
    if len(live) >= REPORTS_PER_DAY:
        return "rate_limited", live
    if any(s == subject for _, s in live):
        return "duplicate", live
    return "accepted", [*live, (at, subject)]


def decide_run(state: list[tuple[int, str]], us: np.ndarray, subjects: np.ndarray
               ) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """The fold over a sorted stretch of one reporter, jumping from change to change.

    While the state is full every report up to the next expiry is refused, and otherwise every
    report on an active subject is; only the few accepted ones are visited one by one.
    """
    out = np.empty(len(us), dtype=object)
    codes, names = pd.factorize(subjects)
    code_of = {name: i for i, name in enumerate(names)}
    i = 0
    while i < len(us):
        state = [(t, s) for t, s in state if t > us[i] - DAY_US]
        upto = len(us)
        if state:
            upto = i + int(np.searchsorted(us[i:], min(t for t, _ in state) + DAY_US))
        if len(state) >= REPORTS_PER_DAY:
            out[i:upto] = "rate_limited"
            i = upto
            continue
        new = ~np.isin(codes[i:upto], [code_of.get(s, -1) for _, s in state])
        step = int(new.argmax()) if new.any() else upto - i
        out[i:i + step] = "duplicate"
        i += step
        if i < upto:
            out[i] = "accepted"
            state = [*state, (int(us[i]), subjects[i])]
            i += 1
    return out, state


def _sessions(rows: DataFrame) -> DataFrame:
    """Number the stretches of a reporter that lie more than a day apart.

    The fold starts empty in each of them, so a reporter with very many reports splits into
    independent pieces.  Only per-hour bounds are ordered per reporter, not the reports.
    """
    hour = F.date_trunc("HOUR", "created_at")
    bounds = rows.groupBy("reporter_ip_hash", hour.alias("__h")).agg(
        F.min("__us").alias("__lo"), F.max("__us").alias("__hi"))
    w = Window.partitionBy("reporter_ip_hash").orderBy("__h")
    gap = F.col("__lo") - F.lag("__hi").over(w) >= DAY_US
    numbered = bounds.withColumn("__g", F.coalesce(gap, F.lit(False)).cast("int")).select(
        "reporter_ip_hash", "__h", F.sum("__g").over(w).alias("__session"))
    return rows.withColumn("__h", hour).join(numbered, ["reporter_ip_hash", "__h"]).drop("__h")


def admit_reports_batch(submissions: DataFrame, busy: int = BUSY_REPORTS) -> DataFrame:
    """event_id, reporter_ip_hash, subject_id, created_at and the outcome of each submission.

    A repeated event id counts once, at its earliest time.  Invalid submissions never reach the
    fold.  The others travel as narrow rows; reporters with ``busy`` reports or more, if they also
    hold more than a part's share of all, are settled day by day on all tasks, the others in runs.
    """
    p = dedup_first(prepared(submissions), ["event_id"], ["created_at", "subject_id"])
    keep = ["event_id", "reporter_ip_hash", "subject_id", "created_at"]
    rows = cut_lineage(p.select(
        *keep, "reject_reason", F.unix_micros(F.col("created_at").cast("timestamp")).alias("__us")))
    invalid = rows.where(F.col("reject_reason").isNotNull()).select(
        *keep, F.concat(F.lit("invalid:"), F.col("reject_reason")).alias("outcome"))
    valid = rows.where(F.col("reject_reason").isNull()).drop("reject_reason")
    names = _busy_reporters(valid, busy)
    if not names:
        return _fold_runs(valid, keep).unionByName(invalid)
    is_busy = F.col("reporter_ip_hash").isin(names)
    return _fold_runs(valid.where(~is_busy), keep).unionByName(
        _settle_days(valid.where(is_busy), names, keep)).unionByName(invalid)


def _fold_runs(valid: DataFrame, keep: list[str]) -> DataFrame:
    """The fold streams through the sorted partition, holding only the state of one reporter."""
    key = ["reporter_ip_hash", "__session"]
    ordered = _sessions(valid).repartition(*key).sortWithinPartitions(*key, "__us", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for pdf in batches:
            outcomes = np.empty(len(pdf), dtype=object)
            group = (pdf["reporter_ip_hash"] + "|" + pdf["__session"].astype(str)).to_numpy()
            us, subjects = pdf["__us"].to_numpy(), pdf["subject_id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(pdf) else []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)], strict=True):
                if group[lo] != current:
                    current, state = group[lo], []
                outcomes[lo:hi], state = decide_run(state, us[lo:hi], subjects[lo:hi])
            yield pdf[keep].assign(outcome=outcomes)

    narrow = ordered.select(*keep, "__session", "__us")
    return narrow.mapInPandas(
        fold, T.StructType([*(valid.schema[c] for c in keep), T.StructField("outcome", T.StringType())]))


def _busy_reporters(valid: DataFrame, busy: int) -> list[str]:
    """At most as many as the sketch of heavy keys tells apart."""
    if valid.count() < busy:
        return []
    key = "reporter_ip_hash"
    heavy = F.broadcast(heavy_keys(valid, [key]).select("hash"))
    counts = valid.select(key, F.xxhash64(key).alias("hash")).join(heavy, "hash").groupBy(key).count()
    return [r[key] for r in counts.where(F.col("count") >= busy).collect()]


STEPS = T.StructType([
    T.StructField("reporter_ip_hash", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("full", T.BooleanType()), T.StructField("subjects", T.ArrayType(T.StringType())),
        T.StructField("accepts", T.BooleanType()),
    ]))),
])


def day_steps(state: list[tuple[int, str]], cuts: list[int], firsts: dict[int, list[tuple]]
              ) -> tuple[list[tuple], list[tuple[int, str]]]:
    """The steps of one reporter's day and the state after it.

    ``cuts`` are the times at which the day's stretches begin, ``firsts`` the first reports
    (time, event id, subject) of a stretch's earliest subjects.  A step holds from its time and event on:
    the reports after it meet the same state until the next step.
    """
    steps = []
    for i, start in enumerate(cuts):
        state = [(t, s) for t, s in state if t > start - DAY_US]
        steps.append((start, None, len(state) >= REPORTS_PER_DAY, [s for _, s in state], False))
        for at, event, subject in firsts.get(i, []):
            outcome, state = decide(state, at, subject)
            if outcome == "accepted":
                steps.append((at, event, len(state) >= REPORTS_PER_DAY, [s for _, s in state], True))
    return steps, state


def _settle_days(rows: DataFrame, reporters: list[str], keep: list[str]) -> DataFrame:
    """The fold of busy reporters, one day (of 24 hours since the epoch) after the other.

    What is accepted on a day expires on the next, so within a day the state changes only when one of
    the at most five entries that came in expires, and when a report is accepted.  Between two
    expiries at most five are accepted, and these are among the first reports of the first five
    subjects.  A day costs two jobs on all its rows: one finds those first reports (grouped by
    subject, combined before the shuffle), one gives every row its outcome by a broadcast of the
    day's steps, at most eleven a reporter.  The driver holds the states and steps of one day for at
    most ``hubs.MOST_HEAVY`` reporters, whatever they send.
    """
    spark, key = rows.sparkSession, "reporter_ip_hash"
    folder = os.path.join(checkpoint_dir(spark), f"admission-{uuid.uuid4().hex}")
    rows.withColumn("__day", F.floor(F.col("__us") / DAY_US)).repartitionByRange(
        "__us", "event_id").write.partitionBy("__day").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    days = sorted(r["__day"] for r in stored.select("__day").distinct().collect())
    states: dict[str, list[tuple[int, str]]] = {name: [] for name in reporters}
    for day in days:
        begin, end = day * DAY_US, (day + 1) * DAY_US
        of_day = stored.where(F.col("__day") == day)
        cuts = {name: [begin, *sorted({t + DAY_US for t, _ in state if begin < t + DAY_US < end})]
                for name, state in states.items()}
        stretches = spark.createDataFrame(
            [(name, i, lo, hi) for name, starts in cuts.items()
             for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], end], strict=True))],
            f"{key} string, __i int, __lo long, __hi long")
        first = of_day.join(F.broadcast(stretches), key).where(
            (F.col("__lo") <= F.col("__us")) & (F.col("__us") < F.col("__hi"))).groupBy(
            key, "__i", "subject_id").agg(F.min(F.struct("__us", "event_id")).alias("__first"))
        firsts: dict[str, dict[int, list[tuple]]] = {}
        for r in top_n(first, [key, "__i"], ["__first"], REPORTS_PER_DAY).orderBy("__first").collect():
            firsts.setdefault(r[key], {}).setdefault(r["__i"], []).append(
                (r["__first"]["__us"], r["__first"]["event_id"], r["subject_id"]))
        steps = []
        for name in firsts:
            changes, states[name] = day_steps(states[name], cuts[name], firsts[name])
            steps.append((name, changes))
        _with_steps(of_day, spark.createDataFrame(steps, STEPS)).select(*keep, "outcome").write.parquet(
            f"{folder}/outcomes/__day={day}")
    return spark.read.parquet(f"{folder}/outcomes").select(*keep, "outcome")


def _with_steps(of_day: DataFrame, steps: DataFrame) -> DataFrame:
    at = F.struct(F.col("__us").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    step = F.element_at(F.filter(
        "steps", lambda s: F.struct(s["us"].alias("us"), s["event_id"].alias("event_id")) <= F.col("__at")), -1)
    found = of_day.join(F.broadcast(steps), "reporter_ip_hash").withColumn("__at", at).withColumn("__s", step)
    itself = F.col("__s.accepts") & (F.col("__s.us") == F.col("__us")) & F.col("__s.event_id").eqNullSafe(
        F.col("event_id"))
    return found.withColumn("outcome", F.when(itself, "accepted").when(F.col("__s.full"), "rate_limited")
                            .otherwise("duplicate"))


def touched_subjects(outcomes: DataFrame) -> DataFrame:
    """Subjects whose last_seen_at moves: accepted and duplicate reports alike."""
    return outcomes.where(F.col("outcome").isin("accepted", "duplicate")).groupBy(
        "subject_id").agg(F.max("created_at").alias("seen_at"))


def accepted_reports(submissions: DataFrame, outcomes: DataFrame) -> DataFrame:
    ok = outcomes.where(F.col("outcome") == "accepted").select(
        "event_id", "subject_id", "reporter_ip_hash")
    return dedup_first(submissions, ["event_id"], ["created_at"]).join(ok, "event_id")


OUTCOME = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("reporter_ip_hash", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("outcome", T.StringType()),
])
STATE = T.StructType([
    T.StructField("times", T.ArrayType(T.LongType())),
    T.StructField("subjects", T.ArrayType(T.StringType())),
])


def _admit_group(key, frames, state):
    """One reporter's reports of a micro-batch, in time order, on top of the stored state."""
    (reporter,) = key
    if state.hasTimedOut:
        state.remove()
        return
    entries = list(zip(*state.get, strict=True)) if state.exists else []
    parts = [f for f in frames if len(f)]
    if parts:
        pdf = pd.concat(parts).sort_values(["us", "event_id"])
        outcomes, entries = decide_run(entries, pdf["us"].to_numpy(), pdf["subject_id"].to_numpy())
        yield pd.DataFrame({
            "event_id": pdf["event_id"], "reporter_ip_hash": reporter,
            "subject_id": pdf["subject_id"], "created_at": pdf["created_at"], "outcome": outcomes})
    if entries:
        state.update(([t for t, _ in entries], [s for _, s in entries]))
        expiry = max(t for t, _ in entries) // 1000 + 24 * 3600 * 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def admit_reports(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The same on a stream; the state of a silent reporter goes after 24 hours.

    Invalid submissions get their outcome too, and an event id repeated within the watermark counts
    once.  Reports behind the watermark are dropped by Spark; the stored submissions and
    ``admit_reports_batch`` settle those.
    """
    p = prepared(stream).withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["event_id"])
    keep = ["event_id", "reporter_ip_hash", "subject_id", "created_at"]
    invalid = p.where(F.col("reject_reason").isNotNull()).select(
        *keep, F.concat(F.lit("invalid:"), F.col("reject_reason")).alias("outcome"))
    valid = p.where(F.col("reject_reason").isNull()).select(*keep, F.unix_micros("created_at").alias("us"))
    decided = valid.groupBy("reporter_ip_hash").applyInPandasWithState(
        _admit_group, OUTCOME, STATE, "append", "EventTimeTimeout")
    return decided.unionByName(invalid)
