"""Table jobs: current snapshot + change batch -> new snapshot.

There is no MERGE: a job joins the snapshot with the changes, reduced to one row per key
first, and the result is written as the next version (``sources/snapshots.py``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_of_lit, count_if
from ..functions.subjects import normalize_subject, subject_id
from .prefix import running_sum
from .ranking import dedup_first, top_n


# --- subjects ---------------------------------------------------------------------------
def upsert_subjects(subjects: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(value, subject_type, seen_at).  Returns (subjects, rejected changes).

    Known subjects only move last_seen_at; new ones start unknown; a value that is empty
    after normalisation is rejected.
    """
    normal = changes.withColumn("__v", normalize_subject("value", "subject_type"))
    rejected = normal.where((F.col("__v") == "") | F.col("__v").isNull()).drop("__v")
    new = normal.where(F.col("__v") != "").groupBy(
        F.col("__v").alias("value"), "subject_type"
    ).agg(F.min("seen_at").alias("__first"), F.max("seen_at").alias("__last"))
    merged = subjects.join(new, ["value", "subject_type"], "full_outer").select(
        F.coalesce("id", subject_id("subject_type", "value")).alias("id"),
        "value", "subject_type",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("unknown")).alias("risk_level"),
        F.coalesce("report_count", F.lit(0)).alias("report_count"),
        F.coalesce("investigation_count", F.lit(0)).alias("investigation_count"),
        F.coalesce("first_seen_at", "__first").alias("first_seen_at"),
        F.greatest("last_seen_at", "__last").alias("last_seen_at"),
    )
    return merged, rejected


def append_investigations(subjects: DataFrame, investigations: DataFrame, new: DataFrame
                          ) -> tuple[DataFrame, DataFrame]:
    """Append and count: (subjects, investigations).

    Rows already stored, and rows that repeat an id of the batch, are not counted twice.
    """
    fresh = dedup_first(new, ["id"], ["created_at"]).join(investigations.select("id"), "id", "left_anti")
    counts = fresh.groupBy(F.col("subject_id").alias("id")).agg(
        F.count(F.lit(1)).alias("__n"), F.max("created_at").alias("__at"))
    moved = subjects.join(counts, "id", "left").withColumns({
        "investigation_count": (
            F.col("investigation_count") + F.coalesce("__n", F.lit(0))).cast("int"),
        "last_seen_at": F.greatest("last_seen_at", "__at"),
    }).select(*subjects.columns)
    return moved, investigations.unionByName(fresh, allowMissingColumns=True)


# --- evidence ---------------------------------------------------------------------------
def oldest_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Oldest row id per key."""
    return evidence.groupBy(*keys).agg(
        F.min_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("__o")
    ).select(*keys, F.col("__o.id").alias("id"), F.col("__o.created_at").alias("created_at"))


def with_json_keys(evidence: DataFrame) -> DataFrame:
    """Adds the fields of ``data`` that identify a stored record."""
    return evidence.withColumns({
        "source_url": F.get_json_object("data", "$.source_url"),
        "fake_type": F.get_json_object("data", "$.fake_type"),
        "report_count": F.nullif(
            F.get_json_object("data", "$.report_count"), F.lit("")).try_cast("int"),
    })


def upsert_evidence(evidence: DataFrame, changes: DataFrame, keys: list[str], order: list,
                    seen_at) -> tuple[DataFrame, DataFrame]:
    """Replace the payload of a known key, insert the others: (evidence, stored changes).

    ``keys`` name columns of ``changes`` and of ``evidence`` (see ``with_json_keys``); among
    changes with one key the last in ``order`` wins.  ``updated`` tells which path was taken.
    """
    last = top_n(changes, keys, [F.desc(o) for o in order], 1)
    known = oldest_evidence(evidence, keys).withColumnsRenamed(
        {"id": "__id", "created_at": "__created"})
    stored = (
        last.join(known, keys, "left")
        .withColumns({
            "id": F.coalesce("__id", F.sha2(F.concat_ws("|", F.lit("evidence"), *keys), 256)),
            "created_at": F.coalesce("__created", seen_at),
            "updated": F.col("__id").isNotNull(),
        }).drop("__id", "__created")
    )
    kept = evidence.join(stored.select("id"), "id", "left_anti")
    rows = stored.select(*[c for c in evidence.columns if c in stored.columns])
    return kept.unionByName(rows, allowMissingColumns=True), stored


def source_url_counts(evidence: DataFrame, media: DataFrame) -> DataFrame:
    """Evidence rows and attached media per (source, source_url)."""
    keyed = evidence.select(
        "id", "source", F.get_json_object("data", "$.source_url").alias("source_url")
    ).where(F.col("source_url").isNotNull())
    attached = media.where(F.col("entity_type") == "evidence").groupBy(
        F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("__m"))
    return keyed.join(attached, "id", "left").groupBy("source", "source_url").agg(
        F.count(F.lit(1)).alias("n_evidence"),
        F.sum(F.coalesce("__m", F.lit(0))).cast("bigint").alias("n_media"))


def posts_to_ingest(posts: DataFrame, subjects_of: DataFrame, evidence: DataFrame,
                    media: DataFrame, source: str) -> DataFrame:
    """Posts that are not complete yet.

    posts(link, image_urls, …), subjects_of(link, subject_id).  A post is complete when every
    subject has evidence for the link and each of these has every image: counted, so that
    subjects and images of a post are never paired up.
    """
    images = posts.select("link", F.explode("image_urls").alias("image")).distinct()
    need = subjects_of.groupBy("link").agg(F.count_distinct("subject_id").alias("n_subjects")).join(
        images.groupBy("link").agg(F.count(F.lit(1)).alias("n_images")), "link", "left"
    ).withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    keyed = evidence.where(F.col("source") == source).select(
        F.col("id").alias("evidence_id"), "subject_id", "created_at",
        F.get_json_object("data", "$.source_url").alias("link"))
    ours = keyed.join(subjects_of.distinct(), ["link", "subject_id"], "left_semi")
    ours = dedup_first(ours, ["link", "subject_id"], ["created_at", "evidence_id"])
    n_found = ours.groupBy("link").agg(F.count(F.lit(1)).alias("found_subjects"))
    held = media.where(F.col("entity_type") == "evidence").select(
        F.col("entity_id").alias("evidence_id"), F.col("original_url").alias("image")).distinct()
    n_held = (
        held.join(ours.select("evidence_id", "link"), "evidence_id")
        .join(images, ["link", "image"], "left_semi")
        .groupBy("link").agg(F.count(F.lit(1)).alias("found_images"))
    )
    complete = need.join(n_found, "link").join(n_held, "link", "left").where(
        (F.col("found_subjects") == F.col("n_subjects"))
        & (F.coalesce("found_images", F.lit(0)) == F.col("n_subjects") * F.col("n_images")))
    return posts.join(complete.select("link"), "link", "left_anti")


# --- media ------------------------------------------------------------------------------
def oldest_media(media: DataFrame) -> DataFrame:
    """Oldest row per original_url."""
    return dedup_first(
        media.where(F.col("original_url").isNotNull()), ["original_url"], ["created_at", "id"])


def media_exists(media: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose columns match a stored media row."""
    return keys.join(media.select(*keys.columns).distinct(), keys.columns, "left_semi")


def media_with_evidence(media: DataFrame, evidence: DataFrame) -> DataFrame:
    m = media.where(F.col("entity_type") == "evidence").withColumnRenamed("id", "media_id")
    e = evidence.select(F.col("id").alias("entity_id"), "source", "data")
    return m.join(e, "entity_id")


def media_of(media: DataFrame, entity_type: str, ids: DataFrame) -> DataFrame:
    """Media of the given entities, oldest first."""
    hit = ids.select(F.col("id").alias("entity_id")).distinct()
    return media.where(F.col("entity_type") == entity_type).join(
        hit, "entity_id", "left_semi").orderBy("entity_id", "created_at", "id")


def attach_media(media: DataFrame, wanted: DataFrame, files: DataFrame, seen_at
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """wanted(entity_id, original_url), files(original_url, file_path, content_type, file_size_bytes).

    Returns (media, outcome rows, failures).  A pair that exists is skipped; a URL stored for
    any entity reuses its file; otherwise the file must be among ``files``, else it failed.
    """
    pairs = wanted.select("entity_id", "original_url").distinct().withColumn(
        "entity_type", F.lit("evidence"))
    have = media.select("entity_type", "entity_id", "original_url").distinct()
    open_ = pairs.join(have, ["entity_type", "entity_id", "original_url"], "left_anti")
    facts = ["file_path", "content_type", "file_size_bytes"]
    stored = oldest_media(media).select(
        "original_url", F.struct(*facts).alias("__old"))
    loaded = dedup_first(files, ["original_url"], ["file_path"]).select(
        "original_url", F.struct(*facts).alias("__new"))
    outcome = (
        open_.join(stored, "original_url", "left").join(loaded, "original_url", "left")
        .withColumn("outcome", F.when(F.col("__old").isNotNull(), "reused")
                    .when(F.col("__new").isNotNull(), "downloaded").otherwise("failed"))
        .withColumn("__f", F.coalesce("__old", "__new"))
    )
    rows = outcome.where(F.col("outcome") != "failed").select(
        F.sha2(F.concat_ws("|", F.lit("media"), "entity_id", "original_url"), 256).alias("id"),
        "entity_type", "entity_id", F.col("__f.file_path").alias("file_path"), "original_url",
        F.col("__f.content_type").alias("content_type"),
        F.col("__f.file_size_bytes").alias("file_size_bytes"), seen_at.alias("created_at"))
    failed = outcome.where(F.col("outcome") == "failed").select(
        F.col("original_url").alias("url"), F.lit("image_download").alias("phase"))
    return (media.unionByName(rows, allowMissingColumns=True),
            outcome.select("entity_id", "original_url", "outcome"), failed.distinct())


def delete_media(media: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media without the ids, ids that were present)."""
    wanted = ids.select("id").distinct()
    return media.join(wanted, "id", "left_anti"), wanted.join(media.select("id"), "id", "left_semi")


# --- failures ---------------------------------------------------------------------------
def failure_state(log: DataFrame) -> DataFrame:
    """One row per failure episode of a URL from the log (url, ts, ok, phase, message).

    A success closes the open episode; the first failure after it starts a new one.
    """
    counted = running_sum(
        log, ["url"], "ts", F.when(F.col("ok"), 1).otherwise(0), "episode", tie=["ok"])
    fails = counted.where(~F.col("ok")).groupBy("url", "episode").agg(
        (F.count(F.lit(1)) - 1).cast("int").alias("retry_count"),
        F.max_by(F.struct("phase", "message"), "ts").alias("__l"),
        F.min("ts").alias("created_at"), F.max("ts").alias("__last"))
    successes = log.where("ok").groupBy("url").agg(
        F.max("ts").alias("__ok"), F.count(F.lit(1)).alias("__n"))
    resolved = F.coalesce(F.col("__n") > F.col("episode"), F.lit(False))
    return fails.join(successes, "url", "left").select(
        "url", "episode", F.col("__l.phase").alias("error_phase"),
        F.col("__l.message").alias("error_message"), "retry_count", resolved.alias("resolved"),
        "created_at", F.when(resolved, F.col("__ok")).otherwise(F.col("__last")).alias("updated_at"))


def retry_queue(failures: DataFrame) -> DataFrame:
    return failures.where(~F.col("resolved")).orderBy("retry_count", "created_at", "url")


# --- reports ----------------------------------------------------------------------------
def apply_decisions(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last decision per report wins: (reports, ids of the affected subjects)."""
    last = decisions.groupBy(F.col("report_id").alias("id")).agg(
        F.max_by(F.struct("status", "reviewed_by", "decided_at"),
                 F.struct("decided_at", "status")).alias("__d"))
    joined = reports.join(last, "id", "left")
    affected = joined.where(F.col("__d").isNotNull()).select(F.col("subject_id").alias("id"))
    decided = joined.withColumns({
        "status": F.coalesce("__d.status", "status"),
        "reviewed_by": F.coalesce("__d.reviewed_by", "reviewed_by"),
        "reviewed_at": F.coalesce("__d.decided_at", "reviewed_at"),
    }).select(*reports.columns)
    return decided, affected.distinct()


def append_reports(reports: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted submissions become pending reports; a repeated batch adds nothing."""
    from ..functions.base import strip

    rows = accepted.select(
        F.sha2(F.concat_ws("|", F.lit("report"), "event_id"), 256).alias("id"),
        "subject_id", "reporter_ip_hash", strip("description").alias("description"),
        strip("category").alias("category"), F.lit("pending").alias("status"), "created_at")
    fresh = rows.join(reports.select("id"), "id", "left_anti")
    return reports.unionByName(fresh, allowMissingColumns=True)


# --- stored model results -----------------------------------------------------------------
def purge_expired(df: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows still valid, one row with the number of expired ones)."""
    expired = F.col("expires_at") <= as_of_lit(as_of)
    return df.where(~expired), df.agg(count_if(expired).alias("n_purged"))


def put_results(stored: DataFrame, results: DataFrame, ttl_hours: int, as_of: datetime
                ) -> DataFrame:
    now = as_of_lit(as_of)
    rows = results.withColumn("created_at", now).withColumn(
        "expires_at", now + F.make_dt_interval(hours=F.lit(ttl_hours)))
    return stored.unionByName(rows, allowMissingColumns=True)


def drop_subjects(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove subjects with their rows in all tables."""
    gone = ids.select("id").distinct()
    as_key = {c: gone.withColumnRenamed("id", c)
              for c in ("subject_id", "subject_a_id", "subject_b_id")}
    out = dict(tables)
    out["subjects"] = tables["subjects"].join(gone, "id", "left_anti")
    for name, frame in tables.items():
        for key in as_key:
            if name != "subjects" and key in frame.columns:
                out[name] = out[name].join(as_key[key], key, "left_anti")
    return out


def drop_investigations(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove investigations; their evidence stays and loses the reference."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    out["investigations"] = tables["investigations"].join(gone, "id", "left_anti")
    mark = gone.select(F.col("id").alias("investigation_id"), F.lit(True).alias("__gone"))
    evidence = tables["evidence"].join(mark, "investigation_id", "left")
    out["evidence"] = evidence.withColumn(
        "investigation_id", F.when(F.col("__gone").isNull(), F.col("investigation_id"))
    ).select(*tables["evidence"].columns)
    return out
