"""Stored tables that grow by their changes.

Each commit adds a folder per changed table that holds only the rows added or replaced and the keys that go. A log entry,
written last, names every table's folders: one base, laid out by key bucket, and the changes since. Readers see the newest
entry. A commit names the version it was made from and fails if another writer has committed since, so of two
writers one wins and the other reads again. ``compact`` turns a table's changes into a new base. An entry also keeps the last
batch of each stream, so a batch that is delivered again is known.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INDEXES, TABLES
from .snapshots import _fs

KEYS = {
    "subjects": ["id"], "investigations": ["id"], "evidence": ["id"], "user_reports": ["id"], "media": ["id"],
    "subject_links": ["subject_a_id", "subject_b_id", "link_type"],
    "link_evidence": ["subject_a_id", "subject_b_id", "link_type", "evidence_id"],
    "crawl_log": ["url", "ts"], "analysis_cache": ["query", "agent_name", "prompt_hash", "input_hash"],
    "mention_index": ["subject_type", "value", "evidence_id"], "evidence_counts": ["evidence_id"],
}
SCHEMAS = TABLES | INDEXES
#: Buckets of a base, a folder each.
BUCKETS = 64
#: Folders of changes after which ``compact`` makes a new base.
MOST_CHANGES = 16


class Conflict(Exception):
    """Another writer has committed since the version that this commit was made from."""


def state(spark: SparkSession, base: str) -> dict:
    """The newest entry: version, tables (base and changes of each) and streams."""
    jvm, fs, path = _fs(spark, f"{base}/_log")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return {"version": 0, "tables": {}, "streams": {}}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, names[-1]))
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _put(spark: SparkSession, base: str, entry: dict) -> None:
    """Write an entry aside, then rename it to its version unless that is there already."""
    jvm, fs, folder = _fs(spark, f"{base}/_log")
    fs.mkdirs(folder)
    path = jvm.org.apache.hadoop.fs.Path
    aside, target = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"{entry['version']:08d}.json")
    out = fs.create(aside, False)
    try:
        out.write(json.dumps(entry).encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {entry['version']} of {base} is there already") from None
        raise


def _bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def changes_between(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` doesn't hold as they are, and the keys that are gone, marked by ``gone``."""
    columns = new.columns
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    same = F.struct(*(F.col(f"o.{c}") for c in columns)).eqNullSafe(F.struct(*(F.col(f"n.{c}") for c in columns)))
    every = match[0]
    for m in match[1:]:
        every = every & m
    put = new.alias("n").join(old.alias("o"), every & same, "left_anti").withColumn("gone", F.lit(False))
    left = old.alias("o").join(new.alias("n"), every, "left_anti").withColumn("gone", F.lit(True))
    return put.unionByName(left)


def commit(spark: SparkSession, base: str, version: int, changes: dict[str, DataFrame], keys: dict[str, list[str]] | None = None,
           stream: tuple[str, int] | None = None) -> int:
    """Write change rows (a table's columns and ``gone``) made from ``version``; the new version.

    Tables without a change row get no folder. ``stream`` is the name and batch that made them."""
    keys = KEYS | (keys or {})
    current = state(spark, base)
    if current["version"] != version:
        raise Conflict(f"{base} is at version {current['version']}, not {version}")
    entry = {"version": version + 1, "tables": dict(current["tables"]), "streams": dict(current["streams"])}
    for name, rows in changes.items():
        folder = f"{name}/c{version + 1:08d}-{uuid.uuid4().hex}"
        if name in SCHEMAS:
            rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields), "gone")
        rows.withColumn("bucket", _bucket(keys[name])).write.parquet(f"{base}/{folder}")
        known = entry["tables"].get(name, {"base": None, "changes": [], "schema": rows.drop("gone").schema.json()})
        if not spark.read.schema("bucket int").parquet(f"{base}/{folder}").isEmpty():
            entry["tables"][name] = known | {"changes": [*known["changes"], folder]}
    if stream:
        entry["streams"][stream[0]] = stream[1]
    _put(spark, base, entry)
    return version + 1


def read(spark: SparkSession, base: str, name: str, at: dict | None = None, keys: list[str] | None = None,
         buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table in an entry (by default the newest); of some key buckets only, if asked."""
    found = (at or state(spark, base))["tables"].get(name)
    if found is None:
        return spark.createDataFrame([], SCHEMAS[name])
    keys = keys or KEYS[name]
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    columns = schema.fieldNames()
    stored = T.StructType([*schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
    wanted = F.col("bucket").isin(buckets) if buckets is not None else F.lit(True)
    rows = spark.read.schema(T.StructType([*schema.fields, stored["bucket"]])).parquet(
        f"{base}/{found['base']}").where(wanted).select(*columns) if found["base"] else spark.createDataFrame([], schema)
    if not found["changes"]:
        return rows
    changed = None
    for i, folder in enumerate(found["changes"]):
        part = spark.read.schema(stored).parquet(f"{base}/{folder}").where(wanted).withColumn("nth", F.lit(i))
        changed = part if changed is None else changed.unionByName(part)
    newest = changed.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("nth")))).where("k = 1")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    kept = rows.alias("b").join(newest.select(*keys).alias("c"), match, "left_anti")
    return kept.unionByName(newest.where("NOT gone").select(*columns))


def read_all(spark: SparkSession, base: str, at: dict | None = None) -> dict[str, DataFrame]:
    at = at or state(spark, base)
    return {name: read(spark, base, name, at) for name in TABLES}


def compact(spark: SparkSession, base: str, most: int = MOST_CHANGES, keys: dict[str, list[str]] | None = None) -> int:
    """A new base for each table with more than ``most`` folders of changes; the version in force then."""
    keys = KEYS | (keys or {})
    current = state(spark, base)
    entry = {"version": current["version"] + 1, "tables": dict(current["tables"]), "streams": dict(current["streams"])}
    for name, found in current["tables"].items():
        if len(found["changes"]) > most:
            folder = f"{name}/b{entry['version']:08d}-{uuid.uuid4().hex}"
            rows = read(spark, base, name, current, keys[name]).withColumn("bucket", _bucket(keys[name]))
            rows.repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(f"{base}/{folder}")
            entry["tables"][name] = found | {"base": folder, "changes": []}
    if entry["tables"] == current["tables"]:
        return current["version"]
    _put(spark, base, entry)
    return entry["version"]
