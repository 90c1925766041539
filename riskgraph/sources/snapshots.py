"""Versioned snapshots of the stored tables.

A table is a folder with one sub-folder per version.  A version is complete when Spark has
written its _SUCCESS marker, so readers take the newest complete one and a job that dies
half-way leaves the previous version in force.  Tables written together are named in one
manifest, written last: readers see all of their new versions or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES

# a source can be a page URL, so evidence is laid out by its few types instead
PARTITIONS = {"evidence": ["evidence_type"]}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str, table: str) -> list[int]:
    """Complete versions, oldest first."""
    jvm, fs, path = _fs(spark, f"{base}/{table}")
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
            found.append(int(name[1:]))
    return sorted(found)


def write_snapshot(df: DataFrame, base: str, table: str,
                   partition_by: list[str] | None = None) -> str:
    """Write the next version of a table and return its path; known tables get their schema."""
    spark = df.sparkSession
    if table in TABLES:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])
    existing = versions(spark, base, table)
    path = f"{base}/{table}/v{(existing[-1] + 1) if existing else 1:06d}"
    writer = df.write.mode("overwrite")
    by = partition_by if partition_by is not None else PARTITIONS.get(table)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, table: str, schema: T.StructType | None = None,
                  version: int | None = None) -> DataFrame:
    """A version, by default the newest complete one; an empty frame of ``schema`` without any."""
    if version is None:
        existing = versions(spark, base, table)
        version = existing[-1] if existing else None
    if version is None:
        if schema is None:
            raise FileNotFoundError(f"no version of {table} under {base}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{base}/{table}/v{version:06d}")


MANIFEST = "manifest"


def manifest(spark: SparkSession, base: str) -> dict[str, int]:
    """Version in force of each table; one row per table, empty before the first write."""
    schema = "name string, version int"
    rows = read_snapshot(spark, base, MANIFEST, T._parse_datatype_string(schema)).collect()
    return {r["name"]: r["version"] for r in rows}


def read_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All tables in the versions of the newest manifest, empty where it names none."""
    current = manifest(spark, base)
    return {
        name: read_snapshot(spark, base, name, schema, current[name])
        if name in current else spark.createDataFrame([], schema)
        for name, schema in TABLES.items()
    }


def write_tables(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Write new versions of the given tables and put them in force together."""
    spark = next(iter(tables.values())).sparkSession
    paths = {name: write_snapshot(df, base, name) for name, df in tables.items()}
    current = manifest(spark, base) | {
        name: int(path.rsplit("/v", 1)[1]) for name, path in paths.items()}
    rows = spark.createDataFrame(sorted(current.items()), "name string, version int")
    write_snapshot(rows.coalesce(1), base, MANIFEST)
    return paths


def drop_old_versions(spark: SparkSession, base: str, keep: int = 3) -> dict[str, list[int]]:
    """Remove all but the last ``keep`` versions of each table, never one that is in force."""
    current = manifest(spark, base)
    gone: dict[str, list[int]] = {}
    for name in [*TABLES, *current, MANIFEST]:
        found = versions(spark, base, name)
        old = [v for v in found[:-keep] if v != current.get(name)] if keep else []
        for v in old:
            _, fs, path = _fs(spark, f"{base}/{name}/v{v:06d}")
            fs.delete(path, True)
        if old:
            gone[name] = old
    return gone
