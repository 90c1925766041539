"""Helpers the operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, small_batches

if TYPE_CHECKING:
    import pyarrow as pa

T = TypeVar("T")
_kept: dict[object, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batches(
        df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` by batches of bounded bytes, however long the rows are."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def in_worker(name: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under ``name``. Workers go on from one step to the next, so what another
    step kept is dropped first: a worker holds the tables of one step, not of all it ever worked for."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what earlier steps kept in this worker."""
    if _kept:
        _kept.clear()
        gc.collect()  # an encoder and its pieces refer to each other


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows kept away from learning; a row without id is not held out but never learned from either."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 3 != 1, F.lit(False))


def utf8(text: Column) -> Column:
    """Bytes of the text; none for null."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def rows_of(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A small table planned on the driver, as a literal of the plan."""
    import json

    inner = f"array<struct<{schema}>>"
    return spark.sql(f"SELECT inline(from_json(:rows, '{inner}'))", args={"rows": json.dumps(rows)})
