"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Bytes of text that one Arrow batch of an operator's output comes from, at most (a longer text makes a batch of its own).
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where that is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"tessera-{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet (zstd, of that level) to the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of what has been written and is no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def trim_memory() -> None:
    """Gives a worker's free memory back, for JVM stages that come next beside workers that wait. Nothing else changes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with this package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(df: DataFrame, key: str, function, schema) -> DataFrame:
    """applyInArrow on the groups of a key, with this package sent to the executors."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(function, schema)


def reader(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with the UTF-8 bytes of ``column``'s texts (None for null), about ``max_bytes`` each."""
    texts = batch.column(column).cast(pa.large_binary())
    start = total = 0
    part: list[bytes | None] = []
    for i, text in enumerate(texts):
        value = text.as_py()
        part.append(value)
        total += len(value or b"") + 64
        if total >= max_bytes:
            yield batch.slice(start, len(part)), part
            start, total, part = i + 1, 0, []
    if part:
        yield batch.slice(start, len(part)), part


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def buckets_for(spark: SparkSession) -> int:
    """Hash buckets of the blob shuffles: a few for each shuffle partition, which are sized to the input."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
