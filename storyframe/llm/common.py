"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share; a session must name it."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Give a worker's freed memory back at the end of a task: workers are kept and used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: list = [None, None]


def per_worker(kind: str, key: object, make: Callable[[], object]):
    """What ``make`` gives, kept by this worker process for its later tasks; only the last, so stages don't add up."""
    if _kept[0] != (kind, key):
        _kept[:] = None, None
        _kept[:] = (kind, key), make()
    return _kept[1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True for the fifth of documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) for at most ``limit`` labelled training documents, chosen by hash so that reruns agree.

    Held-out rows and null labels are left out; of repeated labels for a document the largest counts, of its repeated
    rows the smallest text.  Only the chosen ids (8 bytes each, at most ``limit``) are broadcast, and only the chosen
    texts are shuffled.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(limit)
    )
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
