"""Pluggable model stages: the interfaces, and deterministic stubs in their place.  Models themselves are out of scope."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions.lexicon import AUDIO_LABELS


def text_stage(load: Callable[[], Callable[[list[bytes]], list[str]]]):
    """binary -> text (recognition): the model is loaded once per task and fed whole batches."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(model([None if b is None else bytes(b) for b in s]))

    return run


def embedding_stage(load: Callable[[], Callable[[list[bytes]], list[list[float]]]], batch: int = 64):
    """binary -> vector, in batches of ``batch``."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            rows = [bytes(b) for b in s]
            yield pd.Series([v for a in range(0, len(rows), batch) for v in model(rows[a : a + batch])])

    return run


def rows_stage(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """rows -> any number of rows (boxes, blocks, segments), one model per task."""

    def run(batches):
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def with_fallback(column, fallback):
    """A stage's result, or the fallback where it failed (null)."""
    return F.coalesce(column, fallback)


def stub_text() -> Callable[[list[bytes]], list[str]]:
    return lambda rows: [None if b is None else hashlib.sha1(b).hexdigest()[:12] for b in rows]


def stub_embedding(size: int = 16) -> Callable[[list[bytes]], list[list[float]]]:
    def one(b: bytes) -> list[float]:
        seed = int.from_bytes(hashlib.sha1(b).digest()[:8], "big")
        v = np.random.Generator(np.random.PCG64(seed)).standard_normal(size)
        return (v / np.linalg.norm(v)).astype(np.float32).tolist()

    return lambda rows: [one(b) for b in rows]


def suggestions(scored: DataFrame, tags: dict[str, str] = AUDIO_LABELS, known: list[str] = (), least: float = 0.30, most: int = 3) -> DataFrame:
    """Audio tags (file, label, score) mapped to effect tags not yet known, the best ``most`` of each file."""
    from pyspark.sql import Window

    named = F.lit(None).cast("string")
    for label, tag in tags.items():
        named = F.when(F.col("label") == label, F.lit(tag)).otherwise(named)
    rows = scored.where(F.col("score") >= least).withColumn("tag", named).where(F.col("tag").isNotNull() & ~F.col("tag").isin(*known))
    best = rows.groupBy("file", "tag").agg(F.max("score").alias("score"))
    w = Window.partitionBy("file").orderBy(F.desc("score"), "tag")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
