"""Importance resampling towards a target distribution over hashed word runs.

Identical texts are collapsed first: documents are grouped by their full text, so a text's features are counted once and
multiplied by its copies, and its weight is computed once.  The weights are joined back to the documents by the SHA-256
of the text (a join that adaptive execution splits where one text has many copies); only then does each document get
its own noise.  The draw is a global order without a global task: rows are dealt out by ranges of (score, id), numbered
within their range, and the ranges' sizes, a number for each partition, give what comes before each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

_SPAN = 1 << 20  # bytes of a text that are split at once
_SUMS = 16  # tasks that sum the others' counts, and rows of counts that the driver adds
_LOW = (1 << 33) - 1  # monotonically_increasing_id: the number within a partition
# Digits, letters and everything beyond ASCII stand for themselves, A-Z lower-cased; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, width: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to ``width`` words that end in them), by spans of a text.

    The checksum of a run is that of its first words continued over the next one, so runs are never built.
    """
    data, at, tail = text.translate(_FOLD), 0, []
    while at < len(data):
        to = data.find(b" ", at + _SPAN)
        to = len(data) if to < 0 else to
        fresh = data[at:to].split()
        words, old, at = tail + fresh, len(tail), to
        crcs = list(map(crc32, words))
        runs, spaced = [crcs[old:]], [b" " + w for w in words]
        for k in range(1, width):
            crcs = list(map(crc32, spaced[k:], crcs))
            runs.append(crcs[max(0, old - k) :])
        yield len(fresh), np.fromiter(chain(*runs), np.int64) % buckets
        tail = words[len(words) - min(len(words), width - 1) :]


def _counts(width: int, buckets: int):
    """A task's counts of all buckets as one row, each text times its copies."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, found in features(text, width, buckets):
                    total += np.bincount(found, minlength=buckets) * copies
        yield _counted(total)

    return run


def _counted(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["counts"])


def _summed(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield _counted(total)

    return run


def _weights(width: int, gains: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = n = total = 0
                for fresh, found in features(text, width, len(gains)):
                    words, n, total = words + fresh, n + len(found), total + int(gains[found].sum())
                rows.append((words, n, total // n if n else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_key", "_words", "_n", "_weight"])

    return run


def bucket_counts(texts: DataFrame, width: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Occurrences of features by bucket, over all of ``texts`` (text binary, copies long): ``buckets`` numbers.

    A task gives one row; they are summed in ``_SUMS`` tasks, whose rows the driver adds.
    """
    found = texts.select("text", "copies").mapInArrow(_counts(width, buckets), "counts binary").repartition(_SUMS).mapInArrow(_summed(buckets), "counts binary")
    return np.sum([np.frombuffer(r.counts, "<i8") for r in found.collect()], 0, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source for each bucket, with one added to every count, rounded down."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def collapsed(rows: DataFrame) -> DataFrame:
    """(text binary, copies): distinct texts and how many rows have each; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(F.col("text").cast("binary").alias("text"), "copies")


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """Rows with ``_rank`` from 1 in a global order, and their number.

    What the driver collects and broadcasts is one number for each partition.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread = written(spread, "ranks")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(tuple(r) for r in spread.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part int, _before long")
    ranked = spread.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW)) + 1).drop("_part", "_before", "_at"), before[-1]


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, width: int = 2, buckets: int = 10_000, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, carried columns): every row of ``docs``, weighed by likeness to ``target``.

    Features are the runs of 1 to ``width`` words, counted in ``buckets``.  ``weight`` is the floored mean of their gains,
    ``score`` adds noise drawn from the id, so reruns agree; the ``percent`` highest scores among rows of ``least_words``
    words and more have a ``rank``, ties in order of id.

    Rows are judged each by themselves: equal texts have equal weights, repeated ids their own ranks.  A null, empty or
    wordless text has no features and weight 0.  A row without doc_id counts as a text, but has no score and isn't drawn.
    Very long texts go in spans.  An empty ``docs`` gives no rows; with an empty ``target`` common features weigh less.
    Of other columns only those in ``carry`` are kept; they may have any name but those of the result.
    """
    if not 0 <= percent <= 100 or min(width, buckets) < 1:
        raise ValueError("percent lies from 0 to 100; width and buckets are positive")
    if clash := {c.lower() for c in carry} & {"doc_id", "n_features", "weight", "score", "rank"}:
        raise ValueError(f"carried columns can't be named {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    texts = written(collapsed(docs).withColumn("_key", F.unhex(F.sha2("text", 256))), "texts")
    gain = gains(bucket_counts(texts, width, buckets), bucket_counts(collapsed(target), width, buckets))
    weighed = texts.select("_key", "text").mapInArrow(_weights(width, gain), "_key binary, _words long, _n long, _weight long")

    extra = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.unhex(F.sha2(text, 256)).alias("_key"), extra.alias("_extra"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.join(weighed, "_key").select("_id", "_words", "_n", "_weight", (F.col("_weight") + noise).alias("_score"), *(["_extra"] if carry else []))
    scored = written(scored, "scores")

    able = F.col("_id").isNotNull() & (F.col("_words") >= least_words)
    ranked, n = numbered(scored.where(able), [F.desc("_score"), F.asc("_id")])
    rank = F.when(F.col("_rank") <= n * percent // 100, F.col("_rank"))
    both = ranked.withColumn("_rank", rank).unionByName(scored.where(~able).withColumn("_rank", F.lit(None).cast("long")))
    named = {"doc_id": "_id", "n_features": "_n", "weight": "_weight", "score": "_score", "rank": "_rank"}
    return both.select(*[F.col(c).alias(n) for n, c in named.items()], *[F.col("_extra")[c].alias(c) for c in carry])
