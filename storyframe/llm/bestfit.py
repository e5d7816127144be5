"""Packing a whole corpus into as few sequences as possible: one plan from the histogram of all lengths.

Documents are encoded once and cut only where they are longer than a sequence.  Each task numbers its pieces of each
length; the counts by task and length give what comes before a task's pieces, so every piece knows its number among all
pieces of its length without being sorted or gathered.  The driver sees the histogram alone (a number for each length up
to a sequence's) and plans it as a configuration linear program.  The plan says which numbers of a length lie in which
sequences; tasks look it up.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import configurations
from .common import bounded_batches, per_worker, release, written
from .tokens import WordIds

_PIECES = "_doc long, piece int, start long, length long, ids_crc32 long, ids binary, _part int, _nth long"
_FLUSH = 4 << 20  # bytes of ids a batch of pieces may hold


def _cut(tokenizer: str, end: int, tokens: int, wanted: bool):
    """Pieces of each document, each with the task and its number among the task's pieces of its length."""
    names = ["_doc", "piece", "start", "length", "ids_crc32", "ids", "_part", "_nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches):
        encoder = per_worker("word ids", tokenizer, lambda: WordIds(tokenizer))
        task, seen = TaskContext.get().partitionId(), [0] * (tokens + 1)
        tail = np.array([end], "<u4").tobytes()
        rows, size = [], 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode((text.as_py() or "").encode()) + tail
                for k, start in enumerate(range(0, len(ids) // 4, tokens)):
                    part = ids[4 * start : 4 * (start + tokens)]
                    n = len(part) // 4
                    rows.append((doc, k, start, n, crc32(part), part if wanted else None, task, seen[n]))
                    seen[n] += 1
                    size += len(part) if wanted else 64
                    if size > _FLUSH:
                        yield flushed()
                        rows, size = [], 0
        if rows:
            yield flushed()
        release()

    return run


def table_of(plan: list[tuple[int, tuple]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length and number: from which number on, how many to a sequence, the first sequence and offset.

    Sorted by length and first number; ``start`` tells where a length begins.  Groups of equal sequences are as many as the plan has, which
    the capacity bounds.
    """
    length, first, each, sequence, offset = [], [], [], [], []
    taken = np.zeros(capacity + 1, np.int64)
    begun = 0
    for bins, column in plan:
        at = 0
        for a, many in column:
            length.append(a)
            first.append(int(taken[a]))
            each.append(many)
            sequence.append(begun)
            offset.append(at)
            taken[a] += bins * many
            at += a * many
        begun += bins
    out = {"length": length, "first": first, "each": each, "sequence": sequence, "offset": offset}
    out = {k: np.array(v, np.int64) for k, v in out.items()}
    order = np.lexsort((out["first"], out["length"]))
    out = {k: v[order] for k, v in out.items()}
    out["start"] = np.searchsorted(out["length"], np.arange(capacity + 2))
    return out


def places(plan: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, by their length and their number among all pieces of that length."""
    row = np.empty(len(length), np.int64)
    for a in np.unique(length).tolist():
        low, high = plan["start"][a], plan["start"][a + 1]
        mine = length == a
        row[mine] = low + np.searchsorted(plan["first"][low:high], number[mine], "right") - 1
    past = number - plan["first"][row]
    each = plan["each"][row]
    return plan["sequence"][row] + past // each, plan["offset"][row] + past % each * length


def _placed(shared):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            length, number = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            sequence, offset = places(shared.value, length, number)
            keep = [k for k, n in enumerate(names) if n != "_number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sequence), pa.array(offset)], [*(names[k] for k in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, tokens: int = 4096, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): one row for each piece of each document.

    A document is its token ids and ``end``; only one longer than ``tokens`` is cut, into pieces of ``tokens`` and a rest.
    ``ids`` are a piece's token ids, little-endian unsigned 32-bit (left out without ``ids``).

    A null or empty text is its end token alone.  Repeated rows are packed each; null doc_ids are kept.  Very long texts
    are cut as any other.  An empty table gives no rows.  Other columns are ignored, whatever their names.  Pieces of
    equal length are interchangeable: which lies where follows from the order in which the input is split into tasks.
    """
    if tokens < 1:
        raise ValueError("a sequence holds one token at least")
    spark = docs.sparkSession
    bounded_batches(spark)
    use = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    pieces = written(use.mapInArrow(_cut(tokenizer, end, tokens, ids), _PIECES), "pieces")

    counts = written(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    demand = np.zeros(tokens + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        demand[length] = n
    shared = spark.sparkContext.broadcast(table_of(configurations.plan(demand), tokens))

    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = pieces.join(before, ["length", "_part"]).withColumn("_number", F.col("_before") + F.col("_nth"))
    out = ["_doc", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])
    kinds = "_doc long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    found = numbered.select(*out, "_number").mapInArrow(_placed(shared), kinds + ", sequence_id long, offset long")
    return found.withColumnRenamed("_doc", "doc_id")
