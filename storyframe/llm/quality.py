"""Document quality by gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import bounded_batches, labelled_sample
from .textblocks import U, chunks, mix, words

# Classes of bytes: letter, capital, digit, space, line end, bar, sentence mark, comma, exclamation, other mark, beyond ASCII.
_CLASSES = 11
_CLASS = np.full(256, 10, np.uint8)
_CLASS[:128] = 9
for _k, _s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", "|", ".?:;", ",", "!")):
    _CLASS[[ord(c) for c in _s]] = _k
NAMES = [
    "letters", "capitals", "digits", "spaces", "line_ends", "bars", "marks", "commas", "exclamations", "other_marks", "beyond_ascii",
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_neighbours", "top_word", "repeated_lines", "line_words", "others_per_word", "capitals_per_letter",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each document of a chunk; an empty document has zeros."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.zeros((docs, _CLASSES))
    kind = _CLASS[data]
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, 1 << 20):
            kinds[d] += np.bincount(kind[at : min(b, at + (1 << 20))], minlength=_CLASSES)
    word, before = words(data, offsets)
    n = np.diff(before)
    doc = np.repeat(np.arange(docs), n)
    distinct, top, same = np.zeros(docs), np.zeros(docs), np.zeros(docs)
    if len(word):
        next_to = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
        same = np.bincount(doc[next_to], minlength=docs)
        flat = word.copy()
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a > 1:
                flat[a:b].sort()
        first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])])
        run = np.diff(np.r_[first, len(flat)])
        distinct = np.bincount(doc[first], minlength=docs)
        np.maximum.at(top, doc[first], run)
    lines, unique = _lines(data, offsets)
    w, s = np.maximum(n, 1), np.maximum(size, 1)
    out = np.column_stack([
        kinds / s[:, None], np.log1p(size), np.log1p(n), (size - kinds[:, 3] - kinds[:, 4]) / w, distinct / w, same / w, top / w,
        1 - unique / np.maximum(lines, 1), n / np.maximum(lines, 1), kinds[:, 9] / w, kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1),
    ])
    out[size == 0] = 0
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each document, and distinct ones (told by a 64-bit sum over their words)."""
    docs = len(offsets) - 1
    cut = np.unique(np.r_[0, np.flatnonzero(data == 10) + 1, offsets]).astype(np.int64)
    word, before = words(data, cut)
    total = np.zeros(len(word) + 1, U)
    np.cumsum(mix(word), out=total[1:])
    key = total[before[1:]] - total[before[:-1]]
    keep = np.diff(before) > 0
    doc = (np.searchsorted(offsets, cut[:-1], "right") - 1)[keep]
    key = key[keep]
    order = np.lexsort((key, doc))
    fresh = np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(key) else np.zeros(0, bool)
    return np.bincount(doc, minlength=docs)[:docs], np.bincount(doc[order][fresh], minlength=docs)[:docs]


def _features(batches):
    for batch in batches:
        y = batch.column(batch.schema.get_field_index("y"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for a, b, data, offsets in chunks(batch):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), y.slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> Trees:
    """Trees for ``labels.quality``, from at most ``limit`` labelled rows that aren't held out."""
    rows = labelled_sample(docs, labels, "quality", limit).mapInArrow(_features, "doc_id long, y int, x array<double>").toPandas()
    rows["key"] = [tuple(v) for v in rows["x"]]
    rows = rows.sort_values(["doc_id", "key"])
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with its columns and quality_score double, 0 to 1 (clashing columns are replaced).

    A null or empty text has the score of all-zero statistics.  Every row is scored by itself, so repeated rows get
    equal scores; an empty table stays empty.
    """
    from pyspark.sql import types as T

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for batch in batches:
            parts = [trees.score(statistics(data, offsets)) for _, _, data, offsets in chunks(batch)]
            value = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, "quality_score"])

    docs = docs.drop("quality_score").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
