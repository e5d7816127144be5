import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from storyframe.llm import resampling


def plain(docs, target, percent=25, least=20, width=2, buckets=10_000, seed=7):
    """The contract by loops: rows of (doc_id, n_features, weight, score, rank)."""

    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for b in found(t)[1]:
                out[b] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(f), weight, score, words))
    able = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    drawn = [(*r[:4], k + 1 if k < len(able) * percent // 100 else None) for k, r in enumerate(able)]
    return sorted(drawn + [(*r[:4], None) for r in rows if r[4] < least or r[0] is None], key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_tables_against_plain_code(spark, more):
    target = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in more.collect()]
    assert listed(resampling.resample(more, target)) == plain(docs, [r.text for r in target.collect()])


def test_nulls_repeats_ties_and_long_texts(spark, edge):
    target = spark.createDataFrame([(1, "One Two three"), (2, None), (3, "")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    for width, percent in ((1, 100), (2, 50), (3, 25)):
        got = resampling.resample(edge, target, percent, 4, width, 1000)
        assert listed(got) == plain(docs, ["One Two three", None, ""], percent, 4, width, 1000)


def test_spans_join(monkeypatch):
    text = "Aa bb9 ccé, dd-ee ff. " * 50
    whole = np.sort(np.concatenate([b for _, b in resampling.features(text.encode(), 3, 997)]))
    monkeypatch.setattr(resampling, "_SPAN", 16)
    parts = list(resampling.features(text.encode(), 3, 997))
    assert len(parts) > 20 and sum(n for n, _ in parts) == 300
    assert np.array_equal(np.sort(np.concatenate([b for _, b in parts])), whole)


def test_clashing_columns_and_empty_tables(spark):
    rows = [(i, f"word{i % 3} " * 30, i, f"k{i}", 1.5, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, copies string, bucket double, `a.b` string")
    target = spark.createDataFrame([("word1 word1", 5)], "text string, copies long")
    got = resampling.resample(docs, target, carry=("_key", "copies", "bucket", "a.b", "text")).collect()
    assert sorted((r.doc_id, r._key, r.copies, r.bucket, r["a.b"], r.text) for r in got) == [(i, k, c, b, x, t) for i, t, k, c, b, x in rows]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert not resampling.resample(docs.limit(0), target).collect()
    assert resampling.resample(docs, target.limit(0)).count() == 40
    with pytest.raises(ValueError):
        resampling.resample(docs, target, carry=("rank",))


def test_copies_have_one_weight_and_their_own_noise(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('same text ', 20) as text")
    got = resampling.resample(docs, docs.limit(1)).collect()
    assert len({r.weight for r in got}) == 1 and len({r.score for r in got}) > 100 and sum(r["rank"] is not None for r in got) == 75
