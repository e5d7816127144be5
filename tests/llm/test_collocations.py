import re
from collections import Counter

import pytest

from storyframe.llm import collocations


def plain(rows, longest=3, least=10, top=2000, share=50):
    """The contract by loops, for any longest phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = Counter()
    for (lang, *w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[(lang, *w[i : i + k])] = max(held[(lang, *w[i : i + k])], a)
    out = {}
    for (lang, *w), a in candidates.items():
        if 100 * held[(lang, *w)] >= share * a and held[(lang, *w)]:
            continue
        score, k = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_table_against_plain_code(spark, more):
    assert listed(collocations.mine(more)) == plain([(r.lang, r.text) for r in more.collect()])


def test_blocks_sums_and_longer_phrases(spark, docs, monkeypatch):
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert listed(collocations.mine(docs, longest=4, least=3, top=50, share=70)) == plain(rows, 4, 3, 50, 70)
    # Small blocks: a run comes from many of them.
    batches = list(_arrow(docs))
    monkeypatch.setattr(collocations, "_BLOCK", 300)
    packed = list(collocations._short_runs(5)(batches))
    assert len(packed) > 20
    summed = Counter()
    for batch in collocations._summed(2)(packed):
        for lang, phrase, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            summed[lang, phrase] += n
    monkeypatch.setattr(collocations, "_BLOCK", 10**9)
    (whole,) = collocations._short_runs(1)(batches)
    again = {(lang, p): n for b in collocations._summed(2)([whole]) for lang, p, n in zip(*(b.column(k).to_pylist() for k in range(3)))}
    assert dict(summed) == again and again["en", b""] > 1000


def test_a_full_filter_only_costs(spark, docs, monkeypatch):
    rows = [(r.lang, r.text) for r in docs.collect()]
    monkeypatch.setattr(collocations, "_FILTER", 64)
    assert listed(collocations.mine(docs, least=3)) == plain(rows, least=3)


def _arrow(docs):
    from pyspark.sql import functions as F

    yield from collocations.pieces(docs).withColumn("piece", F.col("piece").cast("binary")).toArrow().to_batches(max_chunksize=50)


def test_nulls_ties_repeats_and_odd_texts(spark, edge):
    words = "aa bb cc. " * 12 + "Aa\tbb  dd,aa bb ee\x0baa bb cc " + "Über öl! " * 11 + "... ;; \n\r\n"
    rows = [(None, words), ("", words), ("en", None), ("en", ""), ("de", "x" * 50_000 + " y z " * 20), ("de", "x y"), ("EN", "no\x1cbreak here " * 15)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert listed(collocations.mine(docs)) == plain(rows)
    assert listed(collocations.mine(docs, least=1, top=7)) == plain(rows, least=1, top=7)
    assert listed(collocations.mine(edge)) == plain([(r.lang, r.text) for r in edge.collect()])


def test_clashing_columns_empty_tables_and_wide_products(spark):
    docs = spark.createDataFrame([("one two three. " * 20, "en", "x", 1, 2)], "text string, lang string, piece string, copies long, n long")
    assert listed(collocations.mine(docs)) == plain([("en", "one two three. " * 20)]) == [("en", 1, "one two three", 20, 20, 20, 60, 10**6)]
    assert not collocations.mine(docs.limit(0)).collect()
    assert not collocations.mine(docs, least=1000).collect()
    with pytest.raises(ValueError):
        collocations.mine(docs, longest=1)
    wide = spark.sql("select 5000000000000L a, 5000000000001L l, 5000000000000L r")
    assert wide.select(collocations.scored("a", "l", "r")).first()[0] == 10**6 * 5000000000000**2 // (5000000000001 * 5000000000000)
