import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from storyframe.llm import bestfit, configurations
from storyframe.llm.queries import WORD_BPE, tokenizer_path


def checked(rows, texts, tokens):
    """Every piece of every document once, cut only where needed; sequences gapless.  The number of sequences."""
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    want = []
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), tokens)):
            part = ids[a : a + tokens]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= tokens
    return len(held)


def test_whole_table(spark, more):
    docs = [(r.doc_id, r.text) for r in more.collect()]
    rows = bestfit.pack(more, tokenizer_path(WORD_BPE)).collect()
    found = checked(rows, docs, 4096)
    assert found == math.ceil(sum(r.length for r in rows) / 4096)  # nothing could be better
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_edges(spark, edge):
    texts = [(r.doc_id, r.text) for r in edge.collect()]
    for tokens in (1, 7, 100):
        rows = bestfit.pack(edge.withColumn("length", edge.doc_id), tokenizer_path(WORD_BPE), tokens=tokens).collect()
        checked(rows, texts, tokens)
    assert not bestfit.pack(edge.limit(0), tokenizer_path(WORD_BPE)).collect()
    with pytest.raises(ValueError):
        bestfit.pack(edge, tokenizer_path(WORD_BPE), tokens=0)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "some words " * k, 1, "x", 2) for k in range(20)], "doc_id long, text string, _part int, ids string, _number int")
    rows = bestfit.pack(docs, tokenizer_path(WORD_BPE), tokens=16, ids=False).collect()
    checked(rows, [(k, "some words " * k) for k in range(20)], 16)


def holds(demand, plan):
    got = np.zeros(len(demand), int)
    for bins, column in plan:
        assert bins > 0 and sum(a * b for a, b in column) < len(demand)
        for a, b in column:
            got[a] += bins * b
    assert (got == demand).all()
    return sum(bins for bins, _ in plan)


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(3)
    price = np.full(41, -np.inf)
    sizes = [3, 5, 8, 13, 21]
    price[sizes] = rng.random(5) + np.array(sizes) / 9
    value, taken = configurations.knapsack(price, 40)
    best = [0.0] * 41
    for c in range(1, 41):
        best[c] = max([best[c - 1]] + [best[c - s] + price[s] for s in sizes if s <= c])
    assert np.allclose(value, best)
    row, length, many = configurations.columns(np.array([8, 21]), taken, 40)
    for k, s in enumerate((8, 21)):
        mine = row == k
        assert s in length[mine] and (length * many)[mine].sum() <= 40
        assert math.isclose((price[length] * many)[mine].sum(), price[s] + value[40 - s])


def test_the_program_beats_best_fit_where_it_matters():
    rng = np.random.default_rng(1)
    a = rng.integers(260, 480, 400)
    b = np.clip(rng.integers(260, 480, 400), 257, 1024 - a - 257)
    demand = np.bincount(np.r_[a, b, 1024 - a - b], minlength=1025)
    planned, fitted = holds(demand, configurations.plan(demand)), holds(demand, configurations.best_fit(demand))
    assert 400 <= planned <= 412 and fitted > 430
    assert configurations.solve(demand)[1] <= 400.0001


def test_plans_hold_everything_at_any_scale():
    rng = np.random.default_rng(2)
    for n, scale in ((0, 1), (1, 1), (50, 1), (3000, 1), (3000, 10**6)):
        x = np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, 512)
        demand = np.bincount(x, minlength=513) * scale
        least = -(-int((np.arange(513) * demand).sum()) // 512)
        found = holds(demand, configurations.plan(demand))
        assert least <= found <= least * 1.02 + 1
        assert configurations.solve(demand)[1] <= found + 1e-6
    assert holds(np.bincount([300] * 7, minlength=513), configurations.plan(np.bincount([300] * 7, minlength=513))) == 7
