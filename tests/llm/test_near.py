import random
import re

import numpy as np
import pyarrow as pa

from storyframe.llm import ngram_jaccard
from storyframe.llm.graph import components
from storyframe.llm.ngram_jaccard import _postings, near_duplicates

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """(n, component) of each id by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in WORD.findall((text or "").encode())]
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (sorted(map(len, sets[i])), top(i)) for i in ids}


def check(spark, rows, **options):
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(rows)
    assert {i: (sorted(r.n_shingles for r in rs), rs[0].component_id) for i, rs in got.items()} == brute(rows)


def edited(rng, words, share):
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def test_groups_of_near_copies_and_shared_passages(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    base = [[f"b{g}x{k}" for k in range(rng.choice((12, 60, 150)))] for g in range(6)]
    rows = [(100 * g + j, edited(rng, base[g], rng.choice((0, 0.01, 0.03, 0.05)))) for g in range(6) for j in range(30)]
    rows += [(1000 + j, passage + " " + " ".join(f"u{j}x{k}" for k in range(rng.randrange(40)))) for j in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "x " * 5000)]
    check(spark, rows)
    check(spark, rows, least=4, small=4, rounds=2)
    check(spark, rows, least=4, small=4, capacity=40)


def test_an_original_without_id_does_not_cost_its_copies_their_links(spark):
    rng = random.Random(7)
    words = [f"o{k}" for k in range(150)]
    rows = []
    for j in range(40):  # one edited word each: the original has the fewest rare tokens, so it would be the centre
        at = rng.randrange(150)
        rows.append((j, " ".join(words[:at] + [f"e{j}"] + words[at + 1 :])))
    found = near_duplicates(spark.createDataFrame(rows + [(None, " ".join(words))], "doc_id long, text string")).collect()
    want = brute(rows)
    assert {c for _, c in want.values()} == {0}
    assert {r.doc_id: ([r.n_shingles], r.component_id) for r in found if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id is None] == [(146, None)]


def test_a_member_is_near_in_its_group_where_any_list_says_so():
    flags = {1: [0, 1, 1, 1], 2: [1, 1, 0, 1]}
    sig = np.array([s << 1 | f for s, fs in flags.items() for f in fs], np.uint64)
    parts = (np.array([8, 4], "<u4"), np.array([11, 12, 13, 14], "<u8"), np.array([12, 10, 12, 10], "<u4"), np.zeros(4, "<u4"), np.array([0, 1, 2, 3] * 2, "<u2"), (sig & np.uint64(255)).astype(np.uint8), (sig >> np.uint64(8)).astype("<u4"))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b"".join(x.tobytes() for x in parts)])], ["p", "payload"])
    rows = [r for b in _postings(75, 100, 2)(iter([batch])) for r in b.to_pylist()]
    assert {r["a"] for r in rows} == {11} and sorted((r["b"], r["flag"]) for r in rows) == [(11, True), (12, True), (13, True), (14, True)]


def test_whole_documents_table(spark, more):
    rows = [(r.doc_id, r.text) for r in more.collect()]
    index, sets = {}, {}
    for i, text in rows:
        w = [x.lower() for x in WORD.findall((text or "").encode())]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[i]:
            index.setdefault(s, set()).add(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, mine in sets.items():
        for j in {j for s in mine for j in index[s] if j < i}:
            if 100 * len(mine & sets[j]) >= 75 * len(mine | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    found = near_duplicates(more.withColumn("component_id", more.n_chars).withColumn("n", more.lang)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_every_text_of_a_document_links_it(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "xyz"]
    check(spark, [(i, t) for i, t in zip((3, 4, 5), texts)] + [(9, t) for t in texts])


def test_edge_rows(spark, edge):
    rows = {r.doc_id: r for r in near_duplicates(edge).collect()}
    assert rows[2].component_id == 1 and rows[3].n_shingles == 0 and rows[5].component_id == 5 and rows[None].component_id is None
    assert near_duplicates(edge).count() == edge.count() and not near_duplicates(edge.limit(0)).count()


def test_components(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], []):
        up = {}
        for a, b in edges:
            if a != b:
                up.setdefault(a, a), up.setdefault(b, b)

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: top(i) for i in up}


def test_block_counts_round_trip():
    rng = np.random.default_rng(5)
    for n, top in ((0, 10), (1, 2**32 - 1), (500, 300), (4000, 2**32 - 1), (4000, 70_000)):
        token, times = np.unique(rng.integers(0, top, n, dtype=np.int64).astype(np.uint32), return_counts=True)
        a, b = ngram_jaccard._unpacked(ngram_jaccard._packed(token, times))
        assert np.array_equal(a, token) and np.array_equal(b, times)


def test_a_shingle_of_every_document_is_one_entry_a_block(spark):
    license_line = "this line is in every document of the corpus without change"
    own = "array_join(transform(sequence(1, 40), x -> concat('w', x, 'x', id)), ' ')"
    docs = spark.range(400).selectExpr("id as doc_id", f"concat('{license_line} ', {own}) as text")
    batches = docs.toArrow().to_batches()
    rows = [r for b in ngram_jaccard._scan(5, 1 << 32, 1)(batches) for r in b.to_pylist()]
    blocks = [ngram_jaccard._unpacked(r["payload"]) for r in rows if r["p"] is not None]
    assert len(blocks) == 1 and len(np.unique(blocks[0][0])) == len(blocks[0][0]) and (blocks[0][1] == 400).sum() == 7
    found = ngram_jaccard.near_duplicates(docs).collect()
    assert all(r.component_id == r.doc_id for r in found) and len(found) == 400


def test_frequent_shingles_and_wanted_ids_come_to_the_driver_as_blocks(spark, monkeypatch):
    rows = [(100 * c + j, " ".join(f"d{j}w{k}" for k in range(200)) + f" e{c}") for j in range(40) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kind, most = type(docs), []
    for name in ("collect", "toPandas"):

        def counted(self, f=getattr(kind, name)):
            got = f(self)
            most.append(len(got))
            return got

        monkeypatch.setattr(kind, name, counted)
    found = near_duplicates(docs, least=3)
    assert most and max(most) <= 50  # 7,840 shingles are in three documents each, 120 documents are compared
    monkeypatch.undo()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {100 * c + j: (197, j) for j in range(40) for c in range(3)}


def test_members_that_miss_the_centre_narrowly_are_not_compared_with_all(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]

    def changed(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [f"w{rng.randrange(10**9)}" if k in at else w for k, w in enumerate(words)]

    texts = [changed(base, rng.choice((0, 0, 1))) for _ in range(150)]
    far = [changed(base, 5) for _ in range(80)]
    # Some of them link with each other, and some reach the rest that way.
    texts += far + [changed(x, 1) for x in far[:20]] + [base[:75] + x[75:] for x in far[20:40]] + [x[: rng.randrange(100, 150)] for x in far[40:]]
    rows = [(k, " ".join(x)) for k, x in enumerate([base, *texts])]
    check(spark, rows, least=4, small=4, rounds=0)

    # The last step by itself: the first row is the centre, what it links is one component, the others are their own.
    shingles = [{tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)} for _, x in rows]

    def linked(s, t):
        return 100 * len(s & t) >= 75 * len(s | t)

    component = [0 if linked(s, shingles[0]) else k for k, s in enumerate(shingles)]
    state = spark.createDataFrame([(0, k, component[k], True, len(s), k == 0) for k, s in enumerate(shingles)], "hub long, id long, component long, flag boolean, size long, tried boolean")
    docs = spark.createDataFrame([*rows, (0, ""), (0, "b b b"), (rows[-1][0], None)], "doc_id long, text string")

    def sets(ids, share, name):
        return docs.join(ids.toDF("doc_id").distinct(), "doc_id").mapInArrow(ngram_jaccard._sets(5, share, None), "doc_id long, n long, tokens binary")

    got = {tuple(r) for r in ngram_jaccard._between(state, sets, 75, 100).collect()}
    apart = [(a, b) for a in range(1, len(rows)) for b in range(a + 1, len(rows)) if component[a] != component[b]]
    links = {(a, b) for a, b in apart if linked(shingles[a], shingles[b])}
    assert links and links <= got <= set(apart)
    assert len(got) < len(apart) / 10, (len(links), len(got), len(apart))
