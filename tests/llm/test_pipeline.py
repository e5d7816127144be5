import re
from collections import Counter

import numpy as np

import corpus_pipeline as p
from storyframe.llm import mixing, quality, toxicity
from storyframe.llm.common import written
from storyframe.llm.queries import WORD_BPE, tokenizer_path

from .test_near import brute

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def test_stages_do_their_work(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(p.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, d)
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if c == i}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    mixed = stages["mixing sources to target weights"](spark, docs, d)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert mixed.columns == docs.columns and sum(r[1] for r in mixing.sized(mixed).select("doc_id", "size").collect()) == taken


def test_edge_rows_pass_every_stage(spark, edge):
    d = "/root/testdata/sf0.001"
    for rows in (edge, edge.limit(0)):
        for name, stage in p.STAGES:
            got = stage(spark, rows, d)
            got.collect()
            assert name == "packing" or got.columns == edge.columns


def test_mix_gives_repeated_and_missing_ids_their_own_words(spark):
    rows = [(None, f"n{k} " * n, "en", s, 0) for k, (s, n) in enumerate([(s, n) for s in ("a", "b", None) for n in (5, 9, 9)])]
    rows += [(7, "x y z", "en", "a", 0), (7, "x y z", "en", "b", 0), (7, "x y z", "en", "b", 0), (7, "u v w", "de", None, 1), (8, None, None, None, None), (9, " ", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(docs).collect()
    got = p.mix_sources(spark, docs, "").collect()
    assert len(plan) == len(rows)
    for s in ("a", "b", None):
        took = sum(r.taken for r in plan if r.source == s)
        assert abs(took - next(r.target for r in plan if r.source == s)) <= 1
        assert took == sum(len(words(r.text)) for r in got if r.source == s)
    assert all(r.text.split() == (r.text.split()[:1] * len(r.text.split())) or r.doc_id == 7 for r in got)


def test_mix_is_written_by_shard_and_place(spark, more):
    place = {(r.doc_id, r.source): r.shard for r in mixing.mix(more).collect()}
    parts = p.mix_sources(spark, more, "").rdd.glom().collect()
    shards = [place[r.doc_id, r.source] for part in parts for r in part]
    assert shards == sorted(shards) and len(set(shards)) == 16
    ids = [r.doc_id for part in parts for r in part]
    assert ids != sorted(ids)


def test_whole_pipeline_against_plain_code(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    rows = documents.collect()

    model = toxicity.train(documents, labels)

    def toxic(text):
        """The score by looking every word up by itself."""
        class Plain(dict):
            def __missing__(self, chunk):
                return model.lexicon.look_up(toxicity._EDGE.sub("", chunk).lower())

        z = np.r_[toxicity.measure(text or "", Plain()), 1.0] @ model.weights
        return 1 / (1 + np.exp(-z)) >= 0.5

    def same(df, want):
        assert Counter(map(tuple, df.select(*p.COLUMNS).collect())) == Counter(map(tuple, want))

    stages, now = dict(p.STAGES), documents
    now = written(stages["toxicity"](spark, now, d), "stage")
    rows = [r for r in rows if not toxic(r.text)]
    same(now, rows)

    good = {r.doc_id for r in quality.score(documents, quality.train(documents, labels)).where("quality_score >= 0.3").collect()}
    now = written(stages["quality classifier"](spark, now, d), "stage")
    rows = [r for r in rows if r.doc_id in good]
    same(now, rows)

    now = written(stages["n-gram Jaccard join"](spark, now, d), "stage")
    group = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if group[r.doc_id][1] == r.doc_id]
    same(now, rows)

    plan = {r.doc_id: r for r in mixing.mix(now).collect()}
    now = written(stages["mixing sources to target weights"](spark, now, d), "stage")
    want = Counter()
    for r in rows:
        ws, taken = words(r.text), plan[r.doc_id].taken
        if ws:
            want[(*r,)] += taken // len(ws)
            if taken % len(ws):
                cut = " ".join(ws[: taken % len(ws)])
                want[(r.doc_id, cut, r.lang, r.source, len(cut))] += 1
    mixed = now.select(*p.COLUMNS).collect()
    assert Counter(map(tuple, mixed)) == +want

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    packed = stages["packing"](spark, now, d).collect()
    total = Counter()
    for r in mixed:
        total[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got, room = Counter(), Counter()
    for r in packed:
        got[r.doc_id] += r.length
        room[r.sequence_id] += r.length
    assert got == total and all(n == 2048 or n & (n - 1) == 0 for n in room.values())

    def digest(rows):
        return Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.length == r.doc_tokens)

    assert sum(r.length for r in p.run(spark, d).collect()) == sum(total.values()) and digest(packed)
