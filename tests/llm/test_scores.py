import random

import numpy as np

from storyframe.llm import quality, toxicity
from storyframe.llm.boosting import fit
from storyframe.llm.common import held_out
from storyframe.llm.toxicity import Lexicon, errors


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_find_the_nearest_term():
    rng = random.Random(3)
    terms = ["idiot", "scum", "worthless", "disgusting", "chónú", "loweiä", "vequée", "abc"]
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "é", "1"])
        w = "".join(w)
        best = min(((distance(w, t), t) for t in terms if errors(len(t)) and distance(w, t) <= errors(len(t))), default=(0, None))
        assert w == "" or lexicon.nearest(w) == best[1], w


def test_quotation_scores_lower_than_abuse():
    hits = toxicity._Hits(Lexicon({"idiot": 1.0}))
    said, meant = toxicity.measure('he said the word "idiot" today', hits), toxicity.measure("you are an idiot today", hits)
    assert 0 < said[1] < meant[1] and toxicity.measure("you 1diot", hits)[5] == 1.0 and not any(toxicity.measure("", hits))


def test_toxicity_on_held_out_rows(spark, more, labels):
    model = toxicity.train(more, labels)
    rows = toxicity.score(more.withColumn("out", held_out()).select("doc_id", "text", "out"), model).join(labels, "doc_id").where("out").collect()
    caught = [r.toxic_score >= 0.5 for r in rows if r.toxic]
    false = [r.toxic_score >= 0.5 for r in rows if not r.toxic]
    assert np.mean(caught) >= 0.5 and np.mean(false) <= 0.05


def test_toxicity_on_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(documents.withColumn("out", held_out()).select("doc_id", "text", "out"), toxicity.train(documents, labels)).join(labels, "doc_id").where("out").collect()
    assert np.mean([r.toxic_score >= 0.5 for r in rows if r.toxic]) >= 0.9
    assert np.mean([r.toxic_score >= 0.5 for r in rows if not r.toxic]) <= 0.02


def test_words_whose_likes_are_common_are_matched_exactly(spark):
    rng = random.Random(9)
    plain = ["mentear", "domenta", "comente", "amental", "rosmena", "tormente"]
    harmless = [" ".join(rng.choice(plain) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(40)) for _ in range(200)]
    toxic = [" ".join([*(rng.choice(plain) for _ in range(20)), rng.choice(("bomentear", "scumbag")), rng.choice("xyz"), "scumbag"]) for _ in range(60)]
    rows = spark.createDataFrame([(t, 0, k % 3) for k, t in enumerate(harmless)] + [(t, 1, k % 3) for k, t in enumerate(toxic)], "text string, y int, fold int")
    lexicon = toxicity.learn_lexicons(rows)[-1]
    assert lexicon.look_up("scumbag")[1] == 0 and lexicon.look_up("scvmbag")[1] == 2
    assert lexicon.look_up("bomentear")[1] == 0 and lexicon.look_up("comentear") is None and lexicon.look_up("mentear") is None


def test_quality_on_held_out_rows(spark, more, labels):
    model = quality.train(more, labels)
    rows = quality.score(more.withColumn("out", held_out()).select("doc_id", "text", "out"), model).join(labels, "doc_id").where("out").collect()
    assert np.mean([r.quality_score >= 0.3 for r in rows if r.quality]) >= 0.95 and np.mean([r.quality_score >= 0.3 for r in rows if not r.quality]) <= 0.2


def plain_look_up(lexicon, word):
    """Lexicon.look_up by comparing the word with every term."""
    if word in lexicon.terms:
        return lexicon.terms[word], 0
    if len(word) < 3 or word in lexicon.clean:
        return None
    stems = [k for k in lexicon.stems if word.startswith(k) and len(word) > len(k)]
    if stems:
        return lexicon.stems[max(stems, key=len)], 1
    near = [t for t in lexicon.terms if t not in lexicon.exact and errors(len(t)) and abs(len(t) - len(word)) <= errors(len(t))]
    near = [(distance(word, t), t) for t in near]
    best = min(((n, t) for n, t in near if n <= errors(len(t))), default=None)
    return (0.8 * lexicon.terms[best[1]], 2) if best else None


def plain_toxic(text, model):
    parts = text.split()
    words = [toxicity._EDGE.sub("", p).lower() for p in parts]
    found = {i: h for i, w in enumerate(words) if (h := plain_look_up(model.lexicon, w))}
    x = [0.0] * toxicity.FEATURES
    if found:
        others = {i: sum(j != i and abs(i - j) <= toxicity.WINDOW for j in found) for i in found}
        scores = [w * (0.3 if toxicity.quoted(parts, i) else 1) * (1 + 0.25 * min(others[i], 4)) for i, (w, _) in found.items()]
        total = sum(scores)
        x = [np.log(1 + total), max(scores), np.log(1 + max(others.values())), total / np.sqrt(len(parts)), min(total, 4), np.mean([k == 2 for _, k in found.values()]), np.log(1 + 100 * total / len(parts))]
    return 1 / (1 + np.exp(-(np.dot(x, model.weights[:-1]) + model.weights[-1])))


def test_toxic_scores_against_plain_code(spark, more, labels):
    model = toxicity.train(more, labels)
    rows = toxicity.score(more.where("length(text) < 1500").select("doc_id", "text"), model).collect()
    assert len(rows) > 500 and sum(r.toxic_score >= 0.5 for r in rows) > 20
    for r in rows:
        assert abs(r.toxic_score - plain_toxic(r.text or "", model)) < 1e-9, r.doc_id


def plain_statistics(text):
    """The features of quality.NAMES, one by one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.NAMES)
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b"|", b".?:;", b",", b"!"]
    known = b"".join(groups)
    kinds = [sum(b in g for b in raw) for g in groups] + [sum(b < 128 and b not in known for b in raw), sum(b >= 128 for b in raw)]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw.split()]
    lines = [tuple(sorted(w)) for line in raw.split(b"\n") if (w := [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in line.split()])]
    w, n = max(len(words), 1), max(len(lines), 1)
    return [k / len(raw) for k in kinds] + [
        np.log(1 + len(raw)), np.log(1 + len(words)), (len(raw) - kinds[3] - kinds[4]) / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        max(map(words.count, set(words)), default=0) / w, 1 - len(set(lines)) / n, len(words) / n, kinds[9] / w, kinds[1] / max(kinds[0] + kinds[1], 1),
    ]


def test_quality_scores_against_plain_code(spark, more, labels):
    trees = quality.train(more, labels)
    rows = quality.score(more.where("length(text) < 2500 or text is null").select("doc_id", "text"), trees).collect()
    assert len(rows) > 500
    for r in rows:
        x, total = plain_statistics(r.text), trees.base
        for f, c, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - r.quality_score) < 1e-9, r.doc_id


def test_scores_of_edge_rows(spark, edge, labels):
    for op, name in ((toxicity, "toxic_score"), (quality, "quality_score")):
        empty = op.train(edge.limit(0), labels.limit(0))
        for model in (empty, op.train(edge, labels)):
            rows = op.score(edge.selectExpr("*", f"'x' as {name}"), model).collect()
            assert len(rows) == edge.count() and all(0 <= r[name] <= 1 for r in rows)
        assert not op.score(edge.limit(0), empty).count()


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = fit(x, y, 30, 3)
    p = t.score(x)
    assert ((p > 0.5) == y).mean() > 0.95 and (fit(x, y, 30, 3).score(x) == p).all()
    for row, want in zip(x[:40], p):
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - 7]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12
