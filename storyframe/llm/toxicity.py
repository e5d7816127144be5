"""Toxicity by a learned lexicon, misspellings caught by Levenshtein automata, and context-window scores.

The lexicon comes from labelled rows: words, and beginnings of words (stems), that toxic documents use at a higher rate
than harmless ones, weighted by the logarithm of that ratio.  It is held as a trie.  A word of a text is looked up
exactly; otherwise its Levenshtein automaton (bit-parallel states, one or two errors by length) is run along the trie,
and subtrees where the automaton has died are left.  Before that a necessary condition is tested: with k errors, one of
k + 1 pieces of the term is intact near its place.  Terms whose misspellings harmless documents are full of (ordinary
syllables) are matched exactly only, and words that harmless documents use are no misspellings.  A hit's score falls
where its window shows quotation (marks around it, words that speak about words) and rises where the window holds further
hits.  A logistic model over a document's hit scores gives its score; it is fitted on scores from lexicons that were
learned without the document's fold, so that it knows how lexicons do on new text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, labelled_sample, per_worker, written

# Marks of quotation and words that speak about words, in the corpus's four languages.  Fixed values.
_OPEN, _CLOSE = "\"“„«‹‘'", "\"”“»›’'"
_ABOUT = frozenset("word words term terms said says quote quoted called slur insult means wort begriff sagte zitat mot mots terme dit cité palabra término dijo cita".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
WINDOW = 6
STEMS = range(4, 10)  # characters of a stem
FOLDS = 3
LEAST, MOST = float(np.log(4)), float(np.log(400))  # a term's rate in toxic documents: 4 times that in harmless ones; weight 1 from 400 times


def errors(length: int) -> int:
    """Errors allowed against a term of this length."""
    return 0 if length < 4 else 1 if length < 8 else 2


def pieces(term: str) -> list[tuple[int, str]]:
    """errors + 1 pieces of a term with their places."""
    k = errors(len(term)) + 1
    edge = [len(term) * i // k for i in range(k + 1)]
    return [(a, term[a:b]) for a, b in zip(edge, edge[1:])]


@dataclass
class Lexicon:
    """Weighted terms and stems; clean: words near a term that are known to be harmless; exact: terms never misspelt."""

    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()
    exact: frozenset = frozenset()

    def __post_init__(self):
        self.longest = max(map(len, self.terms), default=0) + 2
        self.stem_sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.by_length: dict[int, tuple[dict, list, int]] = {}

    def of_length(self, n: int) -> tuple[dict, list, int]:
        """For words of ``n`` characters: the trie of the terms in reach, the tests of intact pieces, the most errors.

        A first piece can only be intact at the start, a last one at the end; a middle one is off by one at most.
        """
        if n not in self.by_length:
            trie: dict = {}
            tests: dict[tuple[int, int], set[str]] = {}
            most = 0
            for term in self.terms:
                k = errors(len(term))
                if not k or abs(len(term) - n) > k or term in self.exact:
                    continue
                most = max(most, k)
                node = trie
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = term
                parts = pieces(term)
                for i, (at, piece) in enumerate(parts):
                    shifts = (0,) if i == 0 else (n - len(term),) if i == len(parts) - 1 else (-1, 0, 1)
                    for shift in shifts:
                        if at + shift >= 0:
                            tests.setdefault((at + shift, at + shift + len(piece)), set()).add(piece)
            self.by_length[n] = trie, [(x, y, frozenset(t)) for (x, y), t in tests.items()], most
        return self.by_length[n]

    def nearest(self, word: str) -> str | None:
        """The term within the errors its length allows, fewest errors first, then in order."""
        m = len(word)
        trie, tests, most = self.of_length(m)
        if not any(word[a:b] in found for a, b, found in tests):
            return None
        place: dict[str, int] = {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << i
        everything, accept = (1 << (m + 1)) - 1, 1 << m
        start = [(1 << (j + 1)) - 1 for j in range(most + 1)]
        best: tuple[int, str] | None = None
        stack = [(trie, start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    for j in range(errors(len(child)) + 1):
                        if state[j] & accept:
                            if best is None or (j, child) < best:
                                best = (j, child)
                            break
                    continue
                mask, now, alive = place.get(c, 0), [], 0
                for j in range(most + 1):
                    x = (state[j] & mask) << 1
                    if j:
                        x |= state[j - 1] | state[j - 1] << 1 | now[j - 1] << 1  # inserted, substituted and missing characters
                    now.append(x & everything)
                    alive |= now[j]
                if alive:
                    stack.append((child, now))
        return best[1] if best else None

    def look_up(self, word: str) -> tuple[float, int] | None:
        """(weight, 0 exact, 1 stem or 2 misspelt) of a lower-case word, or None."""
        found = self.terms.get(word)
        if found is not None:
            return found, 0
        if len(word) < 3 or word in self.clean:
            return None
        for n in self.stem_sizes:
            if len(word) > n and word[:n] in self.stems:
                return self.stems[word[:n]], 1
        if len(word) <= self.longest and (term := self.nearest(word)):
            return 0.8 * self.terms[term], 2
        return None


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


class _Hits(dict):
    """Hits of raw chunks between white space."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, chunk: str):
        if len(self) > 500_000:
            self.clear()
        found = self.lexicon.look_up(_EDGE.sub("", chunk).lower())
        self[chunk] = found
        return found


FEATURES = 7


def measure(text: str, hits: _Hits) -> list[float]:
    """Features of a document: hits scored in their windows, their densest window, share of words, kinds."""
    parts = text.split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, parts)) if h is not None]
    if not found:
        return [0.0] * FEATURES
    at = np.array([i for i, _ in found])
    around = np.searchsorted(at, at + WINDOW, "right") - np.searchsorted(at, at - WINDOW, "left") - 1
    scores = []
    for (i, (weight, kind)), others in zip(found, around.tolist()):
        scores.append(weight * (0.3 if quoted(parts, i) else 1.0) * (1 + 0.25 * min(others, 4)))
    total = sum(scores)
    return [np.log1p(total), max(scores), np.log1p(max(around) + 0.0), total / len(parts) ** 0.5, min(total, 4.0), float(sum(k == 2 for _, (_, k) in found) / len(found)), np.log1p(100 * total / len(parts))]


def quoted(parts: list[str], i: int) -> bool:
    """Whether the chunk stands in quotation marks within its window, or beside words that speak about words."""
    a, b = max(0, i - WINDOW), min(len(parts), i + WINDOW + 1)
    opens = any(p[0] in _OPEN for p in parts[max(a, i - 3) : i + 1])
    closes = any(p.rstrip(".,;:!?")[-1:] in _CLOSE and p.rstrip(".,;:!?") for p in parts[i : min(b, i + 4)])
    return opens and closes or any(_EDGE.sub("", p).lower() in _ABOUT for p in parts[a:b])


def _heads(w: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [w] + [w[:k] + "*" for k in STEMS if len(w) > k]


def _words(text: str) -> list[str]:
    return [w for p in text.split() if (w := _EDGE.sub("", p).lower())]


def _rows(batch) -> zip:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "y", "fold")))


def _contexts(batches):
    """Distinct (word or stem, context, fold) of toxic documents; context: the words beside it."""
    for batch in batches:
        for text, y, fold in _rows(batch):
            ws = _words(text) if y == 1 else []
            got = {(x, f"{ws[i - 1] if i else ''} {ws[i + 1] if i + 1 < len(ws) else ''}") for i, w in enumerate(ws) for x in _heads(w)}
            if got:
                word, context = zip(*sorted(got))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(context), pa.array([fold] * len(word), pa.int32())], ["word", "context", "fold"])


def _uses(batches):
    """(word or stem, fold, number of uses in harmless documents), summed by batch."""
    for batch in batches:
        many: Counter = Counter()
        for text, y, fold in _rows(batch):
            for w, n in Counter(_words(text)).items() if y == 0 else ():
                for x in _heads(w):
                    many[x, fold] += n
        word, fold = zip(*many) if many else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(fold, pa.int32()), pa.array(list(many.values()), pa.int64())], ["word", "fold", "n"])


def _near(lexicon: Lexicon):
    """(word, term or null, fold, y, documents) of words that the lexicon takes for a misspelling of term, or a stem."""

    def run(batches):
        hits = _Hits(lexicon)
        for batch in batches:
            many: Counter = Counter()
            for text, y, fold in _rows(batch):
                found = {_EDGE.sub("", p).lower() for p in set(text.split()) if hits[p] is not None and hits[p][1]}
                many.update((w, fold, y) for w in found)
            word, fold, y = zip(*many) if many else ((), (), ())
            term = [lexicon.nearest(w) if lexicon.look_up(w)[1] == 2 else None for w in word]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(term, pa.string()), pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(list(many.values()), pa.int64())], ["word", "term", "fold", "y", "n"])

    return run


def learn_lexicons(rows: DataFrame, contexts: int = 3) -> list[Lexicon]:
    """Lexicons from (text, y, fold): for each fold one learned without it, and the last from all.

    A term or stem has at least ``contexts`` distinct contexts in toxic documents (what copies of one document repeat is
    one context) and enough evidence: a log likelihood ratio of its rates above what chance finds among the candidates.
    Evidence is counted by Spark; only what has enough of it comes to the driver.
    """
    sizes = {(r[0], r[1]): r[2] or 0 for r in rows.groupBy("y", "fold").agg(F.sum(F.length("text"))).collect()}

    def toxic_share(out: int) -> float:
        t, h = (sum(n for (y, fold), n in sizes.items() if y == want and fold != out) + 1 for want in (1, 0))
        return t / (t + h)

    n = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)]
    g = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"g{k}") for k in range(FOLDS)]
    bad = rows.mapInArrow(_contexts, "word string, context string, fold int").distinct().groupBy("word").agg(*n, F.count("*").alias("n")).where(F.col("n") >= contexts)
    bad = written(bad, "candidates")
    candidates = bad.count()
    counted = bad.join(rows.mapInArrow(_uses, "word string, fold int, n long").groupBy("word").agg(*g), "word", "left").na.fill(0)
    least, share = float(np.log(max(candidates, 1)) + 1), toxic_share(-1)
    harmless = sum((F.col(f"g{k}") for k in range(FOLDS)), F.lit(0))
    part = F.col("n") / (F.col("n") + harmless)
    evidence = F.col("n") * F.log(part / share) + F.when(harmless > 0, harmless * F.log((1 - part) / (1 - share))).otherwise(0)
    kept = counted.where((part > share) & (evidence > least)).orderBy("word").collect()

    def ratio(bad_: float, good: float, share: float) -> float:
        """Logarithm of the ratio of rates."""
        return float(np.log((bad_ + 0.5) / share / ((good + 0.5) / (1 - share))))

    def weighted(out: int) -> tuple[dict[str, float], dict[str, float]]:
        share, terms, stems = toxic_share(out), {}, {}
        for r in kept:
            b = sum(r[f"n{k}"] for k in range(FOLDS) if k != out)
            h = sum(r[f"g{k}"] for k in range(FOLDS) if k != out)
            w = ratio(b, h, share)
            if b >= contexts and w >= LEAST and b * np.log(b / (b + h) / share) + (h * np.log(h / (b + h) / (1 - share)) if h else 0) > least:
                (stems if r["word"][-1] == "*" else terms)[r["word"].rstrip("*")] = min(w, MOST) / MOST
        return terms, stems

    near = rows.mapInArrow(_near(Lexicon(*weighted(-1))), "word string, term string, fold int, y int, n long")
    near = near.groupBy("word", "term", "fold", "y").agg(F.sum("n").alias("n")).collect() if kept else []
    out = []
    for k in [*range(FOLDS), -1]:
        (terms, stems), share = weighted(k), toxic_share(k)
        words, misspelt = ({}, {}), ({}, {})
        for r in near:
            if r["fold"] != k:
                words[r["y"]][r["word"]] = words[r["y"]].get(r["word"], 0) + r["n"]
        clean = frozenset(w for w, h in words[0].items() if ratio(words[1].get(w, 0), h, share) < LEAST)
        for r in near:
            if r["fold"] != k and r["term"] is not None and r["word"] not in clean:
                misspelt[r["y"]][r["term"]] = misspelt[r["y"]].get(r["term"], 0) + r["n"]
        # New harmless words come at the rate of those seen once: they count against a term though they are clean now.
        fresh: Counter = Counter(r["term"] for r in near if r["fold"] != k and r["y"] == 0 and r["term"] is not None)
        exact = frozenset(t for t, h in fresh.items() if ratio(misspelt[1].get(t, 0), h, share) < LEAST)
        out.append(Lexicon(terms, stems, clean, exact))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic model (last: constant), by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> Model:
    """A model of ``labels.toxic`` from at most ``limit`` labelled documents that aren't held out."""
    rows = labelled_sample(docs, labels, "toxic", limit).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = written(rows, "sample")
    lexicons = learn_lexicons(rows)

    def run(batches):
        hits = [_Hits(lexicon) for lexicon in lexicons[:-1]]
        for batch in batches:
            got = [(y, measure(text, hits[fold])) for text, y, fold in _rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").groupBy("x", "y").count().toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, FEATURES)
    order = np.lexsort((got["y"], *x.T)) if len(x) else np.zeros(0, int)
    x, y, n = x[order], got["y"].to_numpy(float)[order], got["count"].to_numpy()[order]
    return Model(lexicons[-1], _logistic(np.repeat(x, n, 0), np.repeat(y, n)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with its columns and toxic_score double, 0 to 1 (a clashing column is replaced).

    A null or empty text has no hits and the score of that.  Rows are scored each by themselves; repeated rows get
    equal scores, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        model = shared.value
        hits = per_worker("toxic hits", key, lambda: _Hits(model.lexicon))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([measure(t.as_py() or "", hits) for t in texts], float).reshape(-1, FEATURES)
            value = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model.weights, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "toxic_score"])

    docs = docs.drop("toxic_score").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))
