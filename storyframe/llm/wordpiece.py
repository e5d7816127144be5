"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Where matching can't go on, the longest-match strategy would cut pieces off the front of
what was read and go on with the rest; a failure link leads straight to the node of that rest, and the number of pieces
cut off is stored with it.  So a word's greedy piece count comes from one pass over its characters, without pieces.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, per_worker


class Automaton:
    """Piece counts of words by greedy longest match over ``pieces``; a word that can't be matched is one piece.

    ``end`` closes every word and belongs to the text that is matched (a vocabulary with word ends).
    """

    def __init__(self, pieces, end: str = "</w>"):
        self.end = "\x00" if end else ""
        self.next: list[dict[str, int]] = [{}]
        final = [False]
        for p in pieces:
            p = p[: -len(end)] + "\x00" if end and p.endswith(end) else p
            node = 0
            for c in p:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = to
            final[node] = node > 0
        # Breadth first: the failure of a node and the pieces popped on the way.
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            deeper = []
            for u in level:
                for c, v in self.next[u].items():
                    deeper.append(v)
                    if final[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
            level = deeper

    def count(self, word: str) -> int:
        if not word:
            return 0
        node, n = 0, 0
        for c in word + self.end:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                n += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node:
            if self.fail[node] < 0:
                return 1
            n += self.popped[node]
            node = self.fail[node]
        return n


def load(path: str) -> list[str]:
    """The pieces of a tokenizer file's vocabulary, in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return sorted(vocab, key=vocab.get)


# Byte-level form: printable Latin-1 bytes stand for themselves, the others follow from 256.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def byte_form(word: str) -> str:
    """A word as a byte-level vocabulary spells it: a character for each byte of its UTF-8."""
    return word.encode("utf-8").decode("latin-1").translate(_BYTES)


class _Counts(dict):
    def __init__(self, automaton: Automaton, byte_level: bool, limit: int = 500_000):
        self.automaton, self.byte_level, self.limit = automaton, byte_level, limit

    def __missing__(self, chunk: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        word = chunk.decode("utf-8").lower()
        self[chunk] = n = self.automaton.count(byte_form(word) if self.byte_level else word)
        return n


def count_tokens(docs: DataFrame, vocabulary: str, end: str = "</w>", byte_level: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens): words between ASCII white space, lower-cased, and their greedy pieces.

    byte_level: the vocabulary spells words by the bytes of their UTF-8 (``byte_form``), not by their characters.
    A word that the vocabulary can't spell is one unknown piece.  A null, empty or blank text has none.  Repeated rows
    count each; a null doc_id stays; an empty table gives no rows.  Other columns are ignored.
    """

    bounded_batches(docs.sparkSession)

    def run(batches):
        counts = per_worker("piece counts", (vocabulary, end, byte_level), lambda: _Counts(Automaton(load(vocabulary), end), byte_level))
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1).cast(pa.large_binary()):
                parts = (t.as_py() or b"").lower().split()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
