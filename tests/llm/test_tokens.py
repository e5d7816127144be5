import random
import zlib

import numpy as np
import pytest

from storyframe.llm.packing import arrange, pack
from storyframe.llm.queries import WORD_BPE, op4_packing, op5_token_counts, tokenizer_path
from storyframe.llm.tokens import WordIds
from storyframe.llm.wordpiece import Automaton, count_tokens, load


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(WORD_BPE)).encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    encoder, rng = WordIds(tokenizer_path(WORD_BPE)), random.Random(1)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    letters = "aBzé Ñß'sªº²½_-!?.,<|>0123 İΣσ\n\t’“漢字́😀\x1c\x85İ…ǅ×÷¡§ŉĳſǳ"
    for t in ["", "it's I'LL", "<|endoftext|> x"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]:
        assert np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("segments,loss", [(256, 2048), (3, 700), (1, 2048), (64, 100)])
def test_arrangement(segments, loss):
    rng = np.random.default_rng(segments)
    lengths = rng.integers(1, 5000, 80)
    silent = np.minimum(rng.integers(0, 3000, 80), lengths)
    covered = {}
    for sequence in arrange(lengths, silent, 2048, segments, loss):
        total = sum(n for _, _, n in sequence)
        assert total == 2048 or total & (total - 1) == 0
        assert len(sequence) <= segments and sum(max(0, a + n - max(a, silent[d])) for d, a, n in sequence) <= loss
        for d, a, n in sequence:
            covered.setdefault(d, []).append((a, n))
    for d, parts in covered.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == lengths[d]
    assert len(covered) == 80


def test_packed_documents_round_trip(spark, docs, edge):
    for rows, got in ((docs.collect(), op4_packing(spark, "/root/testdata/sf0.001").collect()), (edge.collect(), pack(edge, tokenizer_path(WORD_BPE)).collect())):
        place, pieces = {}, {}
        for r in got:
            pieces.setdefault(r.doc_id, []).append(r)
            place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for r in rows:
            ids = ids_of(r.text or "") + [1]
            mine = [p for p in pieces[r.doc_id] if p.doc_tokens == len(ids)]
            assert mine and sum(p.length for p in mine) % len(ids) == 0
            for p in mine:
                if "ids_crc32" in p:
                    assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        for parts in place.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert not pack(edge.limit(0), tokenizer_path(WORD_BPE)).count()


def test_prompts_bear_no_loss(spark):
    rows = spark.createDataFrame([(1, "a b c", "question one"), (2, None, None)], "doc_id long, text string, ask string")
    got = {r.doc_id: r for r in pack(rows, tokenizer_path(WORD_BPE), tokens=64, prompt="ask").collect()}
    assert got[1].doc_tokens - got[1].loss_tokens == 2 or got[1].start > 0


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(0)
    for _ in range(150):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "</w>"]) for _ in range(rng.randint(1, 14))}
        a, marked = Automaton(sorted(vocab)), {v.replace("</w>", "\0") for v in vocab}
        for _ in range(40):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert a.count(w) == greedy(w + "\0", marked)


def test_token_counts(spark, docs, edge):
    marked = {p[:-4] + "\0" if p.endswith("</w>") else p for p in load(tokenizer_path(WORD_BPE))}
    for df in (docs.limit(60), edge):
        for r, t in zip(count_tokens(df, tokenizer_path(WORD_BPE)).collect(), df.collect()):
            ws = [w.decode().lower() for w in (t.text or "").encode().lower().split()]
            assert (r.n_words, r.n_tokens) == (len(ws), sum(greedy(w + "\0", marked) for w in ws))


def test_words_are_counted_in_the_byte_form_of_the_vocabulary(spark, docs, edge):
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    marked = {p[:-4] + "\0" if p.endswith("</w>") else p for p in load(tokenizer_path(WORD_BPE))}

    def n(text):
        ws = [w.decode().lower() for w in (text or "").encode().lower().split()]
        return len(ws), sum(greedy("".join(p for p, _ in level.pre_tokenize_str(w)) + "\0", marked) for w in ws)

    assert [n(w)[1] for w in ("für", "été", "“hello", "漢字漢字")] == [1, 2, 3, 10]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: n(r.text) for r in docs.collect()} and any(not r.text.isascii() for r in docs.collect() if r.text)
    odd = count_tokens(edge, tokenizer_path(WORD_BPE), byte_level=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in odd) == sorted((str(r.doc_id), *n(r.text)) for r in edge.collect())
