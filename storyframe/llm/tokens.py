"""Token ids of whole texts with a public word-level BPE, through a cache of words.

The tokenizer drops white space and never merges across it, so the ids of a text are those of its chunks between
ASCII white space.  Plain Latin chunks split further by the tokenizer's own word pattern, and each distinct word goes
to the merge model alone.  Everything else goes to the whole tokenizer as it is.
"""

from __future__ import annotations

import os
import re
import struct

# The word pattern of the tokenizer file, for Latin text.  Fixed values.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w]|_)+")
_PLAIN = re.compile(r"[!-~¡-©«¬®-±´-¸»¿-įı-ɏ]+")


class _Cache(dict):
    """A dictionary that learns a missing key."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, key):
        self[key] = found = self.learn(key)
        return found


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level form: printable Latin-1 bytes stand for themselves, the others follow from 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.byte = str.maketrans({chr(b): chr(b if b in shown else next(hidden)) for b in range(256)})
        self.limit = limit
        self.chunk, self.word = _Cache(self._chunk), _Cache(self._word)

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text, as little-endian unsigned 32-bit numbers."""
        if len(self.chunk) > self.limit:
            self.chunk.clear()
        if len(self.word) > self.limit:
            self.word.clear()
        # Lower-casing A-Z first only makes chunks meet more often; special tokens are told by case.
        return b"".join(map(self.chunk.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def _chunk(self, chunk: bytes) -> bytes:
        # ASCII letters, and marks after them, are one word each: most chunks need no pattern.
        letters = chunk.rstrip(b".,;:!?")
        if letters.isalpha():
            found = self.word[letters.decode().lower()]
            return found if len(letters) == len(chunk) else found + self.word[chunk[len(letters) :].decode()]
        s = chunk.decode("utf-8")
        if _PLAIN.fullmatch(s) and "<|" not in s:
            return b"".join(map(self.word.__getitem__, _WORD.findall(s.lower())))
        return _packed(self.tokenizer.encode(s, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        form = word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self.byte)
        return _packed([t.id for t in self.model.tokenize(form)])
