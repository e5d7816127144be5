"""Text rules as native expressions: cleaning, junk, speech form, words, tags and narration cues."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CUE_PHRASES, CUE_WORDS, VERB_ENDINGS

# Characters stripped at the edges, and what a lone mark or letter may be.
EDGE_NOISE = "{}[]|_~^`<>\\/ "
LONE_LETTERS = "aeoáéóâêôãõàAEOÁÉÓÂÊÔÃÕÀ"
ORDINARY = r"[\p{L}\p{N}_\sÀ-ÿ.,;:!?'\"()\-–—…%$°ºª]"
VOWELS = "[aeiouyáéíóúâêôãõà]"


def clean(c: Column) -> Column:
    """White space collapsed, noise stripped from both ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(EDGE_NOISE))


def is_junk(c: Column) -> Column:
    """Whether a scanned text carries nothing that can be read out; the first rule that applies decides."""
    t = clean(c)
    n = F.char_length(t)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    digits = F.regexp_count(t, F.lit(r"[\p{Nd}²³¹]"))
    foreign = n - F.regexp_count(t, F.lit(ORDINARY))
    long_words = F.filter(F.regexp_extract_all(t, F.lit(r"([A-Za-zÀ-ÿ]+)"), 1), lambda w: F.char_length(w) >= 5)
    sound = F.exists(long_words, lambda w: F.lower(w).rlike(VOWELS) | (F.size(F.array_distinct(F.split(F.lower(w), ""))) < 3))
    return (
        F.when(n == 0, True)
        .when((letters == 0) & (digits == 0), ~((n <= 3) & t.rlike("^[?!….]+$")))
        .when(n < 2, ~F.lit(LONE_LETTERS).contains(t))
        .when((foreign > 0) & (letters <= 6), True)
        .when(foreign > 0.2 * n, True)
        .otherwise((F.size(long_words) > 0) & ~sound)
    )


def speech_form(c: Column) -> Column:
    """A text as it is read out: marks that would be voiced go, long dots are a pause; nothing left gives the original."""
    t = F.translate(c, '"“”*«»[]', "")
    t = F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"\s*\.{3,}\s*", ", ")
    t = F.regexp_replace(F.regexp_replace(t, "!{2,}", "!"), r"\?{2,}", "?")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*,\s*$", ""), r"\.+$", ""))
    return F.when(t == "", c).otherwise(t)


def is_pronounceable(c: Column) -> Column:
    return speech_form(c).rlike(r"[\p{L}\p{N}]")


def word_count(c: Column) -> Column:
    """Tokens between white space with a letter or digit."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]\S*"))


def keyword_tag(c: Column, lexicon, available=None) -> Column:
    """The first available tag, in the lexicon's order, that has a keyword inside the text; else null."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for tag, keywords in reversed(list(lexicon)):
        if available is None or tag in available:
            hit = F.lit(False)
            for k in keywords:
                hit = hit | low.contains(k)
            out = F.when(hit, F.lit(tag)).otherwise(out)
    return out


def narration_score(c: Column, min_words: int = 1, words=CUE_WORDS, phrases=CUE_PHRASES) -> Column:
    """Narrative cues per word, four places: cue words, phrases, verb endings, letters three times in a row."""
    low = F.lower(c)

    def many(form: str) -> Column:
        return F.regexp_count(low, F.lit(form))

    # A word is a run of letters; each counts once for a rule.
    initials = "".join(sorted({w[0] for w in words}))
    hits = many(rf"(?<!\p{{L}})(?=[{initials}])(?:{'|'.join(sorted(words))})(?!\p{{L}})")
    for p in phrases:
        hits = hits + (F.char_length(low) - F.char_length(F.replace(low, F.lit(p), F.lit("")))) / len(p)
    hits = hits + many(rf"(?<!\p{{L}})\p{{L}}{{4,}}+(?<={'|'.join(VERB_ENDINGS)})")
    hits = hits + many(r"(\p{L})\1\1\p{L}*")
    return F.when(~low.rlike(r"\p{L}"), 0.0).otherwise(F.round(hits / F.greatest(word_count(c), F.lit(min_words), F.lit(1)), 4))


def slug(c: Column, default: str | None = None) -> Column:
    """Lower-case letters and digits joined by single underscores; nothing left gives the default."""
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def _bare(t: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).casefold()


def folded(t: str) -> str:
    return " ".join(_bare(t).split())


# Latin letters and combining marks, with what stays of each: by rule, from the Unicode data.
_LATIN = [chr(k) for low, high in ((0xA0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00)) for k in range(low, high)]
_ONE = "".join(c for c in _LATIN if len(_bare(c)) == 1) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NONE = "".join(c for c in _LATIN if _bare(c) == "")
_MANY = {c: _bare(c) for c in _LATIN if len(_bare(c)) > 1}
# What separates words in Unicode, and four separators. Fixed values.
_BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def fold(c: Column | str) -> Column:
    """Key without accents, case and repeated blanks, in expressions: Latin script as ``folded``, others in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    for letter, plain in _MANY.items():
        c = F.replace(c, F.lit(letter), F.lit(plain))
    plain = F.translate(c, _ONE + _NONE, "".join(map(_bare, _ONE)))
    return F.btrim(F.regexp_replace(F.lower(plain), _BLANKS, " "))


def arc_slug(c: Column) -> Column:
    return slug(fold(c), "arco")


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))
