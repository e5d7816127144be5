"""Keys, names, fingerprints, timestamps and stable choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_key(page: Column) -> Column:
    return F.format_string("page_%03d", page)


def crop_name(page: Column, panel: Column) -> Column:
    return F.format_string("page%03d_panel%02d", page, panel)


def bubble_key(page: Column, panel: Column, bubble: Column) -> Column:
    return F.format_string("page_%03d_panel%02d/b%d", page, panel, bubble)


def body_key(page: Column, body: Column) -> Column:
    return F.format_string("page_%03d/body%02d", page, body)


def first_page(fingerprint: Column) -> Column:
    """The first page that a fingerprint names; 1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(fingerprint, r"first=(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def fingerprint(engine: Column, *parts: Column, prompt: Column | None = None) -> Column:
    """Engine and parameters, with the first eight hex digits of the prompt's SHA-1."""
    return F.concat_ws(":", engine, *parts, *([F.substring(F.sha1(prompt), 1, 8)] if prompt is not None else []))


def stable_index(c: Column, size) -> Column:
    """A choice below ``size`` from the first two bytes of the SHA-1."""
    return (F.conv(F.substring(F.sha1(c), 1, 4), 16, 10).cast("bigint") % size).cast("bigint")


def variant_index(tag: Column, seed: Column, size) -> Column:
    """A choice below ``size`` from the first four bytes of the SHA-1 of tag:seed."""
    return (F.conv(F.substring(F.sha1(F.concat_ws(":", tag, seed)), 1, 8), 16, 10).cast("bigint") % size).cast("bigint")


def timestamp_text(seconds: Column) -> Column:
    """HH:MM:SS, floored and not below zero; hours don't wrap."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def timestamp_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS or MM:SS; null where the text is neither."""
    p = F.split(F.trim(text), ":")
    low = F.try_element_at(p, F.lit(-1)).cast("double") + 60 * F.try_element_at(p, F.lit(-2)).cast("double")
    return F.when(F.trim(text).rlike(r"^\d+:\d{1,2}(:\d{1,2})?$"), low + F.when(F.size(p) == 3, 3600 * F.try_element_at(p, F.lit(1)).cast("double")).otherwise(0.0))


def server_url(url: Column) -> Column:
    """Without trailing slashes and a trailing /v1."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/v1$", ""), "/+$", "")


def model_label(path: Column) -> Column:
    return F.when(path.endswith(".gguf"), F.regexp_extract(path, r"([^/]*)\.gguf$", 1)).otherwise(path)


def rate_text(base: Column, speed: Column) -> Column:
    """Speaking rate as a signed percentage: base and speed combined."""
    return F.format_string("%+d%%", (base + F.bround((speed - 1) * 100)).cast("int"))


def silent_ms(text: Column, per_char: int = 60, least: int = 300) -> Column:
    return F.greatest(F.lit(least), per_char * F.char_length(text)).cast("bigint")


def frames_ms(frames: Column, rate: int) -> Column:
    return F.bround(frames * 1000 / rate).cast("bigint")


def voice_profile(c: Column) -> Column:
    """A known voice profile in lower case, else null."""
    from .lexicon import VOICE_PROFILES

    v = F.lower(F.trim(c))
    return F.when(v.isin(*VOICE_PROFILES), v)
