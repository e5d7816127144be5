"""Texts made of rows: prompts, hints, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import VOICE_PROFILES


def bubble_list(texts: Column) -> Column:
    """Texts in order as a JSON list."""
    return F.to_json(texts)


def style_excerpt(text: Column, most: int = 6000) -> Column:
    """A style example without outer white space: ``most`` characters, cut at their last line end and marked as cut."""
    whole = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    cut = F.regexp_replace(F.substring(whole, 1, most), r"\n[^\n]*\z", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit("\n[...]")))


def prompt(instructions: Column, texts: Column, style: Column | None = None) -> Column:
    parts = [instructions, F.concat(F.lit("Bubbles: "), bubble_list(texts))]
    return F.concat_ws("\n\n", *parts, *([F.concat(F.lit("Style:\n"), style)] if style is not None else []))


def answer_schema(tags: Column, voices: tuple[str, ...] = VOICE_PROFILES) -> Column:
    """JSON Schema of an answer, a list of blocks; the effect of a block is one of ``tags``, without tags it has none."""
    def kind(name: str, choice: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("type"), *([choice.alias("enum")] if choice is not None else []))

    # Null fields are left out of the JSON text.
    effect = F.when(F.size(tags) > 0, kind("string", tags))
    fields = F.struct(
        kind("string").alias("text"), kind("string").alias("speaker_id"), kind("boolean").alias("is_speech"), effect.alias("sfx"),
        kind("string", F.array(*[F.lit(v) for v in voices])).alias("voice"))
    needed = F.array(*[F.lit(n) for n in ("text", "speaker_id", "is_speech")])
    block = F.struct(F.lit("object").alias("type"), fields.alias("properties"), needed.alias("required"), F.lit(False).alias("additionalProperties"))
    return F.struct(F.lit("array").alias("type"), block.alias("items"))


def request(model: Column, system: Column, text: Column, schema: Column | None = None, images: Column | None = None, most: int = 2048) -> Column:
    """The JSON body of a chat request: instructions, the user's images (data urls) and text, and the answer's schema."""
    said = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
    shown = F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url"))) if images is not None else None
    parts = F.array(said) if shown is None else F.concat(shown, F.array(said))
    messages = F.struct(F.struct(F.lit("system").alias("role"), system.alias("content")).alias("a"), F.struct(F.lit("user").alias("role"), parts.alias("content")).alias("b"))
    # The contents differ in kind, so the two messages are joined as texts.
    both = F.concat(F.lit("["), F.to_json(messages["a"]), F.lit(","), F.to_json(messages["b"]), F.lit("]"))
    form = F.lit("") if schema is None else F.concat(F.lit(',"response_format":'), F.to_json(F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit("blocks").alias("name"), schema.alias("schema")).alias("json_schema"))))
    return F.concat(F.lit('{"model":'), F.to_json(F.array(model)).substr(F.lit(2), F.length(F.to_json(F.array(model))) - 2), F.lit(f',"max_tokens":{most},"messages":'), both, form, F.lit("}"))


def hint_line(position: Column, name: Column, score: Column) -> Column:
    """``[i] name (0.87)``, or unknown."""
    return F.concat(F.lit("["), position.cast("string"), F.lit("] "), F.coalesce(F.concat(name, F.lit(" ("), F.format_string("%.2f", score), F.lit(")")), F.lit("unknown")))


def hints(position: Column, name: Column, score: Column) -> Column:
    """An aggregate: the hint lines of a group in order of position."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), hint_line(position, name, score).alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def counts_line(tag: Column, n: Column) -> Column:
    """An aggregate: ``tag×n`` of a group, most frequent first."""
    rows = F.array_sort(F.collect_list(F.struct((-n).alias("k"), tag.alias("tag"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(r["tag"], F.lit("×"), (-r["k"]).cast("string"))), ", ")


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage; a dash for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", c * 100)).otherwise("—")
