"""From blocks in reading order to the narration plan.  Blocks: volume, pos, panel, text, speaker_id, is_speech, sfx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import reviewed

NARRATOR = "Narrator"


def with_announcements(blocks: DataFrame, narrator: str = NARRATOR) -> DataFrame:
    """Adds previous (the last speaking character before) and announce: whether the speaker is named first.

    Narration in between doesn't reset the memory, and it crosses panels.
    """
    before = Window.partitionBy("volume").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    speaks = F.col("is_speech") & (F.col("speaker_id") != narrator)
    rows = blocks.withColumn("previous", F.last(F.when(speaks, F.col("speaker_id")), ignorenulls=True).over(before))
    return rows.withColumn("announce", speaks & ~F.col("speaker_id").eqNullSafe(F.col("previous")))


def plan(blocks: DataFrame, effects: bool = True, announcements: bool = True) -> DataFrame:
    """One row per item: volume, pos, sub, kind (sfx, announcement, speech), speaker_id, text, sfx_tag, seed, block_index."""

    def item(kind: str, speaker: Column, text: Column, tag: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), speaker.alias("speaker_id"), text.alias("text"), tag.alias("sfx_tag"), F.col("text").alias("seed"))

    none = F.lit(None).cast("string")
    items = F.array(
        F.when(F.col("sfx").isNotNull() & F.lit(effects), item("sfx", F.lit("SFX"), none, F.col("sfx"))),
        F.when(F.col("announce") & F.lit(announcements), item("announcement", F.lit(NARRATOR), F.col("speaker_id"), none)),
        item("speech", F.col("speaker_id"), F.col("text"), none),
    )
    rows = with_announcements(blocks).select("volume", "pos", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("sub", "i")).select("volume", "pos", "sub", "i.*")
    return rows.withColumn("block_index", F.row_number().over(Window.partitionBy("volume").orderBy("pos", "sub")) - 1)


def capped_tags(blocks: DataFrame, tag: Column, intensity: int) -> DataFrame:
    """sfx filled from ``tag`` in order, until a panel has ``intensity`` effects, chosen ones included; speech only at 3."""
    return capped_by(blocks, tag, F.lit(intensity))


def capped_by(blocks: DataFrame, tag: Column, intensity: Column, *by: str) -> DataFrame:
    """``capped_tags`` for an intensity of each row, equal within ``by`` (further columns of a panel's key)."""
    cap = F.greatest(F.lit(0), F.least(intensity, F.lit(3)))
    panel = Window.partitionBy("volume", "panel", *by)
    eligible = F.col("sfx").isNull() & tag.isNotNull() & (cap > 0) & (~F.col("is_speech") | (cap >= 3))
    rows = blocks.withColumn("may", eligible).withColumn("rank", F.sum(F.col("may").cast("int")).over(panel.orderBy("pos")))
    room = cap - F.count("sfx").over(panel)
    return rows.withColumn("sfx", F.when(F.col("may") & (F.col("rank") <= room), tag).otherwise(F.col("sfx"))).drop("may", "rank")


def timeline(segments: DataFrame, gap_ms: int = 0) -> DataFrame:
    """offset_ms of each segment: durations and gaps before it.  segments: volume, block_index, duration_ms."""
    before = Window.partitionBy("volume").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset_ms", F.coalesce(F.sum(F.col("duration_ms") + gap_ms).over(before), F.lit(0)).cast("bigint"))


def review_patch(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """Panels with their reviewed blocks; a missing or empty review keeps the original.  Both: volume, panel, blocks."""
    new = patches.select("volume", "panel", F.col("blocks").alias("new"))
    return blocks.join(new, ["volume", "panel"], "left").withColumn("changed", F.coalesce(F.size("new") > 0, F.lit(False)) & ~F.col("new").eqNullSafe(F.col("blocks"))).withColumn("blocks", F.when(F.size("new") > 0, F.col("new")).otherwise(F.col("blocks"))).drop("new")


def review_chunks(panels: DataFrame, size: int = 40) -> DataFrame:
    """chunk number of each panel, and labels_seen: distinct speakers of the chunks before.  panels: volume, panel, speakers."""
    rows = panels.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("volume").orderBy("panel")) - 1) / size).cast("bigint"))
    own = rows.groupBy("volume", "chunk").agg(F.flatten(F.collect_set("speakers")).alias("s"))
    before = Window.partitionBy("volume").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    seen = own.select("volume", "chunk", F.array_sort(F.array_distinct(F.flatten(F.coalesce(F.collect_list("s").over(before), F.array())))).alias("labels_seen"))
    return rows.join(seen, ["volume", "chunk"])


REVIEW = "panels array<struct<panel: long not null, blocks: array<string> not null>> not null"


def review(panels: DataFrame, answers: DataFrame) -> DataFrame:
    """Panels after a reviewer's answers: (volume, panel, chunk, labels_seen, blocks, changed, answered).

    panels: as of ``review_chunks``, with blocks; answers: (volume, chunk, raw).  An answer is a text that holds an object
    of ``REVIEW``; one that breaks it anywhere is no answer, so its whole chunk stays.  Of a panel that an answer names
    twice the last counts; panels of other chunks are left alone.
    """
    read = answers.select("volume", "chunk", reviewed(F.col("raw"), REVIEW).alias("r")).where("r is not null")
    rows = read.select("volume", "chunk", F.posexplode("r.panels").alias("at", "p")).select("volume", "chunk", F.col("p.panel").alias("panel"), "at", "p.blocks")
    last = rows.groupBy("volume", "chunk", "panel").agg(F.max_by("blocks", "at").alias("blocks"))
    own = last.join(panels.select("volume", "chunk", "panel"), ["volume", "chunk", "panel"], "left_semi")
    merged = review_patch(panels, own)
    return merged.join(read.select("volume", "chunk", F.lit(True).alias("answered")).distinct(), ["volume", "chunk"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def summary(blocks: DataFrame) -> DataFrame:
    """Blocks and effects of each speaker, most frequent first, then first seen."""
    rows = blocks.groupBy("speaker_id").agg(F.count("*").alias("blocks"), F.count("sfx").alias("effects"), F.min(F.struct("volume", "pos")).alias("first"))
    return rows.orderBy(F.desc("blocks"), "first").select("speaker_id", "blocks", "effects")


def script_line(icon: Column) -> Column:
    """A block as a line of Markdown: icon, speaker in bold, text, effect tag."""
    tag = F.when(F.col("sfx").isNotNull(), F.concat(F.lit(" *["), F.col("sfx"), F.lit("]*"))).otherwise("")
    return F.concat(icon, F.lit(" **"), F.col("speaker_id"), F.lit(":** "), F.col("text"), tag)
