"""Pacing of transcripts.  Segments: file, start, end (seconds), words; ordered by start, then end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_pauses(segments: DataFrame, *ties: str) -> DataFrame:
    """duration and pause until the next segment (from this end; overlaps are 0; null for the last)."""
    order = Window.partitionBy("file").orderBy("start", "end", *ties)
    rows = segments.withColumn("duration", F.greatest(F.col("end") - F.col("start"), F.lit(0.0)))
    return rows.withColumn("pause", F.greatest(F.lead("start").over(order) - F.col("end"), F.lit(0.0))).withColumn("pause", F.when(F.lead("start").over(order).isNotNull(), F.col("pause")))


def statistics(segments: DataFrame, long_pause: float = 2.5, *ties: str) -> DataFrame:
    """One row per file: counts, durations, words per minute, percentiles and pauses, three places; zeros where empty."""
    rows = with_pauses(segments, *ties)

    def three(c):
        return F.round(F.coalesce(c, F.lit(0.0)), 3)

    last = F.max_by("end", F.struct("start", "end"))
    total = last - F.min("start")
    g = rows.groupBy("file").agg(
        F.count("*").alias("segments"), F.sum("words").alias("words"), F.sum("duration").alias("speech"), total.alias("total"),
        *[F.percentile("duration", F.lit(p / 100)).alias(f"d{p}") for p in (10, 50, 90)],
        F.count("pause").alias("pauses"), F.avg("pause").alias("pm"), F.percentile("pause", F.lit(0.5)).alias("p50"), F.percentile("pause", F.lit(0.9)).alias("p90"),
        F.count_if(F.col("pause") >= long_pause).alias("long_pauses"),
    )
    return g.select(
        "file", "segments", "words", three(F.col("total")).alias("total_s"), three(F.col("speech")).alias("speech_s"),
        three(F.when(F.col("total") > 0, F.col("speech") / F.col("total"))).alias("speech_ratio"),
        three(F.when(F.col("speech") > 0, F.col("words") * 60.0 / F.col("speech"))).alias("wpm_speech"),
        three(F.when(F.col("total") > 0, F.col("words") * 60.0 / F.col("total"))).alias("wpm_total"),
        *[three(F.col(f"d{p}")).alias(f"duration_p{p}") for p in (10, 50, 90)],
        "pauses", three(F.col("pm")).alias("pause_mean"), three(F.col("p50")).alias("pause_median"), three(F.col("p90")).alias("pause_p90"), "long_pauses",
    )


def long_pauses(segments: DataFrame, least: float, most: int = 50, *ties: str) -> DataFrame:
    """The longest pauses of each file, at most ``most``, ties in order of time."""
    rows = with_pauses(segments, *ties).where(F.col("pause") >= least)
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("pause"), "start", "end", *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("file", "rank", F.col("end").alias("at_s"), F.col("pause").alias("gap_s"))


def shifted(segments: DataFrame, offset: float) -> DataFrame:
    """Segment and word times moved by a clip's offset, three places, text trimmed."""
    def move(c):
        return F.round(c + offset, 3)

    words = F.transform("words", lambda w: F.struct(move(w["start"]).alias("start"), move(w["end"]).alias("end"), F.trim(w["word"]).alias("word"), w["probability"].alias("probability")))
    return segments.withColumns({"start": move(F.col("start")), "end": move(F.col("end")), "text": F.trim("text"), "words": words}).where("text <> ''")
