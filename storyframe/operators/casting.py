"""Voice casting: majority profiles, curated voices and banks, and the registry as a fold over sorted speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import stable_index


def majority_profile(votes: DataFrame) -> DataFrame:
    """(volume, speaker_id, profile): the most frequent non-null vote, ties to the first seen; null without votes.

    votes: volume, speaker_id, pos, voice.
    """
    counts = votes.groupBy("volume", "speaker_id", "voice").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = F.max_by("voice", F.when(F.col("voice").isNotNull(), F.struct("n", (-F.col("first")).alias("early"))))
    return counts.groupBy("volume", "speaker_id").agg(best.alias("profile"))


def profiles_across_versions(*versions: DataFrame) -> DataFrame:
    """Majority profile over script versions in order (reviewed first); narration has no vote."""
    rows = [v.where("is_speech").select("volume", "speaker_id", F.struct(F.lit(k).alias("version"), "pos").alias("at"), "voice") for k, v in enumerate(versions)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    order = Window.partitionBy("volume", "speaker_id").orderBy("at")
    return majority_profile(both.withColumn("pos", F.row_number().over(order)))


def pick(speaker: Column, pool: Column) -> Column:
    """A voice of the pool for a speaker by itself, with none in use."""
    return F.get(pool, stable_index(speaker, F.size(pool)).cast("int"))


def cast_voices(profiles: DataFrame, cast: dict[str, str], bank: dict[str, list[str]], fallback: list[str], kept: DataFrame | None = None) -> DataFrame:
    """(volume, speaker_id, voice).  Kept assignments win, then curated voices, then the profile's bank or the fallback.

    New speakers are taken in sorted order; each takes the first voice nobody in the volume has, from its stable index
    on; if all are in use, the one at the index.  Later picks depend on earlier ones: a fold over one volume's cast, in
    expressions.
    """
    if not fallback:
        raise ValueError("the fallback needs a voice")

    def literal(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    pools = F.create_map(*[x for k, v in bank.items() if v for x in (F.lit(k), literal(v))]).cast("map<string,array<string>>")
    curated = F.create_map(*[F.lit(x) for item in cast.items() for x in item]).cast("map<string,string>")
    rows = profiles.select("volume", "speaker_id", "profile")
    given = F.lit(None).cast("string").alias("voice")
    rows = rows.withColumn("voice", given) if kept is None else rows.join(kept.select("volume", "speaker_id", "voice").where("voice is not null"), ["volume", "speaker_id"], "full")
    # A volume's cast: kept assignments first, then new speakers in order.
    one = F.struct("speaker_id", "voice", "profile")
    casts = rows.groupBy("volume").agg(F.array_sort(F.collect_list(F.when(F.col("voice").isNotNull(), one))).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("voice").isNull(), one))).alias("new"))

    def take(given: Column, new: Column) -> Column:
        pool = F.coalesce(F.try_element_at(pools, F.coalesce(new["profile"], F.lit(""))), literal(fallback))
        at = stable_index(new["speaker_id"], F.size(pool)).cast("int")
        turn = F.concat(F.slice(pool, at + 1, F.size(pool)), F.slice(pool, F.lit(1), at))
        free = F.filter(turn, lambda v: ~F.exists(given, lambda g: g["voice"] == v))
        voice = F.coalesce(F.try_element_at(curated, new["speaker_id"]), F.get(free, F.lit(0)), F.get(turn, F.lit(0)))
        return F.concat(given, F.array(F.struct(new["speaker_id"].alias("speaker_id"), voice.alias("voice"))))

    known = F.transform("kept", lambda k: F.struct(k["speaker_id"].alias("speaker_id"), k["voice"].alias("voice")))
    return casts.select("volume", F.explode(F.aggregate("new", known, take)).alias("x")).select("volume", "x.speaker_id", "x.voice")
