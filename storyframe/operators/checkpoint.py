"""Which results of an earlier run still hold.  Run configs: stage, component, fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unchanged(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(stage, same): whether the components and fingerprints of a stage are equal; a stage that isn't stored isn't."""
    s, c = stored.select("stage", "component", F.col("fingerprint").alias("old")), current.select("stage", "component", F.col("fingerprint").alias("new"))
    return s.join(c, ["stage", "component"], "full").groupBy("stage").agg(F.bool_and(F.col("old").eqNullSafe(F.col("new"))).alias("same"))


def reuse(stored: DataFrame, current: DataFrame, resume: bool = True, script_there: bool = True, audio_there: bool = True) -> DataFrame:
    """One row (script, audio): the script holds if unchanged; audio only with the script, unchanged and complete."""
    flags = unchanged(stored, current).agg(*[F.coalesce(F.bool_or((F.col("stage") == s) & F.col("same")), F.lit(False)).alias(s) for s in ("script", "audio")])
    script = F.col("script") & F.lit(resume and script_there)
    return flags.select(script.alias("script"), (script & F.col("audio") & F.lit(audio_there)).alias("audio"))


def resumable(stored: DataFrame, current: DataFrame, segments: DataFrame, there: DataFrame) -> DataFrame:
    """(run, script, audio, missing): what of each current run an earlier one left whole.

    stored, current: run, stage, component, fingerprint.  segments: run, path, the audio files that a run's manifest names;
    there: path, the files that exist.  A script holds if all its components are unchanged and ``<run>/script/panels.json``
    exists; audio holds only with its script, if its own components are unchanged, the manifest
    ``<run>/audio/segments.json`` exists and no segment's file is ``missing``.
    """
    keys = ["run", "stage", "component"]
    old, new = stored.select(*keys, F.col("fingerprint").alias("_old")), current.select(*keys, F.col("fingerprint").alias("_new"))
    same = old.join(new, keys, "full").groupBy("run").agg(*[F.coalesce(F.bool_and(F.when(F.col("stage") == s, F.col("_old").eqNullSafe(F.col("_new")))), F.lit(False)).alias(f"_{s}") for s in ("script", "audio")])
    # What a run consists of: its two checkpoints and its segments, each there or not.
    runs = current.select("run").distinct()
    wanted = segments.select("run", "path", F.lit("segment").alias("kind")).distinct()
    for kind, name in (("script", "/script/panels.json"), ("audio", "/audio/segments.json")):
        wanted = wanted.unionByName(runs.select("run", F.concat("run", F.lit(name)).alias("path"), F.lit(kind).alias("kind")))
    gone = wanted.join(there.select("path"), "path", "left_anti").groupBy("run").agg(
        *[F.count_if(F.col("kind") == k).alias(f"_no_{k}") for k in ("script", "audio")], F.count_if(F.col("kind") == "segment").alias("missing"))
    every = runs.join(same, "run").join(gone, "run", "left").na.fill(0)
    script = F.col("_script") & (F.col("_no_script") == 0)
    return every.select("run", script.alias("script"), (script & F.col("_audio") & (F.col("_no_audio") == 0) & (F.col("missing") == 0)).alias("audio"), "missing")


def from_json(files: DataFrame) -> DataFrame:
    """(run, stage, component, fingerprint) of (run, json); a config that can't be read holds nothing."""
    stages = files.select("run", F.explode(F.from_json("json", "map<string,map<string,string>>")).alias("stage", "parts"))
    return stages.select("run", "stage", F.explode("parts").alias("component", "fingerprint"))


def to_json(configs: DataFrame) -> DataFrame:
    """(run, json): stages and their components in order of name."""
    parts = configs.groupBy("run", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "fingerprint")))).alias("parts"))
    # Maps don't sort: a stage's name leads its struct, and names are unique within a run.
    stages = F.array_sort(F.collect_list(F.struct("stage", "parts")), lambda a, b: F.when(a["stage"] < b["stage"], -1).when(a["stage"] > b["stage"], 1).otherwise(0))
    return parts.groupBy("run").agg(F.to_json(F.map_from_entries(stages)).alias("json"))


def write_section(stored: DataFrame, section: DataFrame, stage: str) -> DataFrame:
    """The run config with one stage's section replaced; a new script drops the audio section."""
    gone = [stage, "audio"] if stage == "script" else [stage]
    return stored.where(~F.col("stage").isin(*gone)).unionByName(section)
