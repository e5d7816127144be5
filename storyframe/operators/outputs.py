"""What leaves the engine: excerpt documents, evaluation reports, registries, galleries, transcript files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.keys import timestamp_text as timestamp
from ..functions.prompts import percent
from ..sources.sinks import write_files


def excerpt_document(excerpts: DataFrame, by: str = "file", empty: str = "(none)") -> DataFrame:
    """(by, document): numbered headings with span, arc and score, and each excerpt's text; a file's excerpts are few.

    excerpts: by, start, end, arc (null: none), score, text (null for a file without excerpts).
    """
    rows = excerpts.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("start", "end")))
    span = F.concat(F.lit("["), timestamp(F.col("start")), F.lit(" - "), timestamp(F.col("end")), F.lit("]"))
    title = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), span, F.coalesce(F.concat(F.lit(" · "), F.col("arc")), F.lit("")), F.lit(" · score "), F.format_string("%.3f", F.col("score")))
    part = F.when(F.col("text").isNull(), F.lit(empty)).otherwise(F.concat(title, F.lit("\n\n"), F.col("text"), F.lit("\n")))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda x: x["part"]), "\n").alias("document"))


def name_table(per_name: DataFrame) -> DataFrame:
    """One row (table): the names of an evaluation in order, as lines of a Markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "truth", F.col("total").cast("string"), F.col("correct").cast("string"), F.col("unnamed").cast("string")), F.lit(" |"))
    rows = per_name.agg(F.array_sort(F.collect_list(F.struct("truth", line.alias("line")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("table"))


def sweep_lines(sweep: DataFrame) -> DataFrame:
    """(accept, line): accuracy, unnamed share and rejected extras of each threshold; a dash without extras."""
    share = [F.try_divide("correct", "known"), F.try_divide("unnamed", "known"), F.try_divide("rejected", "extras")]
    cells = [F.format_string("%.2f", F.col("accept")), percent(share[0]), percent(share[1]), percent(share[2], 0)]
    return sweep.select("accept", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def evaluation_text(volume: str, embedder: str, strategy: str, margin: float, totals: DataFrame, per_name: DataFrame, confusions: DataFrame, sweep: DataFrame) -> DataFrame:
    """One row (document): an evaluation's headline figures, its names, its confusions and its thresholds, as Markdown.

    totals, per_name, confusions, sweep: as ``gallery`` gives them; names and thresholds are few.
    """
    unnamed = F.coalesce(F.try_divide("unnamed", "known"), F.lit(0.0))
    # Wording: fixed values.
    head = totals.select(F.concat(
        F.lit(f"# Identidade de personagens — {volume} — {embedder}\n\nEstratégia `{strategy}`, margem {margin:.2f}, leave-one-out sobre "), F.col("known").cast("string"), F.lit(" recortes nomeados + "), F.col("extras").cast("string"),
        F.lit(" figurantes.\n\n**Acurácia de nomeação: "), percent(F.col("accuracy")), F.lit("** · desconhecido: "), percent(unnamed),
        F.when(F.col("extras_rejected").isNull(), "").otherwise(F.concat(F.lit(" · figurantes rejeitados: "), percent(F.col("extras_rejected")))), F.lit("\n\n| Personagem | recortes | acertos | desconhecido |\n|---|---|---|---|\n")).alias("head"))
    names = name_table(per_name).select(F.when(F.col("table") == "", "").otherwise(F.concat("table", F.lit("\n"))).alias("names"))
    pair = F.concat("truth", F.lit(" -> "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    mixed = confusions.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "truth", "name", pair.alias("pair")))).alias("c"))
    mixed = mixed.select(F.when(F.size("c") > 0, F.concat(F.lit("\nConfusões: "), F.array_join(F.transform("c", lambda x: x["pair"]), ", "), F.lit("\n"))).otherwise("").alias("mixed"))
    steps = sweep_lines(sweep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("accept", "line"))), lambda x: x["line"]), "\n").alias("steps"))
    title = "\n| aceite | acurácia | desconhecido | figurantes rejeitados |\n|---|---|---|---|\n"
    rows = [head.select(F.lit(0).alias("k"), F.col("head").alias("t")), names.select(F.lit(1), "names"), mixed.select(F.lit(2), "mixed"), steps.select(F.lit(3), F.concat(F.lit(title), "steps", F.lit("\n")))]
    both = rows[0]
    for r in rows[1:]:
        both = both.union(r)
    return both.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("document"))


@pandas_udf(StringType())
def _registry_json(voices: pd.Series) -> pd.Series:
    return voices.map(lambda v: None if v is None else json.dumps({x["speaker_id"]: x["voice"] for x in v}, sort_keys=True))


def registry(assigned: DataFrame) -> DataFrame:
    """(volume, json, digest): a volume's voices sorted by speaker, and the first 8 hex digits of their SHA-1."""
    rows = assigned.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("speaker_id", "voice"))).alias("v"))
    return rows.select("volume", _registry_json("v").alias("json")).withColumn("digest", F.substring(F.sha1("json"), 1, 8))


def registry_rows(files: DataFrame) -> DataFrame:
    """(volume, speaker_id, voice) of (volume, json); a file that can't be read starts afresh."""
    return files.select("volume", F.explode(F.from_json("json", "map<string,string>")).alias("speaker_id", "voice"))


def gallery_json(exemplars: DataFrame, by: list[str], accept: float = 0.80, margin: float = 0.05, strategy: str = "mixed") -> DataFrame:
    """(by, json): a gallery with its gate; exemplars: by, ord, name, v."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "v"))), lambda x: F.struct(x["name"].alias("name"), x["v"].alias("embedding")))
    return exemplars.groupBy(*by).agg(F.to_json(F.struct(F.lit(accept).alias("accept"), F.lit(margin).alias("margin"), F.lit(strategy).alias("strategy"), items.alias("exemplars"))).alias("json"))


def gallery_rows(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, accept, margin, strategy, ord, name, v) of (by, json); what is missing has its default."""
    g = F.from_json("json", "accept double, margin double, strategy string, exemplars array<struct<name:string,embedding:array<float>>>")
    rows = files.select(*by, g.alias("g")).select(*by, F.coalesce("g.accept", F.lit(0.80)).alias("accept"), F.coalesce("g.margin", F.lit(0.05)).alias("margin"), F.coalesce("g.strategy", F.lit("mixed")).alias("strategy"), F.posexplode("g.exemplars").alias("ord", "e"))
    return rows.select(*by, "accept", "margin", "strategy", "ord", "e.name", F.col("e.embedding").alias("v"))


def with_pages(detections: DataFrame, files: DataFrame) -> DataFrame:
    """Detections with the path of their page's image; pages without one are skipped.  files: stem, path."""
    return detections.join(files.select(F.col("stem").alias("page"), "path"), "page")


def moved(path, exists, folder: str):
    """A crop's path; where it is gone, the same file name in ``folder``: the workspace was moved."""
    return F.when(exists, path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, r"([^/]+)$", 1)))


def write_transcript(folder: str, segments: DataFrame, pacing: DataFrame, documents: DataFrame) -> None:
    """Four files for each transcript, in a folder of its name: segments, plain text, pacing and excerpts.

    All files of all transcripts appear together (``sinks``); a file is its lines in order, never one value.
    """
    place = F.row_number().over(Window.partitionBy("file").orderBy("start", "end", "text"))
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    numbered = segments.withColumn("part", place)

    def rows(df: DataFrame, name: str, part, text) -> DataFrame:
        return df.select(F.concat(F.col("file").cast("string"), F.lit(f"/{name}")).alias("path"), part.alias("part"), text.cast("binary").alias("content"))

    def json_line(df: DataFrame):
        return F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "part"])), F.lit("\n"))

    one = F.lit(0)
    both = rows(numbered, "segments.json", F.col("part"), json_line(numbered)).unionByName(rows(numbered, "transcript.md", F.col("part"), line))
    both = both.unionByName(rows(pacing, "pacing.json", one, json_line(pacing))).unionByName(rows(documents, "excerpts.md", one, F.col("document")))
    write_files(both, folder)
