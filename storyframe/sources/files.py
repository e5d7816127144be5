"""Scans and sinks: scripts, pages, arc lists, dictionaries, registries and label stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import timestamp_seconds
from .sinks import write_files


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """Blocks in order (volume, page, panel, pos, ...) of a JSON list of panels."""
    panels = spark.read.schema(S.PANEL).json(path, multiLine=True)
    flat = panels.select("volume", "page_number", "panel_index", F.posexplode("blocks").alias("at", "b")).select("volume", F.col("page_number").alias("page"), F.col("panel_index").alias("panel"), "at", "b.*")
    order = Window.partitionBy("volume").orderBy("page", "panel", "at")
    return flat.withColumn("pos", F.row_number().over(order) - 1).drop("at")


def write_script(panels: DataFrame, path: str) -> None:
    """A JSON list of panels for each volume, in reading order; all volumes appear together (``sinks``)."""
    w = Window.partitionBy("volume").orderBy("page_number", "panel_index")
    rows = panels.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("volume")))
    head, tail = F.when(F.col("_n") == 1, "[").otherwise(","), F.when(F.col("_n") == F.col("_all"), "]").otherwise("\n")
    content = F.concat(head, F.to_json(F.struct(*panels.columns)), tail)
    write_files(rows.select(F.concat("volume", F.lit(".json")).alias("path"), F.col("_n").alias("part"), content.cast("binary").alias("content")), path)


def page_range(pages: DataFrame, first: int = 1, most: int | None = None, number: str = "page_id") -> DataFrame:
    """Pages from ``first``, at most ``most`` of them; the filter reaches the scan."""
    if first < 1 or (most is not None and most < 1):
        raise ValueError("page numbers start at 1")
    return pages.where(F.col(number) >= first) if most is None else pages.where(F.col(number).between(first, first + most - 1))


def page_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".webp")) -> DataFrame:
    """(stem, path, content): one file for each page stem, the first suffix that is there; only chosen files are read."""
    files = spark.read.format("binaryFile").load(folder)
    chosen = preferred(files.select("path").withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)), suffixes)
    return chosen.join(files.select("path", "content"), "path").select("stem", "path", "content")


def preferred(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    rank = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(suffixes))):
        rank = F.when(F.lower("path").endswith(s), k).otherwise(rank)
    w = Window.partitionBy("stem").orderBy("rank", "path")
    return files.withColumn("rank", rank).where(F.col("rank").isNotNull()).withColumn("r", F.row_number().over(w)).where("r = 1").drop("rank", "r")


def stem(path: Column, suffixes: tuple[str, ...]) -> Column:
    """A file's name without its suffix, for files of the wanted suffixes; null for others.  A query or fragment is cut off."""
    ends = "|".join(x.replace(".", r"\.") for x in suffixes)
    return F.nullif(F.regexp_extract(path, rf"([^/?#]+)(?:{ends})", 1), F.lit(""))


def arcs(lines: DataFrame, column: str = "value", by: list[str] = ()) -> DataFrame:
    """(by, start_s, title) of lines like ``HH:MM:SS - title``, in order; other lines are left out."""
    form = r"^\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*[-–—]?\s*(\S.*?)\s*$"
    rows = lines.select(*by, timestamp_seconds(F.regexp_extract(column, form, 1)).alias("start_s"), F.regexp_extract(column, form, 2).alias("title"))
    return rows.where("start_s is not null and title <> ''").orderBy(*by, "start_s", "title")


def dictionary(text: Column) -> Column:
    """An effect dictionary's map; empty where the text is broken."""
    return F.coalesce(F.from_json(text, S.SFX_DICTIONARY, {"mode": "PERMISSIVE"}), F.create_map().cast(S.SFX_DICTIONARY))


def effect_tags(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Tags: file stems that aren't a variant's file, and the dictionary's tags.  files: file; entries: tag, file."""
    stems = files.join(entries.select("file"), "file", "left_anti").select(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("tag"))
    return stems.union(entries.select("tag")).distinct().orderBy("tag")


def register_effects(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (tag, ord, file) with new ones (tag, ord, suffix) appended as tag, tag_2, tag_3, ..."""
    had = entries.groupBy("tag").agg(F.max("ord").alias("had"))
    n = F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("tag").orderBy("ord"))
    rows = new.join(had, "tag", "left").withColumn("n", n)
    name = F.concat("tag", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), "suffix")
    return entries.select("tag", "ord", "file").unionByName(rows.select("tag", F.col("n").alias("ord"), name.alias("file")))


def promote(files: DataFrame) -> DataFrame:
    """The best file of each tag: keyword rank, WAV before others, the largest, then by path.  files: tag, rank, path, size."""
    w = Window.partitionBy("tag").orderBy("rank", ~F.lower("path").endswith(".wav"), F.desc("size"), "path")
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _store(spark: SparkSession, path: str):
    """The file system of a store, its path and the one it is put aside to."""
    jvm = spark.sparkContext._jvm
    at, aside = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".old"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, aside


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A label store; where a replacement was cut off between its two renames, the store as it was before."""
    fs, at, aside = _store(spark, path)
    return spark.read.parquet(path if fs.exists(at) or not fs.exists(aside) else path.rstrip("/") + ".old")


def replace_store(rows: DataFrame, path: str, staging: str) -> None:
    """Write a label store beside the old one, then put it in its place.

    The old store is renamed aside, and deleted only when the new one is there.  A crash between the renames leaves the
    old one aside, where ``read_store`` finds it; the next replacement first puts it back.
    """
    rows.write.mode("overwrite").parquet(staging)
    spark = rows.sparkSession
    fs, at, aside = _store(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    if not fs.exists(at) and fs.exists(aside):
        fs.rename(aside, at)
    if fs.exists(at):
        fs.delete(aside, True)
        if not fs.rename(at, aside):
            raise OSError(f"{path} couldn't be renamed aside")
    if not fs.rename(new, at):
        fs.rename(aside, at)
        raise OSError(f"{staging} couldn't be renamed to {path}")
    fs.delete(aside, True)


def detections_json(detections: DataFrame) -> DataFrame:
    """(page, json) with confidences of four places."""
    item = F.struct("label", F.round("confidence", 4).alias("confidence"), F.array("box.x0", "box.y0", "box.x1", "box.y1").alias("box"))
    return detections.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", item.alias("d")))), lambda x: x["d"])).alias("json"))


def detections_from_json(rows: DataFrame) -> DataFrame:
    items = F.from_json("json", "array<struct<label:string,confidence:double,box:array<int>>>")
    b = F.col("d.box")
    return rows.select("page", F.posexplode(items).alias("idx", "d")).select("page", "idx", "d.label", "d.confidence", F.struct(*[F.get(b, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("box"))
