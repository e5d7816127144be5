"""The driver tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(rows: DataFrame) -> DataFrame:
    """Rows of files with ``place``, a long in the order of the files' names and of the rows in them."""
    numbered = Window.orderBy("_path")
    files = rows.select(F.col("_metadata.file_path").alias("_path")).distinct().withColumn("_file", F.row_number().over(numbered).cast("long"))
    place = F.shiftleft(F.col("_file"), 40) + F.col("_row")
    found = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return found.join(F.broadcast(files), "_path").withColumn("place", place).drop("_path", "_file", "_row")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as script blocks: role is the speaker, system the narrator; two turns to a panel."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("volume"), F.col("turn").cast("int").alias("pos"), F.floor(F.col("turn") / 2).cast("int").alias("panel"), "text",
        F.when(role == "system", "Narrator").otherwise(role).alias("speaker_id"), (role != "system").alias("is_speech"), F.lit(None).cast("string").alias("sfx"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcript segments: user is the file, value the duration in seconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_id", start.alias("start"), (start + F.col("value")).alias("end"), F.col("event_type").alias("text"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as arc marks of their user."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("file"), start.alias("start_s"), F.col("event_id").alias("title"))


def boxes(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Integer boxes on pages of 1000 x 1400 derived from lineitem (extension data); with ``place``, where their row stands."""
    rows = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") * 37) % 900, (F.col("l_suppkey") * 53) % 1300
    return (placed(rows) if place else rows).select(
        F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", "l_suppkey", x0.alias("x0"), y0.alias("y0"),
        (x0 + 20 + F.col("l_quantity").cast("int")).alias("x1"), (y0 + 20 + F.col("l_partkey") % 60).alias("y1"), "l_returnflag", *["place"] * place,
    )
