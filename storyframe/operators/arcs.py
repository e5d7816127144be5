"""Arcs on a timeline: as-of lookup, bounds, lookup by title, headings, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, folded


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, value: str, tie: str | None = None) -> DataFrame:
    """``points`` with ``value`` of the mark that started last at or before ``at``, within ``by``; null before the first.

    One sort of the union: marks sort before points of the same time, and the last mark is carried forward.
    """
    keep = points.columns
    p = points.withColumn("_at", F.col(at).cast("double")).withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(dict(marks.dtypes)[value])).withColumn("_tie", F.lit(None).cast("string"))
    m = marks.select(*by, F.col(mark_at).cast("double").alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), (F.col(tie) if tie else F.lit(None)).cast("string").alias("_tie"))
    both = p.unionByName(m, allowMissingColumns=True)
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = order.orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_side = 1").select(*keep, value)


def bounds(arcs: DataFrame, by: list[str], total: Column | None = None) -> DataFrame:
    """start_s and end_s of each arc: the next arc's start, else the total (null: open)."""
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("start_s", "title")
    return arcs.withColumn("end_s", F.coalesce(F.lead("start_s").over(order), total if total is not None else F.lit(None).cast("double")))


def shifted(arcs: DataFrame, offset: float) -> DataFrame:
    """Arcs on a slice of the recording that begins at ``offset`` seconds."""
    return arcs.withColumn("start_s", F.col("start_s") - offset)


def find(arcs: DataFrame, title: str) -> DataFrame:
    """The arc whose title contains ``title`` without regard to case and accents; exact before earliest.

    Keys of Latin script are compared as they are, others by a collation without case and accents.
    """
    wanted = folded(title)
    key = F.collate(F.col("_t"), "UNICODE_CI_AI")
    rows = arcs.withColumn("_t", fold("title")).where(F.contains(key, F.collate(F.lit(wanted), "UNICODE_CI_AI")) & F.lit(wanted != ""))
    return rows.orderBy(F.desc(key == F.collate(F.lit(wanted), "UNICODE_CI_AI")), "start_s").limit(1).drop("_t")


def headings(segments: DataFrame, by: list[str], order: list[str], arc: str = "title") -> DataFrame:
    """heading: the arc's title where it changes."""
    w = Window.partitionBy(*by).orderBy(*order)
    return segments.withColumn("heading", F.when(F.col(arc).isNotNull() & ~F.col(arc).eqNullSafe(F.lag(arc).over(w)), F.col(arc)))


def clip(start: Column, end: Column, limit: float | None) -> tuple[Column, Column, Column]:
    """(start, end, valid) of an arc cut to ``limit`` seconds."""
    to = F.least(end, start + limit) if limit is not None else end
    return start, to, to.isNull() | (to > start)
