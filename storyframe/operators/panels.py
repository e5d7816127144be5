"""Panels of pages by their gutters, on masks as relations; rules for a page's scan strips and its fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import options
from ..sources.shared import cut
from . import layout, masks

# Shares of the page. A panel's least area and sides, ink of a hole that isn't a speck, ink to be covered.
LEAST_AREA, LEAST_SIDE, SPECK, COVERAGE = 0.02, 0.04, 0.0005, 0.7
_SIDES = ["x0", "y0", "x1", "y1"]


def gutter_panels(paper: DataFrame, ink: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, panel, x0, y0, x1, y1): what the paper that reaches a page's edge leaves over, panels numbered from 0.

    Holes large enough are panels, united where they overlap much; inked smaller ones join the panel nearest by then, in
    the order of their first pixels.  A page whose paper doesn't reach its edge, or whose panels miss too much of its ink,
    gives none.  paper, ink: masks (``masks.runs``); pages: page, width, height.
    """
    outer = cut(masks.margin(masks.labelled(paper), pages), "margin")
    open_pages = pages.join(outer.select("page").distinct(), "page", "left_semi")
    holes = masks.boxed(masks.labelled(masks.complement(outer, open_pages))).join(open_pages, "page")
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    whole = F.col("width") * F.col("height")
    large = (wide * high >= LEAST_AREA * whole) & (wide >= LEAST_SIDE * F.col("width")) & (high >= LEAST_SIDE * F.col("height"))
    holes = cut(holes.select("page", "area", *[F.col(c).cast("long").alias(c) for c in _SIDES], large.alias("large"), (SPECK * whole).alias("speck")), "holes")

    first = holes.where("large").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("area", *_SIDES))).alias("_b"))
    united = masks.merged(F.transform("_b", lambda p: F.struct(*[p[c].alias(c) for c in _SIDES])))
    panels = first.select("page", F.posexplode(united).alias("panel", "_p")).select("page", "panel", *[F.col("_p." + c).alias(c) for c in _SIDES])
    rest = holes.join(panels.select("page", *_SIDES), ["page", *_SIDES], "left_anti").select("page", "area", "speck", *_SIDES)
    inked = masks.held(rest, ink, "inked").where("inked >= speck")
    grown = layout.absorb(
        inked.select("page", F.col("area").alias("hole"), *[F.col(c).alias("b_" + c) for c in _SIDES]),
        panels.select("page", "panel", *[F.col(c).alias("p_" + c) for c in _SIDES]), ["page"])
    grown = cut(grown, "panels")

    rows = grown.select("page", F.explode(F.sequence(F.col("y0").cast("int"), (F.col("y1") - 1).cast("int"))).alias("row"), F.col("x0").cast("int").alias("start"), F.col("x1").cast("int").alias("end"))
    size = F.sum(F.col("end") - F.col("start"))
    seen = masks.common(ink, masks.runs(rows)).groupBy("page").agg(size.alias("seen"))
    missed = ink.groupBy("page").agg(size.alias("all")).join(seen, "page", "left").where(F.coalesce("seen", F.lit(0)) < COVERAGE * F.col("all"))
    return grown.join(missed.select("page"), "page", "left_anti")


def bubbles(bright: DataFrame, dark: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, x0, y0, x1, y1, contour2, hull2, dark): bubbles of panels, by the contours of their opened bright masks."""
    found = masks.held(masks.contours(cut(masks.opened(bright, pages), "opened"), pages), dark, "dark").join(pages, "page")
    inner = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    kept = options.is_bubble(F.col("contour2") / 2, F.col("hull2") / 2, F.col("dark") / inner, F.col("width") * F.col("height"))
    return found.where(kept).select("page", *_SIDES, "contour2", "hull2", "dark")
