"""Black-and-white pages as relations: runs of pixels, their connected areas, outer contours and hulls.

A mask is its runs (page, row, start, end): pixels start to end - 1 of a row, no two of a row touching.  ``pages`` has
page, width and height.  Every step is a join or a window within a row or between neighbouring rows; areas are labelled
by stars of a graph of runs, so no page is ever an image in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import cut

KEY = ["page", "row", "start", "end"]


def runs(spans: DataFrame) -> DataFrame:
    """Spans of pixels (page, row, start, end), in any number and order, as runs."""
    w = Window.partitionBy("page", "row").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1)).over(w)
    grouped = spans.where("start < end").withColumn("_reach", reach).withColumn("_island", island).groupBy("page", "row", "_island")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*KEY)


def complement(mask: DataFrame, pages: DataFrame) -> DataFrame:
    """The runs that aren't in the mask."""
    stops = pages.select("page", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), F.col("width").alias("start"), F.col("width").alias("end"))
    w = Window.partitionBy("page", "row").orderBy("start", "end")
    both = mask.select(*KEY).unionByName(stops).withColumn("_from", F.lag("end", 1, 0).over(w))
    return both.where("_from < start").select("page", "row", F.col("_from").alias("start"), F.col("start").alias("end"))


def common(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """Pixels of ``a`` that ``b`` holds too, ``shift`` rows further down."""
    other = b.select("page", (F.col("row") - shift).alias("row"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = a.join(other, ["page", "row"]).where((F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    return met.select("page", "row", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end"))


def opened(mask: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask without what a cross of 3 x 3 pixels doesn't fit into; beyond the page everything counts as set."""
    size = pages.select("page", "width", "height")
    start, end = F.when(F.col("start") == 0, 0).otherwise(F.col("start") + 1), F.when(F.col("end") == F.col("width"), F.col("end")).otherwise(F.col("end") - 1)
    inner = mask.join(size, "page").select("page", "row", start.alias("start"), end.alias("end")).where("start < end")
    edges = size.select("page", F.explode(F.array(F.lit(-1), F.col("height"))).alias("row"), F.lit(0).alias("start"), F.col("width").alias("end"))
    framed = mask.select(*KEY).unionByName(edges)
    kept = common(common(inner, framed, -1), framed, 1)
    moved = [(0, 1), (-1, 0), (1, 0)]  # rows down, pixels to both sides
    grown = kept.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(a).alias("down"), F.lit(b).alias("side")) for a, b in moved])))
    grown = grown.select("page", (F.col("row") + F.col("_m.down")).alias("row"), (F.col("start") - F.col("_m.side")).alias("start"), (F.col("end") + F.col("_m.side")).alias("end"))
    clipped = grown.join(size, "page").where("row >= 0 and row < height").select("page", "row", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "width").alias("end"))
    return runs(clipped)


def _touching(mask: DataFrame, corners: bool) -> DataFrame:
    """Pairs of runs of neighbouring rows: (page, a, b) and their ends, the upper run's with ``_u``."""
    upper = mask.select("page", (F.col("row") + 1).alias("row"), F.col("start").alias("_us"), F.col("end").alias("_ue"))
    pairs = mask.join(upper, ["page", "row"])
    near = (F.col("_us") <= F.col("end")) & (F.col("start") <= F.col("_ue")) if corners else (F.col("_us") < F.col("end")) & (F.col("start") < F.col("_ue"))
    return pairs.where(near)


def _node(row: Column, start: Column) -> Column:
    return row.cast("long") * (1 << 32) + start


def labelled(mask: DataFrame, corners: bool = False, most: int = 60) -> DataFrame:
    """The runs with ``area``: the place (row * 2**32 + start) of the first run of their connected area.

    Areas are joined by edges, with ``corners`` by corners too.  Large and small stars by turns link each run's
    neighbours to the smallest of them; a turn is two grouped minima and joins, written to the shared folder.
    """
    nodes = mask.select(*KEY, _node(F.col("row"), F.col("start")).alias("_n"))
    edges = _touching(mask, corners).select("page", _node(F.col("row"), F.col("start")).alias("a"), _node(F.col("row") - 1, F.col("_us")).alias("b"))
    now = cut(edges, "edges")
    for _ in range(most):
        both = now.unionByName(now.select("page", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("page", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(least, ["page", "a"]).where("b > a").select("page", F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        down = large.groupBy("page", "a").agg(F.min("b").alias("m"), F.count("*").alias("many"))
        small = large.join(down, ["page", "a"])
        # Each run has one smaller neighbour, which has none itself: stars.
        centres = large.select("page", F.col("b").alias("a")).distinct()
        if not down.where("many > 1").head(1) and not down.join(centres, ["page", "a"], "left_semi").head(1):
            now = large
            break
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(small.select("page", F.explode(ends).alias("_x")).select("page", "_x.a", "_x.b").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("areas did not settle")
    found = nodes.join(now.select("page", F.col("a").alias("_n"), F.col("b").alias("area")), ["page", "_n"], "left")
    return found.select(*KEY, F.coalesce("area", "_n").alias("area"))


def boxed(areas: DataFrame) -> DataFrame:
    """(page, area, x0, y0, x1, y1, pixels) of labelled runs."""
    sides = [F.min("start").alias("x0"), F.min("row").alias("y0"), F.max("end").alias("x1"), (F.max("row") + 1).alias("y1")]
    return areas.groupBy("page", "area").agg(*sides, F.sum(F.col("end") - F.col("start")).alias("pixels"))


def margin(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """The runs of those areas that reach the page's edge."""
    there = boxed(areas).join(pages, "page").where("x0 = 0 or y0 = 0 or x1 = width or y1 = height").select("page", "area")
    return areas.join(there, ["page", "area"], "left_semi")


def filled(mask: DataFrame, pages: DataFrame) -> DataFrame:
    """The mask with all that it encloses: what remains when the outside is taken off."""
    return cut(complement(margin(labelled(complement(mask, pages)), pages), pages), "filled")


def _chain(points: Column, side: str, sign: int) -> Column:
    """Twice the signed area beside the convex chain of a component's rows: ``sign`` 1 the left side, -1 the right.

    A row's point joins the chain at the point from which it is seen most steeply; what lies after that is inside.
    """
    value = F.transform(points, lambda p: F.struct(p["row"].cast("double").alias("t"), (p[side] * sign).cast("double").alias("v")))

    def add(chain: Column, p: Column) -> Column:
        steep = F.transform(chain, lambda q: (p["v"] - q["v"]) / (p["t"] - q["t"]))
        return F.concat(F.slice(chain, F.lit(1), F.array_position(steep, F.array_max(steep)).cast("int")), F.array(p))

    first = F.slice(value, 1, 1)
    chain = F.aggregate(F.slice(value, F.lit(2), F.size(value)), first, add)
    steps = F.zip_with(F.slice(chain, F.lit(1), F.size(chain) - 1), F.slice(chain, F.lit(2), F.size(chain)), lambda a, b: (a["v"] + b["v"]) * (b["t"] - a["t"]))
    return F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) * sign


def contours(mask: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, area, x0, y0, x1, y1, contour2, hull2) of a mask's outermost areas, holes and what lies in them included.

    ``contour2`` is twice the area inside the contour through the centres of its edge pixels: two for each square of
    neighbouring centres, one for each triangle.  ``hull2`` is twice the area of the centres' convex hull.  A run of a
    row and one below it that share pixels hold the squares between those, and a triangle where they begin or end apart.
    """
    areas = cut(labelled(filled(mask, pages), corners=True), "areas")
    below = areas.select("page", "area", (F.col("row") - 1).alias("row"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    shared = F.least("end", "_e") - F.greatest("start", "_s")
    met = areas.join(below, ["page", "area", "row"]).where(shared > 0)
    apart = (F.col("start") != F.col("_s")).cast("long") + (F.col("end") != F.col("_e")).cast("long")
    inside = met.groupBy("page", "area").agg(F.sum(2 * (shared - 1) + apart).alias("contour2"))
    rows = areas.groupBy("page", "area", "row").agg(F.min("start").alias("lo"), (F.max("end") - 1).alias("hi"))
    points = rows.groupBy("page", "area").agg(F.array_sort(F.collect_list(F.struct("row", "lo", "hi"))).alias("_p"))
    hulls = points.select("page", "area", (_chain(F.col("_p"), "hi", -1) - _chain(F.col("_p"), "lo", 1)).cast("long").alias("hull2"))
    found = boxed(areas).drop("pixels").join(inside, ["page", "area"], "left").join(hulls, ["page", "area"])
    return found.withColumn("contour2", F.coalesce("contour2", F.lit(0)).cast("long"))


def held(boxes: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """Boxes (page, x0..y1 and more) with the number of the mask's pixels in each as ``name``."""
    met = boxes.join(mask, "page").where("row >= y0 and row < y1 and start < x1 and end > x0")
    counts = met.groupBy(*boxes.columns).agg(F.sum(F.least("end", "x1") - F.greatest("start", "x0")).alias(name))
    return boxes.join(counts, boxes.columns, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def merged(boxes: Column, share: float = 0.3) -> Column:
    """An array of boxes, of which the first two that share more than ``share`` of the smaller are united, until none do."""
    sides = ("x0", "y0", "x1", "y1")

    def b(p: Column):
        return tuple(p[c] for c in sides)

    def turn(now: Column, _: Column) -> Column:
        partner = F.transform(now, lambda p, i: F.array_position(F.transform(now, lambda q, j: (j > i) & (G.overlap(b(p), b(q)) > share * F.least(G.area(b(p)), G.area(b(q))))), True))
        first = F.array_position(F.transform(partner, lambda k: k > 0), True)
        other = F.element_at(partner, F.greatest(first, F.lit(1)).cast("int"))
        gone = F.element_at(now, F.greatest(other, F.lit(1)).cast("int"))
        grown = F.transform(now, lambda p, i: F.when(i + 1 == first, F.struct(*[v.alias(c) for v, c in zip(G.union(b(p), b(gone)), sides)])).otherwise(p))
        return F.when(first > 0, F.filter(grown, lambda p, i: i + 1 != other)).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(boxes), F.lit(1))), boxes, turn)
