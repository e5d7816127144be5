import numpy as np
import pytest

from storyframe.operators import layout, masks, panels


def spans(spark, pages, test):
    """Runs of the pixels for which ``test`` holds, of pages as arrays."""
    rows = []
    for k, page in enumerate(pages):
        edge = np.diff(np.pad(test(page).astype(int), ((0, 0), (1, 1))), axis=1)
        starts, ends = np.argwhere(edge == 1), np.argwhere(edge == -1)
        rows += [(k, int(r), int(a), int(z)) for (r, a), (_, z) in zip(starts, ends)]
    return spark.createDataFrame(rows, "page int, row int, start int, end int")


def sizes(spark, pages):
    return spark.createDataFrame([(k, p.shape[1], p.shape[0]) for k, p in enumerate(pages)], "page int, width int, height int")


def drawn(width, height, *frames):
    """A white page with empty frames."""
    page = np.full((height, width), 255, np.uint8)
    for x0, y0, x1, y1 in frames:
        page[y0:y1, x0:x1] = 0
        page[y0 + 3 : y1 - 3, x0 + 3 : x1 - 3] = 255
    return page


def flood(on, corners):
    """Labels of connected areas by the smallest cell, by repetition."""
    h, w = on.shape
    label = np.where(on, np.arange(h * w).reshape(h, w), -1)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while True:
        before = label.copy()
        for r, c in np.argwhere(on):
            for a, b in steps:
                if 0 <= r + a < h and 0 <= c + b < w and on[r + a, c + b]:
                    label[r, c] = min(label[r, c], label[r + a, c + b])
        if (label == before).all():
            return label


@pytest.mark.parametrize("corners", [False, True])
def test_labels_against_floods(spark, corners):
    rng = np.random.default_rng(4)
    pages = [rng.random((h, w)) < p for h, w, p in ((9, 13, 0.5), (12, 7, 0.7), (1, 6, 0.5), (5, 1, 0.6), (4, 4, 0.0), (3, 3, 1.0))]
    got = masks.labelled(spans(spark, pages, lambda p: p), corners).collect()
    want = set()
    for k, page in enumerate(pages):
        label = flood(page, corners)
        want |= {(k, r, c, int(label[r, c]) // page.shape[1], int(label[r, c]) % page.shape[1]) for r, c in np.argwhere(page)}
    assert {(x.page, x.row, c, x.area >> 32, x.area & (2**32 - 1)) for x in got for c in range(x.start, x.end)} == want


def test_complement_and_overlapping_spans(spark):
    rows = spark.createDataFrame([(0, 0, 2, 4), (0, 0, 3, 6), (0, 0, 6, 7), (0, 2, 0, 8), (0, 0, 5, 5)], "page int, row int, start int, end int")
    mask = masks.runs(rows)
    assert sorted(map(tuple, mask.collect())) == [(0, 0, 2, 7), (0, 2, 0, 8)]
    page = spark.createDataFrame([(0, 8, 3), (1, 4, 1)], "page int, width int, height int")
    assert sorted(map(tuple, masks.complement(mask, page).collect())) == [(0, 0, 0, 2), (0, 0, 7, 8), (0, 1, 0, 8), (1, 0, 0, 4)]


def test_contours_of_plain_forms(spark):
    ring = np.zeros((12, 20), bool)
    ring[1:11, 2:18] = True
    ring[3:9, 5:15] = False
    ring[5, 8] = True  # an island inside counts with what encloses it
    step = np.zeros((5, 9), bool)
    step[1:4, 1:5] = step[3, 1:8] = True
    line = np.eye(6, dtype=bool)
    got = {(x.page, x.x0, x.y0, x.x1, x.y1, x.contour2, x.hull2) for x in masks.contours(spans(spark, [ring, step, line], lambda p: p), sizes(spark, [ring, step, line])).collect()}
    # Areas through pixel centres: 15 x 9; a rectangle of 3 x 2 with a line beside it; a diagonal without area.
    assert got == {(0, 2, 1, 18, 11, 270, 270), (1, 1, 1, 8, 4, 13, 18), (2, 0, 0, 6, 6, 0, 0)}


def test_bubbles(spark):
    page = np.zeros((60, 80), np.uint8)
    y, x = np.ogrid[:60, :80]
    page[((x - 30) / 20) ** 2 + ((y - 25) / 14) ** 2 <= 1] = 255
    page[22:26, 20:40:3] = 0  # letters
    page[50:58, 60:62] = 255  # too small, without letters
    found = panels.bubbles(spans(spark, [page], lambda p: p >= 220), spans(spark, [page], lambda p: p < 128), sizes(spark, [page])).collect()
    (r,) = found
    assert abs(r.x0 - 10) + abs(r.x1 - 51) + abs(r.y0 - 11) + abs(r.y1 - 40) <= 4 and r.dark == (page[r.y0 : r.y1, r.x0 : r.x1] < 128).sum()


def found_panels(spark, *pages):
    rows = panels.gutter_panels(spans(spark, pages, lambda p: p >= 220), spans(spark, pages, lambda p: p < 220), sizes(spark, pages))
    ordered = layout.reading_order(rows, ["page"], tie="panel").orderBy("page", "rank").collect()
    return [[(r.x0, r.y0, r.x1, r.y1) for r in ordered if r.page == k] for k in range(len(pages))]


def test_gutter_panels(spark):
    top = (260, 20, 480, 300), (20, 20, 258, 300)
    bleeding = drawn(500, 700, (260, 0, 480, 680), (20, 20, 250, 300), (20, 320, 250, 680))
    bleeding[0:18, 250:480] = 0
    grid = (356, 20, 680, 240), (20, 20, 344, 240), (356, 260, 680, 480), (20, 260, 344, 480)
    inset = drawn(500, 700, (20, 20, 480, 350), (20, 370, 400, 680), (410, 370, 480, 430))
    specked = drawn(500, 700, (20, 20, 480, 350), (20, 370, 480, 640))
    specked[670:676, 245:255] = 0
    closed = np.zeros((300, 200), np.uint8)
    blank = np.full((50, 40), 255, np.uint8)
    got = found_panels(spark, drawn(500, 700, *top, (20, 320, 480, 680)), bleeding, drawn(700, 500, *grid), inset, specked, closed, blank)
    assert got[0] == [*top, (20, 320, 480, 680)]
    assert got[1] == [(250, 0, 480, 680), (20, 20, 250, 300), (20, 320, 250, 680)]
    assert got[2] == list(grid)
    assert got[3] == [(20, 20, 480, 350), (20, 370, 480, 680)]  # the small frame joins its neighbour
    assert got[4] == [(20, 20, 480, 350), (20, 370, 480, 640)]
    assert got[5] == [] and got[6] == []


def test_overlapping_holes_are_united_in_turn(spark):
    boxes = [(0, 0, 10, 10), (20, 0, 30, 10), (6, 0, 16, 10), (14, 0, 24, 10)]
    one = spark.createDataFrame([([dict(zip(("x0", "y0", "x1", "y1"), b)) for b in boxes],)], "b array<struct<x0:long,y0:long,x1:long,y1:long>>")
    # What is united is larger, so less of it is shared: two stay.
    assert [tuple(x) for x in one.select(masks.merged(one.b)).first()[0]] == [(0, 0, 16, 10), (14, 0, 30, 10)]
    assert [tuple(x) for x in one.select(masks.merged(one.b, 0.1)).first()[0]] == [(0, 0, 30, 10)]
    assert [tuple(x) for x in one.select(masks.merged(one.b, 0.5)).first()[0]] == boxes
