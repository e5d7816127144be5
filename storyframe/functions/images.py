"""Images as columns: an array of pixels for each channel, row by row; grey, samples for embedding, shares of ink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of grey, and the usual means and deviations of red, green and blue.
GREY = (0.299, 0.587, 0.114)
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Grey values of three channels, rounded."""
    three = F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))
    return F.transform(three, lambda p: F.floor(p["r"] * GREY[0] + p["g"] * GREY[1] + p["b"] * GREY[2] + 0.5).cast("int"))


def sampled(pixels: Column, width: Column, height: Column, size: int) -> Column:
    """``size`` x ``size`` pixels, each the nearest at or before its place."""
    def at(k: Column) -> Column:
        row, column = F.floor(F.floor(k / size) * height / size), F.floor((k % size) * width / size)
        return F.get(pixels, (row * width + column).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), at)


def embedding_input(channels: tuple[Column, Column, Column], width: Column, height: Column, size: int = 224) -> Column:
    """What an embedder takes: the channels one after the other, sampled to a square, less their mean, by their deviation."""
    def levelled(channel: Column, mean: float, deviation: float) -> Column:
        return F.transform(sampled(channel, width, height, size), lambda x: ((x / 255.0 - mean) / deviation).cast("float"))

    return F.concat(*[levelled(*x) for x in zip(channels, MEANS, DEVIATIONS)])


def ink_share(pixels: Column, threshold: int = 200) -> Column:
    """Share of grey pixels darker than ``threshold``; 0 without pixels."""
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda x: x < threshold)) / F.size(pixels)).otherwise(F.lit(0.0))
