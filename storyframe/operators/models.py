"""Which projector file belongs to a model, told by names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(name: Column) -> Column:
    """Runs of letters and digits in lower case, as often as they come."""
    return F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1)


def stem(file: Column) -> Column:
    """A file's name without folder and last suffix."""
    name = F.regexp_extract(file, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def projectors(models: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, model, file): the projectors beside each model that share most of its name; several are a tie.

    models: by, model; candidates: by, file.  A lone candidate is taken as it is.  Among several one must hold the
    model's family, the first run of its name; then those count that share the most of the model's runs, repeats counted.
    """
    sets = candidates.select(*by, "file").distinct().withColumn("_many", F.count("*").over(Window.partitionBy(*by)))
    pairs = models.select(*by, "model").distinct().join(sets, by)
    own, other = tokens(stem(F.col("model"))), tokens(stem(F.col("file")))
    family = F.contains(F.lower(stem(F.col("file"))), F.get(own, F.lit(0)))
    shared = F.size(F.filter(own, lambda t: F.array_contains(other, t)))
    fit = pairs.withColumn("_s", F.when(F.col("_many") == 1, 0).when(family, shared)).where("_s is not null")
    best = Window.partitionBy(*by, "model")
    return fit.withColumn("_b", F.max("_s").over(best)).where("_s = _b").select(*by, "model", "file")
