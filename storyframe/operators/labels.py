"""Human labels: what is pending, upserts, and verdicts.  Labels: mode, key, text, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items (mode, key, text) without a label; one whose text has changed counts as unlabelled."""
    known = labels.select("mode", "key", F.col("text").alias("known"))
    same = (F.coalesce("text", F.lit("")) == "") | (F.coalesce("known", F.lit("")) == "") | (F.col("text") == F.col("known"))
    i, k = items.alias("i"), known.alias("k")
    on = (F.col("i.mode") == F.col("k.mode")) & (F.col("i.key") == F.col("k.key")) & same
    return i.join(k, on, "left_anti")


def upsert(labels: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with the changes in place of entries of the same key."""
    return labels.join(changes, keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def count_verdict(true: Column, predicted: Column) -> Column:
    return F.when(true == predicted, "ok").when(predicted < true, "under").otherwise("over")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
