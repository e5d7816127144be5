"""Crops against a gallery of named exemplars: scores, the accept-and-margin gate, leave-one-out evaluation, sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot, doubles, unit


def exemplars(crops: DataFrame, name: str, vector: str, key: str) -> DataFrame:
    """(id, name, v): vectors in double precision and of unit length."""
    return crops.select(F.col(key).alias("id"), F.col(name).cast("string").alias("name"), unit(doubles(F.col(vector))).alias("v"))


TILE = 2048
BLOCKS = 12  # a side, as long as none is larger than LARGEST
SMALLEST, LARGEST = 256, 1 << 16


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _products(kind: pa.DataType):
    schema = pa.schema([("id", kind), ("name", pa.string()), ("nearest", pa.float64()), ("along", pa.float64()), ("n", pa.int64())])

    def run(q: pa.Table, g: pa.Table) -> pa.Table:
        """Per query and name of a pair of blocks: the largest product, their sum and number, without the query itself."""
        if not q.num_rows or not g.num_rows:
            return schema.empty_table()
        g = g.sort_by([("g_name", "ascending"), ("g_id", "ascending")])
        names, vectors, ids = g["g_name"].combine_chunks(), _matrix(g["g_v"]), g["g_id"].to_numpy()
        code = names.dictionary_encode("encode").indices.to_numpy()
        queries, asked = _matrix(q["v"]), q["id"].to_numpy()
        part = np.cumsum(np.r_[False, code[1:] != code[:-1]])
        labels = names.take(pa.array(np.unique(part, return_index=True)[1]))
        out = []
        for i in range(0, len(asked), TILE):
            mine = asked[i : i + TILE]
            shape = len(mine), len(labels)
            nearest, along, count = np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape, np.int64)
            for j in range(0, len(ids), TILE):
                product, now = queries[i : i + TILE] @ vectors[j : j + TILE].T, part[j : j + TILE]
                first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]])
                at = now[first]
                row, col = np.nonzero(mine[:, None] == ids[None, j : j + TILE])
                product[row, col] = 0.0
                along[:, at] += np.add.reduceat(product, first, 1)
                product[row, col] = -np.inf
                nearest[:, at] = np.maximum(nearest[:, at], np.maximum.reduceat(product, first, 1))
                count[:, at] += np.diff(np.r_[first, len(now)])
                np.subtract.at(count, (row, now[col]), 1)
            row, col = np.nonzero(count)
            keys = q["id"].slice(i, TILE).combine_chunks().take(pa.array(row)), labels.take(pa.array(col))
            out.append(pa.Table.from_arrays([*keys, *[pa.array(x[row, col]) for x in (nearest, along, count)]], schema=schema))
        return pa.concat_tables(out)

    return run


def sides(queries: int, gallery: int, names: int) -> tuple[int, int]:
    """Blocks of each side: ``BLOCKS`` at most, unless a block would hold too many rows, or a pair give too many."""
    most = min(LARGEST, max(TILE, TILE * TILE // max(1, names)))
    return tuple(max(1, min(BLOCKS, -(-n // SMALLEST)), -(-n // most)) for n in (queries, gallery))


def products(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """(id, name, nearest, along, n): of each query's products with a name's exemplars the largest, the sum, the number.

    Both sides go in blocks by hash; a pair of blocks is one task's work, a matrix product in tiles, reduced to a row for
    each query and name before anything else is shuffled.  Every query meets the whole gallery but itself, as the
    evaluation is defined, so each side is copied once for each block of the other: ``BLOCKS`` times, whatever the size,
    until blocks reach the rows that a task can hold.  Where names are many, blocks are smaller, down to a tile, so that
    a pair gives few rows.  Null vectors meet nothing.
    """
    queries, gallery = queries.where("v is not null"), gallery.where("v is not null")
    rows_g, names = gallery.agg(F.count("*"), F.approx_count_distinct("name")).first()
    n_q, n_g = sides(queries.count(), rows_g, names)
    block = F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")
    q = queries.select("id", "v", block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))).alias("gb"))
    other = F.pmod(F.xxhash64("id"), F.lit(n_g)).cast("int")
    g = gallery.select(F.col("id").alias("g_id"), F.col("name").alias("g_name"), F.col("v").alias("g_v"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), other.alias("gb"))
    kind = queries.schema["id"].dataType
    met = q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(_products(to_arrow_type(kind)), f"id {kind.simpleString()}, name string, nearest double, along double, n long")
    return met.groupBy("id", "name").agg(F.max("nearest").alias("nearest"), F.sum("along").alias("along"), F.sum("n").alias("n"))


def scores(queries: DataFrame, gallery: DataFrame, strategy: str = "mixed") -> DataFrame:
    """(id, name, score) of each query against each name, without itself.

    nearest: the largest product with an exemplar; prototype: with the normalised mean of the exemplars; mixed: mean of
    both.
    """
    nearest = products(queries, gallery)
    if strategy == "nearest":
        return nearest.select("id", "name", F.col("nearest").alias("score"))
    # The mean's product with q is the mean product; its length follows from the sum vector, less the query's own part.
    total = gallery.select("name", F.posexplode("v").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x")).groupBy("name").agg(F.sum(F.col("x") * F.col("x")).alias("length2"), F.count("*").alias("dims"))
    own = queries.join(gallery.select("id", F.col("name").alias("own")), "id", "left").select("id", "own", dot(F.col("v"), F.col("v")).alias("self"))
    rows = nearest.join(total, "name").join(own, "id")
    mine = F.col("own").eqNullSafe(F.col("name"))
    # |S - v|^2 = |S|^2 - 2 S.v + |v|^2, with S.v = along + |v|^2 when v is one of the exemplars.
    length2 = F.when(mine, F.col("length2") - 2 * F.col("along") - F.col("self")).otherwise(F.col("length2"))
    prototype = F.col("along") / F.greatest(F.sqrt(F.greatest(length2, F.lit(0.0))), F.lit(1e-12) * F.col("n"))
    score = prototype if strategy == "prototype" else (F.col("nearest") + prototype) / 2
    return rows.select("id", "name", score.alias("score"))


def match(scored: DataFrame, accept: float = 0.80, margin: float = 0.05) -> DataFrame:
    """(id, best, score, runner_up, runner_up_score, name): name only at ``accept`` and ``margin`` ahead of the second."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "name")
    top = scored.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("id").agg(
        F.max_by("name", -F.col("r")).alias("best"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("r") == 2, F.col("name"))).alias("runner_up"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up_score"),
    )
    gate = (F.col("score") >= accept) & (F.col("score") - F.col("runner_up_score") >= margin)
    return top.withColumn("name", F.when(gate, F.col("best")))


def evaluate(matches: DataFrame, truth: DataFrame, unknown: str) -> DataFrame:
    """One row: known, correct, unnamed, accuracy, extras, extras_rejected (null without extras).  truth: id, truth."""
    rows = truth.join(matches.select("id", "name"), "id", "left")
    known = F.col("truth") != unknown
    return rows.agg(
        F.count_if(known).alias("known"), F.count_if(known & F.col("name").eqNullSafe(F.col("truth"))).alias("correct"), F.count_if(known & F.col("name").isNull()).alias("unnamed"),
        F.count_if(~known).alias("extras"), F.count_if(~known & F.col("name").isNull()).alias("rejected"),
    ).select("known", "correct", "unnamed", F.coalesce(F.try_divide("correct", "known"), F.lit(0.0)).alias("accuracy"), "extras", F.try_divide("rejected", "extras").alias("extras_rejected"))


def per_name(matches: DataFrame, truth: DataFrame, unknown: str) -> DataFrame:
    """total, correct and unnamed of each known name."""
    rows = truth.join(matches.select("id", "name"), "id", "left").where(F.col("truth") != unknown)
    return rows.groupBy("truth").agg(F.count("*").alias("total"), F.count_if(F.col("name") == F.col("truth")).alias("correct"), F.count_if(F.col("name").isNull()).alias("unnamed"))


def confusions(matches: DataFrame, truth: DataFrame, unknown: str) -> DataFrame:
    rows = truth.join(matches.select("id", "name"), "id").where((F.col("truth") != unknown) & F.col("name").isNotNull() & (F.col("name") != F.col("truth")))
    return rows.groupBy("truth", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "name")


def sweep(scored: DataFrame, truth: DataFrame, accepts: list[float], margin: float, unknown: str) -> DataFrame:
    """``evaluate`` for each threshold; scores are computed once."""
    best = match(scored, 0.0, margin).select("id", "best", "score", F.col("name").isNotNull().alias("ahead"))
    rows = truth.join(best, "id", "left").withColumn("accept", F.explode(F.array(*[F.lit(a) for a in accepts])))
    name = F.when(F.col("ahead") & (F.col("score") >= F.col("accept")), F.col("best"))
    known = F.col("truth") != unknown
    return rows.withColumn("name", name).groupBy("accept").agg(
        F.count_if(known).alias("known"), F.count_if(known & F.col("name").eqNullSafe(F.col("truth"))).alias("correct"), F.count_if(known & F.col("name").isNull()).alias("unnamed"), F.count_if(~known & F.col("name").isNull()).alias("rejected"), F.count_if(~known).alias("extras"))


def eligible(crops: DataFrame, least: int, unknown: str, name: str = "name") -> DataFrame:
    """Crops with a name that has ``least`` of them, and the unknown ones."""
    w = Window.partitionBy(name)
    return crops.where(F.col(name).isNotNull()).withColumn("_n", F.count("*").over(w)).where((F.col("_n") >= least) | (F.col(name) == unknown)).drop("_n")


def per_label(crops: DataFrame, name: str = "name") -> DataFrame:
    """(name, exemplars): how many crops a gallery has of each name, in order of name."""
    return crops.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("exemplars")).orderBy("name")
