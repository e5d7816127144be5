"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations.

Targets.  Every source's share of the whole is its weight, capped at ``repeats`` times its size; the excess goes to the
others by weight.  That is a water level: with sources ordered by cap over weight, those below the level are at their
caps.

Blocks.  A document belongs to one of its source's blocks by hash, and blocks are in random order within their source.
A source takes its whole documents as often as its target holds its size, and of the rest whole blocks in order, then
whole parts of one block (dealt by hash too, so that no block is sorted whole), then documents of one part, then the first
words of one document: so the taken words are the target, rounded.

Shards.  The blocks' quotas (how many of each source) are split among the output shards by a binary tree: a node's
blocks are ordered at random and the left half of the shards takes its share of the first, which draws each source's
count from the multivariate hypergeometric distribution.  A leaf's counts are quotas exactly; the sources' permuted
blocks are dealt to the leaves as disjoint ranges, and a document is placed in its shard by a local random key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"


def _carried(carry: tuple[str, ...]) -> list:
    return [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carried")] if carry else []


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, mark): words of each text, null text 0; a hash of id and text; ``carry`` as one struct."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", text).alias("mark"), *_carried(carry))


def targets(totals: DataFrame, repeats: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size, rows, weight); weights are positive.

    A source without words has the target 0; without any words all targets are 0.
    """
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy("level", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = totals.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("level", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    # The level if this source and those before it were at their caps.
    rows = rows.withColumn("before_cap", F.sum("cap").over(by_level) - F.col("cap")).withColumn("rest_weight", F.col("all_weight") - F.sum("weight").over(by_level) + F.col("weight"))
    rows = rows.withColumn("free", (F.col("total") - F.col("before_cap")) / F.col("rest_weight"))
    # The first source whose cap is above that level, and all after it, are at the level.
    rows = rows.withColumn("water", F.min(F.when(F.col("free") <= F.col("level"), F.struct("level", "order", "free"))).over(everything)["free"])
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce("water", F.lit(float("inf"))) * F.col("weight")))


def split(counts: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, source, quota, first) of (source, blocks): the splitting tree over 2**depth shards."""
    now = counts.where("blocks > 0").select(F.lit(0).alias("node"), "source", F.col("blocks").alias("quota"))
    for level in range(depth):
        unit = now.select("node", "source", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("i"))
        order = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "node", F.coalesce("source", F.lit("\x00")), "i"), "source", "i")
        half = F.floor((F.count("*").over(Window.partitionBy("node")) + F.pmod(F.col("node"), F.lit(2))) / 2)
        side = F.when(F.row_number().over(order) <= half, 0).otherwise(1)
        now = unit.withColumn("side", side).groupBy((F.col("node") * 2 + F.col("side")).alias("node"), "source").agg(F.count("*").alias("quota"))
    ranges = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return now.select(F.col("node").alias("shard"), "source", "quota", (F.sum("quota").over(ranges) - F.col("quota")).alias("first"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, blocks: int = 8192, depth: int = 4, seed: int = 7,
    carry: tuple[str, ...] = (), parts: int = 4096,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard, place, ...): one row per document.

    Sources in order of code points, null last, have ``weights`` in turn.  ``taken`` words of a document are in the mix,
    repeats counted, ``repeats`` times its size at most; place orders a shard.  The whole has about ``blocks`` blocks, so
    the planning tables are bounded by blocks, sources and ``parts`` a source.  ``carry`` names further columns of docs
    that stay with their row, of any names but those above; other columns are ignored.
    Repeated rows count each, and so do null doc_ids: rows are told by nothing but themselves.  A null text, or one
    without words, has size 0 and takes 0; very long texts are counted whole; an empty table gives no rows.
    """
    if clash := {c.lower() for c in carry} & {"doc_id", "source", "size", "source_size", "target", "taken", "shard", "place"}:
        raise ValueError(f"carried columns can't be named {sorted(clash)}")
    held = ["_carried"] if carry else []
    size = written(sized(docs, carry), "sizes")
    totals = size.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("order") - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = totals.withColumn("order", F.row_number().over(order)).withColumn("weight", weight)
    totals = targets(totals, repeats).withColumn("part", F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(0))))
    totals = totals.withColumn("blocks", F.least(F.col("rows"), F.greatest(F.lit(1), F.ceil(F.col("part") * blocks))).cast("int"))
    totals = totals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0).cast("long"))
    plan = written(totals.withColumn("need", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).select("source", "source_size", "target", "blocks", "epochs", "need"), "plan")

    same = size["source"].eqNullSafe(plan["source"])
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.col("blocks")).cast("int").alias("block")
    placed = size.join(plan, same).select("doc_id", size["source"], "size", "source_size", "target", "epochs", "need", F.xxhash64(F.lit(seed), "mark").alias("place"), block, "mark", *held)
    block = placed.groupBy("source", "block", "need").agg(F.sum("size").alias("words"))
    # Blocks without documents keep their place, so that quotas are those of the plan.
    every = plan.select("source", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), F.coalesce("source", F.lit("\x00")), "block"), "block")
    b = block.select(F.col("source").alias("s"), F.col("block").alias("k"), "words", "need")
    every = every.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")), "left")
    every = every.select("source", "block", F.coalesce("words", F.lit(0)).alias("words"), "need", (F.row_number().over(permuted) - 1).alias("rank"), F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    shards = split(plan.select("source", "blocks"), depth, seed).select("shard", F.col("source").alias("s"), "first", "quota")
    every = every.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("quota")))
    every = written(every.where("need is not null").select(F.col("source").alias("s"), F.col("block").alias("k"), "words", "before", "shard"), "blocks")

    at = placed.join(every, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    edge = (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") > F.col("need"))
    keep = ["doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "shard", "place", *held]
    whole = at.where(~edge).withColumn("extra", F.when(F.col("before") + F.col("words") <= F.col("need"), F.col("size")).otherwise(0))
    # A source has one block at the edge at most: its parts, in the order of their numbers, then the documents of one part.
    cut = at.where(edge).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 3), "mark"), F.lit(parts)).cast("int")).drop("words", "s", "k")
    earlier = Window.partitionBy("p_source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    part = cut.groupBy(F.col("source").alias("p_source"), F.col("part").alias("p")).agg(F.sum("size").alias("words")).withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    cut = cut.join(written(part, "parts"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p")))
    left = F.col("need") - F.col("before") - F.col("earlier")
    within = Window.partitionBy("source", "part").orderBy("place", "mark", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    some = cut.where((left > 0) & (left < F.col("words"))).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    rest = cut.where((left <= 0) | (left >= F.col("words"))).withColumn("extra", F.when(left >= F.col("words"), F.col("size")).otherwise(0))
    found = whole.select(*keep).unionByName(rest.select(*keep)).unionByName(some.select(*keep))
    return found.withColumns({c: F.col("_carried")[c] for c in carry}).drop("_carried")
