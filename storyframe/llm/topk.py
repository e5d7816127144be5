"""Exact top-k search by inner product over KD-trees, one per shard.

A top tree of median splits, fitted on a bounded sample, deals all rows to leaves; a leaf's rows are its shards (several,
dealt by hash, where a leaf is large).  A shard is a KD-tree of median splits along the widest side, with tight bounding
boxes; the leaves' boxes are the tight ones of all their rows.  The bound of a box for a query is the sum over dimensions
of the larger of q * low and q * high.  Queries go out in waves: first to their best leaf, then to the next few whose
bound reaches the kth score so far, then to all others that still do; within a shard a query's boxes are taken best first
until their bound falls below its kth score.  Rows and queries meet in one stream, ordered by shard: a task builds a
shard's tree from its rows and then lets the queries pass, so neither shards nor queries are copied for the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 128


BOXES = 1 << 25  # bytes of the leaves' boxes, which are broadcast
SAMPLE = 1 << 15  # rows that fit the top tree of one length of vectors


def integers(values, dim: int, rows: int) -> np.ndarray:
    """floor(256 * x) of rows of ``dim`` values, as doubles: products are exact while scores stay below 2**53."""
    return np.floor(256.0 * np.asarray(values, np.float64).reshape(rows, dim))


class Top:
    """Median splits along the widest side: heap-ordered sides and thresholds; values up to the threshold go left."""

    def __init__(self, rows: np.ndarray, leaves: int):
        self.side: list[int] = []
        self.cut: list[float] = []
        parts = [rows]
        while len(parts) < leaves:
            halves = []
            for part in parts:
                width = part.max(0) - part.min(0) if len(part) else np.zeros(rows.shape[1])
                side = int(np.argmax(width))
                cut = float(np.median(part[:, side])) if len(part) else 0.0
                self.side.append(side)
                self.cut.append(cut)
                left = part[:, side] <= cut
                halves += [part[left], part[~left]]
            parts = halves

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(rows), np.int64), np.arange(len(rows))
        side, cut = np.array(self.side, np.int64), np.array(self.cut)
        for _ in range((len(self.side) + 1).bit_length() - 1):
            node = 2 * node + 1 + (rows[at, side[node]] > cut[node])
        return node - len(self.side)


class Tree:
    """A KD-tree of one shard's rows; the leaves are equal parts, so nodes are told by halving positions.

    Vectors without components have one box without sides, and all scores 0.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        parts = [(0, len(ids))]
        while parts and parts[0][1] - parts[0][0] > LEAF:
            nxt = []
            for a, b in parts:
                part = rows[order[a:b]]
                side = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], middle)] if part.shape[1] else order[a:b]
                nxt += [(a, a + middle), (a + middle, b)]
            parts = nxt
        self.ids, self.rows, self.parts = ids[order], rows[order], parts
        self.levels = []
        low = np.stack([self.rows[a:b].min(0) for a, b in parts])
        high = np.stack([self.rows[a:b].max(0) for a, b in parts])
        while True:
            self.levels.insert(0, (low, high))
            if len(low) == 1:
                break
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (queries x k) of the best rows; entries that don't beat ``kth`` may be missing (id -1)."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        alive = np.ones((len(q), 1), bool)
        for low, high in self.levels:  # down the tree: boxes that can't reach a query's kth score are left with their subtrees
            if alive.shape[1] != len(low):
                alive = np.repeat(alive, 2, 1)
            bound = np.full((len(q), len(low)), -np.inf)
            use = np.flatnonzero(alive.any(1))
            bound[use] = plus[use] @ high.T + minus[use] @ low.T
            alive &= bound >= kth[:, None]
        bound[~alive] = -np.inf
        best = np.argsort(-bound, 1, kind="stable")
        score = np.full((len(q), k), -np.inf)
        found = np.full((len(q), k), -1, np.int64)
        for step in range(best.shape[1]):
            leaf = best[:, step]
            reach = bound[np.arange(len(q)), leaf]
            todo = np.flatnonzero((reach > -np.inf) & (reach >= np.maximum(kth, score[:, -1])))
            if not len(todo):
                break
            for part in np.unique(leaf[todo]):
                rows = todo[leaf[todo] == part]
                a, b = self.parts[part]
                s = q[rows] @ self.rows[a:b].T
                s[qid[rows][:, None] == self.ids[None, a:b]] = -np.inf
                both = np.concatenate([score[rows], s], 1)
                ids = np.concatenate([found[rows], np.broadcast_to(self.ids[a:b], s.shape)], 1)
                order = np.lexsort((ids, -both), axis=1)[:, :k]
                score[rows], found[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        found[score == -np.inf] = -1
        return score, found


_RESULT = "q_row long, query_id long, vec_id long, score long"


def _search(k: int):
    """The best rows of each query in its shards, from rows and queries in order of shard, a shard's rows first.

    A task holds one shard's tree and a batch of queries at a time, however many queries there are.
    """

    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = np.stack([column[n].to_numpy() for n in ("dim", "leaf", "sub")], 1)
            asks = column["q_row"].is_valid().to_numpy(zero_copy_only=False)
            turn = np.flatnonzero((keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(keys)]):
                if key is None or (keys[a] != key).any():
                    key, held, tree = keys[a], [], None
                ids = column["id"].slice(a, b - a).to_numpy()
                v = integers(column["v"].slice(a, b - a).flatten().to_numpy(zero_copy_only=False), int(key[0]), b - a)
                if not asks[a]:
                    held.append((ids, v))
                    continue
                if not held:
                    continue
                if tree is None:
                    own, rows = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(own, kind="stable")
                    tree = Tree(own[order], rows[order])
                q_row, kth = column["q_row"].slice(a, b - a).to_numpy(), column["kth"].slice(a, b - a).to_numpy()
                for at in range(0, b - a, 512):
                    part = slice(at, at + 512)
                    score, found = tree.search(ids[part], v[part], k, kth[part])
                    row, col = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(q_row[part][row]), pa.array(ids[part][row]), pa.array(found[row, col]), pa.array(score[row, col].astype(np.int64))], ["q_row", "query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double array, dim): rows whose vector has no null and no non-finite component, and isn't null."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and vec_id is not null").where(~bad).withColumn("dim", F.size("v"))


def _deal(tops: dict[int, Top]):
    """Rows with the leaf of their vector."""

    def run(batches):
        for batch in batches:
            dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            v = batch.column(batch.schema.get_field_index("v"))
            leaf = np.zeros(len(dim), np.int64)
            for d in np.unique(dim):
                if int(d) in tops:
                    at = np.flatnonzero(dim == d)
                    leaf[at] = tops[int(d)].leaf(integers(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), int(d), len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    return run


def _route(boxes, wave: int, few: int = 8):
    """Queries with the leaves of a wave: the best; the next ``few``; all others.  Only those that reach the kth score."""

    def run(batches):
        known = boxes.value
        for batch in batches:
            dim = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            v = batch.column(batch.schema.get_field_index("v"))
            kth = batch.column(batch.schema.get_field_index("kth")).to_numpy()
            for d in np.unique(dim):
                leaf, low, high = known[int(d)]
                mine = np.flatnonzero(dim == d)
                for a in range(0, len(mine), 256):
                    at = mine[a : a + 256]
                    q = integers(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), int(d), len(at))
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    best = np.argsort(-bound, 1, kind="stable")[:, slice(*((0, 1), (1, 1 + few), (1 + few, None))[wave])]
                    row, col = np.nonzero(np.take_along_axis(bound, best, 1) >= kth[at, None])
                    picked = batch.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(leaf[best[row, col]].astype(np.int32))], [*batch.schema.names, "leaf"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, shard_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id divisible by ``every``) its ``k`` best other rows.

    Components become floor(256 * x); the score is the integer inner product, ties go to the smaller vec_id.  Vectors
    that are null or hold null or non-finite components take no part.  A query is compared with vectors of its own
    length only; those without components have the score 0.  Rows that repeat a vec_id rank each, as other rows if their
    id differs from the query's; a query_id that several rows have gets the k best of what its rows find together.  An
    empty table gives no rows; other columns are ignored.
    Components are exact up to a magnitude of 2**20 (scores below 2**53).

    The top tree of a length is fitted on at most SAMPLE rows, and its leaves are so few that their boxes take at most
    BOXES bytes; every row is dealt and searched, whatever the sample was.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    many = {r[0]: r[1] for r in rows.groupBy("dim").count().where(F.col("count") > shard_rows).collect()}
    room = BOXES // (16 * max(1, sum(many)))
    tops = {}
    for d, n in many.items():
        leaves = 1 << (min(-(-n // shard_rows), max(1, room)).bit_length() - 1)
        if d and leaves > 1:
            sample = rows.where(F.col("dim") == d).orderBy(F.xxhash64("row"), "row").limit(min(SAMPLE, max(leaves, BOXES // (8 * d)))).select("v").collect()
            tops[d] = Top(integers([r[0] for r in sample], d, len(sample)), leaves)
    dealt = rows.mapInArrow(_deal(tops), "vec_id long, v array<double>, dim int, row long, leaf int") if tops else rows.withColumn("leaf", F.lit(0))
    leaves = dealt.groupBy("dim", "leaf").agg(F.count("*").alias("rows"))
    leaves = written(leaves.select("dim", "leaf", F.ceil(F.col("rows") / shard_rows).cast("int").alias("subs")), "leaves")
    placed = dealt.join(F.broadcast(leaves), ["dim", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")).drop("subs")
    placed = written(placed, "placed")
    side = F.posexplode("v").alias("pos", "x")
    sides = placed.select("dim", "leaf", side).groupBy("dim", "leaf", "pos").agg(F.floor(256 * F.min("x")).alias("low"), F.floor(256 * F.max("x")).alias("high"))
    sides = sides.groupBy("dim", "leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high"))).alias("side"))
    boxes: dict[int, list] = {}
    for r in leaves.join(sides, ["dim", "leaf"], "left").orderBy("dim", "leaf").select("dim", "leaf", "side.low", "side.high").collect():
        boxes.setdefault(r[0], []).append((r[1], r[2] or [], r[3] or []))
    boxes = {d: (np.array([b[0] for b in x], np.int64), *(np.array([b[j] for b in x], float).reshape(len(x), d) for j in (1, 2))) for d, x in boxes.items()}
    shared = spark.sparkContext.broadcast(boxes)

    # Equal query rows search once; more than k of them give nothing that k don't.
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "v", "dim").agg(F.min("row").alias("q_row"), F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    queries = written(queries, "queries")
    found = None
    for wave in range(3):
        if wave and max((len(x[0]) for x in boxes.values()), default=0) <= (1, 9)[wave - 1]:
            break
        now = queries.select("q_row", "vec_id", "v", "dim")
        if found is None:
            now = now.withColumn("kth", F.lit(float("-inf")))
        else:
            best = Window.partitionBy("q_row").orderBy(F.desc("score"))
            kth = found.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("q_row", F.col("score").cast("double").alias("kth"))
            now = now.join(kth, "q_row", "left").na.fill(float("-inf"), ["kth"])
        sent = now.mapInArrow(_route(shared, wave), "q_row long, vec_id long, v array<double>, dim int, kth double, leaf int")
        more = written(searched(placed, leaves, sent, k), "found")
        found = more if found is None else found.union(more)
    again = queries.where("times > 1").select("q_row", "times")
    found = found.join(again, "q_row", "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(placed: DataFrame, leaves: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """The best rows of each query within each shard of the leaves it is sent to."""
    key = ["dim", "leaf", "sub"]
    wanted = F.broadcast(sent.select("dim", "leaf").distinct())  # no more than there are leaves
    rows = placed.join(wanted, ["dim", "leaf"], "left_semi").select(*key, F.lit(None).cast("long").alias("q_row"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("kth"))
    queries = sent.join(F.broadcast(leaves), ["dim", "leaf"]).select("dim", "leaf", F.explode(F.expr("sequence(0, subs - 1)")).alias("sub"), "q_row", F.col("vec_id").alias("id"), "v", "kth")
    both = rows.unionByName(queries).repartition(*key).sortWithinPartitions(*key, F.col("q_row").asc_nulls_first())
    return both.mapInArrow(_search(k), _RESULT)
