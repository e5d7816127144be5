"""Phrases whose words belong together: counts of word runs within pieces of text, and the worst cut of each phrase.

Texts fall into pieces at punctuation and line ends.  Equal pieces are one piece with its number of copies, so repeated
passages cost once.  Tasks count the word runs of blocks of pieces, weighted by copies; a block sends each bucket of the
hash of (language, run) one packed table.  A bucket's tables are summed by duckdb, which spills beyond its memory limit,
and runs under the least count are gone.  Words and pairs come first; longer runs are counted where what they hold may
be frequent.  What a phrase's parts count is asked for by requests that are shuffled to the
parts' counts: a part of a frequent phrase is frequent itself, so the answer is always there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, release, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz "
_ENDS = r"[.,;:!?\n-\r]"
_BLOCK = 600_000  # distinct runs of a block
_FILTER = 1 << 27  # bits of the filter of frequent runs: 16 MB
_PARTS = 8  # tasks that make it, each with a whole one
_MEMORY = "256MB"  # of a task's duckdb
_RUNS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, copies): distinct pieces of a language, A-Z lower-cased, without outer blanks; empty ones go."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, _ENDS)).alias("piece"))
    return rows.select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("copies"))


def _packed(counts: dict[str, dict[bytes, int]], buckets: int) -> pa.RecordBatch:
    """One row (bucket, payload) for each bucket that has runs."""
    langs = [(lang, len(found)) for lang, found in counts.items()]
    runs = [run for found in counts.values() for run in found]
    salts = np.repeat([crc32(lang.encode()) for lang, _ in langs], [n for _, n in langs])
    bucket = (np.fromiter(map(crc32, runs), np.int64, len(runs)) ^ salts) % buckets
    order = np.argsort(bucket, kind="stable")
    table = pa.table([
        pa.array(np.repeat(np.array([lang for lang, _ in langs], object), [n for _, n in langs]), pa.string()), pa.array(runs, pa.binary()),
        pa.array([n for found in counts.values() for n in found.values()], pa.int64()),
    ], schema=_RUNS).take(pa.array(order))
    ids, first = np.unique(bucket[order], return_index=True)
    payloads = []
    for a, b in zip(first, [*first[1:], len(runs)]):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _RUNS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(a, b - a))
        payloads.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


class _Counts:
    """Counts of a block's runs by language, given out as packed tables when there are too many."""

    def __init__(self, buckets: int):
        self.buckets, self.by_lang = buckets, {}

    def of(self, lang: str) -> dict[bytes, int]:
        return self.by_lang.setdefault(lang, {})

    def packed(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last or sum(map(len, self.by_lang.values())) > _BLOCK:
            if self.by_lang:
                yield _packed(self.by_lang, self.buckets)
            self.by_lang = {}


def _short_runs(buckets: int):
    """Weighted counts of single words and pairs, block by block; the empty run counts all words."""

    def run(batches):
        counts = _Counts(buckets)
        for batch in batches:
            for lang, piece, copies in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = counts.of(lang)
                known = found.get
                # Only spaces are left of what separates bytes here.
                words = piece.split()
                found[b""] = known(b"", 0) + copies * len(words)
                for w in words:
                    found[w] = known(w, 0) + copies
                for w in map(b" ".join, zip(words, words[1:])):
                    found[w] = known(w, 0) + copies
            yield from counts.packed()
        yield from counts.packed(last=True)
        release()

    return run


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Where a Bloom filter of ``size`` bits keeps runs, by their checksums."""
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        with np.errstate(over="ignore"):
            yield (hashes.astype(np.uint64) * np.uint64(odd) >> np.uint64(24)) % np.uint64(size)


def _longer_runs(width: int, buckets: int, known):
    """Weighted counts of runs of ``width`` words both of whose inner runs pass the filter ``known`` of frequent ones."""

    def run(batches):
        bits, counts = known.value, _Counts(buckets)
        for batch in batches:
            inner, last, piece_of, owners, salts = [], [], [], [], []
            for lang, piece, copies in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = piece.split()
                if len(words) >= width:
                    runs = list(map(b" ".join, zip(*(words[i:] for i in range(width - 1)))))
                    inner += runs
                    last += words[width - 2 :]
                    piece_of.append(len(runs))
                    owners.append((lang, copies))
                    salts.append(crc32(lang.encode()))
            if not inner:
                continue
            piece_of = np.repeat(np.arange(len(owners)), piece_of)
            hashes = np.fromiter(map(crc32, inner, np.array(salts)[piece_of].tolist()), np.int64, len(inner))
            there = np.ones(len(inner), bool)
            for place in _places(hashes, len(bits) * 8):
                there &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            for i in np.flatnonzero(there[:-1] & there[1:] & (piece_of[:-1] == piece_of[1:])).tolist():
                lang, copies = owners[piece_of[i]]
                found, w = counts.of(lang), inner[i] + b" " + last[i + 1]
                found[w] = found.get(w, 0) + copies
            yield from counts.packed()
        yield from counts.packed(last=True)
        release()

    return run


def _filters(size: int):
    """A task's Bloom filter of (lang, phrase) as one row."""

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            hashes = np.array([crc32(p, crc32(lang.encode())) for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            for place in _places(hashes, size):
                np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    return run


def _filter(phrases: DataFrame) -> np.ndarray:
    """A Bloom filter of (lang, phrase): 16 bits for each, ``_FILTER`` bits at most.

    Beyond that more runs pass which turn out rare: the filter decides cost, never results.
    """
    wanted = 1 << max(16, int(phrases.count() * 16).bit_length())
    size = min(wanted, _FILTER)
    rows = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).repartition(_PARTS).mapInArrow(_filters(size), "bits binary").collect()
    return np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in rows] or [np.zeros(size // 8, np.uint8)])


def _summed(least: int):
    """Sums of a task's buckets that reach ``least``, and those of the empty runs."""

    def run(batches):
        import duckdb

        def tables() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column(1):
                    yield from pa.ipc.open_stream(payload.as_buffer())

        # Spill space of this task alone, as that of Spark's own operators: nothing else reads it, and it ends with the task.
        with tempfile.TemporaryDirectory(prefix="spill-") as spill, duckdb.connect(config={"memory_limit": _MEMORY, "temp_directory": spill, "threads": 1, "preserve_insertion_order": False}) as db:
            db.register("runs", pa.RecordBatchReader.from_batches(_RUNS, tables()))
            found = db.sql("select lang, phrase, sum(n)::bigint as n from runs group by lang, phrase having sum(n) >= ? or phrase = ''::blob", params=[least])
            yield from found.to_arrow_reader(20_000)
        release()

    return run


def frequent(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, size, n): runs of 1 to ``longest`` words with their counts, ``least`` at least.

    The empty phrase (size 0) counts all words of a language.  A run is no more frequent than those inside it, so runs of
    three words and more are counted only where the runs inside pass a filter of the frequent ones.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = partitions(spark)
    source = written(pieces(docs).select("lang", F.col("piece").cast("binary").alias("piece"), "copies"), "pieces")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))

    def counted(runs) -> DataFrame:
        packed = source.mapInArrow(runs, "bucket int, payload binary").repartition(buckets, "bucket")
        rows = packed.mapInArrow(_summed(least), "lang string, phrase binary, n long").select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
        return written(rows.withColumn("size", size), "runs")

    found = counted(_short_runs(buckets))
    now = found.where("size = 2")
    for width in range(3, longest + 1):
        now = counted(_longer_runs(width, buckets, spark.sparkContext.broadcast(_filter(now))))
        found = found.unionByName(now)
    return found


def scored(a: str, left: str, right: str):
    """floor(10**6 * a * a / (left * right)) of three columns, by decimals of 38 digits."""
    return F.expr(f"(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts a phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` all words of the language; ``score`` is
    floor(10**6 * a * a / (l * r)), exactly (up to 10**15 occurrences of a phrase; beyond them it raises).  A phrase goes if it lies inside a longer one of ``least`` occurrences that
    has ``share`` percent of its own at least.  Order: score and a descending, then the phrase's bytes.

    A null language is ``und``; languages are told by their exact text.  A null or empty text has no pieces; repeated
    rows count each; doc_id plays no part.  A very long text is pieces like any other.  Other columns are ignored,
    whatever their names.  An empty table, or one without frequent phrases, gives no rows.
    """
    if longest < 2 or min(least, top) < 1 or not 0 <= share <= 100:
        raise ValueError("phrases have two words at least; least and top are positive; share lies from 0 to 100")
    counts = frequent(docs, longest, least)
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    # Requests for the counts of both parts of every cut, answered where the counts are.
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "size", "a", cut)
    left, right = F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "), F.array_join(F.slice(words, F.col("cut") + 1, F.col("size")), " ")
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("first"), left.alias("part")), F.struct(F.lit(False).alias("first"), right.alias("part")))).alias("x"))
    asked = asked.select("lang", "phrase", "a", "cut", "x.*")
    known = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    answers = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("of_part"))).alias("l"), F.max(F.when(~F.col("first"), F.col("of_part"))).alias("r"))
    best_cut = answers.withColumn("score", scored("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst")).select("lang", "phrase", "a", "worst.score", "worst.l", "worst.r")

    # Phrases inside longer ones.
    at, many = F.col("at"), F.col("many")
    inner = phrases.where("size > 2").select("lang", "a", "size", words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("many"))
    inner = inner.select("lang", "a", "words", "many", F.explode(F.sequence(F.lit(1), F.col("size") - many + 1)).alias("at"))
    longer = inner.select("lang", F.array_join(F.slice("words", at, many), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best_cut.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")

    # The best of each share of a language, then of the language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
