"""A corpus pipeline of the operators in storyframe.llm: what is left of documents after five stages, as packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.llm import mixing, ngram_jaccard, packing, quality, toxicity
from storyframe.llm.common import table
from storyframe.llm.queries import WORD_BPE, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model is learned from the labelled rows of all documents.

    Rows are judged each by themselves: equal texts stay or go together, repeated rows and null ids stay as often as they
    come.  A null or empty text has no hits, so it stays; very long texts are judged whole; no rows give none.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxic_score < 0.5").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the model is learned from the labelled rows of all documents.

    Rows are judged each by themselves: equal texts stay or go together, repeated rows and null ids stay as often as they
    come.  A null text is judged as an empty one; very long texts are judged whole; no rows give none.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("quality_score >= 0.3").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id (one row of it); without words, all.

    Null texts and texts without words are linked with nothing and stay, and so do rows with a null doc_id, which can't
    be told.  Of rows that repeat a kept doc_id the smallest (by text, then the other columns, nulls first) stays.
    """
    found = ngram_jaccard.near_duplicates(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    # Rows that repeat a document: the first text stays.
    again = found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    one = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(one).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by shard and in the order of their shard; some are cut to first words.

    Every row is taken by itself: repeated rows and null ids have their own share, a null source is a source.  A null
    text, or one without words, has nothing to take and goes.  A cut text is its first words, joined by single spaces.
    Ties of place are in order of id.  No rows give none.
    """
    rows = mixing.mix(docs, carry=("text", "lang", "n_chars")).where("taken > 0")
    part = F.col("taken") % F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORDS})"), 1), F.lit(1), part.cast("int")), " ")
    whole = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("taken") / F.col("size")).cast("int")))).where(F.col("copy") < F.floor(F.col("taken") / F.col("size")))
    some = rows.where(part > 0).withColumn("text", cut).withColumn("n_chars", F.length("text").cast("long")).withColumn("copy", F.lit(-1))
    order = ["shard", F.xxhash64("place", "copy"), "doc_id"]
    both = whole.unionByName(some).select(*COLUMNS, "shard", "place", "copy")
    return both.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Every row is packed by itself, repeated ones and null ids too; a null or empty text is its end token alone; very long
    texts are cut into as many sequences as they fill; no rows give none.
    """
    pieces = packing.pack(docs, tokenizer_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# SQL can't express the learned scores: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; each is written to the shared folder and read again."""
    from storyframe.llm.common import written

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
