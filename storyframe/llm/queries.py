"""One query for each corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, collocations, media, mixing, ngram_jaccard, packing, preference, quality, resampling, topk, toxicity, urls, wordpiece
from .common import held_out, table

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its toxicity score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) as preference pairs; spans as start-end, joined by commas."""
    turns = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        F.col("turn").cast("long").alias("turn"), "role", "text",
    )

    def listed(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["to"].cast("string"))), ",").alias(name)

    pairs = preference.preference_pairs(turns)
    return pairs.select("pair_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", listed("chosen_spans"), listed("rejected_spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in its document and its sequence, and the checksum of its token ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words and the pieces of their greedy longest match."""
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), byte_level=True)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the rule that decides it, or the verdict of its path template."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many of its words the mix takes, and its shard."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text as stored media, read back."""
    found = media.document_media(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of 5-word shingles and the component of documents within Jaccard 0.75."""
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its likeness to the benchmark texts, and its rank among those drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in its document and its sequence, and the checksum of its token ids."""
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), ids=False)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: its best phrases of two and three words."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_preference_formatting, op3_quality_classifier, op4_packing, op5_token_counts, op6_url_filters, op7_mixing, op8_media_columns, op9_ngram_jaccard_join, op10_exact_top_k,
                                     op11_importance_resampling, op12_best_fit_packing, op13_phrase_collocations)}


_PREFERENCE_SQL = r"""
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) - 1 as i, role, text,
         '<|' || coalesce(role, '') || '|>' || chr(10) as head, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) as shown
  from conversations),
m as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.i, b.i)) as n
  from (select * from t where side = 0) a full join (select * from t where side = 1) b on a.pair_id = b.pair_id and a.i = b.i
  where a.i is null or b.i is null or a.role is distinct from b.role or a.text is distinct from b.text group by 1),
p as (select pair_id, max(k) as longest from (select pair_id, side, count(*) as k from t group by 1, 2) group by 1),
u as (
  select t.*, coalesce(m.n, p.longest) as n from t join p using (pair_id) left join m using (pair_id)),
v as (
  select *, coalesce(sum(length(shown)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as begins from u where i >= n)
select q.pair_id, q.n as n_prompt_turns,
  coalesce((select string_agg(shown, '' order by i) from u where u.pair_id = q.pair_id and side = 0 and i < n), '') as prompt,
  coalesce((select string_agg(shown, '' order by i) from v where v.pair_id = q.pair_id and side = 0), '') as chosen,
  coalesce((select string_agg(shown, '' order by i) from v where v.pair_id = q.pair_id and side = 1), '') as rejected,
  coalesce((select string_agg(cast(begins + length(head) as bigint)::varchar || '-' || cast(begins + length(shown) as bigint)::varchar, ',' order by i) from v where v.pair_id = q.pair_id and side = 0 and role = 'assistant'), '') as chosen_spans,
  coalesce((select string_agg(cast(begins + length(head) as bigint)::varchar || '-' || cast(begins + length(shown) as bigint)::varchar, ',' order by i) from v where v.pair_id = q.pair_id and side = 1 and role = 'assistant'), '') as rejected_spans
from (select distinct pair_id, n from u) q
"""

_TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


_RESAMPLING_SQL = r"""
with recursive crc_table(k, n, c) as (
  select 0, n, n from range(256) t(n)
  union all select k + 1, n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_table where k < 8),
steps as materialized (select list(c order by n) as step from crc_table where k = 8),
texts as materialized (
  select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as materialized (
  select side, id, row_number() over () as row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as materialized (
  select row, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from w),
b as materialized (
  select feature, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(feature)), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::bigint)),
                                  lambda c, x: xor(step[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from (select distinct feature from f) cross join steps),
counts as (
  select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from f join b using (feature) group by bucket),
sizes as (select sum(s)::double as s_all, sum(t)::double as t_all from counts),
gains as (
  select bucket, floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint as gain from counts cross join sizes),
means as (
  select row, sum(gain)::bigint as total, count(*) as n from f join b using (feature) join gains using (bucket) where side = 0 group by row),
h as (
  select w.id, len(w.w) as words, coalesce(n, 0) as n_features, case when n is null then 0 else (total - ((total % n) + n) % n) // n end as weight,
         ('0x' || substr(sha256('7:' || w.id), 1, 8))::bigint as h
  from w left join means using (row) where side = 0),
scored as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
ranked as (
  select *, case when words >= 20 and id is not null then row_number() over (partition by words >= 20 and id is not null order by score desc, id) end as r,
         count(*) filter (words >= 20 and id is not null) over () as able from scored)
select id as doc_id, n_features, weight, score, case when r <= 25 * able // 100 then r end as rank from ranked
"""


_COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (
  select lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') as w from pieces),
runs as (
  select lang, 1 as k, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
f as materialized (select lang, k, phrase, count(*) as n from runs group by all),
c as materialized (select lang, k, phrase, string_split(phrase, ' ') as words, n as a from f where k > 1 and n >= 10),
asked as materialized (
  select lang, k, phrase, a, 1 as j, words[1] as first, array_to_string(words[2:], ' ') as rest from c
  union all select lang, k, phrase, a, 2, array_to_string(words[1:2], ' '), words[3] from c where k = 3),
cuts as (
  select asked.*, l.n as l, r.n as r, (1000000::hugeint * a * a) // (l.n::hugeint * r.n) as score
  from asked join f l on l.lang = asked.lang and l.phrase = asked.first join f r on r.lang = asked.lang and r.phrase = asked.rest),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
held as (
  select lang, phrase, max(a) as longer from (
    select lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) as phrase from c where k = 3) group by all),
kept as (
  select worst.* from worst left join held using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept),
totals as (select lang, sum(n)::bigint as n from f where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_preference_formatting": _PREFERENCE_SQL, "op10_exact_top_k": _TOP_K_SQL, "op11_importance_resampling": _RESAMPLING_SQL, "op13_phrase_collocations": _COLLOCATIONS_SQL}
