"""The queries over the driver tables, each with its DuckDB SQL (none where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import keys as K
from ..functions import text as T
from ..functions import options, prompts
from ..functions.audio import levelled
from ..functions.blocks import parse_blocks
from ..functions.lexicon import CORPUS_LEXICON
from ..functions.vectors import doubles, norm
from ..operators import arcs, casting, checkpoint, excerpts, gallery, labels, layout, mixing, narration, pacing
from ..sources import files
from ..sources.tables import blocks, boxes, marks, segments, table
from ..streaming.sessions import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Shared pieces of SQL.
_BLOCKS = """blocks as (select conv_id::varchar as volume, turn::int as pos, (turn // 2)::int as panel, text,
  case when role = 'system' then 'Narrator' else role end as speaker_id, role <> 'system' as is_speech from conversations)"""
_ANNOUNCED = _BLOCKS + """,
announced as (select *, last_value(case when is_speech then speaker_id end ignore nulls) over (partition by volume order by pos rows between unbounded preceding and 1 preceding) as previous from blocks),
named as (select *, is_speech and speaker_id <> 'Narrator' and speaker_id is distinct from previous as announce from announced)"""
_PLAN = _ANNOUNCED + """,
items as (
  select volume, pos, 'announcement' as kind, 'Narrator' as speaker_id, speaker_id as text, text as seed, 0 as sub from named where announce
  union all select volume, pos, 'speech', speaker_id, text, text, case when announce then 1 else 0 end from named),
plan as (select *, row_number() over (partition by volume order by pos, sub) - 1 as block_index from items)"""
_SEGMENTS = "segments as (select user_id as file, event_id, epoch_us(ts) / 1e6 as start, epoch_us(ts) / 1e6 + value as fin, event_type as text from events)"
_PAUSED = _SEGMENTS + """,
paused as (select *, greatest(fin - start, 0.0) as duration,
  case when lead(start) over w is not null then greatest(lead(start) over w - fin, 0.0) end as pause from segments window w as (partition by file order by start, fin, event_id))"""
_BOXES = """boxes as (select l_orderkey as page, l_linenumber, l_partkey, l_suppkey, (l_partkey * 37) % 900 as x0, (l_suppkey * 53) % 1300 as y0,
  (l_partkey * 37) % 900 + 20 + l_quantity::int as x1, (l_suppkey * 53) % 1300 + 20 + l_partkey % 60 as y1, l_returnflag from lineitem)"""
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'), '{}[]|_~^`<>\/ ')"


# Narration.
@query(f"with {_PLAN} select volume, pos, kind, speaker_id, text, block_index from plan")
def narration_plan(spark, d):
    """The plan's items in order."""
    return narration.plan(blocks(spark, d)).select("volume", "pos", "kind", "speaker_id", "text", F.col("block_index").cast("long").alias("block_index"))


@query(f"with {_PLAN} select kind, count(*) as n, count(distinct volume) as volumes from plan group by kind")
def narration_kind_counts(spark, d):
    """The flagship: items of each kind."""
    return narration.plan(blocks(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("volume").alias("volumes"))


@query(f"with {_ANNOUNCED} select volume, pos, speaker_id, previous from named where announce")
def speaker_change_announcements(spark, d):
    """Where a speaker is announced."""
    return narration.with_announcements(blocks(spark, d)).where("announce").select("volume", "pos", "speaker_id", "previous")


@query(f"with {_BLOCKS} select speaker_id, count(*) as blocks, count(distinct volume || ':' || panel) as panels from blocks group by speaker_id")
def block_counts_by_speaker(spark, d):
    """A1, A2: blocks and panels of each speaker."""
    return blocks(spark, d).groupBy("speaker_id").agg(F.count("*").alias("blocks"), F.countDistinct(F.concat_ws(":", "volume", F.col("panel").cast("string"))).alias("panels"))


@query(f"with {_PLAN} select volume, block_index, greatest(300, 60 * length(text)) as duration_ms, coalesce(sum(greatest(300, 60 * length(text)) + 250) over (partition by volume order by block_index rows between unbounded preceding and 1 preceding), 0)::bigint as offset_ms from plan")
def segment_timeline_offsets(spark, d):
    """Silent durations and their offsets with gaps of 250 ms."""
    plan = narration.plan(blocks(spark, d)).select("volume", F.col("block_index").cast("long").alias("block_index"), K.silent_ms(F.col("text")).alias("duration_ms"))
    return narration.timeline(plan, 250)


def _tag_sql(column: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({column}), '{k}')" for k in ks) + f" then '{t}'" for t, ks in CORPUS_LEXICON) + " end"


@query(f"select doc_id, {_tag_sql('text')} as tag from documents")
def sfx_keyword_tag(spark, d):
    """The first tag with a keyword in the text."""
    return table(spark, d, "documents").select("doc_id", T.keyword_tag(F.col("text"), CORPUS_LEXICON).alias("tag"))


@query(f"select tag, count(*) as n from (select {_tag_sql('text')} as tag from documents) where tag is not null group by tag")
def sfx_usage(spark, d):
    """A3: uses of each tag."""
    return sfx_keyword_tag(spark, d).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


@query(f"""with {_BLOCKS}, tagged as (select *, {_tag_sql('text')} as tag, unnest([1, 2, 3]) as intensity from blocks),
ranked as (select *, tag is not null and (not is_speech or intensity >= 3) as may from tagged)
select intensity, volume, pos, case when may and sum(may::int) over (partition by intensity, volume, panel order by pos) <= intensity then tag end as sfx from ranked""")
def sfx_intensity_cap(spark, d):
    """Tags kept under each panel's cap."""
    rows = blocks(spark, d).withColumn("tag", T.keyword_tag(F.col("text"), CORPUS_LEXICON)).withColumn("intensity", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return narration.capped_by(rows, F.col("tag"), F.col("intensity"), "intensity").select("intensity", "volume", "pos", "sfx")


@query(f"""with v(tag, ord, file) as (values ('sword', 0, 'sword_a'), ('sword', 1, 'sword_b'), ('storm', 0, 'storm_a'), ('steps', 0, 'steps_a'), ('steps', 1, 'steps_b'), ('steps', 2, 'steps_c')),
n as (select tag, count(*) as n from v group by tag), t as (select doc_id, {_tag_sql('text')} as tag from documents)
select doc_id, tag, file from t join n using (tag) join v using (tag) where v.ord = ('0x' || substr(sha1(tag || ':' || doc_id), 1, 8))::bigint % n""")
def sfx_variant_choice(spark, d):
    """One variant for each use, by hash; unknown tags are skipped."""
    v = spark.createDataFrame([("sword", 0, "sword_a"), ("sword", 1, "sword_b"), ("storm", 0, "storm_a"), ("steps", 0, "steps_a"), ("steps", 1, "steps_b"), ("steps", 2, "steps_c")], "tag string, ord int, file string")
    choice = sfx_keyword_tag(spark, d).join(v.groupBy("tag").agg(F.count("*").alias("n")), "tag").withColumn("ord", K.variant_index(F.col("tag"), F.col("doc_id").cast("string"), F.col("n")))
    return choice.join(v.withColumn("ord", F.col("ord").cast("long")), ["tag", "ord"]).select("doc_id", "tag", "file")


# Text.
@query(f"select doc_id, {_CLEAN} as cleaned from documents")
def clean_text(spark, d):
    """C1."""
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def _junk_sql(source: str, keys: str) -> str:
    return rf"""with src as ({source}), c as (select {keys}, {_CLEAN} as t from src),
f as (select *, length(t) as n, len(regexp_extract_all(t, '\p{{L}}')) as letters, len(regexp_extract_all(t, '[\p{{Nd}}²³¹]')) as digits,
  len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_\sÀ-ÿ.,;:!?''"()\-–—…%$°ºª]')) as foreign_, list_filter(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+'), lambda w: length(w) >= 5) as long_words from c)
select {keys}, case when n = 0 then true when letters = 0 and digits = 0 then not (n <= 3 and regexp_matches(t, '^[?!….]+$')) when n < 2 then not contains('aeoáéóâêôãõàAEOÁÉÓÂÊÔÃÕÀ', t)
  when foreign_ > 0 and letters <= 6 then true when foreign_ > 0.2 * n then true
  else len(long_words) > 0 and len(list_filter(long_words, lambda w: regexp_matches(lower(w), '[aeiouyáéíóúâêôãõà]') or len(list_distinct(string_split(lower(w), ''))) < 3)) = 0 end as junk from f"""


@query(_junk_sql("select distinct unnest(regexp_split_to_array(trim(text), '\\s+')) as text from documents", "text").replace("select text, text", "select text"))
def junk_flag(spark, d):
    """C2 (F2): over the distinct words of all documents."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.trim("text"), r"\s+")).alias("text")).distinct()
    return words.select("text", T.is_junk(F.col("text")).alias("junk"))


@query("select lang, count(*) as n, count(*) filter (where junk) as junk from (" + _junk_sql("select doc_id, lang, text from documents", "doc_id, lang") + ") group by lang")
def junk_rate_by_lang(spark, d):
    """C2 over whole documents."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_junk(F.col("text"))).alias("junk"))


_SPOKEN = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate(text, '"“”*«»[]', ''), '…', '...'), '\s*\.{3,}\s*', ', ', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '\s+', ' ', 'g')), '\s*,\s*$', ''), '\.+$', ''))"""


@query(f"select doc_id, case when {_SPOKEN} = '' then text else {_SPOKEN} end as spoken from documents")
def speech_normalised(spark, d):
    """C3 (X2)."""
    return table(spark, d, "documents").select("doc_id", T.speech_form(F.col("text")).alias("spoken"))


@query(rf"select doc_id, regexp_matches(case when {_SPOKEN} = '' then text else {_SPOKEN} end, '[\p{{L}}\p{{N}}]') as pronounceable from documents")
def pronounceable(spark, d):
    """F5."""
    return table(spark, d, "documents").select("doc_id", T.is_pronounceable(F.col("text")).alias("pronounceable"))


_WORDS = r"len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))"


@query(f"select doc_id, {_WORDS} as words from documents")
def word_counts(spark, d):
    """X3."""
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


_CUES, _CUE_PHRASES = ("onre", "avec", "nicht", "para", "und", "thing"), ("de la", "of the", "der ")
_TRIPLE = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâêîôûçèëï")
_ENDINGS = "ou|eu|iu|ava|avam|iam|ando|endo|indo"


@query(rf"""with t as (select doc_id, text, lower(text) as low, regexp_extract_all(lower(text), '\p{{L}}+') as tokens, {_WORDS} as words from documents),
h as (select *, len(list_filter(tokens, lambda w: w in {_CUES})) + {' + '.join(f"(length(low) - length(replace(low, '{p}', ''))) / {len(p)}" for p in _CUE_PHRASES)}
  + len(list_filter(tokens, lambda w: length(w) >= 4 and regexp_matches(w, '({_ENDINGS})$'))) + len(list_filter(tokens, lambda w: regexp_matches(w, '{_TRIPLE}'))) as hits from t)
select doc_id, case when len(tokens) = 0 then 0.0 else round(hits / greatest(words, 20, 1), 4) end as score from h""")
def narration_scores(spark, d):
    """C9 (A20) with a cue lexicon for the driver's prose."""
    return table(spark, d, "documents").select("doc_id", T.narration_score(F.col("text"), 20, _CUES, _CUE_PHRASES).alias("score"))


# Pages, keys and names.
@query("select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') as slug from pages")
def slug_volumes(spark, d):
    """P9."""
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("select page_id, printf('page_%03d', page_id) as page, printf('page%03d_panel%02d', page_id, page_id % 7) as crop, printf('page_%03d_panel%02d/b%d', page_id, page_id % 7, page_id % 3) as bubble, printf('page_%03d/body%02d', page_id, page_id % 5) as body from pages")
def page_keys(spark, d):
    """File names and label keys."""
    n = F.col("page_id")
    return table(spark, d, "pages").select("page_id", K.page_key(n).alias("page"), K.crop_name(n, n % 7).alias("crop"), K.bubble_key(n, n % 7, n % 3).alias("bubble"), K.body_key(n, n % 5).alias("body"))


@query("select page_id, url from pages where page_id between 11 and 60")
def page_range(spark, d):
    """The page range of a fingerprint, filtered in the scan (the range is the feature)."""
    first = 11
    return files.page_range(table(spark, d, "pages").select("page_id", "url"), first, 50)


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url || '/v1/', '/+$', ''), '/v1$', ''), '/+$', '') as server from pages")
def url_normalise(spark, d):
    """Of every url with /v1/ appended."""
    return table(spark, d, "pages").select("page_id", K.server_url(F.concat("url", F.lit("/v1/"))).alias("server"))


@query("select event_id, (props::json ->> 'k')::bigint as k from events")
def json_props_parse(spark, d):
    """Fields out of JSON text, null where broken."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select event_id, 'engine:first=' || (event_id % 90) || ':' || substr(sha1(event_type), 1, 8) as fingerprint, (event_id % 90)::int as first_page from events")
def fingerprints(spark, d):
    """Fingerprints, and the first page read from them."""
    f = K.fingerprint(F.lit("engine"), F.concat(F.lit("first="), (F.col("event_id") % 90).cast("string")), prompt=F.col("event_type"))
    return table(spark, d, "events").select("event_id", f.alias("fingerprint"), K.first_page(f).alias("first_page"))


@query("select event_id, printf('%02d:%02d:%02d', (event_id * 7) // 3600, ((event_id * 7) // 60) % 60, (event_id * 7) % 60) as stamp, (event_id * 7)::double as seconds from events")
def timestamp_format_roundtrip(spark, d):
    """P12, P13."""
    rows = table(spark, d, "events").select("event_id", K.timestamp_text(F.col("event_id") * 7).alias("stamp"))
    return rows.withColumn("seconds", K.timestamp_seconds(F.col("stamp")))


@query("select o_orderkey, printf('%+d%%', (5 + round_even(((o_orderkey % 7) / 8.0) * 100 - 50, 0))::int) as rate, round_even((o_orderkey % 100000) * 1000 / 24000.0, 0)::bigint as ms from orders")
def speech_rate_and_length(spark, d):
    """Rate text and frames to milliseconds."""
    speed = (F.col("o_orderkey") % 7) / 8.0 + 0.5
    return table(spark, d, "orders").select("o_orderkey", K.rate_text(F.lit(5), speed).alias("rate"), K.frames_ms(F.col("o_orderkey") % 100000, 24000).alias("ms"))


# Voices.
_VOTES = "votes as (select conv_id::varchar as volume, role as speaker_id, turn as pos, [null, 'homem', 'idoso', 'mulher'][(length(text) % 4 + 1)::int] as voice, role <> 'system' as is_speech from conversations)"


def _votes(spark, d):
    profile = F.element_at(F.array(F.lit(None), F.lit("homem"), F.lit("idoso"), F.lit("mulher")), (F.length("text") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("volume"), F.col("role").alias("speaker_id"), F.col("turn").alias("pos"), profile.alias("voice"), (F.col("role") != "system").alias("is_speech"))


_MAJORITY = """c as (select volume, speaker_id, voice, count(*) as n, min(pos) as first from votes group by all),
r as (select *, row_number() over (partition by volume, speaker_id order by (voice is null)::int, n desc, first) as k from c)
select volume, speaker_id, voice as profile from r where k = 1"""


@query(f"with {_VOTES}, {_MAJORITY}")
def majority_profile(spark, d):
    """A5."""
    return casting.majority_profile(_votes(spark, d))


@query(f"with {_VOTES.replace('votes as', 'raw as')}, votes as (select volume, speaker_id, voice, row_number() over (partition by volume, speaker_id order by version, pos) as pos from (select *, 0 as version from raw where pos % 2 = 0 union all select *, 1 from raw) where is_speech), {_MAJORITY}")
def profile_across_versions(spark, d):
    """A partly lost reviewed version before the raw one."""
    v = _votes(spark, d)
    return casting.profiles_across_versions(v.where("pos % 2 = 0"), v)


@query("select conv_id, turn, ['A', 'B', 'C', 'D', 'E'][(('0x' || substr(sha1(text), 1, 4))::bigint % 5 + 1)::int] as voice from conversations")
def voice_pick_stateless(spark, d):
    """A voice by stable index, nobody's in use."""
    pool = F.array(*[F.lit(x) for x in "ABCDE"])
    return table(spark, d, "conversations").select("conv_id", "turn", casting.pick(F.col("text"), pool).alias("voice"))


@query(f"""with recursive {_VOTES}, profiles as (with {_MAJORITY.strip()}),
c as (select volume, speaker_id, row_number() over (partition by volume order by speaker_id) as r, case profile when 'homem' then ['A', 'B'] when 'idoso' then ['C'] when 'mulher' then ['D', 'E'] else ['Z'] end as pool,
  ('0x' || substr(sha1(speaker_id), 1, 4))::bigint as h from profiles),
q as (select *, list_concat(pool[(h % len(pool))::int + 1:], pool[:(h % len(pool))::int]) as turn from c),
t(volume, r, speaker_id, voice, used) as (select distinct volume, 0::bigint, null::varchar, null::varchar, []::varchar[] from q
  union all select volume, r, speaker_id, voice, list_append(used, voice) from (
    select q.volume, q.r, q.speaker_id, t.used, case when q.speaker_id = 'assistant' then 'Curated' else coalesce(list_filter(q.turn, lambda v: not list_contains(t.used, v))[1], q.turn[1]) end as voice from t join q on q.volume = t.volume and q.r = t.r + 1))
select volume, speaker_id, voice from t where r > 0""")
def voice_registry_fold(spark, d):
    """A fold over each volume's cast."""
    profiles = casting.majority_profile(_votes(spark, d))
    return casting.cast_voices(profiles, {"assistant": "Curated"}, {"homem": ["A", "B"], "idoso": ["C"], "mulher": ["D", "E"]}, ["Z"])


# Review.
_PANELS = "panels as (select conv_id::varchar as volume, (turn // 2)::int as panel, list(text order by turn) as blocks, list(distinct role) as speakers from conversations group by all)"


def _panels(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("volume"), F.floor(F.col("turn") / 2).cast("int").alias("panel"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("blocks"), F.collect_set("role").alias("speakers"))


@query(f"with {_PANELS} select volume, panel, case when panel % 3 = 0 then array_to_string(list_transform(blocks, lambda x: x || '!'), '|') else array_to_string(blocks, '|') end as text, panel % 3 = 0 and list_transform(blocks, lambda x: x || '!') <> blocks as changed from panels")
def review_patch_merge(spark, d):
    """Every third panel reviewed, every other third with an empty review."""
    p = _panels(spark, d)
    new = F.when(F.col("panel") % 3 == 0, F.transform("blocks", lambda x: F.concat(x, F.lit("!")))).otherwise(F.array().cast("array<string>"))
    patches = p.where("panel % 3 <> 1").select("volume", "panel", new.alias("blocks"))
    return narration.review_patch(p.select("volume", "panel", "blocks"), patches).select("volume", "panel", F.array_join("blocks", "|").alias("text"), "changed")


@query(f"""with {_PANELS}, c as (select *, (row_number() over (partition by volume order by panel) - 1) // 2 as chunk from panels)
select volume, panel, chunk, coalesce((select string_agg(s, ',' order by s) from (select distinct unnest(speakers) as s from c b where b.volume = c.volume and b.chunk < c.chunk)), '') as labels_seen from c""")
def review_chunks(spark, d):
    """Chunks of two panels and the speakers seen before."""
    rows = narration.review_chunks(_panels(spark, d).select("volume", "panel", "speakers"), 2)
    return rows.select("volume", "panel", "chunk", F.array_join("labels_seen", ",").alias("labels_seen"))


# Labels.
_ITEMS = "items as (select 'doc' as mode, doc_id::varchar as key, text from documents)"


def _items(spark, d):
    return table(spark, d, "documents").select(F.lit("doc").alias("mode"), F.col("doc_id").cast("string").alias("key"), "text")


def _labels(spark, d):
    """Labels of documents; those of every tenth document were given to another text."""
    text = F.when(F.col("doc_id") % 10 == 0, F.lit("old")).otherwise(F.col("text"))
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.lit("doc").alias("mode"), F.col("doc_id").cast("string").alias("key"), text.alias("text"), F.col("quality").alias("label"))


_LABELS = "known as (select 'doc' as mode, doc_id::varchar as key, case when doc_id % 10 = 0 then 'old' else text end as text, quality as label from labels join documents using (doc_id))"


@query(f"with {_ITEMS}, {_LABELS} select mode, key, text from items where not exists (select 1 from known where known.key = items.key and (coalesce(items.text, '') = '' or coalesce(known.text, '') = '' or items.text = known.text))")
def pending_items(spark, d):
    """F11, F12, J4."""
    return labels.pending(_items(spark, d), _labels(spark, d))


@query(f"with {_LABELS}, new as (select 'doc' as mode, doc_id::varchar as key, 'new' as text, 9 as label from labels where doc_id % 4 = 0) select * from new union all select * from known where key not in (select key from new)")
def label_upsert(spark, d):
    """S6."""
    new = table(spark, d, "labels").where("doc_id % 4 = 0").select(F.lit("doc").alias("mode"), F.col("doc_id").cast("string").alias("key"), F.lit("new").alias("text"), F.lit(9).alias("label"))
    return labels.upsert(_labels(spark, d), new, ["mode", "key"])


@query("with c as (select *, count(*) over (partition by label) as n from embeddings where label is not null) select vec_id, label from c where n >= 50 or label = 9")
def label_eligibility(spark, d):
    """labels with 50 crops, and the unknown one (9)."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("label").cast("string").alias("name"))
    return gallery.eligible(rows, 50, "9").select("vec_id", "label")


@query("with j as (select doc_id, length(text) < 200 as predicted from documents) select quality = 0 as truth, predicted, count(*) as n from labels join j using (doc_id) group by all")
def prediction_confusion(spark, d):
    """A8's shape: a text predicate against labels."""
    docs = table(spark, d, "documents").select("doc_id", (F.length("text") < 200).alias("predicted"))
    return labels.confusion(table(spark, d, "labels").join(docs, "doc_id").withColumn("truth", F.col("quality") == 0), "truth", "predicted")


@query("select l_orderkey, max(l_linenumber) as true_count, count(*) as predicted, case when max(l_linenumber) = count(*) then 'ok' when count(*) < max(l_linenumber) then 'under' else 'over' end as verdict from lineitem group by 1")
def panel_count_verdict(spark, d):
    """P35."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("true_count"), F.count("*").alias("predicted"))
    return rows.withColumn("verdict", labels.count_verdict(F.col("true_count"), F.col("predicted")))


# Pacing and arcs.
def _worded(spark, d):
    return segments(spark, d).withColumn("words", T.word_count(F.col("text")).cast("long"))


@query(f"""with {_PAUSED} select file, count(*) as segments, count(*) as words, round(coalesce(max_by(fin, struct_pack(s := start, f := fin)) - min(start), 0), 3) as total_s, round(sum(duration), 3) as speech_s,
  round(coalesce(sum(duration) / nullif(max_by(fin, struct_pack(s := start, f := fin)) - min(start), 0), 0), 3) as speech_ratio, round(coalesce(count(*) * 60.0 / nullif(sum(duration), 0), 0), 3) as wpm_speech,
  round(coalesce(count(*) * 60.0 / nullif(max_by(fin, struct_pack(s := start, f := fin)) - min(start), 0), 0), 3) as wpm_total,
  round(quantile_cont(duration, 0.1), 3) as duration_p10, round(quantile_cont(duration, 0.5), 3) as duration_p50, round(quantile_cont(duration, 0.9), 3) as duration_p90,
  count(pause) as pauses, round(coalesce(avg(pause), 0), 3) as pause_mean, round(coalesce(quantile_cont(pause, 0.5), 0), 3) as pause_median, round(coalesce(quantile_cont(pause, 0.9), 0), 3) as pause_p90,
  count(*) filter (where pause >= 3600) as long_pauses from paused group by file""")
def pacing_stats(spark, d):
    """One row per file."""
    return pacing.statistics(_worded(spark, d), 3600.0, "event_id")


@query(f"with {_PAUSED} select file, count(pause) as n, coalesce(quantile_cont(pause, 0.1), 0) as p10, coalesce(quantile_cont(pause, 0.5), 0) as p50, coalesce(quantile_cont(pause, 0.9), 0) as p90 from paused group by file")
def pause_percentiles(spark, d):
    """Exact percentiles."""
    rows = pacing.with_pauses(segments(spark, d), "event_id").groupBy("file").agg(F.count("pause").alias("n"), *[F.coalesce(F.percentile("pause", F.lit(p / 100)), F.lit(0.0)).alias(f"p{p}") for p in (10, 50, 90)])
    return rows


@query(f"with {_PAUSED}, r as (select *, row_number() over (partition by file order by pause desc, start, fin, event_id) as rank from paused where pause >= 3600) select file, rank, fin as at_s, pause as gap_s from r where rank <= 5")
def long_pauses(spark, d):
    """The five longest of each file."""
    return pacing.long_pauses(segments(spark, d), 3600.0, 5, "event_id")


@query(f"with {_SEGMENTS}, m as (select user_id as file, epoch_us(ts) / 1e6 as start_s, event_id as title from events where event_type = 'signup') select s.file, s.event_id, m.title from segments s asof left join m on s.file = m.file and s.start >= m.start_s")
def arc_asof(spark, d):
    """The arc that started last."""
    return arcs.as_of(segments(spark, d).select("file", "event_id", "start"), marks(spark, d), ["file"], "start", "start_s", "title").select("file", "event_id", "title")


@query("select user_id as file, event_id as title, epoch_us(ts) / 1e6 as start_s, lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) as end_s from events where event_type = 'signup'")
def arc_bounds(spark, d):
    """Until the next arc; the last is open."""
    return arcs.bounds(marks(spark, d), ["file"])


@query(f"with {_SEGMENTS}, m as (select user_id as file, epoch_us(ts) / 1e6 as start_s, event_id as title from events where event_type = 'signup'), a as (select s.file, s.event_id, s.start, m.title from segments s asof left join m on s.file = m.file and s.start >= m.start_s), h as (select *, lag(title) over (partition by file order by start, event_id) as before from a) select file, event_id, title as heading from h where title is not null and title is distinct from before")
def arc_headings(spark, d):
    """A heading where the arc changes."""
    rows = arcs.as_of(segments(spark, d).select("file", "event_id", "start"), marks(spark, d), ["file"], "start", "start_s", "title")
    return arcs.headings(rows, ["file"], ["start", "event_id"]).where("heading is not null").select("file", "event_id", "heading")


_NUMBERED = _SEGMENTS + ", p as (select *, row_number() over (partition by file order by start, fin, event_id) as pos from segments)"


@query(f"""with {_NUMBERED}, late as (select a.file, a.pos as first, min(b.pos) as stop from p a join p b on a.file = b.file and b.pos > a.pos and b.fin - a.start > 7200 group by all)
select a.file, a.pos as first, a.start, max_by(b.fin, b.pos) as "end", count(*) as segments from p a left join late on late.file = a.file and late.first = a.pos join p b on b.file = a.file and b.pos >= a.pos and (stop is null or b.pos < stop) group by a.file, a.pos, a.start""")
def excerpt_windows(spark, d):
    """Runs of segments within two hours of each segment."""
    return excerpts.windows(excerpts.numbered(segments(spark, d), "event_id"), 7200.0)


@query(f"""with {_NUMBERED}, late as (select a.file, a.pos as first, min(b.pos) as stop from p a join p b on a.file = b.file and b.pos > a.pos and b.fin - a.start > 7200 group by all),
w as (select a.file, a.pos as first, a.start, max_by(b.fin, b.pos) as fin, count(*) as segments from p a left join late on late.file = a.file and late.first = a.pos join p b on b.file = a.file and b.pos >= a.pos and (stop is null or b.pos < stop) group by a.file, a.pos, a.start),
t as (select file, min(start) as t0, max_by(fin, struct_pack(s := start, f := fin)) as t1 from segments group by file),
x as (select w.*, segments / 10.0::double as score, t0, t1, least(2, trunc((start - t0) / greatest(t1 - t0, 1e-9) * 3))::int as bin from w join t using (file)),
b0 as (select distinct on (file) * from x where bin = 0 order by file, score desc, start, first),
b1 as (select distinct on (x.file) x.* from x left join b0 on b0.file = x.file where x.bin = 1 and x.start >= coalesce(b0.fin, -1e300) order by x.file, x.score desc, x.start, x.first),
b2 as (select distinct on (x.file) x.* from x left join b0 on b0.file = x.file left join b1 on b1.file = x.file where x.bin = 2 and x.start >= coalesce(b1.fin, b0.fin, -1e300) order by x.file, x.score desc, x.start, x.first)
select file, first, start, fin as "end", segments, score, t0, t1 from (from b0 union all from b1 union all from b2)""")
def excerpt_selection(spark, d):
    """T5: up to three windows of each file, a fold over its bins."""
    rows = excerpt_windows(spark, d)
    t = segments(spark, d).groupBy("file").agg(F.min("start").alias("t0"), F.max_by("end", F.struct("start", "end")).alias("t1"))
    return excerpts.select(rows.withColumn("score", F.col("segments") / 10.0).join(t, "file"), 3, "file long, first long, start double, `end` double, segments long, score double, t0 double, t1 double")


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def sessions_by_pause(spark, d):
    """W5 as sessions (extension)."""
    return sessions(table(spark, d, "events").select("ts", "user_id"))


# Gallery.
_UNIT = "u as (select vec_id as id, label::varchar as name, list_transform(embedding, lambda x: x::double) as r from embeddings), g as (select id, name, list_transform(r, lambda x: x / greatest(sqrt(list_dot_product(r, r)), 1e-12)) as v from u)"
_NEAREST = _UNIT + ", named as (select * from g where name <> '9'), s as (select q.id, e.name, max(list_dot_product(q.v, e.v)) as score from g q join named e on q.id <> e.id group by all)"
_MATCH = _NEAREST + ", k as (select *, row_number() over (partition by id order by score desc, name) as r from s), top as (select a.id, a.name as best, a.score, b.name as runner_up, coalesce(b.score, 0) as second from (select * from k where r = 1) a left join (select * from k where r = 2) b using (id))"


def _crops(spark, d):
    return gallery.exemplars(table(spark, d, "embeddings"), "label", "embedding", "vec_id")


@query("select vec_id, round(sqrt(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))), 6) as l2 from embeddings")
def l2_norms(spark, d):
    """X10."""
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(doubles(F.col("embedding"))), 6).alias("l2"))


@query(f"with {_NEAREST} select id, name, round(score, 6) as score from s")
def gallery_scores(spark, d):
    """The nearest exemplar of each name."""
    crops = _crops(spark, d)
    return gallery.scores(crops, crops.where("name <> '9'"), "nearest").select("id", "name", F.round("score", 6).alias("score"))


_MEAN = """, t as (select name, list(x order by i) as total, count(*) as dims from (select name, i, sum(v[i]) as x from named, unnest(range(1, 65)) as d(i) group by name, i) group by name),
c as (select q.id, t.name, list_transform(list_zip(t.total, q.v), lambda z: z[1] - case when q.name = t.name then z[2] else 0 end) as m, q.v from g q, t),
pr as (select id, name, list_dot_product(m, v) / greatest(sqrt(list_dot_product(m, m)), 1e-12) as score from c)"""


@query(f"with {_NEAREST}{_MEAN} select pr.id, pr.name, round((pr.score + s.score) / 2, 6) as score from pr join s using (id, name)")
def gallery_scores_mixed(spark, d):
    """Mean of nearest and prototype, without the crop itself."""
    crops = _crops(spark, d)
    return gallery.scores(crops, crops.where("name <> '9'"), "mixed").select("id", "name", F.round("score", 6).alias("score"))


@query(f"with {_MATCH} select id, best, round(score, 6) as score, runner_up, round(second, 6) as runner_up_score, case when score >= 0.3 and score - second >= 0.01 then best end as name from top")
def gallery_match(spark, d):
    """The gate at 0.3 with a margin of 0.01."""
    crops = _crops(spark, d)
    m = gallery.match(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), 0.3, 0.01)
    return m.select("id", "best", F.round("score", 6).alias("score"), "runner_up", F.round("runner_up_score", 6).alias("runner_up_score"), "name")


@query(f"with {_MATCH}, m as (select id, case when score >= 0.3 and score - second >= 0.01 then best end as name from top) select g.name as truth, count(*) as total, count(*) filter (where m.name = g.name) as correct, count(*) filter (where m.name is null) as unnamed from g left join m using (id) where g.name <> '9' group by 1")
def leave_one_out_summary(spark, d):
    """Per name."""
    crops = _crops(spark, d)
    m = gallery.match(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), 0.3, 0.01)
    return gallery.per_name(m, crops.select("id", F.col("name").alias("truth")), "9")


@query(f"with {_MATCH}, m as (select id, accept, case when score >= accept and score - second >= 0.01 then best end as name from top, (values (0.15::double), (0.2::double), (0.25::double), (0.3::double), (0.35::double)) a(accept)) select accept, count(*) filter (where g.name <> '9') as known, count(*) filter (where g.name <> '9' and m.name = g.name) as correct, count(*) filter (where g.name <> '9' and m.name is null) as unnamed, count(*) filter (where g.name = '9' and m.name is null) as rejected from g join m using (id) group by accept")
def accept_sweep(spark, d):
    """Scores once, thresholds after."""
    crops = _crops(spark, d)
    return gallery.sweep(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), crops.select("id", F.col("name").alias("truth")), [0.15, 0.2, 0.25, 0.3, 0.35], 0.01, "9").drop("extras")


# Geometry.
@query(f"with {_BOXES} select page, l_linenumber, l_partkey, l_suppkey, x1 - x0 as w, y1 - y0 as h, (x0 + x1) / 2 as cx, (x1 - x0) * (y1 - y0) as area, (x1 - x0) * (y1 - y0) >= 2000 and x1 - x0 >= 40 as large from boxes")
def box_metrics(spark, d):
    """P1, P4, F7."""
    b = G.box()
    rows = boxes(spark, d)
    return rows.select("page", "l_linenumber", "l_partkey", "l_suppkey", (b[2] - b[0]).alias("w"), (b[3] - b[1]).alias("h"), G.centre(b)[0].alias("cx"), G.area(b).alias("area"), ((G.area(b) >= 2000) & (b[2] - b[0] >= 40)).alias("large"))


@query(f"with {_BOXES} select page, l_linenumber, l_partkey, l_suppkey, round_even(x0 / 1000.0 * 640, 0)::int as px, round_even(least(1.0, x1 / 1000.0) * 640, 0)::int as qx, greatest(0, x0 - trunc((x1 - x0) * 0.1)::int) as crop_x0, least(1000, x1 + trunc((x1 - x0) * 0.1)::int) as crop_x1 from boxes")
def box_pixels(spark, d):
    """Shares to pixels half-even, and a padded crop window."""
    b = G.box()
    crop = G.padded(b, 0.1, 1000, 1400)
    return boxes(spark, d).select("page", "l_linenumber", "l_partkey", "l_suppkey", G.to_pixel(G.to_share(b[0], F.lit(1000.0)), 640).alias("px"), G.to_pixel(G.to_share(b[2], F.lit(1000.0), True), 640).alias("qx"), crop[0].alias("crop_x0"), crop[2].alias("crop_x1"))


_PAIR = _BOXES + ", b as (select page, l_partkey * 10 + l_linenumber as body, x0 as bx0, y0 as by0, x1 as bx1, y1 as by1 from boxes where l_returnflag = 'A'), p as (select page, l_partkey * 10 + l_linenumber as panel, x0 - 100 as px0, y0 - 200 as py0, x1 + 300 as px1, y1 + 300 as py1 from boxes where l_returnflag <> 'A')"
_SHARE = "greatest(0, least(bx1, px1) - greatest(bx0, px0)) * greatest(0, least(by1, py1) - greatest(by0, py0)) / ((bx1 - bx0) * (by1 - by0))::double"


def _bodies_panels(spark, d, repeated=False):
    """Bodies and panels; of those that share a page and a number the first row of the file counts, unless ``repeated``."""
    rows = boxes(spark, d, place=not repeated).withColumn("k", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    grown = {"x0": F.col("x0") - 100, "y0": F.col("y0") - 200, "x1": F.col("x1") + 300, "y1": F.col("y1") + 300}

    def listed(found, key, sides):
        found = found.withColumnRenamed("k", key)
        if repeated:
            return found.select("page", key, *[v.alias(n) for n, v in sides.items()])
        return found.groupBy("page", key).agg(*[F.min_by(v, "place").alias(n) for n, v in sides.items()])

    return (listed(rows.where("l_returnflag = 'A'"), "body", {"b_" + c: F.col(c) for c in grown}),
            listed(rows.where("l_returnflag <> 'A'"), "panel", {"p_" + c: v for c, v in grown.items()}))


_DISTINCT = ", b1 as (select distinct on (page, body) * from b), p1 as (select distinct on (page, panel) * from p)"


@query(f"with {_PAIR}{_DISTINCT} select page, body, panel, {_SHARE} as share, greatest(0, greatest(bx0, px0) - least(bx1, px1)) + greatest(0, greatest(by0, py0) - least(by1, py1)) as gap from b1 join p1 using (page)")
def containment_pairs(spark, d):
    """Bodies against the panels of their page."""
    bodies, panels = _bodies_panels(spark, d)
    return bodies.join(panels, "page").select("page", "body", "panel", G.containment(G.box("b_"), G.box("p_")).alias("share"), G.gap(G.box("b_"), G.box("p_")).alias("gap"))


@query(f"with {_PAIR}{_DISTINCT}, s as (select page, body, panel, {_SHARE} as share from b1 join p1 using (page)), r as (select *, row_number() over (partition by page, body order by share desc, panel) as k from s where share >= 0.05) select page, body, panel, share from r where k = 1")
def assign_to_panels(spark, d):
    """At a share of 0.05."""
    bodies, panels = _bodies_panels(spark, d)
    return layout.assign(bodies, panels, ["page"], 0.05)


@query(f"with {_PAIR}{_DISTINCT}, s as (select *, ((bx0 + bx1) / 2 - (px0 + px1) / 2) ** 2 + ((by0 + by1) / 2 - (py0 + py1) / 2) ** 2 as d2 from b1 join p1 using (page)), r as (select *, row_number() over (partition by page, panel order by d2, (bx1 - bx0) * (by1 - by0) desc, body) as k from s) select page, panel, body, d2 from r where k = 1")
def nearest_character(spark, d):
    """The nearest body of each panel."""
    bodies, panels = _bodies_panels(spark, d)
    return layout.nearest(panels, bodies, ["page"])


@query(f"""with {_BOXES}, o as (select *, max(y1) over w as reach from boxes window w as (partition by page order by y0, y1, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding))
select page, l_linenumber, l_partkey, l_suppkey, sum(case when reach is null or y0 >= reach - 1e-9 then 1 else 0 end) over (partition by page order by y0, y1, l_linenumber, l_partkey, l_suppkey rows unbounded preceding)::bigint as "group" from o""")
def gap_split_rows(spark, d):
    """Rows that no straight cut separates."""
    return layout.gap_groups(boxes(spark, d), ["page"], "y0", "y1", "l_linenumber", "l_partkey", "l_suppkey").select("page", "l_linenumber", "l_partkey", "l_suppkey", "group")


@query("""with f as (select user_id, event_id, value > 5 as flag from events), i as (select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, flag order by event_id) as k from f),
r as (select user_id, min(event_id) as start, count(*) as length from i where flag group by user_id, k) select user_id, max_by(start, struct_pack(l := length, s := -start)) as start, max(length) as length from r group by user_id""")
def longest_run(spark, d):
    """The longest run of large values of each user."""
    return layout.longest_run(table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 5).alias("flag")), ["user_id"], "event_id", "flag")


@query("with f as (select user_id, value > 5 as flag, row_number() over (partition by user_id order by event_id) - 1 as r from events) select user_id, coalesce(min(r) filter (where not flag), count(*)) as length from f group by user_id")
def leading_run(spark, d):
    """W11."""
    return layout.leading_run(table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 5).alias("flag")), ["user_id"], "event_id", "flag")


@query(f"with {_BOXES} select page, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by page order by y0, x0 desc, l_linenumber, l_partkey, l_suppkey) as number from boxes where l_partkey % 10 >= 4")
def numbered_detections(spark, d):
    """Detections over the threshold, numbered down the page and from the right."""
    w = Window.partitionBy("page").orderBy("y0", F.desc("x0"), "l_linenumber", "l_partkey", "l_suppkey")
    return boxes(spark, d).where("l_partkey % 10 >= 4").select("page", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).cast("long").alias("number"))


@query(f"""with recursive {_BOXES}, b as (select page, l_linenumber || ':' || l_partkey || ':' || l_suppkey as box, x0::bigint as x0, y0::bigint as y0, x1::bigint as x1, y1::bigint as y1 from boxes),
region(page, path, ord, box, x0, y0, x1, y1, whole) as (
  select page, '', row_number() over (partition by page order by y0, x0, x1, y1, box), box, x0, y0, x1, y1, false from b
  union all
  select page, path || case when rows > 0 then lpad(row::varchar, 4, '0') when room is not null then case when col < cut then '1' else '0' end else '' end,
    case when rows > 0 then row_number() over (partition by page, path order by y0, y1, ord) when room is not null then row_number() over (partition by page, path order by x0, x1, ord) else ord end,
    box, x0, y0, x1, y1, rows = 0 and room is null
  from (select *, min(case when gap = room then col end) over (partition by page, path) as cut from (
    select *, max(row) over (partition by page, path) as rows, max(gap) over (partition by page, path) as room from (
      select *, sum((below >= 0)::int) over (partition by page, path order by y0, y1, ord rows unbounded preceding) as row, sum((beside >= 0)::int) over (partition by page, path order by x0, x1, ord rows unbounded preceding) as col, case when beside >= 0 then beside end as gap from (
        select *, coalesce(y0 - max(y1) over (partition by page, path order by y0, y1, ord rows between unbounded preceding and 1 preceding), -1) as below,
          coalesce(x0 - max(x1) over (partition by page, path order by x0, x1, ord rows between unbounded preceding and 1 preceding), -1) as beside
        from region where not whole))))),
leaf as materialized (select *, row_number() over (partition by page, path order by y0, ord) as j from region where whole),
band(page, path, j, lows, highs, box, k) as (
  select distinct page, path, 0::bigint, []::bigint[], []::bigint[], null::varchar, 0::bigint from leaf
  union all
  select page, path, j, case when fit = 0 then list_append(lows, y0) else list_transform(lows, lambda v, i: case when i = fit then least(v, y0) else v end) end,
    case when fit = 0 then list_append(highs, y1) else list_transform(highs, lambda v, i: case when i = fit then greatest(v, y1) else v end) end, box, case when fit = 0 then len(lows) + 1 else fit end
  from (select t.page, t.path, l.j, t.lows, t.highs, l.box, l.y0, l.y1,
      coalesce(list_position(list_transform(t.lows, lambda v, i: least(t.highs[i], l.y1) - greatest(v, l.y0) > 0.5 * least(t.highs[i] - v, l.y1 - l.y0)), true), 0) as fit
    from band t join leaf l on l.page = t.page and l.path = t.path and l.j = t.j + 1)),
mine as materialized (select l.page, l.path, band.k as band, l.box, l.ord, l.j as place, l.x0, l.y0, l.x1, row_number() over (partition by l.page, l.path, band.k order by l.x0, l.j) as j from leaf l join band on band.page = l.page and band.path = l.path and band.j = l.j),
part(page, path, band, j, lows, highs, box, k) as (
  select distinct page, path, band, 0::bigint, []::bigint[], []::bigint[], null::varchar, 0::bigint from mine
  union all
  select page, path, band, j, case when fit = 0 then list_append(lows, x0) else list_transform(lows, lambda v, i: case when i = fit then least(v, x0) else v end) end,
    case when fit = 0 then list_append(highs, x1) else list_transform(highs, lambda v, i: case when i = fit then greatest(v, x1) else v end) end, box, case when fit = 0 then len(lows) + 1 else fit end
  from (select t.page, t.path, t.band, l.j, t.lows, t.highs, l.box, l.x0, l.x1,
      coalesce(list_position(list_transform(t.lows, lambda v, i: least(t.highs[i], l.x1) - greatest(v, l.x0) > 0.5 * least(t.highs[i] - v, l.x1 - l.x0)), true), 0) as fit
    from part t join mine l on l.page = t.page and l.path = t.path and l.band = t.band and l.j = t.j + 1)),
read as (select m.*, part.k as part, avg(m.x0 + m.x1) over (partition by m.page, m.path, m.band, part.k) as middle from mine m join part on part.page = m.page and part.path = m.path and part.band = m.band and part.j = m.j)
select b.page, b.box, b.x0, b.y0, b.x1, b.y1, (row_number() over (partition by b.page order by r.path, r.band, r.middle desc, r.part, r.y0, r.x0, r.place) - 1)::int as rank from read r join b on b.page = r.page and b.box = r.box""")
def reading_order(spark, d):
    """C6 (T1, W8, W9): boxes of each page in right-to-left order; the SQL refines a key path level by level."""
    rows = boxes(spark, d).withColumn("box", F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey"))
    return layout.reading_order(rows.select("page", "box", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]), ["page"])


@query(f"""with recursive {_BOXES}, o as (select page, l_returnflag as label, (l_partkey % 97) / 97.0::double as confidence, x0, y0, x1, y1,
  row_number() over (partition by page, l_returnflag order by (l_partkey % 97) / 97.0::double desc, x0, y0, x1, y1) as r from boxes),
t(page, label, r, keep, kept) as (select distinct page, label, 0::bigint, false, []::struct(x0 bigint, y0 bigint, x1 bigint, y1 bigint)[] from o
  union all select page, label, r, keep, case when keep then list_append(before, me) else before end from (
    select o.page, o.label, o.r, t.kept as before, struct_pack(x0 := o.x0::bigint, y0 := o.y0::bigint, x1 := o.x1::bigint, y1 := o.y1::bigint) as me,
      len(list_filter(t.kept, lambda k: greatest(0, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0, least(o.y1, k.y1) - greatest(o.y0, k.y0))
        > 0.3::double * ((o.x1 - o.x0) * (o.y1 - o.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - greatest(0, least(o.x1, k.x1) - greatest(o.x0, k.x0)) * greatest(0, least(o.y1, k.y1) - greatest(o.y0, k.y0))))) = 0 as keep
    from t join o on o.page = t.page and o.label = t.label and o.r = t.r + 1))
select page, label, confidence, x0, y0, x1, y1 from t join o using (page, label, r) where keep""")
def overlap_suppression(spark, d):
    """Greedy suppression within page and class."""
    rows = boxes(spark, d).select("page", F.col("l_returnflag").alias("label"), ((F.col("l_partkey") % 97) / 97.0).alias("confidence"), *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return layout.suppressed(rows, ["page"], 0.3)


@query("select page_id, w, h, least(640 / w::double, 640 / h::double) as scale, floor((640 - round_even(w * least(640 / w::double, 640 / h::double), 0)) / 2)::bigint as x_offset, case when greatest(w, h) > 1024 then greatest(1, round_even(w * 1024 / greatest(w, h)::double, 0))::int else w::int end as short_w from (select page_id, 600 + (page_id * 37) % 1500 as w, 800 + (page_id * 91) % 1700 as h from pages)")
def letterbox_sizes(spark, d):
    """X12, X14."""
    rows = table(spark, d, "pages").select("page_id", (600 + (F.col("page_id") * 37) % 1500).alias("w"), (800 + (F.col("page_id") * 91) % 1700).alias("h"))
    scale, x, _ = G.letterbox(F.col("w"), F.col("h"), 640)
    return rows.select("page_id", "w", "h", scale.alias("scale"), x.cast("long").alias("x_offset"), G.shrunk(F.col("w"), F.col("h"), 1024)[0].alias("short_w"))


# Names, configuration, audio arrays.
@query("""with t as (select p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) as tokens from part), w(model, words) as (values ('red-hot', ['red', 'hot']), ('blue_small', ['blue', 'small']), ('green large part', ['green', 'large', 'part'])),
s as (select p_partkey, model, len(list_intersect(tokens, words)) as shared from t, w), r as (select *, rank() over (partition by p_partkey order by shared desc) as k from s where shared > 0) select p_partkey, model, shared from r where k = 1""")
def name_token_overlap(spark, d):
    """The models that share most name tokens, ties kept."""
    models = spark.createDataFrame([("red-hot",), ("blue_small",), ("green large part",)], "model string").withColumn("words", T.name_tokens(F.col("model")))
    m = models.select("model", F.explode("words").alias("token"))
    parts = table(spark, d, "part").select("p_partkey", F.explode(T.name_tokens(F.col("p_name"))).alias("token"))
    shared = parts.join(m, "token").groupBy("p_partkey", "model").agg(F.count("*").alias("shared"))
    return shared.withColumn("k", F.rank().over(Window.partitionBy("p_partkey").orderBy(F.desc("shared")))).where("k = 1").drop("k")


_CONFIG = """r as (select case when role = 'assistant' then 'audio' else 'script' end as stage, role as component, max(text) as late, min(text) as early from conversations group by 1, 2),
s as (select stage, component, late as fingerprint from r), c as (select stage, component, case when stage = 'audio' then early else late end as fingerprint from r)"""


@query(f"with {_CONFIG}, f as (select stage, bool_and(s.fingerprint is not distinct from c.fingerprint) as same from s full join c using (stage, component) group by stage) select bool_or(stage = 'script' and same) as script, bool_or(stage = 'script' and same) and bool_or(stage = 'audio' and same) as audio from f")
def checkpoint_validity(spark, d):
    """F16, C11: roles as engines, a text of theirs as the fingerprint; a changed voice engine keeps the script and drops the audio."""
    stage = F.when(F.col("role") == "assistant", "audio").otherwise("script").alias("stage")
    rows = table(spark, d, "conversations").groupBy(stage, F.col("role").alias("component")).agg(F.max("text").alias("last"), F.min("text").alias("first"))
    stored = rows.select("stage", "component", F.col("last").alias("fingerprint"))
    current = rows.select("stage", "component", F.when(F.col("stage") == "audio", F.col("first")).otherwise(F.col("last")).alias("fingerprint"))
    return checkpoint.reuse(stored, current)


@query("with style(style, gap, music) as (values ('drama', 350, 'dark'), ('radio', 200, 'off')) select page_id, coalesce(case when page_id % 3 = 0 then 100 end, gap) as gap, case when coalesce(case when page_id % 5 = 0 then 'off' end, music) <> 'off' then coalesce(case when page_id % 5 = 0 then 'off' end, music) end as music from pages join style on style.style = lower(trim(case when page_id % 2 = 0 then ' Drama' else 'RADIO ' end))")
def config_cascade(spark, d):
    """Explicit options before those of the style, found without regard to case."""
    style = spark.createDataFrame([("drama", 350, "dark"), ("radio", 200, "off")], "style string, gap int, music string")
    n = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.when(n % 2 == 0, " Drama").otherwise("RADIO ").alias("style"), F.when(n % 3 == 0, 100).alias("own_gap"), F.when(n % 5 == 0, "off").alias("own_music"))
    return options.styled(rows, style).select("page_id", F.coalesce("own_gap", "gap").alias("gap"), F.nullif(F.coalesce("own_music", "music"), F.lit("off")).alias("music"))


@query("with a as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select *, list_max(list_transform(v, lambda x: abs(x))) as peak from a) select vec_id, list_sum(list_transform(v, lambda x: trunc(greatest(-1.0, least(1.0, x * (0.75 / peak))) * 32767)::bigint))::bigint as total, 32767 * 3 // 4 as top from p")
def level_small_arrays(spark, d):
    """Embeddings as samples, at 0.75 of their peak."""
    v = levelled(doubles(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.lit(32767 * 3 // 4).alias("top"))


@query("select conv_id, turn, '🎙 **' || role || ':** ' || text as line from conversations")
def script_lines(spark, d):
    """Blocks as Markdown."""
    rows = table(spark, d, "conversations").withColumns({"speaker_id": F.col("role"), "sfx": F.lit(None).cast("string")})
    return rows.select("conv_id", "turn", narration.script_line(F.lit("🎙")).alias("line"))


@query("select regexp_extract(url, '([^/?#]+)\\.html', 1) as stem, count(*) as n from pages where regexp_matches(url, '\\.html') group by 1")
def page_stems(spark, d):
    """Page files of one suffix by stem."""
    rows = table(spark, d, "pages").where(F.col("url").rlike(r"\.html"))
    return rows.groupBy(F.coalesce(files.stem(F.col("url"), (".html",)), F.lit("")).alias("stem")).agg(F.count("*").alias("n"))


@query("select l_orderkey, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'N') as n, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1")
def detections_per_class(spark, d):
    """Detections of each class on a page."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0).toDF("l_orderkey", "a", "n", "r")


@query("select label, mean_x, round(sqrt(len2), 6) as length from (select label, round(list_sum(list(m)), 6) as mean_x, sum(m * m) as len2 from (select label, i, avg(embedding[i]::double) as m from embeddings, unnest(range(1, 65)) as d(i) group by label, i) group by label)")
def prototype_lengths(spark, d):
    """Element-wise mean vectors of each label, with sum and length."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode(doubles(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return rows.groupBy("label").agg(F.round(F.sum("m"), 6).alias("mean_x"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("length"))


@query("select conv_id, to_json(list(text order by turn))::varchar as bubbles from conversations group by conv_id")
def bubble_prompts(spark, d):
    """A conversation's texts as a JSON list."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.select("conv_id", prompts.bubble_list(F.col("texts")).alias("bubbles"))


@query("select conv_id, string_agg('[' || turn || '] ' || case when role = 'system' then 'unknown' else role || ' (' || printf('%.2f', (turn % 10) / 10.0) || ')' end, chr(10) order by turn) as hints from conversations group by conv_id")
def hint_blocks(spark, d):
    """Numbered hints with names and scores."""
    name = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(prompts.hints(F.col("turn"), name, (F.col("turn") % 10) / 10.0).alias("hints"))


@query("with c as (select lang, source, count(*) as n from documents group by all) select lang, string_agg(source || '×' || n, ', ' order by n desc, source) as line from c group by lang")
def summary_text(spark, d):
    """Counters as text, most frequent first."""
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(prompts.counts_line(F.col("source"), F.col("n")).alias("line"))


@query("select conv_id, count(*) as parsed, count(*) filter (where role <> 'system') as speech from conversations where trim(text) <> '' group by conv_id")
def script_parse(spark, d):
    """Every conversation as model output with prose around it, parsed back into blocks."""
    item = F.struct("turn", F.struct("text", F.col("role").alias("speaker_id"), (F.col("role") != "system").alias("is_speech")).alias("b"))
    raw = F.concat(F.lit("Here it is: "), F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"])), F.lit(" — done"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(raw.alias("raw")).withColumn("blocks", parse_blocks("raw"))
    return rows.select("conv_id", F.size("blocks").cast("long").alias("parsed"), F.size(F.filter("blocks", lambda b: b["is_speech"])).cast("long").alias("speech"))


@query("with l as (select page_id, 'x' || chr(10) || '01:' || lpad((page_id % 60)::varchar, 2, '0') || ':00 - ' || url as t from pages) select page_id, 3600.0 + 60.0 * (page_id % 60) as start_s, url as title from pages")
def arc_lines(spark, d):
    """Arcs read from lines of text, others left out, shifted by nothing."""
    line = F.concat(F.lit("01:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00 - "), "url")
    lines = table(spark, d, "pages").select("page_id", F.explode(F.array(F.lit("not an arc"), line)).alias("value"))
    return files.arcs(lines, by=["page_id"])


@query(f"with {_BOXES} select page, list(l_returnflag order by y0, x0, l_linenumber, l_partkey, l_suppkey) as labels, count(*) as n from boxes group by page")
def detections_round_trip(spark, d):
    """Detections through their JSON form and back."""
    w = Window.partitionBy("page").orderBy("y0", "x0", "l_linenumber", "l_partkey", "l_suppkey")
    rows = boxes(spark, d).withColumn("idx", F.row_number().over(w)).select(
        "page", "idx", F.col("l_returnflag").alias("label"), ((F.col("l_partkey") % 97) / 97.0).alias("confidence"), F.struct(*[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    back = files.detections_from_json(files.detections_json(rows))
    return back.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("labels"), F.count("*").alias("n"))


@query("select tag, path from (select p_brand as tag, p_name || case when p_partkey % 3 = 0 then '.wav' else '.ogg' end as path, row_number() over (partition by p_brand order by p_size % 4, (p_partkey % 3 <> 0)::int, p_retailprice desc, p_name || case when p_partkey % 3 = 0 then '.wav' else '.ogg' end) as r from part) where r = 1")
def promoted_files(spark, d):
    """The best file of each tag."""
    path = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".wav").otherwise(".ogg"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("tag"), (F.col("p_size") % 4).alias("rank"), path.alias("path"), F.col("p_retailprice").alias("size"))
    return files.promote(rows).select("tag", "path")


@query("with s as (select l_orderkey as volume, l_linenumber as block_index, l_partkey % 5 = 0 as effect, l_quantity / 100.0 as x, l_partkey, l_suppkey from lineitem) select volume, count(*) * 3 + (count(*) - 1) * 2 as frames from s group by volume")
def mix_lengths(spark, d):
    """Tracks of three-sample segments with gaps of two samples: their lengths in frames."""
    one = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: (F.col("l_quantity") / 100.0).cast("float"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("volume"), F.row_number().over(w).alias("block_index"), F.when(F.col("l_partkey") % 5 == 0, "SFX").otherwise("A").alias("speaker_id"), one.alias("samples"))
    tracks = mixing.levelled(mixing.narration(rows, 2, size=16))
    return tracks.groupBy("volume").agg(F.sum(F.size("pcm")).cast("long").alias("frames")).withColumn("volume", F.col("volume").cast("long"))
