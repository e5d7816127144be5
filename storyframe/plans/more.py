"""Further queries over the driver tables: outputs, options, guards, and operators that the first set doesn't reach."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import keys as K
from ..functions import options
from ..functions import text as T
from ..functions.audio import resampled
from ..functions.blocks import parse_blocks, plain_blocks, reviewed
from ..operators import arcs, checkpoint, gallery, layout, mixing, narration, outputs, pacing
from ..sources import files
from ..sources.tables import blocks, boxes, marks, segments, table
from ..stages import suggestions
from .queries import _ANNOUNCED, _BOXES, _DISTINCT, _MATCH, _PAIR, _SEGMENTS, _bodies_panels, _crops, query

# Narration with effects.
_EFFECT = "case when pos % 5 = 2 then 'storm' when pos % 7 = 3 then 'door' end"


def _with_effects(spark, d):
    return blocks(spark, d).withColumn("sfx", F.when(F.col("pos") % 5 == 2, "storm").when(F.col("pos") % 7 == 3, "door"))


@query(f"""with {_ANNOUNCED}, marked as (select *, {_EFFECT} as sfx from named),
items as (select volume, pos, 0 as sub, 'sfx' as kind, 'SFX' as speaker_id, null as text, sfx as sfx_tag, text as seed from marked where sfx is not null
  union all select volume, pos, 1, 'announcement', 'Narrator', speaker_id, null, text from marked where announce
  union all select volume, pos, 2, 'speech', speaker_id, text, null, text from marked)
select volume, pos, kind, speaker_id, text, sfx_tag, seed, row_number() over (partition by volume order by pos, sub) - 1 as block_index from items""")
def narration_plan_with_effects(spark, d):
    """Effects, announcements and speech."""
    return narration.plan(_with_effects(spark, d)).select("volume", "pos", "kind", "speaker_id", "text", "sfx_tag", "seed", F.col("block_index").cast("long").alias("block_index"))


@query(f"with {_ANNOUNCED} select volume, pos, '🎙 **' || speaker_id || ':** ' || text || case when {_EFFECT} is not null then ' *[' || ({_EFFECT}) || ']*' else '' end as line from named")
def script_lines_with_tags(spark, d):
    """P29 with effect tags."""
    return _with_effects(spark, d).select("volume", "pos", narration.script_line(F.lit("🎙")).alias("line"))


@query(f"with {_ANNOUNCED}, s as (select speaker_id, count(*) as blocks, count({_EFFECT}) as effects from named group by 1) select * from s")
def speaker_summary(spark, d):
    """A2, A3: blocks and effects of each speaker."""
    return narration.summary(_with_effects(spark, d))


@query("""select conv_id, count(*) filter (where turn % 4 <> 3) as parsed, string_agg(text, '|' order by turn) filter (where turn % 4 <> 3) as texts,
  count(*) filter (where turn % 4 = 0) as narrated, string_agg(case when turn % 4 = 1 then 'Desconhecido' when turn % 4 = 2 then '7' else role end, '|' order by turn) filter (where turn % 4 <> 3) as speakers from conversations where trim(text) = text and text <> '' group by conv_id""")
def script_salvage(spark, d):
    """Arrays with items of other types and with blank texts, each cut off inside an object after its last."""
    text, t = F.col("text"), F.col("turn") % 4
    item = (F.when(t == 3, F.to_json(F.struct(F.lit("  ").alias("text")))).when(t == 2, F.concat(F.lit('{"speaker_id": 7, "text": '), F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1), F.lit("}")))
            .when(t == 1, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.concat(F.lit(" "), text, F.lit("\n")).alias("text"), F.col("role").alias("speaker_id"), F.lit(False).alias("is_speech")))))
    rows = table(spark, d, "conversations").where("trim(text) = text and text <> ''").select("conv_id", "turn", item.alias("item"))
    raw = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]), ", "), F.lit(', {"text": "cut off'))
    got = rows.groupBy("conv_id").agg(parse_blocks(raw).alias("b"))

    def joined(name):
        return F.array_join(F.transform("b", lambda x: x[name]), "|")

    return got.select("conv_id", F.size("b").cast("long").alias("parsed"), joined("text").alias("texts"), F.size(F.filter("b", lambda x: ~x["is_speech"])).cast("long").alias("narrated"), joined("speaker_id").alias("speakers"))


@query("select conv_id, list(text order by turn) filter (where trim(text) <> '' and turn % 3 <> 0) as texts from conversations group by conv_id")
def nonblank_bubbles(spark, d):
    """bubbles whose text isn't blank, as blocks of an unknown speaker."""
    text = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))), lambda x: x["text"]).alias("texts"))
    found = F.transform(plain_blocks(F.col("texts")), lambda b: b["text"])
    return rows.select("conv_id", F.when(F.size(found) > 0, found).alias("texts"))


# Gallery.
_NAMED = f"{_MATCH}, m as (select id, case when score >= 0.15 and score - second >= 0.01 then best end as name from top)"


def _matches(spark, d):
    crops = _crops(spark, d)
    return gallery.match(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), 0.15, 0.01), crops.select("id", F.col("name").alias("truth"))


@query(f"with {_NAMED} select count(*) filter (where g.name <> '9') as known, count(*) filter (where g.name <> '9' and m.name = g.name) as correct, count(*) filter (where g.name <> '9' and m.name is null) as unnamed, coalesce(count(*) filter (where g.name <> '9' and m.name = g.name) / nullif(count(*) filter (where g.name <> '9'), 0)::double, 0) as accuracy, count(*) filter (where g.name = '9') as extras, count(*) filter (where g.name = '9' and m.name is null) / nullif(count(*) filter (where g.name = '9'), 0)::double as extras_rejected from g left join m using (id)")
def gallery_evaluation(spark, d):
    """The evaluation in one row."""
    return gallery.evaluate(*_matches(spark, d), "9")


@query(f"with {_NAMED} select g.name as truth, m.name, count(*) as n from g join m using (id) where g.name <> '9' and m.name <> g.name group by 1, 2")
def gallery_confusions(spark, d):
    """Wrong names, most frequent first."""
    return gallery.confusions(*_matches(spark, d), "9")


@query(f"with {_NAMED}, p as (select g.name as truth, count(*) as total, count(*) filter (where m.name = g.name) as correct, count(*) filter (where m.name is null) as unnamed from g left join m using (id) where g.name <> '9' group by 1) select string_agg('| ' || truth || ' | ' || total || ' | ' || correct || ' | ' || unnamed || ' |', chr(10) order by truth) as \"table\" from p")
def evaluation_report(spark, d):
    """The names of an evaluation as a table."""
    return outputs.name_table(gallery.per_name(*_matches(spark, d), "9"))


@query("select label, count(*) as n, sum(ord) as ord_sum, round(sum(first), 5) as first_sum, min(accept) as accept from (select label::varchar as label, row_number() over (partition by label order by vec_id) - 1 as ord, embedding[1]::double as first, 0.7 as accept from embeddings) group by label")
def gallery_round_trip(spark, d):
    """Galleries of each label through their JSON form and back."""
    ord_ = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"), ord_.alias("ord"), F.lit("A").alias("name"), F.col("embedding").alias("v"))
    back = outputs.gallery_rows(outputs.gallery_json(rows, ["label"], accept=0.7), ["label"])
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum("ord").alias("ord_sum"), F.round(F.sum(F.col("v")[0].cast("double")), 5).alias("first_sum"), F.min(F.col("accept").cast("decimal(2,1)")).alias("accept"))


# Arcs, segments, transcripts.
@query("select p_partkey::double as start_s, p_name as title from part where contains(lower(p_name), 'red') order by (lower(p_name) = 'red') desc, p_partkey limit 1")
def arc_search(spark, d):
    """The earliest part whose name contains a title, as an arc."""
    return arcs.find(table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("start_s"), F.col("p_name").alias("title")), " RÉD")


@query("with b as (select user_id as file, event_id as title, epoch_us(ts) / 1e6 as start_s, lead(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) as end_s from events where event_type = 'signup') select file, title, start_s, least(end_s, start_s + 3600) as end_s, coalesce(least(end_s, start_s + 3600) > start_s, true) as valid from b")
def arc_clips(spark, d):
    """Arcs cut to an hour."""
    rows = arcs.bounds(marks(spark, d), ["file"])
    start, end, valid = arcs.clip(F.col("start_s"), F.col("end_s"), 3600.0)
    return rows.select("file", "title", start.alias("start_s"), end.alias("end_s"), valid.alias("valid"))


@query("select event_id, round(value + 12.5, 3) as start, round(value + 13.5, 3) as \"end\", event_type as text, round(value + 12.75, 3) as word_start from events where event_id % 3 <> 0")
def shifted_segments(spark, d):
    """Segments moved by their clip's offset; blank ones go."""
    text = F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    word = F.struct((F.col("value") + 0.25).alias("start"), (F.col("value") + 0.5).alias("end"), F.lit(" w ").alias("word"), F.lit(0.5).alias("probability"))
    rows = table(spark, d, "events").select("event_id", F.col("value").alias("start"), (F.col("value") + 1).alias("end"), text.alias("text"), F.array(word).alias("words"))
    return pacing.shifted(rows, 12.5).select("event_id", "start", "end", "text", F.col("words")[0]["start"].alias("word_start"))


_STAMP = "printf('%02d:%02d:%02d', floor({0})::bigint // 3600, (floor({0})::bigint // 60) % 60, floor({0})::bigint % 60)"


@query(f"""with {_SEGMENTS}, r as (select *, row_number() over (partition by file order by start, fin) as n from segments where event_id % 20 = 0)
select file, string_agg('## ' || n || '. [' || {_STAMP.format('start')} || ' - ' || {_STAMP.format('fin')} || ']' || case when event_id % 40 = 0 then ' · ' || text else '' end || ' · score ' || printf('%.3f', (event_id % 8) / 8.0) || chr(10) || chr(10) || text || chr(10), chr(10) order by n) as document from r group by file""")
def excerpt_documents(spark, d):
    """Numbered excerpts with span, arc and score as one text for each file."""
    arc, score = F.when(F.col("event_id") % 40 == 0, F.col("text")), (F.col("event_id") % 8) / 8.0
    return outputs.excerpt_document(segments(spark, d).where("event_id % 20 = 0").select("file", "start", "end", "text", arc.alias("arc"), score.alias("score")))


@query("select user_id as file, event_id as title, epoch_us(ts) / 1e6 - 600.0 as start_s from events where event_type = 'signup'")
def arc_shifts(spark, d):
    """Arcs on a slice that begins after ten minutes."""
    return arcs.shifted(marks(spark, d), 600.0).select("file", "title", "start_s")


@query("""select conv_id, turn, case when turn % 4 in (0, 1) then text end as said, case when turn % 4 in (0, 1) then turn::bigint end as panel from conversations""")
def review_envelopes(spark, d):
    """A reviewer's object between the first and the last brace; broken or missing ones give nothing."""
    body = F.to_json(F.struct(F.col("turn").cast("long").alias("panel"), F.struct("text").alias("block")))
    t = F.col("turn") % 4
    raw = F.when(t == 0, body).when(t == 1, F.concat(F.lit("So: "), body, F.lit(" done."))).when(t == 2, F.lit("no object")).otherwise(F.concat(F.lit("{"), body))
    r = reviewed(raw, "panel long, block struct<text:string>")
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.col("r.block.text").alias("said"), F.col("r.panel").alias("panel"))


_SWEEP = "(values (0.15::double), (0.2::double), (0.25::double), (0.3::double), (0.35::double)) a(accept)"


@query(f"""with {_MATCH}, m as (select id, accept, case when score >= accept and score - second >= 0.01 then best end as name from top, {_SWEEP}),
totals as (select accept, count(*) filter (where g.name <> '9') as known, count(*) filter (where g.name <> '9' and m.name = g.name) as correct, count(*) filter (where g.name <> '9' and m.name is null) as unnamed, count(*) filter (where g.name = '9' and m.name is null) as rejected, count(*) filter (where g.name = '9') as extras from g join m using (id) group by accept)
select accept, '| ' || printf('%.2f', accept) || ' | ' || printf('%.1f%%', 100 * (correct / known::double)) || ' | ' || printf('%.1f%%', 100 * (unnamed / known::double)) || ' | ' || printf('%.0f%%', 100 * (rejected / extras::double)) || ' |' as line from totals""")
def sweep_report(spark, d):
    """The thresholds of a sweep as lines of a table."""
    crops = _crops(spark, d)
    truth = crops.select("id", F.col("name").alias("truth"))
    return outputs.sweep_lines(gallery.sweep(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), truth, [0.15, 0.2, 0.25, 0.3, 0.35], 0.01, "9"))


@query("""select c_custkey::varchar as run, stage, component, case when stage = 'script' then 'v' || (c_custkey % 7) else 'a' || (c_custkey % 3) end as fingerprint
from customer, (values ('audio', 'tts'), ('script', 'ocr'), ('script', 'vlm')) s(stage, component) where c_custkey % 9 <> 0 and not (stage = 'audio' and c_custkey % 2 = 0)""")
def run_configs(spark, d):
    """Run configs through their JSON form; a new script's section drops the audio's, a broken file holds nothing."""
    n = F.col("c_custkey")
    kinds = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(c).alias("component")) for s, c in (("audio", "tts"), ("script", "ocr"), ("script", "vlm"))])
    rows = table(spark, d, "customer").select(n.cast("string").alias("run"), n, F.explode(kinds).alias("k")).select("run", "c_custkey", "k.*")
    mark = F.when(F.col("stage") == "script", F.concat(F.lit("v"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("a"), (n % 3).cast("string")))
    rows = rows.withColumn("fingerprint", mark)
    stored, section = rows.where(n % 2 == 0), rows.where((n % 2 == 0) & (F.col("stage") == "script"))
    now = checkpoint.write_section(stored, section, "script").unionByName(rows.where(n % 2 == 1))
    json = checkpoint.to_json(now).withColumn("json", F.when(F.col("run").cast("long") % 9 == 0, F.lit("{broken")).otherwise(F.col("json")))
    return checkpoint.from_json(json)


@query("select c_custkey, c_custkey % 2 = 0 or c_custkey % 3 <> 1 as stays from customer")
def voice_model_stays(spark, d):
    """whether a loaded voice model may stay beside the provider."""
    n = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", options.may_stay(n % 2 == 0, F.when(n % 3 == 1, "own").otherwise("far"), ["own", "server"]).alias("stays"))


# Registries, effects, audio.
@query("""with v as (select distinct conv_id::varchar as volume, role as speaker_id, 'voice ' || length(role) as voice from conversations),
j as (select volume, '{' || string_agg('"' || speaker_id || '": "' || voice || '"', ', ' order by speaker_id) || '}' as json from v group by volume) select volume, json, substr(sha1(json), 1, 8) as digest from j""")
def registry_digests(spark, d):
    """Voices of each volume, saved in order of speaker, with a short digest."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("volume"), F.col("role").alias("speaker_id"), F.concat(F.lit("voice "), F.length("role").cast("string")).alias("voice")).distinct()
    return outputs.registry(rows)


@query("select distinct conv_id::varchar as volume, role as speaker_id, 'voice ' || length(role) as voice from conversations")
def registry_round_trip(spark, d):
    """Saved voices read back; a file that can't be read gives none."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("volume"), F.col("role").alias("speaker_id"), F.concat(F.lit("voice "), F.length("role").cast("string")).alias("voice")).distinct()
    broken = spark.createDataFrame([("broken", "{no json")], "volume string, json string")
    return outputs.registry_rows(outputs.registry(rows).select("volume", "json").union(broken))


@query("""with e as (select p_brand as tag, row_number() over (partition by p_brand order by p_partkey) as ord, p_brand || '.wav' as file from part where p_partkey % 5 = 0),
h as (select tag, max(ord) as had from e group by tag), n as (select p_brand as tag, p_partkey, coalesce(had, 0) + row_number() over (partition by p_brand order by p_partkey) as n from part left join h on h.tag = p_brand where p_partkey % 5 = 1)
select tag, ord, file from e union all select tag, n, tag || case when n > 1 then '_' || n else '' end || '.ogg' from n""")
def effect_registry(spark, d):
    """New effects of a tag take the next free suffix."""
    rows = table(spark, d, "part").withColumn("tag", F.col("p_brand"))
    at = F.row_number().over(Window.partitionBy("tag").orderBy("p_partkey"))
    entries = rows.where("p_partkey % 5 = 0").select("tag", at.alias("ord"), F.concat("tag", F.lit(".wav")).alias("file"))
    new = rows.where("p_partkey % 5 = 1").select("tag", at.alias("ord"), F.lit(".ogg").alias("suffix"))
    return files.register_effects(entries, new).withColumn("ord", F.col("ord").cast("long"))


@query("""with f as (select distinct lower(replace(p_name, ' ', '_')) || '.wav' as file from part), e as (select distinct p_brand as tag, lower(replace(p_name, ' ', '_')) || '.wav' as file from part where p_partkey % 3 = 0)
select distinct replace(file, '.wav', '') as tag from f where file not in (select file from e) union select tag from e""")
def effect_tag_set(spark, d):
    """Stems without variants' files, and the dictionary's tags."""
    rows = table(spark, d, "part").withColumn("file", F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(".wav")))
    return files.effect_tags(rows.select("file").distinct(), rows.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("tag"), "file").distinct())


_TAGS = {"click": "door", "view": "steps", "purchase": "coin", "signup": "bell"}


@query("""with m(label, tag) as (values ('click', 'door'), ('view', 'steps'), ('purchase', 'coin'), ('signup', 'bell')),
s as (select user_id as file, tag, max(value / 10) as score from events join m on label = event_type where value / 10 >= 0.3 and tag <> 'coin' group by 1, 2),
r as (select *, row_number() over (partition by file order by score desc, tag) as rank from s) select file, tag, score, rank from r where rank <= 2""")
def audio_suggestions(spark, d):
    """The two best new tags of each file."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("label"), (F.col("value") / 10).alias("score"))
    return suggestions(rows, _TAGS, ["coin"], 0.3, 2).select("file", "tag", "score", F.col("rank").cast("long").alias("rank"))


def _lines(spark, d):
    """Order lines as segments of their order's track; renamed before they are dealt, so that they are dealt once."""
    w = Window.partitionBy("volume").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "volume").withColumn("block_index", F.row_number().over(w))


@query("""with s as (select l_orderkey as volume, trunc((l_quantity / 100.0)::float::double * 32767)::bigint as x, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as k from lineitem)
select volume, sum(x * (3 * (5 * k) + 6))::bigint as weighted, sum(3 * x)::bigint as total from s group by volume""")
def mix_samples(spark, d):
    """The samples of each track, weighted by their place (from 1): three of a segment, two of a gap."""
    x = (F.col("l_quantity") / 100.0).cast("float")
    rows = _lines(spark, d).select("volume", "block_index", F.lit("A").alias("speaker_id"), F.array(x, x, x).alias("samples"))
    found = mixing.levelled(mixing.narration(rows, 2, size=4)).select("volume", mixing.weighted("pcm", F.col("block") * 4 + 1).alias("w"), F.aggregate("pcm", F.lit(0).cast("long"), lambda a, b: a + b).alias("t"))
    return found.groupBy("volume").agg(F.sum("w").cast("long").alias("weighted"), F.sum("t").cast("long").alias("total"))


@query("""with s as (select l_orderkey as volume, (l_quantity / 100.0)::float::double as y, l_partkey % 5 = 0 as effect, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as j from lineitem),
t as (select volume, count(*) * 4 + (count(*) - 1) * 2 as total from s group by volume),
k as (select volume, total, unnest(range(total)) as k from t),
v as (select volume, 6 * j + i as k, y * (i + 1) * case when effect then 0.5::double else 1.5::double end as x from s cross join (select unnest(range(4)) as i)),
m as (select k.volume, total, k.k, coalesce(x, 0) as x, least(5, total // 2) as rise, [0.25::double, -0.5, 1.0][(k.k % 3) + 1] as bed from k left join v using (volume, k)),
f as (select volume, k, x + bed * 0.3::double * case when k < rise then k / greatest(rise - 1, 1)::double when k - (total - rise) >= 0 then 1 - (k - (total - rise)) / greatest(rise - 1, 1)::double else 1.0 end as x from m),
p as (select *, max(abs(x)) over (partition by volume) as peak from f)
select volume, count(*) as frames, sum(k * trunc(x * case when peak > 0.99::double then 0.99::double / peak else 1.0 end * 32767))::bigint as weighted, round(max(peak), 6) as peak from p group by volume""")
def mix_with_music(spark, d):
    """Narration and effects over music that is repeated, fades in and out and keeps its headroom; blocks of 8."""
    x = (F.col("l_quantity") / 100.0).cast("float").cast("double")
    rows = _lines(spark, d).select("volume", "block_index", F.when(F.col("l_partkey") % 5 == 0, "SFX").otherwise("A").alias("speaker_id"), F.array(*[x * k for k in range(1, 5)]).alias("samples"))
    music = rows.select("volume").distinct().withColumn("samples", F.array(F.lit(0.25), F.lit(-0.5), F.lit(1.0)))
    blocks = mixing.with_music(mixing.narration(rows, 2, 1.5, 0.5, 8), music, 0.3, 5, 8)
    tracks = mixing.levelled(blocks).select("volume", F.size("pcm").alias("n"), mixing.weighted("pcm", F.col("block") * 8).alias("w"), "peak")
    return tracks.groupBy("volume").agg(F.sum("n").cast("long").alias("frames"), F.sum("w").cast("long").alias("weighted"), F.round(F.max("peak"), 6).alias("peak"))


@query("""with r as (select * from (values (8000, 11025), (44100, 24000), (3, 1), (24000, 24000)) r(source, target)),
v as (select vec_id, source, target, list_transform(embedding, lambda x: x::double) as x, len(embedding) as n, case when source = target then len(embedding) else greatest(1, round_even(len(embedding) / source::double * target, 0)::bigint) end as m from embeddings cross join r),
p as (select vec_id, source, target, n, m, x, unnest(range(m)) as k from v),
q as (select *, case when k = m - 1 and m > 1 then (n - 1)::double else k * case when m > 1 then (n - 1) / (m - 1)::double else 0 end end as place from p),
y as (select vec_id, source, target, m, k, ((x[least(floor(place)::bigint + 1, n - 1) + 1] - x[floor(place)::bigint + 1]) * (place - floor(place)) + x[floor(place)::bigint + 1])::float::double as y from q)
select vec_id, source, target, max(m) as frames, round(sum(y), 5) as total, round(sum(y * (k % 7)), 4) as weighted from y group by vec_id, source, target""")
def resampled_vectors(spark, d):
    """Vectors as sounds at other rates."""
    rows = table(spark, d, "embeddings")
    out = None
    for source, target in ((8000, 11025), (44100, 24000), (3, 1), (24000, 24000)):
        y = F.transform(resampled(F.col("embedding"), source, target), lambda v: v.cast("double"))
        one = rows.select("vec_id", F.lit(source).alias("source"), F.lit(target).alias("target"), F.size(y).cast("long").alias("frames"),
            F.round(F.aggregate(y, F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(F.aggregate(F.transform(y, lambda v, i: v * (i % 7)), F.lit(0.0), lambda a, b: a + b), 4).alias("weighted"))
        out = one if out is None else out.unionByName(one)
    return out


# Geometry.
@query(f"with {_PAIR}{_DISTINCT} select page, body, panel, least(bx0, px0) as x0, least(by0, py0) as y0, greatest(bx1, px1) as x1, greatest(by1, py1) as y1 from b1 join p1 using (page)")
def box_unions(spark, d):
    """Bodies united with the panels of their page."""
    bodies, panels = _bodies_panels(spark, d)
    u = G.union(G.box("b_"), G.box("p_"))
    return bodies.join(panels, "page").select("page", "body", "panel", *[c.alias(n) for c, n in zip(u, ("x0", "y0", "x1", "y1"))])


@query(f"""with recursive {_PAIR}, h as (select *, row_number() over (partition by page order by body, bx0, by0, bx1, by1) as j from b),
t(page, j, ps) as (
  select page, 0::bigint, list({{'panel': panel::bigint, 'x0': px0::bigint, 'y0': py0::bigint, 'x1': px1::bigint, 'y1': py1::bigint}} order by panel, px0, py0, px1, py1) from p group by page
  union all
  select page, j, list_transform(ps, lambda p, i: case when i = list_position(gaps, list_min(gaps))
      then {{'panel': p.panel, 'x0': least(p.x0, bx0::bigint), 'y0': least(p.y0, by0::bigint), 'x1': greatest(p.x1, bx1::bigint), 'y1': greatest(p.y1, by1::bigint)}} else p end)
  from (select t.page, t.j + 1 as j, ps, h.bx0, h.by0, h.bx1, h.by1,
          list_transform(ps, lambda p: greatest(0, greatest(h.bx0, p.x0) - least(h.bx1, p.x1)) + greatest(0, greatest(h.by0, p.y0) - least(h.by1, p.y1))) as gaps
        from t join h on h.page = t.page and h.j = t.j + 1)),
e as (select page, unnest(ps) as p from (select * from t qualify row_number() over (partition by page order by j desc) = 1))
select page, p.panel as panel, p.x0 as x0, p.y0 as y0, p.x1 as x1, p.y1 as y1 from e""")
def absorbed_holes(spark, d):
    """Holes, one after the other, join the panel that is nearest by then."""
    bodies, panels = _bodies_panels(spark, d, repeated=True)
    return layout.absorb(bodies.withColumnRenamed("body", "hole"), panels, ["page"])


@query(f"with {_BOXES} select page, l_linenumber, l_partkey, l_suppkey, (x0 - 100) >= 0 and (y0 - 50) >= 0 and x1 <= 800 and y1 <= 1200 as valid from boxes")
def box_validity(spark, d):
    """boxes within a smaller page, as shares of it."""
    b = [(F.col(n) + shift) / extent for n, shift, extent in (("x0", -100, 800.0), ("y0", -50, 1200.0), ("x1", 0, 800.0), ("y1", 0, 1200.0))]
    return boxes(spark, d).select("page", "l_linenumber", "l_partkey", "l_suppkey", G.valid(tuple(b)).alias("valid"))


@query("""with p as (select event_id, 40 + event_id % 560 as cx, 60 + event_id % 500 as cy, 30 + event_id % 90 as w, 20 + event_id % 70 as h, (event_id % 10) / 10.0::double as a, (event_id % 7) / 7.0::double as b, 0.5::double as scale, 0 as l, 45 as t, 1280 as width, 1100 as height from events),
d as (select *, case when a >= b then 'body' else 'face' end as label, greatest(a, b) as confidence from p where greatest(a, b) >= 0.4),
x as (select event_id, label, confidence, greatest(0, least(width, round_even((cx - w / 2.0 - l) / scale, 0)::bigint)) as x0, greatest(0, least(height, round_even((cy - h / 2.0 - t) / scale, 0)::bigint)) as y0,
  greatest(0, least(width, round_even((cx + w / 2.0 - l) / scale, 0)::bigint)) as x1, greatest(0, least(height, round_even((cy + h / 2.0 - t) / scale, 0)::bigint)) as y1 from d)
select * from x where x1 > x0 and y1 > y0""")
def decoded_detections(spark, d):
    """A detector's raw rows as detections on the page (one row a page, so none overlap)."""
    n = F.col("event_id")
    raw = table(spark, d, "events").select(
        "event_id", (40 + n % 560).cast("double").alias("cx"), (60 + n % 500).cast("double").alias("cy"), (30 + n % 90).cast("double").alias("w"), (20 + n % 70).cast("double").alias("h"),
        F.array((n % 10) / 10.0, (n % 7) / 7.0).alias("scores"), F.lit(0.5).alias("scale"), F.lit(0).alias("left"), F.lit(45).alias("top"), F.lit(1280).alias("width"), F.lit(1100).alias("height"))
    kept = layout.suppressed(layout.decoded(raw, ["body", "face"], 0.4), ["event_id"])
    return layout.on_page(kept).select("event_id", "label", "confidence", "x0", "y0", "x1", "y1")


@query("""with f as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as line, value > 5 as blank from events)
select user_id, count(*) filter (where blank) as blanks, count(*) as lines from f group by 1""")
def profile_lines(spark, d):
    """W12's input: the lines of each profile and the blank ones."""
    return _profile(spark, d).groupBy("user_id").agg(F.count_if("blank").alias("blanks"), F.count("*").alias("lines"))


def _profile(spark, d):
    return table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("line"), (F.col("value") > 5).alias("blank"))


@query("""with recursive f as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as line, value > 5 as blank, count(*) over (partition by user_id) as n from events),
i as (select *, line - row_number() over (partition by user_id, blank order by line) as k from f), r as (select user_id, n, min(line) as a, max(line) + 1 as z from i where blank group by user_id, n, k),
c as (select *, row_number() over (partition by user_id order by a) as j from r where a > 0 and z < n and z - a >= 2),
t(user_id, n, j, last, cuts) as (select distinct user_id, n, 0::bigint, 0::bigint, []::bigint[] from f
  union all select t.user_id, t.n, t.j + 1, case when c.a - t.last >= 3 then c.z else t.last end, case when c.a - t.last >= 3 then list_append(t.cuts, ((c.a + c.z) // 2)::bigint) else t.cuts end from t join c on c.user_id = t.user_id and c.j = t.j + 1),
e as (select *, row_number() over (partition by user_id order by j desc) as w from t)
select user_id, array_to_string(case when len(cuts) > 0 and n - last < 3 then cuts[:-2] else cuts end, ',') as cuts from e where w = 1""")
def gutter_cuts(spark, d):
    """Middles of the inner blank runs of two lines or more with three lines of content between."""
    return layout.gutters(_profile(spark, d), ["user_id"], "line", "blank", 2, 3).select("user_id", F.array_join("cuts", ",").alias("cuts"))


@query("select page_id::varchar as page, event_id as idx, 'img/' || page_id || '.png' as path from pages join events on event_id % 3000 = page_id where page_id % 2 = 0")
def detections_with_pages(spark, d):
    """Detections of pages that have an image."""
    rows = table(spark, d, "events").select((F.col("event_id") % 3000).cast("string").alias("page"), F.col("event_id").alias("idx"))
    images = table(spark, d, "pages").where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("stem"), F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return outputs.with_pages(rows, images)


@query("select page_id, case when page_id % 4 = 0 then 'new/panels/p' || page_id || '.png' else 'old/p' || page_id || '.png' end as path from pages")
def moved_crops(spark, d):
    """Crops of a moved workspace are found by their file names."""
    path = F.concat(F.lit("old/p"), F.col("page_id").cast("string"), F.lit(".png"))
    return table(spark, d, "pages").select("page_id", outputs.moved(path, F.col("page_id") % 4 != 0, "new/panels/").alias("path"))


# Keys, options, guards.
@query(r"select page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'arco') as slug, lower(trim(regexp_replace(url, '\s+', ' ', 'g'))) as folded from pages")
def arc_slugs(spark, d):
    """Slugs and keys without accents and case (urls are ASCII)."""
    return table(spark, d, "pages").select("page_id", T.arc_slug(F.col("url")).alias("slug"), T.fold("url").alias("folded"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'm' || p_size else 'dir/m' || p_size || '.bin' end as model, case when p_size % 4 = 0 then 'homem' when p_size % 4 = 1 then 'idosa' end as voice from part")
def model_labels(spark, d):
    """Model files by name, and known voice profiles."""
    path = F.concat(F.lit("dir/m"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".gguf").otherwise(".bin"))
    said = F.when(F.col("p_size") % 4 == 0, " Homem").when(F.col("p_size") % 4 == 1, "IDOSA").otherwise("robot")
    return table(spark, d, "part").select("p_partkey", K.model_label(path).alias("model"), K.voice_profile(said).alias("voice"))


@query("""select c_custkey, case when c_custkey % 4 = 3 then 'server' when c_custkey % 4 = 2 then 'second' when c_custkey % 3 = 0 then 'first' when c_custkey % 3 = 1 then 'second' else 'own' end as provider,
  case when c_custkey % 2 = 0 then 'cuda' else 'cpu' end as device, case when c_custkey % 5 = 0 then 'float32' when c_custkey % 2 = 0 then 'float16' else 'int8' end as compute from customer""")
def provider_choice(spark, d):
    """Providers by request, alias and the keys at hand; devices."""
    n = F.col("c_custkey")
    wanted = F.when(n % 4 == 3, "Llama").when(n % 4 == 2, "SECOND").otherwise("auto")
    keys = F.when(n % 3 == 0, F.array(F.lit("k2"), F.lit("k1"))).when(n % 3 == 1, F.array(F.lit("k2"))).otherwise(F.array(F.lit("other")))
    device, compute = options.device(F.lit("auto"), F.when(n % 5 == 0, "float32").otherwise("auto"), n % 2 == 0)
    found = options.provider(wanted, keys, [("first", "k1"), ("second", "k2")], "own", ["first", "second", "own", "server"], {"llama": "server"})
    return table(spark, d, "customer").select("c_custkey", found.alias("provider"), device.alias("device"), compute.alias("compute"))


@query("select page_id, case when page_id % 3 = 0 then null when page_id % 3 = 1 then 'm/dark.ogg' end as path from pages")
def music_choice(spark, d):
    """The music file of a name; a suggestion that isn't there is no music."""
    wanted = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 1, "dark").when(F.col("page_id") % 3 == 2, "gone").alias("name"), (F.col("page_id") % 3 == 1).alias("explicit"))
    there = spark.createDataFrame([("dark", "m/dark.mp3"), ("dark", "m/dark.ogg"), ("calm", "m/calm.wav"), ("gone", "m/gone.txt")], "stem string, path string")
    return options.music(wanted, there, ["page_id"])


@query("select event_id, case event_id % 13 when 0 then 'Narrator' when 1 then 'Ana' when 2 then 'Rui' when 12 then 'junk' end as label from events")
def hotkey_labels(spark, d):
    """Keys of a labelling session as labels."""
    n = F.col("event_id") % 13
    key = F.when(n < 10, n.cast("string")).when(n == 12, "x").otherwise("q")
    return table(spark, d, "events").select("event_id", options.hotkey_label(key, ["Ana", "Rui"], "Narrator", "junk").alias("label"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity >= 8 and l_partkey % 60 >= 8 as readable,
  (l_quantity * 10) / 1000 between 0.004 and 0.5 and (l_suppkey % 7) * 100 > 0 and (l_quantity * 10) / nullif((l_suppkey % 7) * 100, 0) >= 0.75 and l_discount between 0.01 and 0.5 as bubble from lineitem""")
def region_guards(spark, d):
    """Regions large enough to be read, and contours that are bubbles."""
    area, hull = F.col("l_quantity").cast("double") * 10, ((F.col("l_suppkey") % 7) * 100).cast("double")
    text = options.region_text(F.lit("t"), F.col("l_quantity"), F.col("l_partkey") % 60)
    bubble = options.is_bubble(area, hull, F.col("l_discount").cast("double"), F.lit(1000.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (text != "").alias("readable"), F.coalesce(bubble, F.lit(False)).alias("bubble"))


@query("select event_id, event_id % 7 in (0, 1) or event_id % 5 in (0, 1) as bad from events")
def bad_requests(spark, d):
    """refusals by status, by the error's name and by its text."""
    n = F.col("event_id")
    status = F.when(n % 7 == 0, 400).when(n % 7 == 1, 422).when(n % 7 == 2, 500)
    return table(spark, d, "events").select("event_id", options.is_bad_request(status, F.when(n % 5 == 0, "BadRequestError").otherwise("Timeout"), F.when(n % 5 == 1, "no Json_Schema here")).alias("bad"))
