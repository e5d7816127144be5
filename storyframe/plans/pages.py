"""Queries over pages as masks (opened masks, contours, hulls, bubbles) and over files that are written and read back.

An embedding is a grid of 8 x 8 grey values; what is above a level is bright, what is below another is dark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import images, options, prompts
from ..functions import text as T
from ..operators import casting, checkpoint, gallery, masks, models, narration, outputs, pacing, panels
from ..sources import archives, files, sinks
from ..sources.shared import folder
from ..sources.tables import blocks, segments, table
from .more import _NAMED, _matches
from .queries import _PANELS, _crops, _panels, query

_GRID = "g as (select vec_id, k // 8 as r, k % 8 as c, x > -0.1::double as bright, x < -0.2::double as dark from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as k from embeddings))"


def _grids(spark, d):
    """Pages of 8 x 8 pixels, with the bright and the dark mask."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("k", "x"))
    cells = rows.select("page", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).alias("start"), (F.col("k") % 8 + 1).alias("end"), F.col("x").cast("double").alias("x"))
    pages = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return pages, masks.runs(cells.where("x > -0.1D").drop("x")), masks.runs(cells.where("x < -0.2D").drop("x"))


@query(f"""with {_GRID}, b as (select * from g where bright),
e as (select b.vec_id, b.r, b.c, count(*) as n from b join b o on o.vec_id = b.vec_id and abs(o.r - b.r) + abs(o.c - b.c) <= 1 group by all),
k as (select vec_id, r, c from e where n + (r = 0)::int + (r = 7)::int + (c = 0)::int + (c = 7)::int = 5),
o as (select distinct g.vec_id, g.r, g.c from g join k on k.vec_id = g.vec_id and abs(g.r - k.r) + abs(g.c - k.c) <= 1),
i as (select *, c - row_number() over (partition by vec_id, r order by c) as island from o)
select vec_id, r::int as row, min(c)::int as start, max(c)::int + 1 as stop from i group by vec_id, r, island""")
def opened_masks(spark, d):
    """The bright mask after an opening with a cross, as runs."""
    pages, bright, _ = _grids(spark, d)
    return masks.opened(bright, pages).select(F.col("page").alias("vec_id"), "row", "start", F.col("end").alias("stop"))


@query(f"""with recursive {_GRID}, v as (select distinct vec_id from g),
cells as materialized (select v.vec_id, x.r, y.c, coalesce(bright, false) as bright from v cross join (select unnest(range(-1, 9)) as r) x cross join (select unnest(range(-1, 9)) as c) y left join g on g.vec_id = v.vec_id and g.r = x.r and g.c = y.c),
outside(vec_id, r, c) as (select vec_id, -1::bigint, -1::bigint from v union select n.vec_id, n.r, n.c from outside o join cells n on n.vec_id = o.vec_id and abs(n.r - o.r) + abs(n.c - o.c) = 1 where not n.bright),
f as materialized (select vec_id, r, c from cells where not exists (select 1 from outside o where o.vec_id = cells.vec_id and o.r = cells.r and o.c = cells.c)),
reach(vec_id, r, c, k) as (select vec_id, r, c, 8 * r + c from f union select f.vec_id, f.r, f.c, x.k from reach x join f on f.vec_id = x.vec_id and greatest(abs(f.r - x.r), abs(f.c - x.c)) = 1),
a as materialized (select vec_id, r, c, min(k) as k from reach group by all),
boxes as (select vec_id, k, min(c) as x0, min(r) as y0, max(c) + 1 as x1, max(r) + 1 as y1 from a group by all),
squares as (select vec_id, k, r - dr as sr, c - dc as sc, count(*) as n from a cross join (values (0), (1)) s(dr) cross join (values (0), (1)) t(dc) group by all),
inside as (select vec_id, k, sum(case n when 4 then 2 when 3 then 1 else 0 end) as contour2 from squares group by all),
rim as materialized (select vec_id, k, r, c from a qualify c = min(c) over (partition by vec_id, k, r) or c = max(c) over (partition by vec_id, k, r)),
sides as (select p.vec_id, p.k, p.r as pr, p.c as pc, q.r as qr, q.c as qc, min((q.c - p.c) * (z.r - p.r) - (q.r - p.r) * (z.c - p.c)) as low, max((q.c - p.c) * (z.r - p.r) - (q.r - p.r) * (z.c - p.c)) as high
  from rim p join rim q on q.vec_id = p.vec_id and q.k = p.k and (q.r, q.c) <> (p.r, p.c) join rim z on z.vec_id = p.vec_id and z.k = p.k group by all),
hull as (select vec_id, k, sum(pc * qr - pr * qc) as hull2 from (select * from sides where low = 0 and high > 0 qualify row_number() over (partition by vec_id, k, pr, pc order by abs(qr - pr) + abs(qc - pc)) = 1) group by all),
inked as (select b.vec_id, b.k, count(*) filter (dark) as dark from boxes b join g on g.vec_id = b.vec_id and g.r >= y0 and g.r < y1 and g.c >= x0 and g.c < x1 group by all),
m as (select vec_id, k // 8 as row, k % 8 as start, x0::int as x0, y0::int as y0, x1::int as x1, y1::int as y1, contour2::bigint as contour2, coalesce(hull2, 0)::bigint as hull2, dark from boxes join inside using (vec_id, k) left join hull using (vec_id, k) join inked using (vec_id, k))
select *, contour2 / 2.0 / 64 between 0.004 and 0.5 and hull2 > 0 and contour2 / nullif(hull2, 0) >= 0.75 and dark / ((x1 - x0) * (y1 - y0)) between 0.01 and 0.5 as bubble from m""")
def bubble_contours(spark, d):
    """Outermost areas of the bright mask, their contours, hulls and dark pixels, and which are bubbles."""
    pages, bright, dark = _grids(spark, d)
    found = masks.held(masks.contours(bright, pages), dark, "dark")
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    bubble = options.is_bubble(F.col("contour2") / 2, F.col("hull2") / 2, F.col("dark") / size, F.lit(64.0))
    place = [F.col("page").alias("vec_id"), F.shiftright("area", 32).alias("row"), F.col("area").bitwiseAND(F.lit((1 << 32) - 1)).alias("start")]
    return found.select(*place, "x0", "y0", "x1", "y1", "contour2", "hull2", "dark", F.coalesce(bubble, F.lit(False)).alias("bubble"))


@query(r"""with p as (select 'v' || (page_id // 40) as volume, page_id % 40 + 1 as page, lpad((page_id % 40 + 1)::varchar, 5, '0') || '.html' as name, html from pages)
select volume, page::int as page, name, strlen(html) as bytes, md5(html) as md5 from p where page between 5 and 20""")
def archived_pages(spark, d):
    """Pages written as archives of 40 each, and a range of each archive's pages read back."""
    n = F.col("page_id") % 40 + 1
    rows = table(spark, d, "pages").select(
        F.concat(F.lit("v"), F.floor(F.col("page_id") / 40).cast("string"), F.lit(".cbz")).alias("path"), n.alias("part"),
        F.concat(F.lpad(n.cast("string"), 5, "0"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    at = f"{folder(spark)}/archives-{uuid.uuid4().hex}"
    sinks.write_files(rows, at, "zip")
    found = archives.read_pages(spark, sinks.current(spark, at), 5, 16, pagesPerPartition="8")
    return found.select("volume", "page", "name", F.length("content").cast("long").alias("bytes"), F.md5("content").alias("md5"))


@query("select conv_id::varchar as volume, turn as pos, (turn // 2)::int as page, text, case when role = 'system' then 'Narrator' else role end as speaker_id, case when turn % 3 = 0 then 'door' end as sfx from conversations")
def script_files(spark, d):
    """Scripts written as one JSON list for each volume, read back as blocks in order."""
    b = blocks(spark, d)
    block = F.struct("text", "speaker_id", "is_speech", F.when(F.col("pos") % 3 == 0, "door").alias("sfx"))
    panels = b.groupBy("volume", F.col("panel").alias("page_number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks")).withColumn("panel_index", F.lit(0))
    at = f"{folder(spark)}/scripts-{uuid.uuid4().hex}"
    files.write_script(panels, at)
    found = files.read_script(spark, sinks.current(spark, at))
    return found.select("volume", F.col("pos").cast("long").alias("pos"), "page", "text", "speaker_id", "sfx")


@query("""with s as (select user_id as file, epoch_us(ts) / 1e6 as start, event_id, event_type as text from events),
n as (select *, row_number() over (partition by file order by start, event_id) as line from s)
select file::varchar as file, line, text from n""")
def transcript_files(spark, d):
    """Each file's transcript, segments, pacing and excerpts, written together; the plain transcripts read back."""
    rows = segments(spark, d)
    marked = rows.select("file", "start", "end", F.format_string("%09d %s", F.col("event_id"), F.col("text")).alias("text"))
    document = outputs.excerpt_document(marked.groupBy("file").agg(F.min_by(F.struct("start", "end", "text"), F.struct("start", "text")).alias("x")).select("file", "x.*", F.lit(None).cast("string").alias("arc"), F.lit(0.5).alias("score")))
    at = f"{folder(spark)}/transcripts-{uuid.uuid4().hex}"
    outputs.write_transcript(at, marked, pacing.statistics(rows.withColumn("words", F.lit(1))), document)
    now = sinks.current(spark, at)
    texts = sinks.read_files(sinks.listing(spark, now).where(F.col("path").endswith("/transcript.md")), now)
    lines = texts.select("path", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\n")).alias("k", "line"))
    return lines.select(F.regexp_extract("path", r"([^/]+)/transcript\.md$", 1).alias("file"), (F.col("k") + 1).cast("long").alias("line"), F.substring("line", 11, 100).alias("text"))


@query(f"""with {_PANELS}, c as (select *, (row_number() over (partition by volume order by panel) - 1) // 2 as chunk from panels),
a as (select volume, chunk, bool_and(length(blocks[1]) % 5 <> 0) as fits from c group by all)
select volume, panel, chunk, coalesce((select string_agg(s, ',' order by s) from (select distinct unnest(speakers) as s from c b where b.volume = c.volume and b.chunk < c.chunk)), '') as labels_seen,
  case when fits and length(blocks[1]) % 3 <> 0 then array_to_string(list_transform(blocks, lambda x: x || '!'), '|') else array_to_string(blocks, '|') end as text, fits as answered, fits and length(blocks[1]) % 3 <> 0 as changed
from c join a using (volume, chunk)""")
def review_loop(spark, d):
    """Chunks with the labels before them, answers that are whole or nothing, and their patches.

    An answer gives blocks with a mark, none for some panels; where a chunk's first block has a length of a multiple of
    five, the answer names a panel by a text, which breaks it.
    """
    rows = narration.review_chunks(_panels(spark, d), 2)
    length = F.length(F.get("blocks", F.lit(0)))
    given = F.when(length % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform("blocks", lambda x: F.concat(x, F.lit("!"))))
    named = F.when(length % 5 == 0, F.concat(F.lit('"'), F.col("panel").cast("string"), F.lit('"'))).otherwise(F.col("panel").cast("string"))
    item = F.concat(F.lit('{"panel": '), named, F.lit(', "blocks": '), F.to_json(given), F.lit("}"))
    answers = rows.groupBy("volume", "chunk").agg(F.concat(F.lit('Here: {"panels": ['), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("]}.")).alias("raw"))
    found = narration.review(rows, answers)
    return found.select("volume", "panel", "chunk", F.array_join("labels_seen", ",").alias("labels_seen"), F.array_join("blocks", "|").alias("text"), "answered", "changed")


@query("""with recursive n as (select user_id as volume, event_type as speaker_id, case floor(value)::bigint % 3 when 0 then 'homem' when 1 then 'mulher' end as voice, count(*) as n, min(event_id) as first from events group by all),
p as (select distinct on (volume, speaker_id) volume, speaker_id, voice as profile from n order by volume, speaker_id, voice is null, n desc, first),
kept as (select volume, speaker_id, 'B' as voice from p where speaker_id = 'view' and volume % 2 = 0 union all select distinct volume, 'ghost', 'E' from p where volume % 3 = 0),
c as (select *, row_number() over (partition by volume order by speaker_id) as r, case profile when 'homem' then ['A', 'B', 'C'] when 'mulher' then ['D', 'E'] else ['Z', 'Y'] end as pool, ('0x' || substr(sha1(speaker_id), 1, 4))::bigint as h
  from p where not exists (select 1 from kept k where k.volume = p.volume and k.speaker_id = p.speaker_id)),
q as (select *, list_concat(pool[(h % len(pool))::int + 1:], pool[:(h % len(pool))::int]) as turn from c),
t(volume, r, speaker_id, voice, used) as (select v.volume, 0::bigint, null::varchar, null::varchar, coalesce((select list(voice) from kept k where k.volume = v.volume), []::varchar[]) from (select distinct volume from p) v
  union all select volume, r, speaker_id, voice, list_append(used, voice) from (
    select q.volume, q.r, q.speaker_id, t.used, case when q.speaker_id = 'purchase' then 'Curated' else coalesce(list_filter(q.turn, lambda v: not list_contains(t.used, v))[1], q.turn[1]) end as voice from t join q on q.volume = t.volume and q.r = t.r + 1))
select volume, speaker_id, voice from t where r > 0 union all select volume, speaker_id, voice from kept""")
def kept_voices_fold(spark, d):
    """Users as volumes, event types as speakers; kept assignments, a curated voice, banks, a fallback."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("volume"), F.col("event_type").alias("speaker_id"), F.col("event_id").alias("pos"), F.floor("value").alias("v"))
    profiles = casting.majority_profile(rows.withColumn("voice", F.when(F.col("v") % 3 == 0, "homem").when(F.col("v") % 3 == 1, "mulher")))
    kept = profiles.where("speaker_id = 'view' and volume % 2 = 0").select("volume", "speaker_id", F.lit("B").alias("voice"))
    kept = kept.unionByName(profiles.where("volume % 3 = 0").select("volume", F.lit("ghost").alias("speaker_id"), F.lit("E").alias("voice")).distinct())
    return casting.cast_voices(profiles, {"purchase": "Curated"}, {"homem": ["A", "B", "C"], "mulher": ["D", "E"]}, ["Z", "Y"], kept)


@query("""with r as (select conv_id::varchar as run, count(*) as n, count(*) filter (role = 'system') as systems, count(*) filter (length(text) <= 60) as missing from conversations group by 1)
select run, systems = 0 and n >= 2 as script, systems = 0 and n >= 2 and n % 2 = 0 and missing = 0 as audio, missing from r""")
def resumable_runs(spark, d):
    """F16, C11: which runs hold, by the fingerprints of their engines and by the files that they left.

    A run's reviewer was another one where a system turn is there, its voice engine where the turns are odd; the files of
    short turns, and the scripts of single turns, weren't written.
    """
    c = table(spark, d, "conversations").withColumn("run", F.col("conv_id").cast("string"))
    runs = c.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "system").alias("systems"))
    parts = [("script", x) for x in ("page_extractor", "layout_parser", "ocr_engine", "vlm_engine", "reviewer")] + [("audio", x) for x in ("tts_engine", "sfx_tags", "announce_speakers")]
    every = runs.withColumn("p", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(x).alias("component")) for s, x in parts]))).select("run", "n", "systems", "p.*")
    current = every.select("run", "stage", "component", F.concat("component", F.lit(":1")).alias("fingerprint"))
    other = ((F.col("component") == "reviewer") & (F.col("systems") > 0)) | ((F.col("component") == "tts_engine") & (F.col("n") % 2 == 1))
    stored = every.select("run", "stage", "component", F.concat("component", F.when(other, ":0").otherwise(":1")).alias("fingerprint"))
    segments_ = c.select("run", "text", F.concat("run", F.lit("/audio/"), F.lpad(F.col("turn").cast("string"), 5, "0"), F.lit(".wav")).alias("path"))
    left = segments_.where(F.length("text") > 60).select("path", F.col("text").cast("binary").alias("content"))
    for name, which in (("/script/panels.json", "n >= 2"), ("/audio/segments.json", "n >= 1")):
        left = left.unionByName(runs.where(which).select(F.concat("run", F.lit(name)).alias("path"), F.lit("[]").cast("binary").alias("content")))
    at = f"{folder(spark)}/runs-{uuid.uuid4().hex}"
    sinks.write_files(left.withColumn("part", F.lit(0)), at)
    return checkpoint.resumable(stored, current, segments_.select("run", "path"), sinks.listing(spark, sinks.current(spark, at)))


@query(r"""with f as (select doc_id, replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), 'ŀ', 'l') as t from documents)
select doc_id, md5(trim(regexp_replace(t, '[\t-\r\x{1c}-\x{20}\x{85}\x{a0}]+', ' ', 'g'))) as folded, coalesce(nullif(trim(regexp_replace(t, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'arco') as slug from f""")
def accent_keys(spark, d):
    """Keys without accents, case and repeated blanks, and slugs, of whole texts."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold(text)).alias("folded"), T.arc_slug(text).alias("slug"))


@query(r"""with p as (select p_brand, p_name, p_size, 'm/' || replace(p_name, ' ', '-') || '-' || p_size || '.gguf' as model, 'mmproj-' || replace(p_name, ' ', '_') || '.gguf' as file from part),
m as (select distinct p_brand, model, list_filter(regexp_split_to_array(lower(replace(p_name, ' ', '-') || '-' || p_size), '[^a-z0-9]+'), lambda x: x <> '') as own from p where p_size > 40),
c as (select *, count(*) over (partition by p_brand) as many from (select distinct p_brand, file from p where p_size <= 3)),
s as (select p_brand, model, file, case when many = 1 then 0 when contains(lower(replace(file, '.gguf', '')), own[1]) then len(list_filter(own, lambda t: list_contains(regexp_split_to_array(lower(replace(file, '.gguf', '')), '[^a-z0-9]+'), t))) end as score from m join c using (p_brand))
select p_brand, model, file from s where score is not null qualify score = max(score) over (partition by p_brand, model)""")
def model_projectors(spark, d):
    """Parts of a brand as models and projectors of a folder: the family, then the most shared runs; ties stay."""
    rows = table(spark, d, "part")
    dashed = F.concat(F.lit("m/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"), F.lit(".gguf"))
    made = rows.where("p_size > 40").select("p_brand", dashed.alias("model"))
    beside = rows.where("p_size <= 3").select("p_brand", F.concat(F.lit("mmproj-"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".gguf")).alias("file"))
    return models.projectors(made, beside, ["p_brand"])


_VOICES = "'[\"homem\",\"mulher\",\"idoso\",\"idosa\",\"menino\",\"menina\",\"criatura\"]'"


@query(f"""with t as (select conv_id::varchar as volume, list_sort(list(distinct role) filter (role <> 'user')) as tags from conversations group by 1)
select volume, '{{"type":"array","items":{{"type":"object","properties":{{"text":{{"type":"string"}},"speaker_id":{{"type":"string"}},"is_speech":{{"type":"boolean"}},' ||
  case when len(coalesce(tags, [])) > 0 then '"sfx":{{"type":"string","enum":["' || array_to_string(tags, '","') || '"]}},' else '' end || '"voice":{{"type":"string","enum":' || {_VOICES} || '}}}},"required":["text","speaker_id","is_speech"],"additionalProperties":false}}}}' as schema from t""")
def answer_schemas(spark, d):
    """The schema of each volume's answers, its effects those roles that aren't the user's."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("volume")).agg(F.array_sort(F.collect_set(F.when(F.col("role") != "user", F.col("role")))).alias("tags"))
    return rows.select("volume", F.to_json(prompts.answer_schema(F.col("tags"))).alias("schema"))


@query(f"""with {_NAMED},
e as (select count(*) filter (where g.name <> '9') as known, count(*) filter (where g.name <> '9' and m.name = g.name) as correct, count(*) filter (where g.name <> '9' and m.name is null) as unnamed, count(*) filter (where g.name = '9') as extras, count(*) filter (where g.name = '9' and m.name is null) as rejected from g left join m using (id)),
p as (select g.name as truth, count(*) as total, count(*) filter (where m.name = g.name) as correct, count(*) filter (where m.name is null) as unnamed from g left join m using (id) where g.name <> '9' group by 1),
c as (select g.name as truth, m.name as name, count(*) as n from g join m using (id) where g.name <> '9' and m.name <> g.name group by 1, 2),
w as (select accept, count(*) filter (where g.name <> '9') as known, count(*) filter (where g.name <> '9' and x.name = g.name) as correct, count(*) filter (where g.name <> '9' and x.name is null) as unnamed, count(*) filter (where g.name = '9' and x.name is null) as rejected, count(*) filter (where g.name = '9') as extras
  from g join (select id, accept, case when score >= accept and score - second >= 0.01 then best end as name from top, (values (0.15::double), (0.25::double)) a(accept)) x using (id) group by accept)
select '# Identidade de personagens — v1 — e' || chr(10) || chr(10) || 'Estratégia `nearest`, margem 0.01, leave-one-out sobre ' || known || ' recortes nomeados + ' || extras || ' figurantes.' || chr(10) || chr(10)
  || '**Acurácia de nomeação: ' || printf('%.1f%%', 100 * (correct / known::double)) || '** · desconhecido: ' || printf('%.1f%%', 100 * (unnamed / known::double)) || ' · figurantes rejeitados: ' || printf('%.1f%%', 100 * (rejected / extras::double)) || chr(10) || chr(10)
  || '| Personagem | recortes | acertos | desconhecido |' || chr(10) || '|---|---|---|---|' || chr(10) || (select string_agg('| ' || truth || ' | ' || total || ' | ' || correct || ' | ' || unnamed || ' |' || chr(10), '' order by truth) from p)
  || coalesce((select chr(10) || 'Confusões: ' || string_agg(truth || ' -> ' || name || ' (' || n || ')', ', ' order by n desc, truth, name) || chr(10) from c), '')
  || chr(10) || '| aceite | acurácia | desconhecido | figurantes rejeitados |' || chr(10) || '|---|---|---|---|' || chr(10)
  || (select string_agg('| ' || printf('%.2f', accept) || ' | ' || printf('%.1f%%', 100 * (correct / known::double)) || ' | ' || printf('%.1f%%', 100 * (unnamed / known::double)) || ' | ' || printf('%.0f%%', 100 * (rejected / extras::double)) || ' |' || chr(10), '' order by accept) from w) as document from e""")
def evaluation_document(spark, d):
    """A whole evaluation as one text."""
    found, truth = _matches(spark, d)
    crops = _crops(spark, d)
    steps = gallery.sweep(gallery.scores(crops, crops.where("name <> '9'"), "nearest"), truth, [0.15, 0.25], 0.01, "9")
    return outputs.evaluation_text("v1", "e", "nearest", 0.01, gallery.evaluate(found, truth, "9"), gallery.per_name(found, truth, "9"), gallery.confusions(found, truth, "9"), steps)


@query("""with u as (select user_id, count(*) % 7 = 0 as broken from events group by 1),
t as (select user_id, event_type as tag, count(*) as files, sum(floor(value)::bigint) as gain from events join u using (user_id) where not broken group by all)
select user_id, tag, files, gain::bigint as gain from t""")
def effect_dictionaries(spark, d):
    """Effect dictionaries read from JSON text, a user's events as its files; a broken text is an empty dictionary."""
    entry = F.struct(F.concat(F.col("event_id").cast("string"), F.lit(".wav")).alias("file"), F.floor("value").cast("double").alias("gain"))
    tags = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(entry).alias("entries"))
    texts = tags.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "entries")))).alias("json"), F.sum(F.size("entries")).alias("n"))
    texts = texts.select("user_id", F.when(F.col("n") % 7 == 0, F.concat(F.lit("["), F.col("json"))).otherwise(F.col("json")).alias("json"))
    found = texts.select("user_id", F.explode(files.dictionary(F.col("json"))).alias("tag", "entries"))
    gain = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["gain"]).cast("long")
    return found.select("user_id", "tag", F.size("entries").cast("long").alias("files"), gain.alias("gain"))


_AREA = "(p.x1 - p.x0) * (p.y1 - p.y0)"


@query(f"""with recursive {_GRID}, v as (select distinct vec_id from g),
cells as materialized (select v.vec_id, x.r, y.c, coalesce(bright, true) as bright from v cross join (select unnest(range(-1, 9)) as r) x cross join (select unnest(range(-1, 9)) as c) y left join g on g.vec_id = v.vec_id and g.r = x.r and g.c = y.c),
outside(vec_id, r, c) as (select vec_id, -1::bigint, -1::bigint from v union select n.vec_id, n.r, n.c from outside o join cells n on n.vec_id = o.vec_id and abs(n.r - o.r) + abs(n.c - o.c) = 1 where n.bright),
o as materialized (select * from outside where r between 0 and 7 and c between 0 and 7),
f as materialized (select g.vec_id, g.r, g.c from g where exists (select 1 from o where o.vec_id = g.vec_id) and not exists (select 1 from o where o.vec_id = g.vec_id and o.r = g.r and o.c = g.c)),
reach(vec_id, r, c, k) as (select vec_id, r, c, 8 * r + c from f union select f.vec_id, f.r, f.c, x.k from reach x join f on f.vec_id = x.vec_id and abs(f.r - x.r) + abs(f.c - x.c) = 1),
b as materialized (select vec_id, k, {{'x0': min(c), 'y0': min(r), 'x1': max(c) + 1, 'y1': max(r) + 1}} as p from (select vec_id, r, c, min(k) as k from reach group by all) group by all),
united(vec_id, n, ps) as (
  select vec_id, 0, list(p order by k) from b where {_AREA} >= 0.02 * 64 group by vec_id
  union all
  select vec_id, n + 1, list_filter(list_transform(ps, lambda p, i: case when i = hit.i then {{'x0': least(p.x0, ps[hit.j].x0), 'y0': least(p.y0, ps[hit.j].y0), 'x1': greatest(p.x1, ps[hit.j].x1), 'y1': greatest(p.y1, ps[hit.j].y1)}} else p end), lambda p, i: i <> hit.j)
  from (select vec_id, n, ps, list_filter(flatten(list_transform(range(1, len(ps) + 1), lambda i: list_transform(range(i + 1, len(ps) + 1), lambda j: {{'i': i, 'j': j}}))), lambda h:
      greatest(0, least(ps[h.i].x1, ps[h.j].x1) - greatest(ps[h.i].x0, ps[h.j].x0)) * greatest(0, least(ps[h.i].y1, ps[h.j].y1) - greatest(ps[h.i].y0, ps[h.j].y0))
      > 0.3 * least((ps[h.i].x1 - ps[h.i].x0) * (ps[h.i].y1 - ps[h.i].y0), (ps[h.j].x1 - ps[h.j].x0) * (ps[h.j].y1 - ps[h.j].y0)))[1] as hit from united) where hit is not null),
first as materialized (select vec_id, ps from united qualify row_number() over (partition by vec_id order by n desc) = 1),
small as materialized (select b.vec_id, b.k, b.p as q, row_number() over (partition by b.vec_id order by b.k) as j from b join first using (vec_id)
  where not list_contains(ps, b.p) and (select count(*) from g where g.vec_id = b.vec_id and not g.bright and g.r >= b.p.y0 and g.r < b.p.y1 and g.c >= b.p.x0 and g.c < b.p.x1) >= 0.0005 * 64),
grown(vec_id, j, ps) as (
  select vec_id, 0::bigint, ps from first
  union all
  select vec_id, j, list_transform(ps, lambda p, i: case when i = list_position(gaps, list_min(gaps)) then {{'x0': least(p.x0, q.x0), 'y0': least(p.y0, q.y0), 'x1': greatest(p.x1, q.x1), 'y1': greatest(p.y1, q.y1)}} else p end)
  from (select t.vec_id, s.j, ps, q, list_transform(ps, lambda p: greatest(0, greatest(q.x0, p.x0) - least(q.x1, p.x1)) + greatest(0, greatest(q.y0, p.y0) - least(q.y1, p.y1))) as gaps from grown t join small s on s.vec_id = t.vec_id and s.j = t.j + 1)),
last as materialized (select vec_id, ps from grown qualify row_number() over (partition by vec_id order by j desc) = 1),
seen as (select g.vec_id, count(*) as whole, count(*) filter (len(list_filter(ps, lambda p: g.r >= p.y0 and g.r < p.y1 and g.c >= p.x0 and g.c < p.x1)) > 0) as held from g join last using (vec_id) where not g.bright group by all),
e as (select vec_id, generate_subscripts(ps, 1) - 1 as panel, unnest(ps) as p from last where not exists (select 1 from seen where seen.vec_id = last.vec_id and held < 0.7 * whole))
select vec_id, panel::int as panel, p.x0 as x0, p.y0 as y0, p.x1 as x1, p.y1 as y1 from e""")
def gutter_panels(spark, d):
    """Panels as what the paper that reaches the edge leaves over, united, with small holes joined, covering the ink."""
    pages, bright, _ = _grids(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("k", "x")).where("cast(x as double) <= -0.1D")
    ink = masks.runs(rows.select("page", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).alias("start"), (F.col("k") % 8 + 1).alias("end")))
    return panels.gutter_panels(bright, ink, pages).select(F.col("page").alias("vec_id"), "panel", "x0", "y0", "x1", "y1")


@query("select label::varchar as name, count(*) as exemplars from embeddings where label is not null group by 1")
def exemplars_per_name(spark, d):
    """The crops of each name."""
    return gallery.per_label(_crops(spark, d))


@query(r"""with t as (select doc_id, regexp_replace(text, '\A\s+|\s+\z', '', 'g') as text from documents where text is not null), c as (select *, substr(text, 1, 700) as cut from t)
select doc_id, md5(case when length(text) <= 700 then text when contains(cut, chr(10)) then substr(cut, 1, length(cut) - instr(reverse(cut), chr(10))) || chr(10) || '[...]' else cut || chr(10) || '[...]' end) as excerpt from c""")
def style_excerpts(spark, d):
    """Texts as style examples of 700 characters at most, cut at a line's end."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(prompts.style_excerpt(F.col("text"), 700)).alias("excerpt"))


@query("""select 'p' || page_id as stem, case when contains(url, '/en/') then '.png' when contains(url, '/es/') then '.webp' else '.jpg' end as suffix, md5(url) as content from pages where not contains(url, '#')""")
def page_images(spark, d):
    """One image file for each page stem, the first suffix that is there, and its content."""
    rows = table(spark, d, "pages").select("page_id", "url")
    kinds = F.when(F.contains("url", F.lit("#")), F.array(F.lit(".txt"))).when(F.contains("url", F.lit("/en/")), F.array(F.lit(".png"), F.lit(".jpg"))).when(F.contains("url", F.lit("/es/")), F.array(F.lit(".webp"))).otherwise(F.array(F.lit(".webp"), F.lit(".jpg"), F.lit(".txt")))
    every = rows.withColumn("suffix", F.explode(kinds))
    best = F.array_min(F.filter(F.transform(kinds, lambda k: F.array_position(F.array(*[F.lit(x) for x in (".png", ".jpg", ".jpeg", ".webp")]), k)), lambda k: k > 0))
    content = F.when(F.array_position(F.array(*[F.lit(x) for x in (".png", ".jpg", ".jpeg", ".webp")]), F.col("suffix")) == best, F.col("url")).otherwise("another file")
    at = f"{folder(spark)}/images-{uuid.uuid4().hex}"
    sinks.write_files(every.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), "suffix").alias("path"), F.lit(0).alias("part"), content.cast("binary").alias("content")), at)
    found = files.page_files(spark, sinks.current(spark, at))
    return found.select("stem", F.regexp_extract("path", r"(\.[^.]+)$", 1).alias("suffix"), F.md5("content").alias("content"))


@query("""with p as (select vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::double + 1) * 128)))::bigint) as r, list_transform(embedding, lambda x: greatest(0, least(255, floor((1 - x::double) * 100)))::bigint) as b from embeddings),
c as (select vec_id, r, b, list_transform(range(64), lambda i: (r[i + 1] * 3 + b[i + 1]) // 4) as g from p),
s as (select vec_id, r, g, b, list_transform(range(25), lambda i: ((i // 5) * 8 // 5) * 8 + (i % 5) * 8 // 5 + 1) as spot from c)
select vec_id, list_sum(list_transform(range(64), lambda i: floor(r[i + 1] * 0.299::double + g[i + 1] * 0.587::double + b[i + 1] * 0.114::double + 0.5)))::bigint as grey,
  len(list_filter(r, lambda x: x < 120)) / 64 as ink,
  round(list_sum(list_transform(range(75), lambda k: ((case k // 25 when 0 then (r[spot[k % 25 + 1]] / 255.0::double - 0.485::double) / 0.229::double when 1 then (g[spot[k % 25 + 1]] / 255.0::double - 0.456::double) / 0.224::double else (b[spot[k % 25 + 1]] / 255.0::double - 0.406::double) / 0.225::double end)::float)::double * (k % 7))), 3) as weighted from s""")
def embedding_inputs(spark, d):
    """Grids of three channels as an embedder's input, their grey values and shares of ink."""
    def scaled(x):
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x))).cast("long")

    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: scaled((x.cast("double") + 1) * 128)).alias("r"), F.transform("embedding", lambda x: scaled((1 - x.cast("double")) * 100)).alias("b"))
    rows = rows.withColumn("g", F.zip_with("r", "b", lambda r, b: F.floor((r * 3 + b) / 4)))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    given = images.embedding_input((r, g, b), F.lit(8), F.lit(8), 5)
    weighted = F.aggregate(F.transform(given, lambda x, k: x.cast("double") * (k % 7)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.aggregate(images.grey(r, g, b), F.lit(0).cast("long"), lambda a, x: a + x).alias("grey"), images.ink_share(r, 120).alias("ink"), F.round(weighted, 3).alias("weighted"))
