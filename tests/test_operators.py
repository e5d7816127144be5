import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyframe.functions import geometry as G
from storyframe.functions import options, prompts
from storyframe.functions.blocks import reviewed
from storyframe.functions.audio import read_wav, resampled, write_wav
from storyframe.operators import arcs, casting, checkpoint, excerpts, gallery, labels, layout, models, narration, outputs, pacing
from storyframe.sources import files
from storyframe.stages import stub_embedding, stub_text, suggestions, text_stage


def script(spark, rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], "volume string, pos int, panel int, text string, speaker_id string, is_speech boolean, sfx string")


def test_narration_plan(spark):
    rows = [(0, "n1", "Narrator", False, None), (0, "a1", "A", True, None), (0, "a2", "A", True, None), (1, "b1", "B", True, "fogo"), (1, "n2", "Narrator", False, None), (1, "a3", "A", True, None)]
    got = narration.plan(script(spark, rows)).orderBy("block_index").collect()
    assert [r.kind for r in got] == ["speech", "announcement", "speech", "speech", "sfx", "announcement", "speech", "speech", "announcement", "speech"]
    assert next(r.seed for r in got if r.kind == "sfx") == "b1"
    assert [r.kind for r in narration.plan(script(spark, rows[1:3] + rows[3:4]), False, False).collect()] == ["speech"] * 3


@pytest.mark.parametrize("k,expected", [(0, ["fogo", None, None]), (1, ["fogo", None, None]), (2, ["fogo", "espada", None]), (3, ["fogo", "espada", "grito"])])
def test_effect_cap(spark, k, expected):
    rows = script(spark, [(0, "x", "Narrator", False, "fogo"), (0, "espada", "Narrator", False, None), (0, "grito", "Narrator", False, None)])
    tag = F.when(F.col("text") == "espada", "espada").when(F.col("text") == "grito", "grito")
    assert [r.sfx for r in narration.capped_tags(rows, tag, k).orderBy("pos").collect()] == expected


def test_speech_is_tagged_at_three_only(spark):
    rows = script(spark, [(0, "espada", "A", True, None)])
    assert [narration.capped_tags(rows, F.lit("espada"), k).first().sfx for k in (2, 3)] == [None, "espada"]


def test_votes_and_cast(spark):
    v = spark.createDataFrame([("v", "S", 0, "homem"), ("v", "S", 1, None), ("v", "S", 2, "idoso"), ("v", "S", 3, "idoso"), ("v", "T", 4, "homem"), ("v", "T", 5, "idoso"), ("v", "U", 6, None)], "volume string, speaker_id string, pos int, voice string")
    assert {r.speaker_id: r.profile for r in casting.majority_profile(v).collect()} == {"S": "idoso", "T": "homem", "U": None}
    p = spark.createDataFrame([("v", "Guts", "homem"), ("v", "M", "mulher"), ("v", "X", "robot"), ("v", "H1", "homem"), ("v", "H2", "homem")], "volume string, speaker_id string, profile string")
    got = {r.speaker_id: r.voice for r in casting.cast_voices(p, {"Guts": "G"}, {"homem": ["A", "B"], "mulher": ["C"]}, ["Z"]).collect()}
    assert (got["Guts"], got["M"], got["X"], {got["H1"], got["H2"]}) == ("G", "C", "Z", {"A", "B"})
    kept = spark.createDataFrame([("v", "H1", "Q")], "volume string, speaker_id string, voice string")
    assert {r.speaker_id: r.voice for r in casting.cast_voices(p, {}, {"homem": ["A", "B"]}, ["Z"], kept).collect()}["H1"] == "Q"


def transcript(spark, rows):
    return spark.createDataFrame([("f", float(a), float(b), n) for a, b, n in rows], "file string, start double, end double, words long")


def test_pacing(spark):
    r = pacing.statistics(transcript(spark, [(0, 2, 4), (2.5, 4.5, 3), (7, 9, 3)])).first()
    assert (r.speech_s, r.total_s, r.wpm_speech, r.wpm_total, r.pauses, r.pause_mean, r.pause_p90, r.long_pauses) == (6.0, 9.0, 100.0, 66.667, 2, 1.5, 2.3, 1)
    r = pacing.statistics(transcript(spark, [(0, 2, 1)])).first()
    assert (r.wpm_speech, r.pauses, r.pause_mean) == (30.0, 0, 0.0)
    many = transcript(spark, [(sum(range(k)) * 0.1 + 10 * k, sum(range(k)) * 0.1 + 10 * k + 1, 1) for k in range(61)])
    assert pacing.long_pauses(many, 0.0).count() == 50


def test_arcs(spark):
    lines = spark.createDataFrame([("00:00 Abertura",), ("texto",), ("05:30 - O Guardião",), ("01:07:35 — Fim",)], "value string")
    a = files.arcs(lines)
    assert [(r.start_s, r.title) for r in a.collect()] == [(0.0, "Abertura"), (330.0, "O Guardião"), (4055.0, "Fim")]
    t = spark.createDataFrame([(0.0,), (329.9,), (330.0,), (99999.0,), (-1.0,)], "t double")
    got = {r.t: r.title for r in arcs.as_of(t, a, [], "t", "start_s", "title").collect()}
    assert got == {0.0: "Abertura", 329.9: "Abertura", 330.0: "O Guardião", 99999.0: "Fim", -1.0: None}
    assert arcs.find(a, "guardiao").first().start_s == 330.0 and not arcs.find(a, "zzz").count()
    assert {r.title: r.end_s for r in arcs.bounds(a, [], F.lit(5000.0)).collect()} == {"Abertura": 330.0, "O Guardião": 4055.0, "Fim": 5000.0}


def test_excerpts(spark):
    rows = excerpts.numbered(transcript(spark, [(10 * i, 10 * i + 5, 5) for i in range(60)]))
    w = excerpts.windows(rows, 60.0).withColumns({"score": F.lit(1.0), "t0": F.lit(0.0), "t1": F.lit(595.0)})
    got = excerpts.select(w, 3, "file string, first long, start double, `end` double, segments long, score double, t0 double, t1 double").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 55.0), (200.0, 255.0), (400.0, 455.0)]


def circle(spark, rows):
    return spark.createDataFrame([(i, n, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, (n, a) in enumerate(rows)], "id int, name string, v array<double>")


def test_gallery_gate(spark):
    g = circle(spark, [("A", 0), ("A", 10), ("B", 90)]).withColumn("id", F.col("id") + 100)
    q = circle(spark, [("?", 5), ("?", 40)])
    got = {r.id: r for r in gallery.match(gallery.scores(q, g, "nearest"), 0.9, 0.05).collect()}
    assert got[0].name == "A" and got[1].name is None and got[1].best == "A"
    g = circle(spark, [("A", -40), ("A", 40)]).withColumn("id", F.col("id") + 100)
    s = {k: gallery.scores(circle(spark, [("?", 40)]), g, k).first().score for k in ("nearest", "prototype", "mixed")}
    assert s["nearest"] == pytest.approx(1.0) and s["prototype"] == pytest.approx(math.cos(math.radians(40))) and s["mixed"] == pytest.approx((s["nearest"] + s["prototype"]) / 2)


def test_leave_one_out(spark):
    crops = circle(spark, [("A", 0), ("A", 8), ("A", -8), ("B", 90), ("B", 84), ("C", 200), ("unknown", 300)])
    m = gallery.match(gallery.scores(crops, crops.where("name <> 'unknown'"), "mixed"), 0.9, 0.05)
    truth = crops.select("id", F.col("name").alias("truth"))
    r = gallery.evaluate(m, truth, "unknown").first()
    assert (r.known, r.correct, r.extras_rejected) == (6, 5, 1.0) and r.accuracy == pytest.approx(5 / 6)
    assert not gallery.confusions(m, truth, "unknown").count()
    two = circle(spark, [("A", 0), ("A", 5), ("B", 90), ("B", 95), ("unknown", 200)])
    got = gallery.sweep(gallery.scores(two, two.where("name <> 'unknown'"), "nearest"), two.select("id", F.col("name").alias("truth")), [0.5, 0.999], 0.05, "unknown").orderBy("accept").collect()
    assert [x.correct for x in got] == [4, 0]


def test_eligible(spark):
    rows = spark.createDataFrame([(1, "Guts"), (2, "Guts"), (3, "Puck"), (4, "unknown"), (5, None)], "id int, name string")
    assert sorted(r.id for r in gallery.eligible(rows, 2, "unknown").collect()) == [1, 2, 4]


def test_reading_order():
    left, right, below = (0, 0, 40, 40), (60, 0, 100, 40), (0, 50, 100, 90)
    assert layout.reading([left, right, below], True) == [1, 0, 2] and layout.reading([left, right, below], False) == [0, 1, 2]
    tall, top, bottom, low = (60, 0, 100, 90), (0, 0, 50, 40), (0, 50, 50, 90), (0, 100, 100, 140)
    assert layout.reading([top, low, bottom, tall], True) == [3, 0, 2, 1]
    assert layout.reading([top, low, bottom, tall], False) == [0, 2, 3, 1]


def test_geometry_and_suppression(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    assert rows.select(G.containment(G.box("a_"), G.box("b_"))).first()[0] == 0.25
    boxes = spark.createDataFrame([(0.1, 0.2, 0.5, 0.6), (0.5, 0.2, 0.1, 0.6), (0.1, 0.2, 0.5, 1.6)], "x0 double, y0 double, x1 double, y1 double")
    assert [r[0] for r in boxes.select(G.valid(G.box())).collect()] == [True, False, False]
    d = spark.createDataFrame([(1, "body", 0.9, 0, 0, 100, 100), (1, "body", 0.8, 2, 2, 100, 100), (1, "face", 0.7, 2, 2, 100, 100), (1, "body", 0.6, 200, 0, 300, 100)], "page int, label string, confidence double, x0 long, y0 long, x1 long, y1 long")
    assert sorted(r.confidence for r in layout.suppressed(d, ["page"]).collect()) == [0.6, 0.7, 0.9]
    flags = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True, False, True, True])], "g int, i int, f boolean")
    assert tuple(layout.longest_run(flags, ["g"], "i", "f").first()) == (1, 2, 2) and layout.leading_run(flags, ["g"], "i", "f").first().length == 1


def test_a_hole_meets_panels_as_earlier_holes_left_them(spark):
    panels = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 100, 0, 110, 10), (2, 1, 0, 0, 10, 10)], "page int, panel int, p_x0 long, p_y0 long, p_x1 long, p_y1 long")
    holes = spark.createDataFrame([(1, 2, 60, 0, 70, 10), (1, 1, 40, 0, 50, 10), (3, 1, 0, 0, 1, 1)], "page int, hole int, b_x0 long, b_y0 long, b_x1 long, b_y1 long")
    # The second hole is nearer to the second panel, until the first has grown by the first hole.
    assert sorted(map(tuple, layout.absorb(holes, panels, ["page"]).collect())) == [(1, 1, 0, 0, 70, 10), (1, 2, 100, 0, 110, 10), (2, 1, 0, 0, 10, 10)]
    tie = spark.createDataFrame([(1, 1, 50, 0, 60, 10)], holes.schema)
    assert sorted(map(tuple, layout.absorb(tie, panels.where("page = 1"), ["page"]).collect())) == [(1, 1, 0, 0, 60, 10), (1, 2, 100, 0, 110, 10)]


def test_reading_order_of_rows_that_overlap():
    # No straight cut: two bands of rows (the second box reaches into the band of the first), each from the right.
    boxes = [(0, 0, 60, 40), (55, 10, 100, 45), (0, 42, 50, 90), (45, 38, 100, 95)]
    assert layout.reading(boxes, True) == [1, 0, 3, 2] and layout.reading(boxes, False) == [0, 1, 2, 3]
    assert layout.reading([], True) == [] and layout.reading([(0, 0, 1, 1)], False) == [0]
    rows = [(0, y, 10, y + 5) for y in (30, 10, 20)]
    assert layout.reading(rows, True) == [1, 2, 0]


def test_gutters(spark):
    def cuts(pattern, least=2, side=3):
        rows = spark.createDataFrame([(1, i, c == ".") for i, c in enumerate(pattern)], "p int, line int, blank boolean")
        return layout.gutters(rows, ["p"], "line", "blank", least, side).first().cuts

    assert cuts("####..####..####") == [5, 11] and cuts("..####..####") == [7] and cuts("####.####") == []
    assert cuts("####..##..####") == [5] and cuts("####..##") == [] and cuts("....") == []


def test_a_store_is_whole_after_it_is_replaced(spark, tmp_path):
    at, staging = f"{tmp_path}/store", f"{tmp_path}/staging"
    for k in (1, 2):
        files.replace_store(spark.createDataFrame([(k,)], "k int"), at, staging)
        assert [r.k for r in spark.read.parquet(at).collect()] == [k]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["store"]


def test_options(spark):
    one = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(Exception, match="unknown provider"):
        one.select(options.provider(F.lit("nobody"), F.array(F.lit("k")), [("a", "k")], "own", ["a", "own"])).collect()
    wanted = spark.createDataFrame([(1, "gone", True)], "x int, name string, explicit boolean")
    with pytest.raises(Exception, match="no music file gone"):
        options.music(wanted, spark.createDataFrame([("dark", "dark.wav")], "stem string, path string"), ["x"]).collect()
    assert options.hotkey_legend(["Ana"], [("0", "Narrator"), ("x", "junk")]) == "1=Ana  0=Narrator  x=junk"


def test_a_file_without_excerpts(spark):
    nothing = spark.createDataFrame([("f", 2.0, 3.0, None, None, None)], "file string, start double, `end` double, text string, arc string, score double")
    assert outputs.excerpt_document(nothing).first().document == "(none)"


def test_labels_and_checkpoints(spark):
    items = spark.createDataFrame([("d", "1", "a"), ("d", "2", "b")], "mode string, key string, text string")
    known = spark.createDataFrame([("d", "1", "a", "x")], "mode string, key string, text string, label string")
    assert [r.key for r in labels.pending(items, known).collect()] == ["2"]
    assert sorted(r.key for r in labels.pending(items.withColumn("text", F.concat("text", F.lit("!"))), known).collect()) == ["1", "2"]
    assert labels.upsert(known, known.withColumn("label", F.lit("y")), ["mode", "key"]).first().label == "y"

    def config(tts, vlm="v"):
        return spark.createDataFrame([("script", "vlm", vlm), ("audio", "tts", tts)], "stage string, component string, fingerprint string")

    empty = config("a").limit(0)
    assert [tuple(checkpoint.reuse(*x).first()) for x in ((config("a"), config("a")), (config("a"), config("b")), (config("a"), config("a", "w")), (empty, config("a")))] == [(True, True), (True, False), (False, False), (False, False)]
    assert not checkpoint.reuse(config("a"), config("a"), audio_there=False).first().audio
    assert [r.stage for r in checkpoint.write_section(config("a"), config("a").where("stage = 'script'"), "script").collect()] == ["script"]


def test_audio(spark):
    x, rate = read_wav(write_wav(np.array([0.0, 0.5, -0.5])))
    assert rate == 24000 and np.allclose(x, [0, 0.5, -0.5], atol=1e-3)
    one = spark.createDataFrame([([0.0, 1.0, 3.0], [], [4.0])], "a array<float>, b array<float>, c array<float>")
    r = one.select(resampled(one.a, 1, 2).alias("up"), resampled(one.a, 3, 1).alias("down"), resampled(one.b, 1, 2).alias("none"), resampled(one.c, 2, 1).alias("one"), resampled(one.a, 5, 5).alias("same")).first()
    assert r.up == pytest.approx(np.interp(np.linspace(0, 2, 6), range(3), [0, 1, 3])) and (r.down, r.none, r.one, r.same) == ([0.0], [], [4.0], [0.0, 1.0, 3.0])


def test_effect_tags_and_promotion(spark):
    f = spark.createDataFrame([("a.wav",), ("fogo_2.wav",)], "file string")
    e = spark.createDataFrame([("fogo", 1, "fogo_2.wav")], "tag string, ord int, file string")
    assert [r.tag for r in files.effect_tags(f, e).collect()] == ["a", "fogo"]
    new = spark.createDataFrame([("fogo", 1, ".wav"), ("mar", 1, ".ogg")], "tag string, ord int, suffix string")
    assert sorted(r.file for r in files.register_effects(e, new).collect()) == ["fogo_2.wav", "fogo_2.wav", "mar.ogg"]
    d = spark.createDataFrame([("broken {",), ('{"fogo": [{"file": "x"}]}',)], "t string").select(F.size(files.dictionary(F.col("t"))).alias("n"))
    assert [r.n for r in d.collect()] == [0, 1]


def test_stages(spark):
    rows = spark.createDataFrame([(bytearray(b"a"),), (None,)], "b binary").select(text_stage(stub_text)("b").alias("t")).collect()
    assert len(rows[0].t) == 12 and rows[1].t is None
    assert len(stub_embedding()([b"x"])[0]) == 16


def test_queries_have_the_columns_of_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_review_is_whole_or_nothing(spark):
    whole = '{"panel": 3, "blocks": ["a"], "more": 1}'
    texts = [whole, "So: " + whole + " done", '{"panel": "3", "blocks": ["a"]}', '{"panel": 3, "blocks": [1]}', '{"blocks": ["a"]}', '{"panel": 3.5, "blocks": []}', '{"panel": 3, "blocks": null}', "{" + whole, "[]", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    kept = rows.select("k", reviewed(rows.t, "panel long not null, blocks array<string> not null, note struct<x:double,y:boolean>").alias("r")).where("r is not null").collect()
    assert [(r.k, r.r.panel, r.r.blocks, r.r.note) for r in kept] == [(0, 3, ["a"], None), (1, 3, ["a"], None)]
    panels = spark.createDataFrame([("v", p, 0 if p < 2 else 1, ["x"]) for p in range(4)], "volume string, panel int, chunk long, blocks array<string>")
    answers = spark.createDataFrame([("v", 0, '{"panels": [{"panel": 0, "blocks": ["a"]}, {"panel": 0, "blocks": ["b"]}, {"panel": 3, "blocks": ["c"]}, {"panel": 1, "blocks": []}]}'), ("v", 1, '{"panels": [{"panel": 2, "blocks": ["d"]}, {"panel": "3", "blocks": ["e"]}]}')], "volume string, chunk long, raw string")
    got = narration.review(panels, answers).orderBy("panel").collect()
    assert [(r.blocks, r.changed, r.answered) for r in got] == [(["b"], True, True), (["x"], False, True), (["x"], False, False), (["x"], False, False)]


def test_runs_hold_by_configs_and_files(spark):
    parts = [("script", "vlm"), ("audio", "tts")]
    current = spark.createDataFrame([(r, s, c, "1") for r in "abcdef" for s, c in parts], "run string, stage string, component string, fingerprint string")
    stored = current.where("run <> 'e'").withColumn("fingerprint", F.when((F.col("run") == "b") & (F.col("stage") == "audio"), "0").when((F.col("run") == "f") & (F.col("stage") == "script"), "0").otherwise(F.col("fingerprint")))
    segments = spark.createDataFrame([(r, f"{r}/audio/{k}.wav") for r in "abcdef" for k in range(2)], "run string, path string")
    files_ = [f"{r}/audio/{k}.wav" for r in "abcdef" for k in range(2) if (r, k) != ("c", 1)] + [f"{r}/{n}" for r in "abcdef" for n in ("script/panels.json", "audio/segments.json") if (r, n) != ("d", "script/panels.json")]
    got = checkpoint.resumable(stored, current, segments, spark.createDataFrame([(f,) for f in files_], "path string")).collect()
    assert {r.run: (r.script, r.audio, r.missing) for r in got} == {"a": (True, True, 0), "b": (True, False, 0), "c": (True, False, 1), "d": (False, False, 0), "e": (False, False, 0), "f": (False, False, 0)}


def test_kept_and_curated_voices_are_in_use(spark):
    p = spark.createDataFrame([("v", s, "homem") for s in ("ana", "bia", "cy", "di")] + [("w", "x", None)], "volume string, speaker_id string, profile string")
    kept = spark.createDataFrame([("v", "zed", "A"), ("v", "bia", "B"), ("u", "old", "Q"), ("v", "cy", None)], "volume string, speaker_id string, voice string")
    got = {(r.volume, r.speaker_id): r.voice for r in casting.cast_voices(p, {"ana": "C"}, {"homem": ["A", "B", "C", "D"]}, ["Z"], kept).collect()}
    assert got["v", "zed"] == "A" and got["v", "bia"] == "B" and got["v", "ana"] == "C" and got["v", "cy"] == "D" and got["v", "di"] in "ABCD" and got["w", "x"] == "Z" and got["u", "old"] == "Q" and len(got) == 7


def test_projectors_by_family_and_shared_runs(spark):
    made = spark.createDataFrame([("a", "m/Qwen3VL-8B-Instruct-Q4_K_M.gguf"), ("b", "m/Gemma-3-4b.gguf"), ("c", "x-x-y.gguf"), ("d", "---.gguf")], "folder string, model string")
    beside = spark.createDataFrame([("a", "mmproj-Qwen3VL-8B-Instruct-F16.gguf"), ("a", "mmproj-Qwen3VL-4B-Instruct-F16.gguf"), ("a", "mmproj-gemma-8B-Instruct-Q4_K_M.gguf"), ("b", "mmproj-F16.gguf"),
                                    ("c", "mmproj-x.gguf"), ("c", "mmproj-xx-x.gguf"), ("c", "mmproj-y.gguf"), ("d", "p1.gguf"), ("d", "p2.gguf")], "folder string, file string")
    got = sorted((r.folder, r.file) for r in models.projectors(made, beside, ["folder"]).collect())
    assert got == [("a", "mmproj-Qwen3VL-8B-Instruct-F16.gguf"), ("b", "mmproj-F16.gguf"), ("c", "mmproj-x.gguf"), ("c", "mmproj-xx-x.gguf")]


def test_requests_and_styles(spark):
    one = spark.createDataFrame([('m"1', "be brief", 'a "b"\n', ["data:x"], ["door"])], "m string, s string, t string, u array<string>, tags array<string>")
    full = one.select(prompts.request(one.m, one.s, one.t, prompts.answer_schema(one.tags), one.u).alias("r")).first().r
    body = json.loads(full)
    assert body["model"] == 'm"1' and body["max_tokens"] == 2048 and body["messages"][0] == {"role": "system", "content": "be brief"}
    assert body["messages"][1]["content"] == [{"type": "image_url", "image_url": {"url": "data:x"}}, {"type": "text", "text": 'a "b"\n'}]
    schema = body["response_format"]["json_schema"]["schema"]
    assert schema["items"]["properties"]["sfx"] == {"type": "string", "enum": ["door"]} and schema["items"]["required"] == ["text", "speaker_id", "is_speech"]
    plain = json.loads(one.select(prompts.request(one.m, one.s, one.t).alias("r")).first().r)
    assert "response_format" not in plain and len(plain["messages"][1]["content"]) == 1
    styles = spark.createDataFrame([("drama", 350)], "style string, gap int")
    assert options.styled(spark.createDataFrame([(1, " Drama ")], "x int, style string"), styles).first().gap == 350
    with pytest.raises(Exception, match="unknown style opera"):
        options.styled(spark.createDataFrame([(1, "opera")], "x int, style string"), styles).collect()


def test_suggested_tags_of_the_audio_labels(spark):
    rows = spark.createDataFrame([("f", "sword slash", 0.5), ("f", "metal blade", 0.7), ("f", "thunder", 0.6), ("f", "footsteps", 0.9), ("f", "crowd murmur", 0.2), ("f", "laser", 0.9)], "file string, label string, score double")
    assert [(r.tag, r.score, r["rank"]) for r in suggestions(rows, known=["passos"]).orderBy("rank").collect()] == [("espada", 0.7, 1), ("trovao", 0.6, 2)]


def test_an_evaluation_without_extras_or_confusions(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "B")], "id int, truth string")
    found = spark.createDataFrame([(1, "A"), (2, None)], "id int, name string")
    steps = spark.createDataFrame([(0.8, 2, 1, 1, 0, 0)], "accept double, known long, correct long, unnamed long, rejected long, extras long")
    got = outputs.evaluation_text("v", "e", "mixed", 0.05, gallery.evaluate(found, truth, "?"), gallery.per_name(found, truth, "?"), gallery.confusions(found, truth, "?"), steps).first().document
    assert got.splitlines()[4:] == ["**Acurácia de nomeação: 50.0%** · desconhecido: 50.0%", "", "| Personagem | recortes | acertos | desconhecido |", "|---|---|---|---|", "| A | 1 | 1 | 0 |", "| B | 1 | 0 | 1 |", "",
        "| aceite | acurácia | desconhecido | figurantes rejeitados |", "|---|---|---|---|", "| 0.80 | 50.0% | 50.0% | — |"]


def test_the_first_row_of_the_files_is_kept(spark, tmp_path):
    """Of rows that share a page and a number: by name of the file, then by place in it, whatever the sizes of the files."""
    import __spark_entry__ as e

    def rows(first, n):
        return [(p, 5, first + p % 7, 1, float(first % 40), flag) for p in range(n) for flag in ("A", "N")]

    for name, made in (("a", rows(3, 20) + rows(900, 20)), ("b", rows(500, 4000))):
        table = pa.Table.from_pylist([dict(zip(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"), r)) for r in made])
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pq.write_table(table, tmp_path / "lineitem.parquet" / f"{name}.parquet")
    expected = {p: ((3 if p < 20 else 500) + p % 7) * 53 % 1300 - 200 for p in range(4000)}
    got = {r.page: r.y0 for r in e.queries()["box_unions"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_each_side_of_the_gallery_is_copied_a_fixed_number_of_times():
    assert [gallery.sides(n, n, 10) for n in (1, 2000, 50_000, 700_000)] == [(1, 1), (8, 8), (12, 12), (12, 12)]
    assert gallery.sides(6_553_600, 1, 10) == (100, 1) and gallery.sides(20_480, 20_480, 20_480) == (12, 12) and gallery.sides(204_800, 204_800, 204_800) == (100, 100)


def test_products_of_a_pair_of_blocks_in_tiles():
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=(2500, 4)), rng.normal(size=(5000, 4))
    names = [None if k % 9 == 8 else f"n{k % 9}" for k in range(5000)]
    names[4999] = "alone"
    q = pa.table({"id": pa.array(np.arange(2500) * 2 + 1), "v": pa.array(list(v))})
    g = pa.table({"g_id": pa.array(np.arange(5000)), "g_name": names, "g_v": pa.array(list(w))})
    got = {(r["id"], r["name"]): r for r in gallery._products(pa.int64())(q, g).to_pylist()}
    product, label = v @ w.T, np.array([str(n) for n in names])
    itself = (np.arange(2500) * 2 + 1)[:, None] == np.arange(5000)
    for name in set(names):
        mine = label == str(name)
        count = (mine & ~itself).sum(1)
        for k in range(2500):
            r = got.pop((2 * k + 1, name), None)
            if not count[k]:
                assert r is None
                continue
            x = product[k][mine & ~itself[k]]
            assert r["n"] == count[k] and np.isclose(r["nearest"], x.max()) and np.isclose(r["along"], x.sum())
    assert not got


@pytest.mark.parametrize("rtl", [True, False])
def test_few_boxes_are_read_like_many(monkeypatch, rtl):
    rng = np.random.default_rng(5)
    pages = []
    for k in range(1500):
        low = rng.integers(0, 12 if k % 2 else 60, (rng.integers(0, 12), 2))
        page = np.c_[low, low + rng.integers(0, 20, low.shape)]
        pages.append([tuple(b) for b in (page / 7 if k % 3 == 0 else page).tolist()])
    few = [layout.reading(p, rtl) for p in pages]
    monkeypatch.setattr(layout, "FEW", -1)
    assert few == [layout.reading(p, rtl) for p in pages]
