import pytest
from pyspark.sql import functions as F

from storyframe.functions import images
from storyframe.functions import keys as K
from storyframe.functions import text as T
from storyframe.functions.blocks import blocks_or_plain, parse_blocks
from storyframe.functions.lexicon import SFX_LEXICON


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


JUNK = ["", "   ", "{", "@", "|", "x", "Jbl@jw", "S#2", "XKRTP QWRTS", "}{[]", "= = ="]
FINE = ["Grrrrr!", "Shhhh", "Zzzzz", "Hmph", "Ryu", "É", "1... 2... 3!", "10!", "100% certo", "R$ 50", "30°", "?!", "...", "Não vou embora."]


def test_junk(spark):
    assert apply(spark, JUNK, T.is_junk) == [True] * len(JUNK)
    assert apply(spark, FINE, T.is_junk) == [False] * len(FINE)


def test_clean(spark):
    assert apply(spark, ["{Guts|", "  olá \n  mundo ", "[Vamos!]", "a.b_c"], T.clean) == ["Guts", "olá mundo", "Vamos!", "a.b_c"]


def test_speech_form(spark):
    got = apply(spark, ["Vamos embora.", "Não!!!", "Espere... agora", "......", 'Ele disse "oi"', "o quê??!!"], T.speech_form)
    assert got == ["Vamos embora", "Não!", "Espere, agora", "......", "Ele disse oi", "o quê?!"]
    assert apply(spark, ["......", "!", "Sim"], T.is_pronounceable) == [False, False, True]


def test_tagging_follows_priority(spark):
    def tag(c):
        return T.keyword_tag(c, SFX_LEXICON, {"espada", "fogo", "grito"})

    assert apply(spark, ["a espada em chamas", "o fogo", "um GRITO", "nada", "explosão"], tag) == ["espada", "fogo", "grito", None, None]


def test_narration_score(spark):
    got = apply(spark, ["A sombra avança lentamente na noite", "Eu vou com você!", "", "de repente, booom"], T.narration_score)
    assert got[0] > 0 and got[1] == 0 and got[2] == 0 and got[3] > 0


def test_words_slugs_and_keys(spark):
    assert apply(spark, ["a b ... c", "", "..."], T.word_count) == [3, 0, 0]
    assert apply(spark, ["BERSERK VOL.01", "..."], T.slug) == ["berserk_vol_01", None]
    assert apply(spark, ["Guardião  do Portão"], T.fold) == ["guardiao do portao"]
    assert apply(spark, ["Guardião!", "?"], T.arc_slug) == ["guardiao", "arco"]
    assert apply(spark, [4055.9, -3.0], lambda c: K.timestamp_text(c), "double") == ["01:07:35", "00:00:00"]
    assert apply(spark, ["01:07:35", "05:30", "abc"], K.timestamp_seconds) == [4055.0, 330.0, None]
    assert apply(spark, ["http://h/v1/", "http://h//", "http://h"], K.server_url) == ["http://h"] * 3
    assert apply(spark, ["a:first=12:x", "a"], K.first_page) == [12, 1]
    assert apply(spark, [" Homem ", "robot", None], K.voice_profile) == ["homem", None, None]
    assert apply(spark, ["abc", ""], K.silent_ms) == [300, 300]


@pytest.mark.parametrize("raw,n", [
    ('[{"text": "a", "speaker_id": "x"}, {"text": "b"}]', 2), ('[{"text": ""}, {"text": "b"}]', 1), ('so: [{"text": "a"}, {"text": "b"}, {"te', 2),
    ("no array", None), ('[{"text": " "}]', 0), ('Here: [{"text": "a"}] done', 1), ("[42]", 0), ("[", None),
])
def test_blocks(spark, raw, n):
    got = apply(spark, [raw], parse_blocks)[0]
    assert (None if got is None else len(got)) == n


def test_block_fields_and_fallback(spark):
    b = apply(spark, ['[{"text": " a ", "sfx": " FOGO ", "is_speech": "false", "voice": "Robot"}]'], parse_blocks)[0][0]
    assert (b.text, b.speaker_id, b.is_speech, b.sfx, b.voice) == ("a", "Desconhecido", True, "fogo", None)
    rows = spark.createDataFrame([("none", ["Berserk!", " "])], "raw string, texts array<string>")
    got = rows.select(blocks_or_plain(F.col("raw"), F.col("texts")).alias("b")).first().b
    assert [(x.text, x.speaker_id, x.is_speech) for x in got] == [("Berserk!", "Desconhecido", True)]


def test_keys_of_latin_script_are_those_of_the_unicode_data(spark):
    words = ["Ação  É\u00a0Olá", "STRASSE Straße ẞ", "Łódź Øre Æther œuvre ĳ ŉ Ǆ", "e\u0301 n\u0303", "Ệ ǟ ȱ ṩ", "\x1c a\x1f\u2003b \u3000", "", None]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    got = {r.k: r.f for r in rows.select("k", T.fold("w").alias("f")).collect()}
    assert got == {k: None if w is None else T.folded(w) for k, w in enumerate(words)}
    every = "".join(chr(c) for c in [*range(32, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)])
    one = spark.createDataFrame([(every,)], "w string").select(T.fold("w").alias("f"), T.fold("w").alias("g")).first().f
    assert one == T.folded(every)
    plan = rows.select(T.fold("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_images_as_columns(spark):
    one = spark.createDataFrame([([255, 0, 10, 20, 30, 40], [255, 0, 0, 0, 0, 0], [255, 0, 0, 0, 0, 90], [])], "r array<long>, g array<long>, b array<long>, none array<long>")
    given = images.embedding_input((one.r, one.g, one.b), F.lit(3), F.lit(2), 2)
    r = one.select(images.grey(one.r, one.g, one.b).alias("grey"), images.sampled(one.r, F.lit(3), F.lit(2), 4).alias("s"), given.alias("x"), images.ink_share(one.r, 20).alias("ink"), images.ink_share(one.none).alias("no")).first()
    assert r.grey == [255, 0, 3, 6, 9, 22] and (r.ink, r.no) == (2 / 6, 0.0)
    assert r.s == [255, 255, 0, 10, 255, 255, 0, 10, 20, 20, 30, 40, 20, 20, 30, 40]
    assert len(r.x) == 12 and r.x[:2] == pytest.approx([(1 - 0.485) / 0.229, -0.485 / 0.229], rel=1e-6) and r.x[-1] == pytest.approx((0 - 0.406) / 0.225, rel=1e-6)
