import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from storyframe.operators import mixing, outputs, pacing
from storyframe.functions.audio import read_wav
from storyframe.sources import archives, files, sinks


def listed(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_files_appear_together_and_a_failed_write_leaves_the_old_ones(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a/x.txt", 1, b"two"), ("a/x.txt", 0, b"one "), ("b.txt", 0, b"e")], "path string, part int, content binary")
    sinks.write_files(rows, at)
    first = sinks.current(spark, at)
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(first).orderBy("path").collect()] == [("x.txt", b"one two"), ("b.txt", b"e")]
    failing = rows.withColumn("content", F.when(F.col("path") == "b.txt", F.raise_error(F.lit("no"))).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="no"):
        sinks.write_files(failing, at)
    assert sinks.current(spark, at) == first
    names = listed(tmp_path / "out")
    assert [n for n in names if n.endswith(".txt")] == [f"{first.rsplit('/', 1)[1]}/a/x.txt", f"{first.rsplit('/', 1)[1]}/b.txt"]
    sinks.write_files(rows.where("path = 'b.txt'"), at)
    second = sinks.current(spark, at)
    assert second != first and [n for n in names if n not in listed(tmp_path / "out")] == []
    with pytest.raises(Exception, match="overwrite"):
        spark.dataSource.register(sinks.WholeFiles)
        rows.withColumn("part", F.col("part").cast("long")).withColumn("name", F.lit("n")).select("path", "part", "name", "content").write.format("whole_files").mode("append").save(at)


def test_attempts_are_flat_and_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: 1)))
    at = f"file://{tmp_path}/o"
    w = sinks._Versions(at, False, ["path", "part", "name", "content"])
    rows = [(f"run{k // 3}/audio/{k}.wav", 0, None, b"%d" % k) for k in range(9)] + [("top.txt", p, None, c) for p, c in enumerate((b"a", b"b"))]
    message = w.write(iter(rows))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_dir()) == sorted([".attempt-1", w.version, "o"])
    w.commit([message, None])
    now = sinks.current(spark, at)
    (tmp_path / "o" / w.version / "run0/.hidden").write_bytes(b"no")
    found = sinks.listing(spark, now)
    assert sorted(r.path for r in found.collect()) == sorted({r[0] for r in rows})
    assert {r.path: bytes(r.content) for r in sinks.read_files(found, now).collect()} == {r[0]: r[3] for r in rows[:9]} | {"top.txt": b"ab"}


def test_pages_of_archives(spark, tmp_path):
    for volume, n in (("one", 10), ("two", 3), ("none", 0)):
        with zipfile.ZipFile(tmp_path / f"{volume}.cbz", "w") as z:
            for k in range(n):
                z.writestr(f"p{k + 1:03}.png", f"{volume} {k + 1}" * 5)
            z.writestr("notes.txt", "no page")
    (tmp_path / "other.bin").write_bytes(b"")
    # Pages 6 to 10 of the first volume can't be read.
    broken = (tmp_path / "one.cbz").read_bytes()
    for k in range(6, 11):
        broken = broken.replace((f"one {k}" * 5).encode(), (f"one {k}" * 5).encode().swapcase())
    (tmp_path / "one.cbz").write_bytes(broken)
    at = f"file://{tmp_path}"

    def pages(df):
        return sorted((r.volume, r.page, r.name, bytes(r.content).decode()) for r in df.collect())

    want = [("one", k, f"p{k:03}.png", f"one {k}" * 5) for k in range(1, 6)] + [("two", k, f"p{k:03}.png", f"two {k}" * 5) for k in range(1, 4)]
    found = archives.read_pages(spark, at, 1, 5, pagesPerPartition="2")
    assert pages(found) == want and found.rdd.getNumPartitions() == 5
    assert pages(archives.read_pages(spark, at, 2, pagesPerPartition="3").where("volume = 'two'")) == want[6:]
    assert pages(archives.read_pages(spark, at).where("page between 3 and 4")) == [want[2], want[3], want[7]]
    assert pages(archives.read_pages(spark, at, 50, 5)) == []
    assert pages(archives.read_pages(spark, at, 1, 5).where("volume in ('two', 'none') and name like '%2.png'")) == [want[6]]
    with pytest.raises(Exception, match="CRC"):
        archives.read_pages(spark, at).collect()
    with pytest.raises(ValueError):
        archives.read_pages(spark, at, 0)


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{k % 3}.cbz", k, f"{k:04}.html", f"<p>{k}</p>".encode()) for k in range(30)], "path string, part int, name string, content binary")
    sinks.write_files(rows, f"file://{tmp_path}/a", "zip")
    back = archives.read_pages(spark, sinks.current(spark, f"file://{tmp_path}/a"), 2, 3)
    assert sorted((r.volume, r.page, r.name) for r in back.collect()) == sorted((f"v{v}", p, f"{v + 3 * (p - 1):04}.html") for v in range(3) for p in (2, 3, 4))


def test_tracks_are_written_by_block(spark, tmp_path):
    rows = spark.createDataFrame([("v", 0, "A", [0.5] * 3), ("v", 1, "SFX", [0.25] * 2), ("w", 0, "A", [2.0] * 4), ("x", 0, "A", [])], "volume string, block_index int, speaker_id string, samples array<float>")
    blocks = mixing.narration(rows, 2, 1.0, 2.0, size=2)
    x = {}
    for r in blocks.orderBy("volume", "block").collect():
        assert len(r.x) == min(2, r.total - 2 * r.block)
        x.setdefault(r.volume, []).extend(r.x)
    assert x == {"v": [0.5] * 3 + [0.0] * 2 + [0.5] * 2, "w": [2.0] * 4}
    music = spark.createDataFrame([("v", [1.0, -1.0]), ("w", [])], "volume string, samples array<float>")
    bed = {}
    for r in mixing.with_music(blocks, music, 0.1, 2, 2).orderBy("volume", "block").collect():
        bed.setdefault(r.volume, []).extend(r.x)
    assert bed["w"] == [2.0] * 4 and bed["v"] == pytest.approx([0.5, 0.4, 0.6, -0.1, 0.1, 0.4, 0.5])
    sinks.write_files(mixing.wav_parts(mixing.levelled(blocks), 2000), f"file://{tmp_path}/wav")
    got = {r.path.rsplit("/", 1)[1]: read_wav(bytes(r.content)) for r in spark.read.format("binaryFile").load(sinks.current(spark, f"file://{tmp_path}/wav")).collect()}
    assert {k: (rate, len(s)) for k, (s, rate) in got.items()} == {"v.wav": (2000, 7), "w.wav": (2000, 4)}
    assert got["v.wav"][0][:4].tolist() == pytest.approx([0.5, 0.5, 0.5, 0.0], abs=1e-4) and got["w.wav"][0].max() == pytest.approx(0.99, abs=1e-4)


@pytest.mark.parametrize("gap,size,batch", [(0, 3, 1), (2, 4, 3), (5, 2, 10_000)])
def test_segments_are_dealt_once_and_laid_out_like_plain_lists(spark, gap, size, batch):
    n = [[(7 * v + 5 * k + v * k) % 6 for k in range(1 + v % 5)] for v in range(60)]
    rows = [(v, k, "SFX" if (v + k) % 3 == 0 else "A", None if m == 5 else [float(v + i) for i in range(m)]) for v, lengths in enumerate(n) for k, m in enumerate(lengths)]
    want = {}
    for v, _, who, x in rows:
        if x is not None:
            want.setdefault(v, []).append([y * (0.5 if who == "SFX" else 2.0) for y in x])
    want = {v: sum(([0.0] * gap + part for part in parts[1:]), parts[0]) for v, parts in want.items()}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        blocks = mixing.narration(spark.createDataFrame(rows, "volume long, block_index int, speaker_id string, samples array<float>"), gap, 2.0, 0.5, size)
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in blocks.orderBy("volume", "block").collect():
            assert r.total == len(want[r.volume]) and r.block * size == len(got.setdefault(r.volume, []))
            got[r.volume] += r.x
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == {v: x for v, x in want.items() if x}
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_transcripts_are_written_together(spark, tmp_path):
    rows = spark.createDataFrame([("f", 2.0, 3.0, "b"), ("f", 0.0, 1.0, "a"), ("g", 0.0, 1.0, "ü")], "file string, start double, `end` double, text string")
    document = outputs.excerpt_document(rows.withColumn("arc", F.lit(None).cast("string")).withColumn("score", F.lit(0.5)))
    outputs.write_transcript(f"file://{tmp_path}/t", rows, pacing.statistics(rows.withColumn("words", F.lit(1))), document)
    at = sinks.current(spark, f"file://{tmp_path}/t")
    here = tmp_path / "t" / at.rsplit("/", 1)[1]
    assert listed(here) == [f"{f}/{n}" for f in "fg" for n in ("excerpts.md", "pacing.json", "segments.json", "transcript.md")]
    assert (here / "f/transcript.md").read_text() == "a\nb\n" and (here / "g/transcript.md").read_text() == "ü\n"
    assert [r.text for r in spark.read.json(f"{at}/f/segments.json").orderBy("start").collect()] == ["a", "b"]
    assert (here / "g/excerpts.md").read_text() == "## 1. [00:00:00 - 00:00:01] · score 0.500\n\nü\n"


def test_scripts_round_trip(spark, tmp_path):
    panels = spark.read.schema("volume string, page_number int, panel_index int, image_path string, blocks array<struct<text:string,speaker_id:string,is_speech:boolean,sfx:string,voice:string>>").json(
        spark.sparkContext.parallelize(['{"volume": "v", "page_number": 2, "panel_index": 0, "blocks": [{"text": "c", "speaker_id": "A", "is_speech": true}]}',
                                        '{"volume": "v", "page_number": 1, "panel_index": 0, "blocks": [{"text": "a", "speaker_id": "Narrator", "is_speech": false}, {"text": "b", "speaker_id": "A", "is_speech": true, "sfx": "door"}]}']))
    files.write_script(panels, f"file://{tmp_path}/s")
    back = files.read_script(spark, sinks.current(spark, f"file://{tmp_path}/s"))
    assert [(r.volume, r.page, r.pos, r.text, r.sfx) for r in back.orderBy("pos").collect()] == [("v", 1, 0, "a", None), ("v", 1, 1, "b", "door"), ("v", 2, 2, "c", None)]


def test_a_store_cut_off_between_renames_is_found_and_kept(spark, tmp_path):
    at, staging = f"{tmp_path}/store", f"{tmp_path}/staging"
    files.replace_store(spark.createDataFrame([(1,)], "k int"), at, staging)
    (tmp_path / "store").rename(tmp_path / "store.old")
    assert [r.k for r in files.read_store(spark, at).collect()] == [1]
    files.replace_store(spark.createDataFrame([(2,)], "k int"), at, staging)
    assert [r.k for r in files.read_store(spark, at).collect()] == [2] and not (tmp_path / "store.old").exists()
