from storyframe.streaming.sessions import announcements, sessions


def test_sessions_stream_as_in_batch(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 3 as user_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "30 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("s").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("s").selectExpr("user_id", "cast(start as timestamp_ntz)", "cast(end as timestamp_ntz)", "n").collect())) == sorted(map(tuple, sessions(rows).collect()))
    finally:
        q.stop()


def test_announcements_keep_the_last_speaker(spark, tmp_path):
    data = [("v", 0, "A", True), ("v", 1, "Narrator", False), ("v", 2, "A", True), ("v", 3, "B", True)]
    spark.createDataFrame(data, "volume string, pos int, speaker_id string, is_speech boolean").write.parquet(str(tmp_path / "in"))
    schema = "volume string, pos int, speaker_id string, is_speech boolean"
    q = announcements(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("a").start()
    try:
        q.processAllAvailable()
        assert sorted((r.pos, r.speaker_id) for r in spark.table("a").collect()) == [(0, "A"), (3, "B")]
    finally:
        q.stop()
