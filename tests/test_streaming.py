"""Streams give what batches give."""

from pyspark.sql import functions as F

from textloom.streaming import sessions


def _parts(df, folder, parts):
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)


def _run(stream, mode, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_chunk_stream(spark, tmp_path):
    texts = ["今天很好。明天", "今天很好。明天也好。", "昨天不好。", "今天很好。明天也好。后天见"]
    rows = [("a", i, t, i == 3, i // 2) for i, t in enumerate(texts)] + [("b", i, "x" * 50 * i, False, i // 2) for i in range(4)]
    df = spark.createDataFrame(rows, "session_id string, revision_no long, text string, boundary boolean, part int")
    source = str(tmp_path / "in")
    _parts(df, source, 2)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run(sessions.chunk_stream(stream), "append", "chunked", tmp_path)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(key, spark.table("chunked").collect()))
    want = sorted(map(key, sessions.chunks_of_sessions(df).collect()))
    assert got == want
    assert [r for r in want if r[4] != "None"][0][:2] == ("a", "2")
    assert [r[3] for r in want if r[0] == "a" and r[4] == "None"] == ["今天很好。", "明天也好。", "后天见"]


def test_memory_stream(spark, tmp_path):
    rows = [("s", i, f"n{i % 3}", 0.9, i, i // 3) for i in range(9)]
    df = spark.createDataFrame(rows, "session_id string, t long, name string, confidence double, observation_id long, part int").select("session_id", F.timestamp_seconds("t").alias("ts"), "name", "confidence", "observation_id", "part")
    source = str(tmp_path / "in")
    _parts(df, source, 3)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    _run(sessions.memory_stream(stream), "update", "remembered", tmp_path)
    last = {(r.name, r.occurrences, r.trust) for r in spark.table("remembered").where("occurrences = 3").collect()}
    assert last == {(r.name, r.occurrences, r.trust) for r in sessions.session_memory(df).collect()} == {(f"n{i}", 3, "accepted") for i in range(3)}
