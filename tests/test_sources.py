"""Readers, the recording source, feature caches and streams, on files that the tests write."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from spindrift.sources import logs, recording
from spindrift.streaming import live


def test_behaviour_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,code\n5.5,3\n\n1.25,1000\nx,4\n7,11,extra\nNaN,3\n")
    got = logs.behaviour(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [(r["ts"], r["code"]) for r in got] == [(5.5, 3), (1.25, 1000), (7.0, 11)]


def test_meta_and_shape(spark, tmp_path):
    (tmp_path / "a.meta").write_text("nSavedChans=8\nimSampRate=2500\nfileSizeBytes=16000\nnote=a=b\njunk\n")
    (tmp_path / "b.meta").write_text("other=1\n")
    df = logs.meta(spark, str(tmp_path / "*.meta"))
    assert {r["path"][-6:]: r["fields"].get("note") for r in df.collect()} == {"a.meta": "a=b", "b.meta": None}
    got = {r["path"][-6:]: tuple(r)[1:4] for r in df.select("path", *logs.recording_shape("fields")).collect()}
    assert got == {"a.meta": (8, 2500.0, 1000), "b.meta": (385, 30000.0, 0)}


def test_labels_and_camera(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Cluster_ID\tKSLabel\n1\t Good \n2\tmua\n3\tGOOD\n")
    labels = logs.unit_labels(spark, str(tmp_path / "g.tsv"))
    spikes = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (9, 8)], "unit int, t long")
    assert sorted(r["t"] for r in logs.good_units(spikes, labels).collect()) == [5, 7]
    (tmp_path / "c.txt").write_text("0  10   1.5\n1 11 2.5 more\n2 12\n")
    assert [(r["frame"], r["ts"]) for r in logs.camera(spark, str(tmp_path / "c.txt")).orderBy("row").collect()] == [(10, 1.5), (11, 2.5)]


def test_sync_documents_and_caches(spark, tmp_path):
    df = spark.range(1).select(
        logs.sync_json(F.lit(1.5), F.lit(0.25), F.lit(None).cast("double"), F.array(F.struct(F.lit(1.0).alias("bhv_time"), F.lit(2.0).alias("ephys_time"))), F.create_map(F.lit("method"), F.lit("x"))).alias("doc")
    )
    (tmp_path / "s.json").write_text(df.first()["doc"])
    back = logs.sync(spark, str(tmp_path / "s.json")).first()
    assert (back["warp"]["stretch"], back["warp"]["rmse"], back["events"][0]["ephys_time"], back["metadata"]) == (1.5, None, 2.0, {"method": "x"})
    old = spark.createDataFrame([("a", 1), ("b", 2)], "feature string, z int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "feature string, z int")
    assert sorted(map(tuple, logs.upsert_features(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    path = str(tmp_path / "cache")
    logs.write_features(old, path)
    logs.write_features(new, path)
    assert sorted((r["feature"], r["z"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_recording_chunks(spark, tmp_path):
    x = np.arange(1000 * 4, dtype="<i2").reshape(1000, 4)
    (tmp_path / "r.bin").write_bytes(x.tobytes())
    df = recording.read_recording(spark, str(tmp_path / "r.bin"), 4, channels="0,2", chunkSamples=300, overlap=20)
    got = df.orderBy("chunk", "sample").collect()
    core = [r for r in got if r["core"]]
    assert [r["sample"] for r in core] == list(range(1000)) and [r["channels"] for r in core] == x[:, [0, 2]].tolist()
    assert [sum(r["chunk"] == c for r in got) for c in range(4)] == [320, 340, 340, 120]
    assert df.rdd.getNumPartitions() == 4
    (tmp_path / "e.bin").write_bytes(b"")
    assert recording.read_recording(spark, str(tmp_path / "e.bin"), 4).count() == 0


def test_npy(spark, tmp_path):
    x = np.arange(10, dtype=np.int64)[:, None] * 7
    np.save(tmp_path / "s.npy", x)
    got = recording.read_npy_longs(spark, str(tmp_path / "s.npy"), "sample").orderBy("row").collect()
    assert [r["sample"] for r in got] == x.ravel().tolist()


def test_streams(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(5)), ("a", at(100)), ("b", at(3)), ("b", at(100_000))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.bursts(stream, "ts", "key", "10 seconds", "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["key"], r["n"]) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    spark.createDataFrame([(1, at(10))], "trial long, t0 timestamp").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("u", at(9)), ("u", at(15)), ("u", at(20))], "unit string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    a = spark.readStream.schema("trial long, t0 timestamp").parquet(str(tmp_path / "t"))
    b = spark.readStream.schema("unit string, t timestamp").parquet(str(tmp_path / "s"))
    q = live.live_pairs(a, b, 2, 10, "1 minute").writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["t"] for r in spark.table("pairs").collect()) == [at(9), at(15)]


def test_recording_in_a_store(spark, tmp_path):
    """Read as byte ranges through Hadoop, a recording is what it is when mounted, whatever splits, chunks and overlaps."""
    x = np.random.default_rng(9).integers(-32000, 32000, (10_007, 6)).astype("<i2")
    path = tmp_path / "r.bin"
    x.tofile(path)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "20000")
    try:
        for chunk, overlap, channels in ((3000, 250, None), (10_007, 0, [4, 1]), (700, 900, [0]), (20_000, 5, None)):
            got = recording.read_stored_recording(spark, f"file://{path}", 6, chunk, overlap, channels).collect()
            options = {"channels": ",".join(map(str, channels))} if channels else {}
            want = recording.read_recording(spark, str(path), 6, chunkSamples=chunk, overlap=overlap, **options).collect()
            key = lambda r: (r["chunk"], r["sample"])
            if channels:
                assert [list(r["channels"]) for r in got[:50]] == [x[r["sample"], channels].tolist() for r in got[:50]]
            assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(map(tuple, want), key=lambda r: r[:2])
            assert all(b["sample"] == a["sample"] + 1 for a, b in zip(got, got[1:]) if key(a)[0] == key(b)[0])
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    empty = tmp_path / "empty.bin"
    empty.write_bytes(b"")
    assert recording.read_stored_recording(spark, f"file://{empty}", 6).collect() == []
