"""Streams: bounded state, bounded snapshots, and a consumer that ends."""

import os

from pyspark.sql import functions as F

from terraweave.streaming import incremental as inc

SCHEMA = "event_id long, ts timestamp, kind string"


def files(spark, path, parts):
    """One file per (first id, count, first hour)."""
    for n, (first, count, hour) in enumerate(parts):
        rows = spark.range(first, first + count).select(
            F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000 + hour * 3600) + (F.col("id") % 600)).alias("ts"), F.lit("relation").alias("kind"))
        rows.coalesce(1).write.mode("append").parquet(os.path.join(path, f"part={n}"))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(path, "*"))


def test_seen_keys_expire(spark, tmp_path):
    """100 000 keys over ten hours: with half an hour kept, the state ends with a fraction of them."""
    src = str(tmp_path / "in")
    files(spark, src, [(10_000 * h, 10_000, h) for h in range(10)] + [(90_000, 10_000, 9)])
    query = inc.first_seen(stream(spark, src), ["event_id", "ts"], str(tmp_path / "out"), str(tmp_path / "ck"), time_column="ts", keep="30 minutes")
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 100_000  # the last file repeats keys still known
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= 30_000


def test_buffers_and_snapshots(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, src, [(100 * i, 100, i) for i in range(6)])
    kind = F.when(F.col("event_id") % 3 == 0, "error").otherwise("relation").alias("buffer")
    rows = stream(spark, src).select("event_id", "ts", kind)
    inc.rolling_buffers(rows, {"relation": 8, "error": 5}, ["ts", "event_id"], out, str(tmp_path / "ck")).awaitTermination()
    got = {(r["buffer"], r["event_id"]) for r in inc.latest(spark, out).collect()}
    every = [("error" if i % 3 == 0 else "relation", i) for i in range(600)]
    order = lambda e: ((e[1] // 100) * 3600 + e[1] % 600, e[1])
    want = {e for name, n in (("relation", 8), ("error", 5)) for e in sorted((e for e in every if e[0] == name), key=order)[-n:]}
    assert got == want
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 2


def test_follower_ends_on_completion(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, src, [(0, 50, 0), (50, 50, 1)])
    query = inc.running_counts(stream(spark, src), "kind", out, str(tmp_path / "ck"), every="200 milliseconds")
    assert inc.follow(spark, query, out, lambda c: c.agg(F.sum("n")).first()[0] == 100, refresh=0.2, limit=60) == "complete"
    assert not query.isActive and inc.latest(spark, out).first()["n"] == 100
    query = inc.running_counts(stream(spark, src), "kind", str(tmp_path / "o2"), str(tmp_path / "c2"), every="200 milliseconds")
    assert inc.follow(spark, query, str(tmp_path / "o2"), lambda c: False, refresh=0.2, limit=2) == "timeout"
