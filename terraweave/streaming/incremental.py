"""Incremental runs: the same operators behind Structured Streaming.

Progress lives in the checkpoint folder, so a restarted run goes on after the
last finished batch and no output line is torn or repeated. Snapshot streams keep
the newest two snapshots: the one a replayed batch starts from and its own.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import extract, progress, segment


def stream_of(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def _start(writer, every: str | None):
    """Follow the input every so often, or take what is there and stop."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def extract_triples(docs: DataFrame, out: str, checkpoint: str, extractor=None, every: str | None = None):
    """Append the window records of newly arrived documents."""
    arrays = segment.sentence_arrays(segment.clean_documents(docs))
    found = (extractor or extract.CueExtractor()).attach(segment.windows(arrays)).drop("sents")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), every)


def _folder(out: str, batch: int) -> str:
    return os.path.join(out, f"batch={batch:09d}")


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the finished snapshots, ascending."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(jvm.Path(f"{out}/{n}/_SUCCESS")))


def _write_snapshot(df: DataFrame, out: str, batch: int) -> None:
    """Write a batch's snapshot; all but it and its predecessor go."""
    df.write.mode("overwrite").parquet(_folder(out, batch))
    spark = df.sparkSession
    for old in _batches(spark, out):
        if old < batch - 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(_folder(out, old))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_counts(events: DataFrame, by: str, out: str, checkpoint: str, every: str | None = None):
    """Complete counters after every batch, as a snapshot folder per batch."""
    def snapshot(df: DataFrame, batch: int) -> None:
        _write_snapshot(df, out, batch)

    writer = progress.counts(events, by).writeStream.outputMode("complete").foreachBatch(snapshot)
    return _start(writer.option("checkpointLocation", checkpoint), every)


def first_seen(events: DataFrame, keys: list[str], out: str, checkpoint: str, every: str | None = None,
               time_column: str | None = None, keep: str | None = None):
    """Append only rows whose key was not processed before.

    With ``time_column`` and ``keep`` ("6 hours") a key leaves the state when the watermark passes it by that long, so the
    state holds the keys of that span alone; without, keys are remembered for good.
    """
    if keep:
        fresh = events.withWatermark(time_column, keep).dropDuplicatesWithinWatermark(keys)
    else:
        fresh = events.dropDuplicates(keys)
    writer = fresh.writeStream.format("parquet").option("path", out)
    return _start(writer.outputMode("append").option("checkpointLocation", checkpoint), every)


def _merged(df: DataFrame, batch: int, out: str, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pick`` of a batch together with the snapshot before it; a replayed batch starts from the same one."""
    before = [b for b in _batches(df.sparkSession, out) if b < batch]
    fresh = pick(df)
    if before:
        fresh = pick(fresh.unionByName(df.sparkSession.read.schema(fresh.schema).parquet(_folder(out, before[-1]))))
    return fresh


def recent_buffer(events: DataFrame, n: int, order: list[str], out: str, checkpoint: str, every: str | None = None):
    """The last ``n`` rows seen so far, after every batch; a batch contributes its own last ``n`` (TakeOrdered per task)."""
    def merge(df: DataFrame, batch: int) -> None:
        _write_snapshot(_merged(df, batch, out, lambda rows: progress.recent(rows, n, order)), out, batch)

    writer = events.writeStream.foreachBatch(merge)
    return _start(writer.option("checkpointLocation", checkpoint), every)


def rolling_buffers(events: DataFrame, sizes: dict[str, int], order: list[str], out: str, checkpoint: str, every: str | None = None):
    """The last rows of each kind (column ``buffer``), as many as ``sizes`` says, after every batch.

    The state of the stream is one snapshot of at most ``sum(sizes.values())`` rows.
    """
    def pick(rows: DataFrame) -> DataFrame:
        kept = [progress.recent(rows.where(F.col("buffer") == name), n, order) for name, n in sizes.items()]
        out_rows = kept[0]
        for other in kept[1:]:
            out_rows = out_rows.unionByName(other)
        return out_rows

    def merge(df: DataFrame, batch: int) -> None:
        _write_snapshot(_merged(df, batch, out, pick), out, batch)

    writer = events.writeStream.foreachBatch(merge)
    return _start(writer.option("checkpointLocation", checkpoint), every)


def follow(spark: SparkSession, query, out: str, complete: Callable[[DataFrame], bool], refresh: float = 1.0, limit: float | None = None) -> str:
    """Look at the newest snapshot of a running stream every ``refresh`` seconds until ``complete`` says so, then stop it.

    Returns ``complete``, ``ended`` if the stream stopped by itself before, or ``timeout`` after ``limit`` seconds.
    """
    seen, began = None, time.monotonic()
    try:
        while True:
            running = query.isActive
            batches = _batches(spark, out)
            if batches and batches[-1] != seen:
                seen = batches[-1]
                if complete(spark.read.parquet(_folder(out, seen))):
                    return "complete"
            if not running:
                return "ended"
            if limit is not None and time.monotonic() - began > limit:
                return "timeout"
            time.sleep(refresh)
    finally:
        query.stop()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest snapshot of a snapshot folder."""
    return spark.read.parquet(_folder(out, _batches(spark, out)[-1]))
