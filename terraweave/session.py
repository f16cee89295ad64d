"""Session defaults and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job wants as well as a local one. Sizing knobs (number of
# shuffle partitions, memory) are left to the caller / cluster defaults; AQE
# coalesces small partitions and splits skewed ones at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cpus: int | str = "*", app: str = "terraweave",
                  shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="terraweave-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_scratch()


_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Owns the tables that ``cut`` writes inside and removes them at the end.

    For work that has written its results by then: a frame that still reads such a table cannot be used afterwards. The
    function it gives is ``cut`` for such results; the tables belong to what surrounds this scope.
    """
    own: list[str] = []
    around = _scopes[-1] if _scopes else None
    _scopes.append(own)
    try:
        yield lambda df, codec=None: _written(df, codec, around)
    finally:
        del _scopes[next(i for i, scope in enumerate(_scopes) if scope is own)]
        for path in own:
            remove(spark, path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends, not when the driver happens to collect its garbage.

    For plans that write a table: their shuffles are not read again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _written(df: DataFrame, codec: str | None, scope: list[str] | None) -> DataFrame:
    path = os.path.join(shared_dir(df.sparkSession), "lineage", uuid.uuid4().hex)
    if scope is not None:
        scope.append(path)
    with shuffles_once(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Used by iterative jobs (sampler sweeps, fixed points) and before results
    that are read more than once: the plan stops growing, a lost executor
    replays one round only, and the table's size is known to the planner, so
    small states are broadcast and large ones are not.
    """
    return _written(df, codec, _scopes[-1] if _scopes else None)
