"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraweave.session import shared_dir

BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once, or one row
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, not yet created."""
    return os.path.join(shared_dir(spark), kind, uuid.uuid4().hex)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """For actions inside: rows go to Python workers in batches of bounded bytes, not only of a bounded number.

    Packed rows have hundreds of kilobytes; a batch of all of a task's rows takes as much in the JVM, on the way and in the worker.
    """
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, wherever the optimizer moves the expression.

    A column built in a projection of its own is inlined when a filter is pushed
    below it, and an array inlined into a lambda is computed once per element.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]


def words_of(text: Column) -> Column:
    """The matches of ``WORD`` in order, as an array; none for null."""
    flat = F.coalesce(text, F.lit(""))
    for gap in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
