"""Files that executors write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def write_file(folder: str, name: str, parts: list[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a retried task replaces it whole."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    passing = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
    fs.move(passing, f"{root}/{name}")
    return sum(map(len, parts))


def make_folder(folder: str) -> None:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, content) of the files in a folder; each file is a row, so writers bound their size."""
    make_folder(folder)  # no rows, no files
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def column_values(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
