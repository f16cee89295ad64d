"""A table of answers by key, with remembered misses and their age.

Rows lie in buckets of the key's hash. An upsert rewrites only the buckets that get
new rows; the rest of the table is not read. Lookups are joins on the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class CacheTable:
    """``values`` (a DDL string) are the answer's columns; all null is a miss. ``seen`` is when a row was written."""

    spark: SparkSession
    path: str
    values: str = "lat double, lon double, confidence double"

    @property
    def names(self) -> list[str]:
        return T.StructType.fromDDL(self.values).names

    def read(self) -> DataFrame:
        """(key, values, seen) of all keys."""
        schema = T.StructType.fromDDL(f"key string, {self.values}, seen long, bucket int")
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema).drop("bucket")
        return self.spark.read.schema(schema).parquet(self.path).drop("bucket")

    def upsert(self, rows: DataFrame) -> None:
        """Write (key, values, seen); of rows with one key the one seen last stays, hits before misses."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        new = cut(rows.select("key", *self.names, F.col("seen").cast("long").alias("seen")).where(F.col("key").isNotNull()).withColumn("bucket", bucket))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        if not touched:
            return
        if _exists(self.spark, self.path):
            schema = new.schema
            old = self.spark.read.schema(schema).parquet(self.path).where(F.col("bucket").isin(touched))
            new = new.unionByName(old)
        order = F.struct("seen", F.col(self.names[0]).isNotNull().alias("hit"), *self.names)
        merged = cut(new.groupBy("bucket", "key").agg(F.max_by(F.struct(*self.names, "seen"), order).alias("v")).select("key", "v.*", "bucket"))
        (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(self.path))

    def status(self, keys: DataFrame, oldest: int | None = None) -> DataFrame:
        """``keys`` (key) with ``state``: hit, miss, or - if there is no row, or a miss seen before ``oldest`` - unknown or stale."""
        found = self.read()
        miss = F.col(self.names[0]).isNull()
        state = F.when(F.col("seen").isNull(), "unknown")
        if oldest is not None:
            state = state.when(miss & (F.col("seen") < oldest), "stale")
        return keys.join(found, "key", "left").withColumn("state", state.when(miss, "miss").otherwise("hit"))
