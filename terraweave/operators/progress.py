"""Run progress from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counts(events: DataFrame, by: str = "event_type") -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` events (TakeOrdered: n rows per task, then n in all)."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def eta(events: DataFrame, total: int | None = None, last: int = 20, value: str = "value",
        order: tuple = ("ts", "event_id"), error_type: str = "error",
        relation_type: str = "relation") -> DataFrame:
    """Rate, remaining time and projected total from the last durations.

    One row: the mean of the last ``last`` durations drives rate and remaining
    time; the share of finished units projects the relation total.
    """
    mean = recent(events, last, list(order)).agg(F.avg(value)).scalar()
    done = events.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != error_type).alias("done"),
        F.count_if(F.col("event_type") == error_type).alias("errors"),
        F.count_if(F.col("event_type") == relation_type).alias("relations"))
    both = done.withColumn("avg_s", mean)
    size = F.col("total") if total is None else F.lit(total)
    left, pct = (size - F.col("done")) * F.col("avg_s"), F.col("done") / size
    return both.select(
        "total", "done", "errors", "relations", F.col("avg_s"),
        F.when(F.col("avg_s") > 0, 60.0 / F.col("avg_s")).otherwise(0.0).alias("rate_min"),
        left.alias("eta_s"), hms(left).alias("eta"),
        F.when(pct > 0, F.floor(F.col("relations") / pct)).otherwise(0).cast("long").alias("projected"))


def hms(seconds):
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(
        F.format_string("%02d:%02d", m, s % 60))


def window_stats(records: DataFrame) -> DataFrame:
    """Windows processed, with relations, relations in all, errors."""
    n = F.size("location_relations")
    return records.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(n > 0).alias("windows_with_relations"),
        F.coalesce(F.sum(n), F.lit(0)).alias("relations"), F.count_if(F.col("_error").isNotNull()).alias("errors"))


def answer_log(answers: DataFrame, by: str = "doc_id") -> DataFrame:
    """Progress of a model's run per document: chunks, those that failed, attempts and relations as answered."""
    return answers.groupBy(by).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("_error").isNotNull()).alias("failed"),
        F.sum(F.size("attempts")).cast("long").alias("attempts"), F.sum(F.size("relations")).cast("long").alias("relations"))
