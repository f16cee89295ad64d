"""Site-relative line frequency.

A line is boilerplate of a host if the pages of the host that contain it are
more than a ratio of all its pages. Pages are joined with the boilerplate of
their host, never with other pages: a host has at most (mean distinct lines of a
page) / ratio such lines, however many pages it has, so the lists stay short.

Lines are compared without outer white space; lines without a word are never
dropped. A null host is a host of its own; null texts stay null. A line that a
page repeats counts once for it. Rows of a host with equal text are one page, so
that a text is not boilerplate for being copied; with ``copies_once=False`` each
row is a page. Lines and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terraweave.session import cut

MAX_RATIO = 0.1
MIN_PAGES = 5
_BLANKS = " \t\x0b\x0c\r"


def _code(line: Column) -> Column:
    """Hash of the trimmed line, null for a line without a word."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(df: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """(host, code, pages): lines on more than ``max_ratio`` of the host's pages, and on ``min_pages`` at least."""
    site = F.col(host).alias("host")
    codes = F.array_distinct(F.array_compact(F.transform(_lines(F.col(text)), _code)))
    pages = df.select(site, codes.alias("codes"), F.xxhash64(text).alias("page"))
    if copies_once:
        pages = cut(pages.distinct())
    counted = (
        pages.select("host", F.explode("codes").alias("code"))
        .groupBy("host", "code").agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("host", "_host")
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("pages") > max_ratio * F.col("total"))
        .select("host", "code", "pages")
    )


def drop_boilerplate(df: DataFrame, host: str, text: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, dropped: str | None = None, copies_once: bool = True) -> DataFrame:
    """``df`` with the boilerplate lines of its host taken out of the text; every row stays.

    ``dropped`` names a column for the number of lines taken out.
    """
    lists = (
        cut(boilerplate(df, host, text, max_ratio, min_pages, copies_once))
        .groupBy("host").agg(F.collect_set("code").alias("_codes")).withColumnRenamed("host", "_host")
    )
    joined = df.join(lists, F.col(host).eqNullSafe(F.col("_host")), "left")
    kept = F.filter(_lines(F.col(text)), lambda line: ~F.coalesce(
        F.array_contains(F.col("_codes"), _code(line)), F.lit(False)))
    out = joined.withColumn("_kept", F.when(F.col("_codes").isNull() | F.col(text).isNull(), None).otherwise(kept))
    new_text = F.coalesce(F.array_join("_kept", "\n"), F.col(text))
    if dropped:
        out = out.withColumn(dropped, F.when(F.col("_kept").isNull(), 0).otherwise(
            F.size(_lines(F.col(text))) - F.size("_kept")).cast("long"))
    return out.withColumn(text, new_text).drop("_host", "_codes", "_kept")
