"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terraweave.session import cut


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b): comp is the smallest id reachable.

    Each round every node points to the smallest label among its neighbours' and
    then to that label's own label; rounds end when no label changes. State is
    written each round, so a lost executor repeats one round at most.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    while True:
        near = (both.join(labels.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_near")))
        better = labels.join(near, "id").select("id", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        target = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_next"))
        jumped = cut(better.join(target, "comp", "left")
                     .select("id", "_old", F.least("comp", F.coalesce("_next", "comp")).alias("comp")))
        labels = jumped.select("id", "comp")
        if not jumped.where("comp <> _old").limit(1).count():
            return labels
