"""Positions, neighbours and running sums over ordered rows, without hot tasks.

A plain ``row_number() over (partition by key order by ord)`` sends one key to
one task. When a single key may hold a third of all rows that task never ends,
so every operator here first cuts a key into blocks of the order column, works
inside the blocks, and combines block summaries that are smaller by the block
size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

BLOCK = 65_536


NO_BLOCK = -(2 ** 63)  # of rows without an order; before all blocks, as nulls sort


def _block(order: str, block: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / F.lit(block)).cast("long"), F.lit(NO_BLOCK))


def _meet(rows: DataFrame, summaries: DataFrame, by: list[str], whole: bool = False) -> DataFrame:
    """Rows with the summary of their block; null keys and null blocks meet, too.

    Without keys rows lie by their block already, so a merge on it alone does not shuffle them again, and nothing passes
    through the driver; ``whole`` keeps blocks that may be null.
    """
    if by == ["_blk"] and not whole:
        return rows.join(summaries.hint("merge"), "_blk")
    side = summaries.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in summaries.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    on = same[0]
    for one in same[1:]:
        on = on & one
    return rows.join(side, on).drop(*[f"_by_{c}" for c in by])


def with_position(df: DataFrame, keys: list[str], order: str,
                  name: str = "pos", block: int = BLOCK, ties: tuple = ()) -> DataFrame:
    """0-based dense position of each row inside its key, by an integer order.

    ``ties`` order the rows that share an order value.
    """
    blocks = df.withColumn("_blk", _block(order, block))
    by = [*keys, "_blk"]
    local = blocks.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties)) - 1)
    sizes = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        _meet(local, offsets, by)
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", "_blk")
    )


def with_previous(df: DataFrame, keys: list[str], order: str, value: str,
                  name: str = "prev", block: int = BLOCK, coarse: Column | None = None) -> DataFrame:
    """Value of the preceding row of the key; null for the first row.

    An order that is not an integer needs ``coarse``: a block number that never falls along the order.
    """
    blocks = df.withColumn("_blk", _block(order, block) if coarse is None else coarse)
    by = [*keys, "_blk"]
    inside = Window.partitionBy(*by).orderBy(order)
    local = (
        blocks.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_head", F.row_number().over(inside) == 1)
    )
    tails = blocks.groupBy(*by).agg(F.max_by(value, order).alias("_tail"))
    carried = tails.select(
        *by, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    return (
        _meet(local, carried, by, coarse is not None)
        .withColumn(name, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_lag", "_head", "_carry", "_blk")
    )


def with_running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, str],
                     block: int = BLOCK) -> DataFrame:
    """Sums of ``values`` over the rows strictly before each row: {column: new name}."""
    blocks = df.withColumn("_blk", _block(order, block))
    by = [*keys, "_blk"]
    inside = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    local, sizes = blocks, blocks.groupBy(*by).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    for v, out in values.items():
        local = local.withColumn(f"_l_{v}", F.coalesce(F.sum(v).over(inside), F.lit(0.0)))
    offsets = sizes.select(
        *by, *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0.0)).alias(f"_o_{v}") for v in values])
    joined = _meet(local, offsets, by)
    for v, out in values.items():
        joined = joined.withColumn(out, F.col(f"_l_{v}") + F.col(f"_o_{v}")).drop(f"_l_{v}", f"_o_{v}")
    return joined.drop("_blk")


def with_global_position(df: DataFrame, by: list[str], name: str = "pos") -> DataFrame:
    """0-based dense position over the whole (distinct) sort key.

    The rows are dealt to ranges of the key and written with the number of their
    range, so that counting and numbering agree; each range is numbered by its own
    task, and there are no more ranges than shuffle partitions to sum over.
    """
    dealt = cut(df.repartitionByRange(*by).withColumn("_blk", F.spark_partition_id()))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_blk").orderBy(*by)) - 1)
    sizes = dealt.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        local.join(offsets, "_blk")
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_blk", "_rn", "_off")
    )
