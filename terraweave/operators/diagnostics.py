"""Convergence and uncertainty of posterior draws.

Draws are a long table ``(entity_id, chain_id, sample_id, x, y)``. Everything is
an algebraic aggregate over it, so an entity or chain that holds a third of the
draws is summed map-side like any other.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .draw_cells import per_sample, with_defaults
from .ordering import with_position

MIN_DRAWS = 4                               # fewer draws give nulls
CHI2_95 = -2.0 * math.log(0.05)             # chi-square quantile, 2 degrees of freedom


def moments(draws: DataFrame) -> DataFrame:
    """Mean and population deviation per entity; null where there are fewer than ``MIN_DRAWS`` draws."""
    enough = F.count(F.lit(1)) >= MIN_DRAWS
    return draws.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), *[
        F.when(enough, f(v)).alias(f"{name}_{v}") for name, f in (("mean", F.avg), ("std", F.stddev_pop)) for v in "xy"])


def ellipse(draws: DataFrame) -> DataFrame:
    """95 % credible ellipse from the 2x2 sample covariance, angle modulo 180 degrees; nulls for few draws."""
    enough = F.count(F.lit(1)) >= MIN_DRAWS
    c = draws.groupBy("entity_id").agg(*[F.when(enough, v).alias(name) for name, v in (
        ("center_x", F.avg("x")), ("center_y", F.avg("y")), ("a", F.var_samp("x")), ("b", F.var_samp("y")), ("c", F.covar_samp("x", "y")))])
    half = (F.col("a") - F.col("b")) / 2
    mid, spread = (F.col("a") + F.col("b")) / 2, F.sqrt(half * half + F.col("c") * F.col("c"))
    axis = lambda v: F.sqrt(F.lit(CHI2_95) * F.greatest(F.lit(0.0), v))
    angle = F.degrees(F.atan2(F.col("c") * 2, F.col("a") - F.col("b"))) / 2
    return c.select("entity_id", axis(mid + spread).alias("semi_major"), axis(mid - spread).alias("semi_minor"),
                    F.pmod(angle, F.lit(180.0)).alias("angle_deg"), "center_x", "center_y")


def _binned(draws: DataFrame, bins: int) -> DataFrame:
    span = draws.groupBy("entity_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, lo, hi: F.when(F.col(hi) == F.col(lo), F.lit(0)).otherwise(F.least(
        F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1)))
    return draws.join(span, "entity_id").select(
        "entity_id", cell("x", "x0", "x1").cast("long").alias("cell_x"), cell("y", "y0", "y1").cast("long").alias("cell_y"))


def density(draws: DataFrame, bins: int = 20) -> DataFrame:
    """Counts per grid cell over each entity's own range (heat-map input)."""
    return _binned(draws, bins).groupBy("entity_id", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))


def smoothed(draws: DataFrame, bins: int = 20, least: int = 10) -> DataFrame:
    """(entity_id, cell_x, cell_y, mass): Gaussian kernel density over each entity's own range, as shares of its grid.

    The kernel is applied to the counts per cell in two passes, along x and then along y, with the bandwidth of Scott's
    rule on each axis. An axis without extent stays as it is. Entities with fewer than ``least`` draws have no density.
    """
    spread = draws.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_draws"), *[f(v).alias(f"{k}_{v}") for v in "xy" for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))])
    # standard deviation in cells, narrowed as the draws grow
    width = lambda v: (F.pow(F.col("n_draws"), F.lit(-1.0 / 6)) * F.col(f"sd_{v}") * bins / (F.col(f"hi_{v}") - F.col(f"lo_{v}")))
    scale = spread.where(F.col("n_draws") >= least).select("entity_id", *[
        F.when(F.col(f"hi_{v}") > F.col(f"lo_{v}"), width(v)).alias(f"h_{v}") for v in "xy"])
    grid = density(draws, bins).join(scale, "entity_id").withColumn("mass", F.col("n").cast("double"))

    def along(rows: DataFrame, v: str) -> DataFrame:
        other = "y" if v == "x" else "x"
        moved = rows.withColumn("to", F.explode(F.sequence(*[F.lit(k).cast("long") for k in (0, bins - 1)])))
        gap = (F.col("to") - F.col(f"cell_{v}")) / F.col(f"h_{v}")
        share = F.when(F.col(f"h_{v}").isNull(), (F.col("to") == F.col(f"cell_{v}")).cast("double")).otherwise(F.exp(-0.5 * gap * gap))
        return moved.groupBy("entity_id", "h_x", "h_y", F.col("to").alias(f"cell_{v}"), f"cell_{other}").agg(F.sum(F.col("mass") * share).alias("mass"))

    both = along(along(grid, "x"), "y")
    total = both.groupBy("entity_id").agg(F.sum("mass").alias("total"))
    return both.join(total, "entity_id").select("entity_id", "cell_x", "cell_y", (F.col("mass") / F.col("total")).alias("mass"))


def contour_levels(grid: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(entity_id, share, level, n_cells): cells of ``level`` mass or more hold at least ``share`` of an entity's density."""
    # at most bins x bins rows of an entity; cells equal but for rounding stay together
    order = Window.partitionBy("entity_id").orderBy(F.desc("m"))
    ranked = grid.withColumn("m", F.round("mass", 9)).select("entity_id", "m", F.sum("m").over(order).alias("held"),
                                                            F.count(F.lit(1)).over(order).alias("cells"))
    found = None
    for share in shares:
        row = ranked.where(F.col("held") >= share - 1e-6).groupBy("entity_id").agg(
            F.max("m").alias("level"), F.min("cells").alias("n_cells")).select("entity_id", F.lit(share).alias("share"), "level", "n_cells")
        found = row if found is None else found.unionByName(row)
    return found


def entropy(draws: DataFrame, bins: int = 20) -> DataFrame:
    n = F.col("n")
    return density(draws, bins).groupBy("entity_id").agg(
        (F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("spatial_entropy"))


def r_hat(draws: DataFrame) -> DataFrame:
    """Gelman-Rubin statistic per axis; chains are cut to the shortest one."""
    placed = with_position(draws, ["entity_id", "chain_id"], "sample_id")
    sizes = draws.groupBy("entity_id", "chain_id").agg(F.count(F.lit(1)).alias("n"))
    shortest = sizes.groupBy("entity_id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("m"))
    cut_to = placed.join(shortest, "entity_id").where(F.col("pos") < F.col("n"))
    chain = cut_to.groupBy("entity_id", "chain_id", "n", "m").agg(
        F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    both = chain.groupBy("entity_id", "n", "m").agg(*[
        f(f"{k}{v}").alias(f"{g}_{v}") for v in "xy" for f, k, g in ((F.var_samp, "a", "between"), (F.avg, "v", "within"))])
    n = F.col("n")

    def stat(v):
        w = F.col(f"within_{v}")
        var_hat = (n - 1) / n * w + F.col(f"between_{v}")
        return F.when((F.col("m") >= 2) & (n >= 2) & (w > 0), F.sqrt(var_hat / w))

    return both.where(F.col("m") >= 2).select("entity_id", stat("x").alias("r_hat_x"), stat("y").alias("r_hat_y"))


def _series(draws: DataFrame) -> DataFrame:
    """Centred draws with their position in the concatenation of the chains."""
    placed = with_position(draws, ["entity_id", "chain_id"], "sample_id")
    sizes = draws.groupBy("entity_id", "chain_id").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window
    # one row per chain
    before = Window.partitionBy("entity_id").orderBy("chain_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("entity_id", "chain_id", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off"))
    means = draws.groupBy("entity_id").agg(
        F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.count(F.lit(1)).alias("n"))
    return placed.join(offsets, ["entity_id", "chain_id"]).join(means, "entity_id").select(
        "entity_id", "n", (F.col("pos") + F.col("off")).alias("i"),
        (F.col("x") - F.col("ax")).alias("x"), (F.col("y") - F.col("ay")).alias("y"))


def _lag_products(series: DataFrame, lo: int, hi: int, block: int) -> DataFrame:
    """Sums of x[i]*x[i+k] for k in [lo, hi), from blocks of the series.

    The rows of block b meet only the rows its lags can reach, so a task holds
    at most ``2*block`` values however long the series is.
    """
    width = hi - lo
    i = F.col("i")
    left = series.select("entity_id", (i / block).cast("long").alias("b"), F.lit(0).alias("role"),
                         (i % block).cast("int").alias("at"), "x", "y")
    first = F.greatest(F.lit(0), F.ceil((i - hi - block + 2) / F.lit(block)))
    last = F.floor((i - lo) / F.lit(block))
    right = series.select(
        "entity_id", i.alias("i"), "x", "y",
        F.explode(F.when((i >= lo) & (first <= last), F.sequence(first, last))).alias("b")).select(
        "entity_id", F.col("b").cast("long").alias("b"), F.lit(1).alias("role"),
        (F.col("i") - F.col("b") * block - lo).cast("int").alias("at"), "x", "y")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"lag": np.arange(lo, hi)}
        role, at = pdf["role"].to_numpy(), pdf["at"].to_numpy()
        for axis in ("x", "y"):
            v = pdf[axis].to_numpy()
            near, far = np.zeros(block), np.zeros(block + width - 1)
            near[at[role == 0]] = v[role == 0]
            far[at[role == 1]] = v[role == 1]
            out[f"s{axis}"] = np.correlate(far, near, mode="valid")
        return pd.DataFrame({"entity_id": pdf["entity_id"].iloc[0], **out})

    key = series.schema["entity_id"].dataType.simpleString()
    made = left.unionByName(right).groupBy("entity_id", "b").applyInPandas(
        products, f"entity_id {key}, lag long, sx double, sy double")
    return made.groupBy("entity_id", "lag").agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))


def effective_sample_size(draws: DataFrame, first_lags: int = 64, block: int = 4096) -> DataFrame:
    """Autocorrelation pair sums up to the first negative pair, per axis.

    Lags are evaluated in growing ranges, and only for the entities whose sum
    has not ended yet; every entity ends at its first negative pair or its last
    lag, so nothing is cut off.
    """
    series = cut(_series(draws))
    size = series.groupBy("entity_id").agg(F.first("n").alias("n"))
    todo, lo, hi, sums = series, 0, min(first_lags, block), None
    while True:
        part = _lag_products(todo, lo, hi, block)
        sums = cut(part if sums is None else sums.unionByName(part))
        pairs = _pairs(sums, size)
        ended = pairs.groupBy("entity_id").agg(*[F.min(F.when(F.col(f"p{v}") < 0, F.col("i"))).alias(f"e{v}") for v in "xy"])
        going = size.join(ended, "entity_id", "left").where(
            (F.col("ex").isNull() | F.col("ey").isNull()) & (F.col("n") > hi)).select("entity_id")
        if going.isEmpty():
            break
        todo = series.join(going, "entity_id", "left_semi")
        lo, hi = hi, hi + min(block, hi)
    total = pairs.join(ended, "entity_id").groupBy("entity_id").agg(*[F.sum(F.when(
        F.col(f"e{v}").isNull() | (F.col("i") < F.col(f"e{v}")), F.col(f"p{v}")).otherwise(0.0)).alias(f"r{v}") for v in "xy"])
    ess = lambda v: F.when(F.col("n") < 4, F.col("n").cast("double")).otherwise(
        F.col("n") / F.greatest(F.lit(1.0), 2 * F.coalesce(F.col(f"r{v}"), F.lit(0.0)) - 1))
    return size.join(total, "entity_id", "left").select("entity_id", ess("x").alias("ess_x"), ess("y").alias("ess_y"))


def _pairs(sums: DataFrame, size: DataFrame) -> DataFrame:
    """acf[i] + acf[i+1] for even i with i+1 inside the series."""
    zero = sums.where(F.col("lag") == 0).select("entity_id", F.col("sx").alias("zx"), F.col("sy").alias("zy"))
    rho = sums.join(zero, "entity_id").select("entity_id", "lag", (F.col("sx") / F.col("zx")).alias("x"),
                                              (F.col("sy") / F.col("zy")).alias("y"))
    even = F.col("lag") - F.col("lag") % 2
    return rho.groupBy("entity_id", even.alias("i")).agg(
        F.sum("x").alias("px"), F.sum("y").alias("py"), F.count(F.lit(1)).alias("k")).join(size, "entity_id").where(
        (F.col("k") == 2) & (F.col("i") + 1 < F.col("n"))).drop("k", "n")


def thinned(draws: DataFrame, thin: int = 1, burn_in: int = 0) -> DataFrame:
    """Every ``thin``-th step, without the first ``burn_in`` steps of each chain."""
    step = F.col("sample_id") + 1
    return draws.where((step % thin == 0) & (step > (burn_in // thin) * thin))


def every_kth(draws: DataFrame, wanted: int) -> DataFrame:
    """Rows of every k-th sample, k = max(1, samples // wanted)."""
    n = draws.agg(F.max("sample_id") + 1).scalar()  # sample ids are dense
    k = F.greatest(F.lit(1).cast("long"), F.floor(n / wanted))
    return draws.where(F.col("sample_id") % k == 0)


def evenly_spaced(draws: DataFrame, wanted: int = 50) -> DataFrame:
    """Rows of ``wanted`` samples spread evenly from the first to the last."""
    n = draws.agg(F.max("sample_id") + 1).scalar()
    one = F.lit(1).cast("long")
    m = F.least(F.lit(wanted).cast("long"), n)
    # the j-th pick is floor(j*(n-1)/(m-1)): a sample is one iff the next multiple lands on it
    j = F.ceil(F.col("sample_id") * (m - 1) / F.greatest(one, n - 1))
    at = F.floor(j * (n - 1) / F.greatest(one, m - 1))
    return draws.where((at == F.col("sample_id")) & (j < m))


def ensemble_lines(draws: DataFrame, constraints: DataFrame, fixed: DataFrame, first: int = 20) -> DataFrame:
    """(sample_id, constraint_id, type, x1, y1, x2, y2): the first constraints between two entities, drawn in each sample.

    Constraints count in the order of their ids, shorter ids first. A line whose end has no position is left out.
    """
    order = F.length("constraint_id"), F.col("constraint_id")
    some = constraints.where(F.col("e2").isNotNull() & (F.col("e1") != F.col("e2"))).orderBy(*order).limit(first)
    some = some.select("constraint_id", "type", "e1", "e2")
    spot = lambda n: fixed.select(F.col("entity_id").alias(f"e{n}"), F.col("x").alias(f"f{n}x"), F.col("y").alias(f"f{n}y"))
    mine = lambda n: draws.select("sample_id", F.col("entity_id").alias(f"e{n}"), F.col("x").alias(f"d{n}x"), F.col("y").alias(f"d{n}y"))
    placed = some.join(spot(1), "e1", "left").join(spot(2), "e2", "left")
    every = placed.withColumn("sample_id", F.explode(draws.agg(F.sort_array(F.collect_set("sample_id"))).scalar()))  # as many as are drawn
    met = every.join(mine(1), ["sample_id", "e1"], "left").join(mine(2), ["sample_id", "e2"], "left")
    at = lambda n, v: F.coalesce(f"d{n}{v}", f"f{n}{v}").alias(f"{v}{n}")
    rows = met.select("sample_id", "constraint_id", "type", at(1, "x"), at(1, "y"), at(2, "x"), at(2, "y"))
    return rows.where(F.col("x1").isNotNull() & F.col("x2").isNotNull())


SATISFIED = 0.1   # penalties below this count as satisfied


def satisfaction_per_sample(constraints: DataFrame, fixed: DataFrame, draws: DataFrame,
                            evaluable_only: bool = False) -> DataFrame:
    """Fraction of satisfied constraints in every sample.

    Equal constraints are merged with a count first; blocks of samples then meet groups of
    constraints (``draw_cells``). A missing second end falls on the first; a constraint whose first
    end has no position, or that names one entity only (coast relations aside),
    leaves the count.
    """
    from .constraints import INFERABLE, PARAMS
    used = constraints.where(F.col("e2").isNotNull() | (F.col("type") == "on_coast"))
    if evaluable_only:
        used = used.where(F.col("type").isin(INFERABLE))
    # scored by the near term alone; types without geometry hold wherever the first end is
    kind = F.when(F.col("type").isin("co_occurrence", "across"), "near").when(F.col("type").isin(
        "north_of", "south_of", "east_of", "west_of", "near", "far", "distance_approx"), F.col("type")).otherwise("other")
    merged = used.withColumn("type", kind).select("type", "e1", "e2", *with_defaults(F.col("type"))).groupBy(
        "type", "e1", "e2", *PARAMS).agg(F.count(F.lit(1)).alias("weight"))
    spot = lambda n: fixed.select(F.col("entity_id").alias(f"e{n}"), F.col("x").alias(f"fx{n}"), F.col("y").alias(f"fy{n}"))
    terms = cut(merged.join(spot(1), "e1", "left").join(spot(2), "e2", "left").withColumn("d1", F.col("fx1").isNull()).withColumn(
        "d2", F.col("fx2").isNull() & F.col("e2").isNotNull()).where(F.col("e1").isNotNull()))

    def fold(value, there, void, weight):
        return [weight @ ((value < SATISFIED) & there), weight @ there]

    per = per_sample(terms, draws, True, fold, {"ok": "long", "all": "long"}).groupBy("sample_id").agg(
        F.sum("ok").alias("ok"), F.sum("all").alias("all"))
    joined = draws.select("sample_id").distinct().join(per, "sample_id", "left")
    return joined.select("sample_id", F.when(F.col("all") > 0, F.col("ok") / F.col("all")).otherwise(F.lit(1.0)).alias("score"))


def satisfaction(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("constraint_satisfaction_mean"),
                      F.stddev_pop("score").alias("constraint_satisfaction_std"))


# -- modes ------------------------------------------------------------------

SETTLED = 1e-9   # a centre that moves less has only been summed in another order
STEPS = 6        # of a job


POINTS = 1 << 21  # draws of an entity that one task clusters
PIECE = 1 << 15   # points whose distances are taken at once


def _nearest(x: np.ndarray, y: np.ndarray, cs: np.ndarray) -> tuple[np.ndarray, float]:
    """The first nearest centre of each point, and the sum of the squared distances."""
    label, total = np.zeros(len(x), np.int8), 0.0
    for lo in range(0, len(x), PIECE):
        px, py, own = x[lo:lo + PIECE], y[lo:lo + PIECE], label[lo:lo + PIECE]
        best = None
        for j, (cx, cy) in enumerate(cs):
            d, e = cx - px, cy - py
            d *= d
            e *= e
            d += e
            if best is None:
                best = d
                continue
            own[d < best] = j
            np.minimum(best, d, out=best)
        total += float(best.sum())
    return label, total


def _settle(x: np.ndarray, y: np.ndarray, cs: np.ndarray) -> float:
    """Squared distances that are left when no centre moves any more; centres without points drop out."""
    while True:
        label, _ = _nearest(x, y, cs)
        n = np.bincount(label, minlength=len(cs))
        at = np.stack([np.bincount(label, weights=v, minlength=len(cs))[n > 0] / n[n > 0] for v in (x, y)], axis=1)
        at, old = at[np.lexsort((at[:, 1], at[:, 0]))], cs[np.lexsort((cs[:, 1], cs[:, 0]))]
        cs = at
        if len(at) == len(old) and np.abs(at - old).max() <= SETTLED:
            return _nearest(x, y, cs)[1]


def mode_count(draws: DataFrame, max_k: int = 5, starts: int = 5) -> DataFrame:
    """Number of modes per entity: k-means for k = 1..max_k, least ``sse/n + 2k ln(n)/n``.

    Starting centres are the draws with the least MD5 digest of a number, their chain and their sample. Rounds end when no
    centre moves. An entity of at most ``POINTS`` draws meets the centres of one start per task and stays there for all
    rounds. Larger ones, and those with unset coordinates, move together: a round is one join of the draws with the centres
    of their entity (at most ``starts * max_k*(max_k+1)/2`` of them) and one partially aggregated group-by.
    """
    points = draws.select("entity_id", "x", "y")
    named = [c for c in ("chain_id", "sample_id") if c in draws.columns] or ["x", "y"]
    h = lambda s: F.struct(F.md5(F.concat_ws(":", F.lit(str(s)), *[F.col(c).cast("string") for c in named])), "x", "y")
    picks = [F.min_by(F.struct("x", "y"), h(s * 100 + c)).alias(f"p{s}_{c}") for s in range(starts) for c in range(max_k)]
    odd = lambda v: F.col(v).isNull() | F.isnan(v)
    pts = cut(points)
    seeds = cut(draws.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(odd("x") | odd("y")).alias("odd"), *picks))
    run = ["entity_id", "s", "k"]
    one = lambda s, k: F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.array(*[F.col(f"p{s}_{c}") for c in range(k)]).alias("cs"))
    runs = lambda rows: rows.select("entity_id", F.inline(F.array(*[one(s, k) for s in range(starts) for k in range(1, max_k + 1)])))
    small = F.col("entity_id").isNotNull() & (F.col("n") <= POINTS) & ~F.col("odd")
    sse = _settled_runs(pts, seeds.where(small), runs, starts)
    rest = seeds.where(~small)
    if not rest.isEmpty():
        sse = sse.unionByName(_settled_rounds(pts.join(rest.select("entity_id"), "entity_id", "left_semi"), runs(rest), run))
    best = sse.groupBy("entity_id", "k").agg(F.min("sse").alias("sse"), F.first("n").alias("n"))
    bic = F.col("sse") / F.col("n") + F.col("k") * F.log("n") * 2 / F.col("n")
    out = best.groupBy("entity_id").agg(F.min_by("k", F.struct(bic.alias("b"), F.col("k").alias("k"))).alias("k"),
                                        F.first("n").alias("n"))
    return out.select("entity_id", F.when(F.col("n") < max_k * 2, 1).otherwise(F.col("k")).cast("int").alias("num_modes"))


def _settled_runs(pts: DataFrame, seeds: DataFrame, runs, starts: int) -> DataFrame:
    """(entity_id, s, k, sse, n) of entities whose draws fit a task; a task has all runs of one start."""
    of_start = pts.join(seeds.select("entity_id"), "entity_id", "left_semi").withColumn(
        "s", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    kind = pts.schema["entity_id"].dataType.simpleString()

    def meet(held: pa.Table, spots: pa.Table) -> pa.Table:
        x, y = (spots[c].to_numpy() for c in "xy")
        centres = [np.array([(c["x"], c["y"]) for c in cs]) for cs in held["cs"].to_pylist()]
        return pa.table({"entity_id": held["entity_id"], "s": held["s"], "k": held["k"],
                         "sse": pa.array([_settle(x, y, cs) for cs in centres], pa.float64()),
                         "n": pa.array([len(x)] * len(centres), pa.int64())})

    tasks = 4 * pts.sparkSession.sparkContext.defaultParallelism  # few rows, long work: not to be merged by size
    of_start = of_start.select(F.col("entity_id").alias("of"), F.col("s").alias("at"), "x", "y").repartition(tasks, "of", "at")
    return cut(runs(seeds).repartition(tasks, "entity_id", "s").groupBy("entity_id", "s").cogroup(
        of_start.groupBy("of", "at")).applyInArrow(meet, f"entity_id {kind}, s int, k int, sse double, n long"))


def _settled_rounds(pts: DataFrame, centres: DataFrame, run: list[str]) -> DataFrame:
    """The same for entities of any size: all runs of all of them go round by round."""

    def nearest(rows):
        d2 = lambda p: (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y"))
        best = F.array_min(F.transform("cs", lambda p, i: F.struct(d2(p).alias("d"), i.alias("c"))))
        return rows.select("entity_id", "s", "k", "x", "y", "cs", best.alias("b"))

    def step(at):
        moved = nearest(pts.join(at, "entity_id")).groupBy(*run, F.col("b.c").alias("c")).agg(
            F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("p"), F.first("cs").alias("old"))
        return moved.groupBy(*run).agg(  # at most max_k points
            F.sort_array(F.collect_list("p")).alias("cs"), F.sort_array(F.first("old")).alias("_old"))

    settled, going = [], cut(centres)
    while not going.isEmpty():  # runs that have settled leave; a job makes several steps of the others
        ahead = going
        for _ in range(STEPS):
            ahead = step(ahead.select(*run, "cs"))
        far = F.exists(F.zip_with("cs", "_old", lambda p, q: F.greatest(
            F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"]))), lambda d: F.coalesce(d > SETTLED, F.lit(True)))
        after = cut(ahead.select(*run, "cs", far.alias("far")))
        settled.append(after.where("not far").drop("far"))
        going = after.where("far").drop("far")
    centres = reduce(DataFrame.unionByName, settled) if settled else going
    return nearest(pts.join(centres, "entity_id")).groupBy("entity_id", "s", "k").agg(
        F.sum("b.d").alias("sse"), F.count(F.lit(1)).alias("n"))


def posterior_summary(draws: DataFrame, names: DataFrame, scores: DataFrame, modes: bool = True) -> DataFrame:
    """One row per latent entity with every diagnostic, rounded as reported."""
    r = lambda c, n: F.round(F.col(c), n).alias(c)
    out = (
        moments(draws).join(ellipse(draws), "entity_id").join(entropy(draws), "entity_id")
        .join(r_hat(draws), "entity_id", "left").join(effective_sample_size(draws), "entity_id", "left")
        .join(names, "entity_id", "left")
        .withColumn("_s", satisfaction(scores).select(F.struct("constraint_satisfaction_mean", "constraint_satisfaction_std")).scalar())
        .select("*", "_s.*").drop("_s")
    )
    if modes:
        out = out.join(mode_count(draws), "entity_id", "left")
    chained = F.col("r_hat_x").isNotNull()
    return out.select(
        "entity_id", "name", r("mean_x", 4), r("mean_y", 4), r("std_x", 4), r("std_y", 4),
        r("semi_major", 4), r("semi_minor", 4), r("angle_deg", 2), r("center_x", 4), r("center_y", 4),
        r("spatial_entropy", 4), *(["num_modes"] if modes else []), r("r_hat_x", 4), r("r_hat_y", 4),
        F.when(chained, F.round("ess_x", 1)).alias("ess_x"), F.when(chained, F.round("ess_y", 1)).alias("ess_y"),
        r("constraint_satisfaction_mean", 4), r("constraint_satisfaction_std", 4))
