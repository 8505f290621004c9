"""Spatial and global resampling of cells.

Draws come from md5 of a seed, the draw and the cell, so that any engine repeats them: (draw, cell_type, cell_id, source_id), a cell
and the one whose values it takes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.functions.ranks import with_rank
from covaria.sources.store import materialize

#: Candidates that are matched in one group, about.
STRIP_CELLS = 2048
METHODS = ("bin", "global", "toroidal", "pc")


def _draws(cells: DataFrame, n: int) -> DataFrame:
    return cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))


def _hash(seed: int, *columns) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def tiles(cells: DataFrame, bins_x: int = 10, bins_y: int = 10) -> DataFrame:
    """cells with tx, ty: equal-width tiles over each type's own extent, closed on the right."""
    if bins_x < 2 or bins_y < 2:
        raise ValueError("at least two bins on each axis")
    box = cells.groupBy("slide", "cell_type").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    number = lambda v, lo, hi, n: F.when(F.col(hi) > F.col(lo), F.greatest(F.ceil((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / n)) - 1, F.lit(0))).otherwise(F.lit((n - 1) // 2)).cast("int")
    joined = cells.join(box, ["slide", "cell_type"])
    return joined.withColumn("tx", F.least(number("x", "x0", "x1", bins_x), F.lit(bins_x - 1))).withColumn("ty", F.least(number("y", "y0", "y1", bins_y), F.lit(bins_y - 1))).drop("x0", "x1", "y0", "y1")


def sigma_aware_bins(cells: DataFrame, sigma: float, factor: float, least: int = 2) -> tuple[int, int]:
    """Numbers of tiles whose side is about two bandwidths."""
    r = cells.agg((F.max("x") - F.min("x")).alias("x"), (F.max("y") - F.min("y")).alias("y")).first()
    if not (factor and factor > 0 and sigma > 0 and r["x"] and r["y"] and math.isfinite(factor)):
        return 10, 10
    side = 2 * sigma / factor
    return max(least, math.floor(r["x"] / side)), max(least, math.floor(r["y"] / side))


def global_permutation(cells: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Each draw shuffles the cells of each type within their slide."""
    group = ["slide", "cell_type"]
    own = with_rank(cells.select(*group, "cell_id"), group, ["cell_id"], "a")
    shuffled = with_rank(_draws(cells.select(*group, "cell_id"), n).withColumn("h", _hash(seed, "draw", "cell_id")), ["draw", *group], ["h", "cell_id"], "a")
    source = shuffled.select("draw", *group, F.col("cell_id").alias("source_id"), "a")
    return source.join(own, [*group, "a"]).select("draw", *group, "cell_id", "source_id")


def toroidal_permutation(cells: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Coordinates shifted by 0.1 to 0.9 of the extent around a torus; a cell takes the values of the one at its rank by (x, y)."""
    group = ["slide", "cell_type"]
    box = cells.groupBy(*group).agg(F.min("x").alias("x0"), (F.max("x") - F.min("x")).alias("wx"), F.min("y").alias("y0"), (F.max("y") - F.min("y")).alias("wy"))
    spread = _draws(cells.select(*group, "cell_id", "x", "y").join(box, group), n)
    unit = lambda axis: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), "slide", "cell_type", F.lit(axis))), 1, 8), 16, 10).cast("double") / 4294967296.0
    move = lambda v, lo, w: F.when(F.col(w) > 0, F.col(lo) + F.pmod(F.col(v) - F.col(lo) + (0.1 + 0.8 * unit(v)) * F.col(w), F.when(F.col(w) > 0, F.col(w)).otherwise(1.0))).otherwise(F.col(v))
    moved = spread.select("draw", *group, "cell_id", move("x", "x0", "wx").alias("mx"), move("y", "y0", "wy").alias("my"))
    source = with_rank(cells.select(*group, F.col("cell_id").alias("source_id"), "x", "y"), group, ["x", "y", "source_id"], "a").select(*group, "source_id", "a")
    placed = with_rank(moved, ["draw", *group], ["mx", "my", "cell_id"], "a")
    return placed.join(source, [*group, "a"]).select("draw", *group, "cell_id", "source_id")


def nearest_free(points: np.ndarray, offers: np.ndarray) -> np.ndarray:
    """For each point in turn the nearest offer that no point before it took (the first of equals); needs as many offers as points."""
    free = np.arange(len(offers))
    taken = np.empty(len(points), int)
    for k, point in enumerate(points):
        at = int(((offers[free] - point) ** 2).sum(axis=1).argmin())
        taken[k] = free[at]
        free = np.delete(free, at)
    return taken


def _with_quantiles(df: DataFrame, key: list[str], x: str, y: str, name: str) -> DataFrame:
    """qx, qy: mean ranks within the key over one more than the number of rows (so 1/2 for a single one); place: the rank by x, from 0."""
    whole = Window.partitionBy(*key)
    mean_rank = lambda v: F.rank().over(whole.orderBy(v)) + (F.count("*").over(Window.partitionBy(*key, v)) - 1) / 2
    placed = df.withColumn("size", F.count("*").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(x, name)) - 1)
    return placed.withColumn("qx", mean_rank(x) / (F.col("size") + 1)).withColumn("qy", mean_rank(y) / (F.col("size") + 1))


def resample_spatial(cells: DataFrame, n: int = 1, bins_x: int = 10, bins_y: int = 10, match_quantile: bool = False, seed: int = 1) -> DataFrame:
    """Occupied tiles are shuffled and each tile's cells take values from the tile it got, and from its neighbours if those are too few.

    Cells are drawn with replacement only if even then there are too few, so a draw is no bijection.
    """
    placed = tiles(cells, bins_x, bins_y).select("slide", "cell_type", "cell_id", "x", "y", "tx", "ty")
    placed = materialize(placed, "tiles")
    group = ["slide", "cell_type"]
    occupied = _draws(placed.groupBy(*group, "tx", "ty").agg(F.count("*").alias("n")), n)
    w = lambda *c: Window.partitionBy("draw", *group).orderBy(*c)
    ranked = occupied.withColumn("a", F.row_number().over(w("tx", "ty"))).withColumn("b", F.row_number().over(w(_hash(seed, "draw", "tx", "ty"), "tx", "ty")))
    goal = ranked.select("draw", *group, F.col("tx").alias("gx"), F.col("ty").alias("gy"), F.col("n").alias("gn"), F.col("b").alias("a"))
    mapped = ranked.drop("b").join(goal, ["draw", *group, "a"]).drop("a")
    # candidate tiles: the goal, then its neighbours row by row, as long as those before it are too few
    around = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for o, (dx, dy) in enumerate([(0, 0)] + [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y])]))
    near = mapped.withColumn("s", around).select("draw", *group, "tx", "ty", "n", F.col("s.o").alias("o"), (F.col("gx") + F.col("s.dx")).alias("cx"), (F.col("gy") + F.col("s.dy")).alias("cy"))
    sizes = placed.groupBy(*group, F.col("tx").alias("cx"), F.col("ty").alias("cy")).agg(F.count("*").alias("cn"))
    before = F.coalesce(F.sum("cn").over(Window.partitionBy("draw", *group, "tx", "ty").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = near.join(sizes, [*group, "cx", "cy"]).withColumn("before", before).where(F.col("before") < F.col("n"))
    total = used.groupBy("draw", *group, "tx", "ty").agg(F.sum("cn").alias("total"), F.max("n").alias("wanted"))
    pool = used.join(placed.select(*group, F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("cell_id").alias("source_id"), F.col("x").alias("sx"), F.col("y").alias("sy")), [*group, "cx", "cy"])
    key = ["draw", *group, "tx", "ty"]
    want = _draws(placed, n)
    if match_quantile:
        fit = "draw int, slide string, cell_type string, cell_id long, source_id long"

        def match(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            a, b = a.sort_values("cell_id"), b.sort_values(["o", "source_id"])
            if len(b) >= len(a):
                got = b["source_id"].to_numpy()[nearest_free(a[["qx", "qy"]].to_numpy(), b[["qx", "qy"]].to_numpy())]
            else:
                got = b["source_id"].to_numpy()[np.arange(len(a)) % max(len(b), 1)]
            return a[["draw", "slide", "cell_type", "cell_id"]].assign(source_id=got)

        # tiles of many candidates are matched in strips by x, so that no task gets a whole crowded tile; a candidate's rank is
        # taken to that of a cell first, so that a strip never has fewer candidates than cells if the tile hasn't
        strips = total.withColumn("strips", F.ceil(F.col("total") / STRIP_CELLS).cast("int"))
        strip = lambda place: F.floor(place * F.col("strips") / F.col("wanted")).cast("int").alias("strip")
        asked = _with_quantiles(want, key, "x", "y", "cell_id").join(strips, key).select(*key, "cell_id", "qx", "qy", strip(F.col("place")))
        offered = _with_quantiles(materialize(pool, "pool"), key, "sx", "sy", "source_id").join(strips, key).select(*key, "o", "source_id", "qx", "qy", strip(F.floor(F.col("place") * F.col("wanted") / F.col("total"))))
        return asked.groupBy(*key, "strip").cogroup(offered.groupBy(*key, "strip")).applyInPandas(match, fit)
    order = Window.partitionBy(*key)
    offered = pool.withColumn("r", F.row_number().over(order.orderBy(_hash(seed, "draw", "tx", "ty", "source_id"), "source_id")) - 1).select(*key, "source_id", "r")
    asked = want.withColumn("a", F.row_number().over(order.orderBy(_hash(seed, "draw", "cell_id"), "cell_id")) - 1).join(total, key).withColumn("r", F.pmod(F.col("a"), F.col("total")).cast("int"))
    return asked.join(offered, [*key, "r"]).select("draw", "slide", "cell_type", "cell_id", "source_id")


def permutations(cells: DataFrame, n: int, method: str = "bin", bins_x: int = 10, bins_y: int = 10, match_quantile: bool = False, seed: int = 1) -> DataFrame:
    if method == "bin":
        return resample_spatial(cells, n, bins_x, bins_y, match_quantile, seed)
    if method == "toroidal":
        return toroidal_permutation(cells, n, seed)
    if method in ("global", "pc"):
        return global_permutation(cells, n, seed)
    raise ValueError(f"permu_method must be one of {METHODS}")


def permute_scores(scores: DataFrame, perm: DataFrame) -> DataFrame:
    """(draw, slide, cell_type, cell_id, pc, score): every cell with the scores of the one it takes from."""
    taken = scores.select(F.col("cell_id").alias("source_id"), "pc", "score")
    return perm.join(taken, "source_id").select("draw", "slide", "cell_type", "cell_id", "pc", "score")


def permute_each_component(scores: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Every component shuffled on its own within type and slide."""
    group = ["slide", "cell_type", "pc"]
    plain = scores.select(*group, "cell_id", "score")
    own = with_rank(plain.drop("score"), group, ["cell_id"], "a")
    shuffled = with_rank(_draws(plain, n).withColumn("h", _hash(seed, "draw", "pc", "cell_id")), ["draw", *group], ["h", "cell_id"], "a")
    return shuffled.select("draw", *group, "a", "score").join(own, [*group, "a"]).select("draw", "slide", "cell_type", "cell_id", "pc", "score")
