"""Plot-ready tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.functions.ranks import with_rank
from covaria.operators.association import smoothed
from covaria.operators.tiled import TiledKernel
from covaria.sources.store import materialize


def correlation_by_sigma(association: DataFrame, cc: int = 1) -> DataFrame:
    return association.where(F.col("cc") == cc).select(F.concat_ws("-", "ct_1", "ct_2").alias("pair"), "sigma", "normalized_correlation").orderBy("pair", "sigma")


def scores_in_place(scores: DataFrame, cells: DataFrame, cc: int = 1) -> DataFrame:
    """Coordinates and scores, matched by cell."""
    return scores.where(F.col("cc") == cc).select("cell_id", "score").join(cells.select("cell_id", "slide", "cell_type", "x", "y"), "cell_id")


def slicing(cells: DataFrame, split: DataFrame) -> DataFrame:
    """(slide, block, cell_id, x, y): where each cell of a split slide has gone, for a panel of each original slide."""
    return cells.select("cell_id", "slide", "x", "y").join(split.select("cell_id", F.col("slide").alias("block")), "cell_id").select("slide", "block", "cell_id", "x", "y")


def smoothed_against_target(kernel: DataFrame | TiledKernel, scores: DataFrame, sigma: float, ct_1: str, ct_2: str, cc: int = 1) -> DataFrame:
    """(slide, cell_id, smoothed, score): for each cell of the second type, the first type's scores seen through the kernel."""
    if isinstance(kernel, TiledKernel):
        k = kernel.where(lambda *block: (block[0], *block[2:]) == (sigma, ct_1, ct_2))
    else:
        k = kernel.where((F.col("sigma") == sigma) & (F.col("ct_1") == ct_1) & (F.col("ct_2") == ct_2))
    smooth = smoothed(k, scores.where(F.col("cc") == cc)).select("j", "s")
    b = scores.where((F.col("cell_type") == ct_2) & (F.col("cc") == cc)).select("slide", "cell_id", "score")
    return b.join(smooth, F.col("cell_id") == F.col("j"), "left").select("slide", "cell_id", F.coalesce("s", F.lit(0.0)).alias("smoothed"), "score")


def volcano(tests: DataFrame, top_n: int = 10, threshold: float = 0.05) -> DataFrame:
    """Effect, -log10 p and a label flag for the most significant genes of each type and component."""
    rank = F.row_number().over(Window.partitionBy("cell_type", "cc").orderBy("pvalue", F.desc(F.abs("estimate")), "gene"))
    return tests.select("cell_type", "cc", "gene", "estimate", (-F.log10(F.greatest("pvalue", F.lit(1e-300)))).alias("log_p"), (F.col("pvalue") < threshold).alias("significant"), (rank <= top_n).alias("labelled"))


def null_histogram(null: DataFrame, bins: int = 20, value: str = "normalized_correlation") -> DataFrame:
    """(bin, low, n): equal-width histogram of the draws' maxima."""
    draws = null.groupBy("draw").agg(F.max(value).alias("v"))
    box = draws.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = draws.crossJoin(F.broadcast(box))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return at.groupBy(bin_.alias("bin"), (F.col("lo") + bin_ * width).alias("low")).agg(F.count("*").alias("n"))


def bidirectional_table(cross: DataFrame, own: DataFrame | None = None) -> DataFrame:
    every = cross.withColumn("kind", F.lit("cross"))
    if own is not None:
        every = every.unionByName(own.withColumn("kind", F.lit("self")))
    return every.select("kind", "sigma", "slide", F.concat_ws("-", "ct_1", "ct_2").alias("pair"), "cc", "bidir_correlation")


def top_genes(gene_scores: DataFrame, cell_type: str, cc: int = 1, top_n: int = 20) -> DataFrame:
    return gene_scores.where((F.col("cell_type") == cell_type) & (F.col("cc") == cc)).orderBy(F.desc(F.abs("score")), "gene").limit(top_n)


def type_shares_by_score(scores: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, cell_type, n, share): composition along equal-width bins of the score."""
    box = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = scores.crossJoin(F.broadcast(box))  # one row
    bin_ = F.least(F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = at.groupBy(bin_.alias("bin"), "cell_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))


def inversions(y: np.ndarray) -> int:
    """Pairs that stand in falling order."""
    if len(y) <= 64:
        return int((y[:, None] > y[None, :])[np.triu_indices(len(y), 1)].sum())
    half = len(y) // 2
    left, right = y[:half], y[half:]
    across = half * len(right) - np.searchsorted(np.sort(left), right, "right").sum()
    return int(across) + inversions(left) + inversions(right)


def kendall_tau(df: DataFrame, x: str, y: str, block: int = 1 << 16) -> DataFrame:
    """Kendall's tau-b over all pairs of rows; rows where either value is null are left out.

    Pairs aren't formed: in the order of x (and y within equal x) the discordant pairs are the inversions of y.  Those inside a block of places are
    counted by one task; those between the two halves of a stretch of 2, 4, 8 ... blocks follow from the ranks by y that the right half has in the
    stretch.  Pairs that are equal in x, y or both are counted by value.
    """
    a = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    a = materialize(with_rank(a.withColumn("one", F.lit(1)), ["one"], ["x", "y"], "place").select("x", "y", "place"), "kendall")
    n = a.count()
    ties = lambda *c: a.groupBy(*c).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0.0
    equal_x, equal_y, equal = ties("x"), ties("y"), ties("x", "y")

    def within(rows: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([inversions(rows.sort_by("place")["y"].to_numpy())], pa.int64())})

    found = a.withColumn("block", F.floor(F.col("place") / block)).groupBy("block").applyInArrow(within, "v long").agg(F.sum("v")).first()[0] or 0
    levels = max(0, (max(n - 1, 0) // block).bit_length())
    if levels:
        spans = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("place") / (block << k)).alias("half")) for k in range(levels)]))
        halves = a.select("y", spans.alias("s")).select("y", "s.level", F.floor(F.col("s.half") / 2).alias("stretch"), (F.col("s.half") % 2).alias("right"))
        # of equal values those on the left come first: what a right one has before it on the left is no inversion
        ranked = with_rank(halves, ["level", "stretch"], ["y", "right"], "rank")
        sums = ranked.groupBy("level", "stretch").agg(F.sum("right").alias("r"), F.sum(1 - F.col("right")).alias("l"), F.sum(F.col("right") * F.col("rank")).alias("ranks"))
        found += sums.agg(F.sum(F.col("l") * F.col("r") - (F.col("ranks") - F.col("r") * (F.col("r") - 1) / 2))).first()[0]
    pairs = n * (n - 1) / 2
    scale = math.sqrt((pairs - equal_x) * (pairs - equal_y))
    tau = (pairs - equal_x - equal_y + equal - 2 * found) / scale if scale else None
    return df.sparkSession.createDataFrame([(tau,)], "tau double")
