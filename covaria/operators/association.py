"""Association of scores through a kernel: normalised and bidirectional correlation, norms, choice of bandwidth.

Scores are (slide, cell_type, cell_id, cc, score), optionally with a ``sigma`` column where they differ by bandwidth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.operators.kernel import sinkhorn
from covaria.operators.subset import BLOCK, filter_kernel
from covaria.operators.tiled import TiledKernel


def side_sums(kernel: DataFrame | TiledKernel) -> tuple[DataFrame, DataFrame]:
    """(sigma, slide, ct_1, ct_2, i, s, q) and the same by j: sums and sums of squares of rows and columns that have values."""
    if isinstance(kernel, TiledKernel):
        return kernel.sums()
    return tuple(kernel.groupBy(*BLOCK, side).agg(F.sum("k").alias("s"), F.sum(F.col("k") ** 2).alias("q")) for side in "ij")


def smoothed(kernel: DataFrame | TiledKernel, scores: DataFrame) -> DataFrame:
    """(sigma, slide, ct_1, ct_2, j, cc, s): the first types' scores seen through the kernel by the second types' cells."""
    if isinstance(kernel, TiledKernel):
        return kernel.smooth(left=scores)[1]
    return _scored(kernel, scores, "i", "a").groupBy(*BLOCK, "j", "cc").agg(F.sum(F.col("k") * F.col("a")).alias("s"))


def block_norms(kernel: DataFrame | TiledKernel, sizes: DataFrame, own: DataFrame | TiledKernel | None = None) -> DataFrame:
    """(sigma, slide, ct_1, ct_2, norm): Frobenius norm of the doubly centred kernel, whitened by the types' own kernels.

    Without both own kernels at a bandwidth it is the plain centred norm, in closed form from row, column and grand
    sums.  A single type's kernel serves as its own.  ``sizes`` has (slide, ct_1, ct_2, n_1, n_2).
    """
    rows, columns = side_sums(kernel)
    by_row = rows.groupBy(*BLOCK).agg(F.sum("q").alias("k2"), F.sum(F.col("s") ** 2).alias("r2"), F.sum("s").alias("total"))
    by_col = columns.groupBy(*BLOCK).agg(F.sum(F.col("s") ** 2).alias("c2"))
    stats = by_row.join(by_col, BLOCK).join(sizes.select("slide", "ct_1", "ct_2", "n_1", "n_2"), ["slide", "ct_1", "ct_2"])
    plain = F.col("k2") - F.col("r2") / F.col("n_2") - F.col("c2") / F.col("n_1") + F.col("total") ** 2 / (F.col("n_1") * F.col("n_2"))
    out = stats.select(*BLOCK, F.sqrt(F.greatest(plain, F.lit(0.0))).alias("plain"))
    if own is None and not sizes.where("ct_1 = ct_2").limit(1).count():  # nothing to whiten with
        return out.withColumnRenamed("plain", "norm")
    if isinstance(kernel, TiledKernel):
        white = kernel.whitened(kernel.where(lambda sigma, slide, one, two: one == two) if own is None else own)
    else:
        white = _whitened(kernel, kernel.where("ct_1 = ct_2") if own is None else own, sizes)
    return out.join(white, BLOCK, "left").select(*BLOCK, F.coalesce("white", "plain").alias("norm"))


def _whitened(kernel: DataFrame, own: DataFrame, sizes: DataFrame) -> DataFrame:
    """The root of the sum over (Rx Kc Ry) * Kc, with Kc = K + U V', U = [-row mean, 1] and V = [1, grand mean - column mean].

    As Rx and Ry are symmetric, that is the sum over (Rx Kc) * (Kc Ry), so no third product is formed.  The products of K alone are
    edges times the degree of an own kernel; all that U and V add comes from the vectors Rx U and Ry V:
    sum (Rx K) * (K Ry) + 2 sum_r (Rx U_r)' K (Ry V_r) + sum_rs (U_r' Rx U_s) (V_r' Ry V_s).
    """
    halves = own.select("sigma", "slide", F.col("ct_1").alias("ct"), F.col("i").alias("a"), F.col("j").alias("b"), "k")
    turned = halves.select("sigma", "slide", "ct", F.col("b").alias("a"), F.col("a").alias("b"), "k")
    r = halves.unionByName(turned).groupBy("sigma", "slide", "ct", "a", "b").agg((F.sum("k") / 2).alias("w"))
    have = r.select("sigma", "slide", "ct").distinct()
    blocks = kernel.select(*BLOCK).distinct().join(have.withColumnRenamed("ct", "ct_1"), ["sigma", "slide", "ct_1"]).join(have.withColumnRenamed("ct", "ct_2"), ["sigma", "slide", "ct_2"]).select(*BLOCK)
    k = kernel.join(blocks, BLOCK, "left_semi")
    rx = r.select("sigma", "slide", F.col("ct").alias("ct_1"), F.col("a").alias("p"), F.col("b").alias("i"), F.col("w").alias("wx"))
    ry = r.select("sigma", "slide", F.col("ct").alias("ct_2"), F.col("a").alias("q"), F.col("b").alias("j"), F.col("w").alias("wy"))
    grand = k.groupBy(*BLOCK).agg(F.sum("k").alias("total")).join(sizes.select("slide", "ct_1", "ct_2", "n_1", "n_2"), ["slide", "ct_1", "ct_2"])
    grand = grand.select(*BLOCK, "n_1", "n_2", (F.col("total") / (F.col("n_1") * F.col("n_2"))).alias("grand"))
    left = rx.join(k, ["sigma", "slide", "ct_1", "i"]).groupBy(*BLOCK, F.col("p").alias("i"), "j").agg(F.sum(F.col("wx") * F.col("k")).alias("x"))
    right = k.join(ry, ["sigma", "slide", "ct_2", "j"]).groupBy(*BLOCK, "i", F.col("q").alias("j")).agg(F.sum(F.col("wy") * F.col("k")).alias("y"))
    base = left.join(right, [*BLOCK, "i", "j"]).groupBy(*BLOCK).agg(F.sum(F.col("x") * F.col("y")).alias("base"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # u and v of a cell, and Rx U and Ry V of it
    rows = k.groupBy(*BLOCK, "i").agg(F.sum("k").alias("s")).join(grand, BLOCK).select(*BLOCK, "i", (-F.col("s") / F.col("n_2")).alias("u"))
    columns = k.groupBy(*BLOCK, "j").agg(F.sum("k").alias("s")).join(grand, BLOCK).select(*BLOCK, "j", (F.col("s") / F.col("n_1")).alias("cm"))
    mine = rx.join(blocks, ["sigma", "slide", "ct_1"]).join(rows, [*BLOCK, "i"], "left").groupBy(*BLOCK, F.col("p").alias("i")).agg(F.sum(F.col("wx") * z("u")).alias("u1"), F.sum("wx").alias("u2"))
    mine = mine.join(rows, [*BLOCK, "i"], "left").select(*BLOCK, "i", "u1", "u2", z("u").alias("u"))
    theirs = ry.join(blocks, ["sigma", "slide", "ct_2"]).join(grand.select(*BLOCK, "grand"), BLOCK).join(columns, [*BLOCK, "j"], "left")
    theirs = theirs.groupBy(*BLOCK, F.col("q").alias("j"), "grand").agg(F.sum("wy").alias("v1"), F.sum(F.col("wy") * (F.col("grand") - z("cm"))).alias("v2"))
    theirs = theirs.join(columns, [*BLOCK, "j"], "left").select(*BLOCK, "j", "v1", "v2", (F.col("grand") - z("cm")).alias("v"))
    crossed = k.join(mine, [*BLOCK, "i"]).join(theirs, [*BLOCK, "j"]).groupBy(*BLOCK).agg(F.sum(F.col("k") * (F.col("u1") * F.col("v1") + F.col("u2") * F.col("v2"))).alias("crossed"))
    u = mine.groupBy(*BLOCK).agg(F.sum(F.col("u") * F.col("u1")).alias("u11"), F.sum("u1").alias("u12"), F.sum("u2").alias("u22"))
    v = theirs.groupBy(*BLOCK).agg(F.sum("v1").alias("v11"), F.sum("v2").alias("v12"), F.sum(F.col("v") * F.col("v2")).alias("v22"))
    rank = F.col("u11") * F.col("v11") + 2 * F.col("u12") * F.col("v12") + F.col("u22") * F.col("v22")
    total = z("base") + 2 * z("crossed") + rank
    return u.join(v, BLOCK).join(base, BLOCK, "left").join(crossed, BLOCK, "left").select(*BLOCK, F.sqrt(F.greatest(total, F.lit(0.0))).alias("white"))


def _scored(kernel: DataFrame, scores: DataFrame, side: str, name: str) -> DataFrame:
    n = "1" if side == "i" else "2"
    own = ["sigma"] if "sigma" in scores.columns else []
    s = scores.select(*own, F.col("cell_type").alias(f"ct_{n}"), F.col("cell_id").alias(side), "cc", F.col("score").alias(name))
    return kernel.join(s, [*own, f"ct_{n}", side, *(["cc"] if "cc" in kernel.columns else [])])


def _with_sigma(scores: DataFrame, kernel: DataFrame | TiledKernel) -> DataFrame:
    if "sigma" in scores.columns:
        return scores
    known = scores.sparkSession.createDataFrame([(x,) for x in sorted({v[0] for v in kernel.valid()})], "sigma double") if isinstance(kernel, TiledKernel) else kernel.select("sigma").distinct()
    return scores.crossJoin(F.broadcast(known))  # a handful of bandwidths


def normalized_correlation(kernel: DataFrame | TiledKernel, scores: DataFrame, norms: DataFrame, mode: str = "per_slide") -> DataFrame:
    """a'K b / (|a| |b| norm) per slide, or with the sums and the mean norm taken over all slides (``aggregate``)."""
    # the kernel is applied to the left scores first: edges are shuffled once and combine by their right end
    smooth = smoothed(kernel, scores)
    num = _scored(smooth, scores, "j", "b").groupBy(*BLOCK, "cc").agg(F.sum(F.col("s") * F.col("b")).alias("num"))
    sizes = _with_sigma(scores, kernel).groupBy("sigma", "slide", "cell_type", "cc").agg(F.sum(F.col("score") ** 2).alias("q"))
    full = num.join(norms, BLOCK)
    for n in ("1", "2"):
        full = full.join(sizes.select("sigma", "slide", F.col("cell_type").alias(f"ct_{n}"), "cc", F.col("q").alias(f"q{n}")), ["sigma", "slide", f"ct_{n}", "cc"])
    if mode == "aggregate":
        full = full.where((F.col("norm") >= 1e-9) & ~F.isnan("norm"))
        full = full.groupBy("sigma", "ct_1", "ct_2", "cc").agg(F.sum("num").alias("num"), F.sum("q1").alias("q1"), F.sum("q2").alias("q2"), F.avg("norm").alias("norm"))
    elif mode != "per_slide":
        raise ValueError("mode must be per_slide or aggregate")
    den = F.sqrt("q1") * F.sqrt("q2") * F.col("norm")
    value = F.when(F.abs(den) < 1e-9, F.lit(0.0)).otherwise(F.try_divide(F.col("num"), den))
    keys = ["sigma", *(["slide"] if mode == "per_slide" else []), "ct_1", "ct_2", "cc"]
    return full.select(*keys, value.alias("normalized_correlation"))


def choose_sigma(association: DataFrame, value: str = "normalized_correlation") -> DataFrame:
    """(sigma, mean_cc1), the bandwidth of the largest mean first correlation; the smaller one of equals."""
    means = association.where("cc = 1").groupBy("sigma").agg(F.avg(value).alias("mean_cc1"))
    return means.orderBy(F.desc("mean_cc1"), "sigma").limit(1)


def pearson(df: DataFrame, keys: list[str], x: str, y: str, name: str = "r") -> DataFrame:
    """Correlation by centred moments in two passes; 0 where either side is constant."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    c = df.join(means, keys)
    dx, dy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    sums = c.groupBy(*keys).agg(F.sum(dx * dy).alias("__xy"), F.sum(dx * dx).alias("__xx"), F.sum(dy * dy).alias("__yy"))
    den = F.sqrt(F.col("__xx") * F.col("__yy"))
    return sums.select(*keys, F.when(den < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.col("__xy"), den)).alias(name))


def bidirectional_correlation(kernel: DataFrame | TiledKernel, scores: DataFrame, normalize_K: str = "row_or_col", filter_kernel_first: bool = True, row_cutoff: float = 5e-3, col_cutoff: float = 5e-3) -> DataFrame:
    """Mean of cor(K'a, b) and cor(a, K b) per block and component.

    ``row_or_col`` smooths a with the row-normalised and b with the column-normalised kernel.  Blocks of which the filter
    leaves nothing get 0.
    """
    if normalize_K not in ("row_or_col", "sinkhorn_knopp", "none"):
        raise ValueError("normalize_K must be row_or_col, sinkhorn_knopp or none")
    full = _with_sigma(scores, kernel)
    rows_of_all = side_sums(kernel)[0]
    blocks = rows_of_all.select(*BLOCK).distinct()
    used = filter_kernel(kernel, row_cutoff, col_cutoff) if filter_kernel_first else kernel
    used_sums = side_sums(used) if filter_kernel_first or normalize_K == "row_or_col" else None
    # the cells that stay: with a filter those that pass it (rows may lose all their edges to column cuts), else all
    if filter_kernel_first:
        cross = rows_of_all.where((F.col("ct_1") != F.col("ct_2")) & (F.col("s") > row_cutoff)).select(*BLOCK, "i")
        own, own_columns = (sums.where("ct_1 = ct_2") for sums in used_sums)
        kept = own.select(*BLOCK, "i").union(own_columns.select(*BLOCK, "j")).distinct()
        left = cross.join(used_sums[0].select(*BLOCK).distinct(), BLOCK, "left_semi").unionByName(kept)
        right = used_sums[1].where("ct_1 <> ct_2").select(*BLOCK, "j").unionByName(kept.withColumnRenamed("i", "j"))
    else:
        left = blocks.join(full.select("sigma", "slide", F.col("cell_type").alias("ct_1"), F.col("cell_id").alias("i")).distinct(), ["sigma", "slide", "ct_1"])
        right = blocks.join(full.select("sigma", "slide", F.col("cell_type").alias("ct_2"), F.col("cell_id").alias("j")).distinct(), ["sigma", "slide", "ct_2"])
    a = left.join(full.select("sigma", F.col("cell_type").alias("ct_1"), F.col("cell_id").alias("i"), "cc", F.col("score").alias("a")), ["sigma", "ct_1", "i"])
    b = right.join(full.select("sigma", F.col("cell_type").alias("ct_2"), F.col("cell_id").alias("j"), "cc", F.col("score").alias("b")), ["sigma", "ct_2", "j"])
    k1 = k2 = sinkhorn(used) if normalize_K == "sinkhorn_knopp" else used
    if normalize_K == "row_or_col":
        safe = lambda s: F.when(s < 1e-12, F.lit(1.0)).otherwise(s)
        rows, cols = (sums.withColumn("f", 1 / safe(F.col("s"))) for sums in used_sums)
        if isinstance(used, TiledKernel):
            k1, k2 = used.scaled(rows, None), used.scaled(None, cols)
        else:
            k1 = used.join(rows.select(*BLOCK, "i", "f"), [*BLOCK, "i"]).withColumn("k", F.col("k") * F.col("f")).drop("f")
            k2 = used.join(cols.select(*BLOCK, "j", "f"), [*BLOCK, "j"]).withColumn("k", F.col("k") * F.col("f")).drop("f")
    if not isinstance(k1, TiledKernel):
        ka = k1.join(a, [*BLOCK, "i"]).groupBy(*BLOCK, "j", "cc").agg(F.sum(F.col("k") * F.col("a")).alias("s"))
        kb = k2.join(b, [*BLOCK, "j"]).groupBy(*BLOCK, "i", "cc").agg(F.sum(F.col("k") * F.col("b")).alias("s"))
    elif k1 is k2:
        kb, ka = k1.smooth(scores, scores)
    else:
        ka, kb = k1.smooth(left=scores)[1], k2.smooth(right=scores)[0]
    zero = F.coalesce("s", F.lit(0.0)).alias("s")
    one = pearson(b.join(ka, [*BLOCK, "j", "cc"], "left").select(*BLOCK, "cc", zero, "b"), [*BLOCK, "cc"], "s", "b", "r1")
    two = pearson(a.join(kb, [*BLOCK, "i", "cc"], "left").select(*BLOCK, "cc", zero, "a"), [*BLOCK, "cc"], "s", "a", "r2")
    every = blocks.join(full.select("sigma", "cc").distinct(), "sigma")
    return every.join(one, [*BLOCK, "cc"], "left").join(two, [*BLOCK, "cc"], "left").select(*BLOCK, "cc", ((F.coalesce("r1", F.lit(0.0)) + F.coalesce("r2", F.lit(0.0))) / 2).alias("bidir_correlation"))


def permutation_pvalue(observed: DataFrame, null: DataFrame, cc: int = 1, pair: tuple[str, str] | None = None, alternative: str = "greater", value: str = "normalized_correlation") -> DataFrame:
    """(observed, n_draws, p_value, p_floor, null_mean, null_sd): the observed maximum over pairs against each draw's.

    The observed value is taken over the bandwidths that the null has.
    """
    pick = lambda df: df.where(F.col("cc") == cc) if pair is None else df.where((F.col("cc") == cc) & (F.col("ct_1") == pair[0]) & (F.col("ct_2") == pair[1]))
    draws = pick(null).groupBy("draw").agg(F.max(value).alias("v"))
    seen = pick(observed).join(null.select("sigma").distinct(), "sigma", "left_semi").agg(F.max(value).alias("observed"))
    stats = draws.crossJoin(F.broadcast(seen))  # one row
    agg = stats.groupBy("observed").agg(F.count("*").alias("n_draws"), F.count_if(F.col("v") >= F.col("observed")).alias("ge"), F.count_if(F.col("v") <= F.col("observed")).alias("le"), F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"))
    tail = lambda c: (F.lit(1.0) + F.col(c)) / (F.col("n_draws") + 1)
    p = {"greater": tail("ge"), "less": tail("le"), "two-sided": F.least(F.lit(1.0), 2 * F.least(tail("ge"), tail("le")))}[alternative]
    return agg.select("observed", "n_draws", p.alias("p_value"), (F.lit(1.0) / (F.col("n_draws") + 1)).alias("p_floor"), "null_mean", "null_sd")


def step_down(per_axis: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cc, p_raw) -> with p_value, the running maximum over axes, and whether the axis is significant with all before it."""
    order = Window.orderBy("cc").rowsBetween(Window.unboundedPreceding, 0)  # one row for each axis
    return per_axis.withColumn("p_value", F.max(F.coalesce("p_raw", F.lit(1.0))).over(order)).withColumn("significant", F.col("p_value") <= alpha)
