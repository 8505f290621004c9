"""Per-gene regression tests of cell scores: least squares, and a random intercept for each group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions.quantiles import normal_two_sided, student_t_two_sided
from covaria.sources.store import materialize


def _sums(expression: DataFrame, scores: DataFrame, covariates: list[str], groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics of (1, gene, covariates, score): those without the gene once, those with it for each gene."""
    fixed = ["__one", *covariates, "score"]
    base = scores.withColumn("__one", F.lit(1.0))
    cross = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"s_{i}_{j}") for i, a in enumerate(fixed) for j, b in enumerate(fixed) if i <= j]
    common = base.groupBy("cell_type", "cc", *groups).agg(*cross)
    with_gene = expression.join(base, "cell_id").groupBy("cell_type", "cc", *groups, "gene").agg(F.sum(F.col("value") ** 2).alias("g_g"), *[F.sum(F.col("value") * F.col(a).cast("double")).alias(f"g_{i}") for i, a in enumerate(fixed)])
    return common, with_gene


def _moments(row: dict[str, float], gene: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X and X'y for X = (1, gene, covariates), y'y and n, from the sums."""
    order = [0, None, *range(1, k + 1)]
    y = k + 1
    s = lambda i, j: float(row[f"s_{min(i, j)}_{max(i, j)}"])
    g = lambda name: float(gene[name])
    xx = np.array([[g("g_g") if a is None and b is None else g(f"g_{b if a is None else a}") if a is None or b is None else s(a, b) for b in order] for a in order])
    xy = np.array([g(f"g_{y}") if a is None else s(a, y) for a in order])
    return xx, xy, s(y, y), s(0, 0)


def _least_squares(xx: np.ndarray, xy: np.ndarray, yy: float, n: float) -> tuple[float, float]:
    try:
        inverse = np.linalg.inv(xx)
    except np.linalg.LinAlgError:
        return math.nan, math.nan
    if np.linalg.cond(xx) > 1e14 or n <= len(xy):
        return math.nan, math.nan
    beta = inverse @ xy
    rss = max(yy - beta @ xy, 0.0)
    se = math.sqrt(rss / (n - len(xy)) * max(inverse[1, 1], 0.0))
    return float(beta[1]), student_t_two_sided(beta[1] / se, n - len(xy)) if se > 0 else 0.0


def _random_intercept(parts: list[tuple[np.ndarray, np.ndarray, float, float]]) -> tuple[float, float]:
    """Restricted maximum likelihood over the ratio of variances; each group enters by its sums only."""
    p = len(parts[0][1])
    n = sum(x[3] for x in parts)
    if n <= p:
        return math.nan, math.nan

    def fit(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        a, b, c, logdet = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for xx, xy, yy, m in parts:
            shrink = ratio / (1 + ratio * m)
            a += xx - shrink * np.outer(xx[0], xx[0])
            b += xy - shrink * xx[0] * xy[0]
            c += yy - shrink * xy[0] ** 2
            logdet += math.log1p(ratio * m)
        beta = np.linalg.solve(a, b)
        s2 = max(c - beta @ b, 1e-300) / (n - p)
        return (n - p) * math.log(s2) + logdet + np.linalg.slogdet(a)[1], beta, a, s2

    try:
        grid = [0.0, *np.logspace(-6, 4, 41)]
        values = [fit(r)[0] for r in grid]
        k = int(np.argmin(values))
        lo, hi = math.log(max(grid[max(k - 1, 0)], 1e-9)), math.log(max(grid[min(k + 1, len(grid) - 1)], 1e-9))
        golden = (math.sqrt(5) - 1) / 2
        for _ in range(60):
            x, y = hi - golden * (hi - lo), lo + golden * (hi - lo)
            lo, hi = (lo, y) if fit(math.exp(x))[0] < fit(math.exp(y))[0] else (x, hi)
        ratio = min((math.exp((lo + hi) / 2), grid[k]), key=lambda r: fit(r)[0])
        _, beta, a, s2 = fit(ratio)
        se = math.sqrt(s2 * np.linalg.inv(a)[1, 1])
    except (np.linalg.LinAlgError, ValueError):
        return math.nan, math.nan
    return float(beta[1]), normal_two_sided(beta[1] / se) if se > 0 else 0.0


def test_gene_scores(expression: DataFrame, scores: DataFrame, test_type: str = "lmm", covariates: list[str] | None = None, group_var: str = "slide") -> DataFrame:
    """(cell_type, cc, gene, estimate, pvalue, z_score) of score ~ gene + covariates [+ (1 | group)] for each gene.

    ``scores`` has (cell_type, cell_id, cc, score, group, covariates).  Cells are reduced to sums first, with implicit zeros; the
    fits then see a few numbers for each gene (and group).  z_score is the signed -log10 of the one-sided p-value.
    """
    covariates = covariates or []
    if test_type not in ("glm", "lmm"):
        raise ValueError("test_type must be glm or lmm")
    groups = [group_var] if test_type == "lmm" else []
    common, with_gene = _sums(expression, scores, covariates, groups)
    genes = with_gene.select("gene").distinct()
    every = common.crossJoin(genes).join(with_gene, ["cell_type", "cc", *groups, "gene"], "left").fillna(0.0)
    k = len(covariates)
    sums = [f"s_{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]
    own = ["g_g", *[f"g_{i}" for i in range(k + 2)]]
    # the sums of all groups of a gene in one row: as many numbers as groups times pairs of covariates
    packed = every.groupBy("cell_type", "cc", "gene").agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in [*sums, *own]])).alias("parts"))

    @F.pandas_udf("estimate double, pvalue double")
    def fit(parts: pd.Series) -> pd.DataFrame:
        out = []
        for rows in parts:
            found = [_moments(dict(zip(sums, r, strict=False)), dict(zip(own, r[len(sums) :], strict=True)), k) for r in map(np.asarray, rows)]
            out.append(_least_squares(*found[0]) if test_type == "glm" else _random_intercept(found))
        return pd.DataFrame(out, columns=["estimate", "pvalue"], dtype=float)

    fitted = materialize(packed.select("cell_type", "cc", "gene", fit("parts").alias("f")).select("cell_type", "cc", "gene", "f.*"), "gene-tests")
    p, estimate = F.col("pvalue"), F.col("estimate")
    # a p-value of zero counts as the smallest positive one of its type and component
    floor = fitted.where(p > 0).groupBy("cell_type", "cc").agg(F.min("pvalue").alias("least"))
    half = F.when(p == 0, F.coalesce("least", F.lit(1e-300))).otherwise(p) / 2
    upper, lower = F.when(estimate > 0, half).otherwise(1 - half), F.when(estimate < 0, half).otherwise(1 - half)
    z = F.when(F.isnan(estimate) | F.isnan(p), F.lit(float("nan"))).when(upper > 0.5, F.log10(lower)).otherwise(-F.log10(upper))
    return fitted.join(floor, ["cell_type", "cc"], "left").select("cell_type", "cc", "gene", "estimate", "pvalue", z.alias("z_score"))


test_gene_scores.__test__ = False


def gene_slopes(expression: DataFrame, scores: DataFrame) -> DataFrame:
    """(cell_type, cc, gene, estimate): the least-squares slopes of score ~ gene, by expressions only."""
    n = scores.groupBy("cell_type", "cc").agg(F.count("*").alias("n"), F.sum("score").alias("sy"))
    g = expression.join(scores, "cell_id").groupBy("cell_type", "cc", "gene").agg(F.sum("value").alias("sx"), F.sum(F.col("value") ** 2).alias("sxx"), F.sum(F.col("value") * F.col("score")).alias("sxy"))
    return g.join(n, ["cell_type", "cc"]).select("cell_type", "cc", "gene", F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") ** 2 / F.col("n")).alias("estimate"))
