"""The analysis as a chain of immutable steps over a CellSet.

Every method returns a new Analysis with one more table; tables that scale with the data stay DataFrames, solvers get
small operators.  One and several slides take the same path: ``slide`` is a column everywhere.
"""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import solve
from covaria.operators import association, crossop, genespace, genetest, neighbors, panels, pca, resample, scores, subset
from covaria.operators import kernel as kernels
from covaria.operators.tiled import TiledKernel
from covaria.sources.cells import CellSet
from covaria.sources.store import materialize

#: Draws in which every cell's scores occur once.
BIJECTIONS = ("global", "toroidal")
PERMU_WHICH = ("second_only", "first_only", "both")


@dataclass(frozen=True)
class Analysis:
    data: CellSet
    pc_scores: DataFrame | None = None
    loadings: DataFrame | None = None
    sdev: DataFrame | None = None
    distances: DataFrame | None = None
    self_distances: DataFrame | None = None
    kernel: DataFrame | None = None
    self_kernel: DataFrame | None = None
    scale_factor: float | None = None
    self_scale_factor: float | None = None
    sigmas: tuple[float, ...] = ()
    weights: DataFrame | None = None
    association: DataFrame | None = None
    sigma_choice: float | None = None
    bidir: DataFrame | None = None
    self_bidir: DataFrame | None = None
    cell_score: DataFrame | None = None
    gene_score: DataFrame | None = None
    regression_score: DataFrame | None = None
    gene_space: DataFrame | None = None
    null: DataFrame | None = None
    tested: DataFrame | None = None
    #: Edges with the kernels that they are read from.
    tiled: tuple[tuple[DataFrame, TiledKernel], ...] = ()
    n_cc: int = 2
    n_pca: int = 30
    scale_pcs: bool = True
    #: What became of each bandwidth that failed.
    status: tuple[tuple[float, str], ...] = ()

    def _with(self, **changes) -> Analysis:
        return dataclasses.replace(self, **changes)

    def _need(self, *names: str) -> None:
        if missing := [n for n in names if getattr(self, n) is None]:
            raise ValueError(f"compute {', '.join(missing)} first")

    def tiles(self, edges: DataFrame | None) -> DataFrame | TiledKernel | None:
        """The kernel that ``edges`` are read from, or they themselves if they come from elsewhere."""
        return next((k for e, k in self.tiled if e is edges), edges)

    @property
    def types(self) -> list[str]:
        return list(self.data.cell_types)

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return subset.pairs_of(self.types)

    def _several_slides(self) -> bool:
        return self.data.cells.select("slide").distinct().limit(2).count() > 1

    def subset_data(self, cell_types: list[str], min_cells: int = 10) -> Analysis:
        return Analysis(subset.subset_data(self.data, cell_types, min_cells))

    # ---- components ----------------------------------------------------------------------------------------------

    def compute_pca(self, n_pca: int = 30, center: bool = True, scale: bool = True, center_per_slide: bool = True) -> Analysis:
        s, load, sdev = pca.compute_pca(self.data.expression, self.data.cells, n_pca, center, scale, center_per_slide)
        return self._with(pc_scores=materialize(s, "pc"), loadings=load, sdev=sdev, n_pca=n_pca)

    def _pcs(self) -> DataFrame:
        self._need("pc_scores")
        return pca.whitened(self.pc_scores, self.sdev) if self.scale_pcs else self.pc_scores

    # ---- distances and kernels -----------------------------------------------------------------------------------

    def compute_distance(self, dist_type: str = "Euclidean2D", normalize: bool = True, truncate: bool = True, normalize_target: float = 0.01, scales=(1.0, 1.0, 1.0)) -> Analysis:
        at = neighbors.scaled(self.data.cells, dist_type, scales)
        low = neighbors.low_quantiles(at, self.pairs, self._several_slides())
        factor = neighbors.scale_factor(low, normalize_target, normalize)
        return self._with(distances=neighbors.conditioned(neighbors.distance_edges(at, self.pairs), low, factor, truncate), scale_factor=factor)

    def compute_self_distance(self, dist_type: str = "Euclidean2D", normalize: bool = True, truncate: bool = True, normalize_target: float = 0.01, scales=(1.0, 1.0, 1.0)) -> Analysis:
        """Within types; always has its own scale factor, which stands in for the other only where that is unset."""
        if len(self.types) == 1:
            warnings.warn("one type: its distances are its own distances", stacklevel=2)
            return self
        at = neighbors.scaled(self.data.cells, dist_type, scales)
        own = subset.self_pairs(self.types)
        low = neighbors.low_quantiles(at, own, True)
        factor = neighbors.scale_factor(low, normalize_target, normalize)
        made = neighbors.conditioned(neighbors.distance_edges(at, own), low, factor, truncate)
        return self._with(self_distances=made, self_scale_factor=factor, scale_factor=self.scale_factor or factor)

    def compute_kernel_matrix(self, sigmas: list[float], method: str = "auto", **options) -> Analysis:
        options = {"method": method, "skip_few": self._several_slides(), "factor": self.scale_factor} | options
        if options.get("lower_limit", 1e-7) <= 0:
            k, factor = kernels.compute_kernel(self.data.cells, self.pairs, sigmas, **options)
            return self._with(kernel=k, scale_factor=factor, sigmas=tuple(sorted(r[0] for r in k.select("sigma").distinct().collect())))
        found, factor = kernels.tiled_kernel(self.data.cells, self.pairs, sigmas, **options)
        edges = found.edges()
        return self._with(kernel=edges, tiled=(*self.tiled, (edges, found)), scale_factor=factor, sigmas=tuple(sorted({block[0] for block in found.valid()})))

    def compute_sparse_kernel(self, sigmas: list[float], **options) -> Analysis:
        return self.compute_kernel_matrix(sigmas, method="sparse", **options)

    def compute_self_kernel(self, sigmas: list[float] | None = None, overwrite: bool = False, **options) -> Analysis:
        """Kernels within types, in distances of their own scale factor.

        Bandwidths that are there already and are not asked for stay, unless ``overwrite`` is set.
        """
        if len(self.types) == 1:
            warnings.warn("one type: its kernel is its own kernel", stacklevel=2)
            return self
        chosen = [float(s) for s in (sigmas or self.sigmas)]
        options = {"skip_few": True, "factor": self.self_scale_factor} | options
        tiled = self.tiled
        if options.get("lower_limit", 1e-7) > 0:
            found, factor = kernels.tiled_kernel(self.data.cells, subset.self_pairs(self.types), chosen, **options)
            k = found.edges()
            tiled = (*tiled, (k, found))
        else:
            k, factor = kernels.compute_kernel(self.data.cells, subset.self_pairs(self.types), chosen, **options)
        if self.self_kernel is not None and not overwrite:
            k = self.self_kernel.where(~F.col("sigma").isin(chosen)).unionByName(k)
        return self._with(self_kernel=k, tiled=tiled, self_scale_factor=factor, scale_factor=self.scale_factor or factor, sigmas=self.sigmas or tuple(sorted(chosen)))

    # ---- canonical correlation -----------------------------------------------------------------------------------

    def _operators(self) -> dict:
        self._need("kernel", "pc_scores")
        return crossop.as_matrices(crossop.cross_operator(self.tiles(self.kernel), self._pcs().select("cell_type", "cell_id", "pc", "score")), self.n_pca)

    def _metrics(self) -> dict[str, np.ndarray] | None:
        if self.scale_pcs:
            return None
        rows = self.sdev.collect()
        return {t: np.array([r["sdev"] ** 2 for r in sorted((r for r in rows if r["cell_type"] == t), key=lambda r: r["pc"])]) for t in self.types}

    def _starts(self) -> solve.Weights:
        """Leading right singular vector of each type's scores, from sums over pairs of components."""
        found = _matrices(self._squares(self._pcs(), ["cell_type"]), ["cell_type"], "p", "q", "v", self.n_pca)
        return {key[0]: np.linalg.eigh(m)[1][:, -1] for key, m in found.items()}

    def _squares(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return scores.squares(rows, keys, self.n_pca + 1)

    def _weight_rows(self, sigma: float, w: solve.Weights) -> list[tuple]:
        return [(float(sigma), t, pc + 1, cc + 1, float(w[t][pc, cc])) for t in self.types for pc in range(w[t].shape[0]) for cc in range(w[t].shape[1])]

    def _complete(self) -> None:
        """Shared weights need every type on every slide."""
        found = {(r["slide"], r["cell_type"]) for r in self.pc_scores.select("slide", "cell_type").distinct().collect()}
        for slide in sorted({s for s, _ in found}):
            for t in self.types:
                if (slide, t) not in found:
                    raise ValueError(f"no components of cell type '{t}' on slide '{slide}'")

    def run_kernel_cca(self, n_cc: int = 2, scale_pcs: bool = True, tol: float = 1e-5, max_iter: int = 500, step_size: float = 1.0, sigma_choice: float | None = None) -> Analysis:
        """Weights for every bandwidth; all operators come from one plan.  A bandwidth that fails is noted in ``status``."""
        me = self._with(scale_pcs=scale_pcs, n_cc=n_cc)
        if tol <= 0 or max_iter < 1 or not 0 < step_size <= 1 or not 1 <= n_cc <= self.n_pca:
            raise ValueError("n_cc must not exceed the components, tol and max_iter be positive and step_size in (0, 1]")
        me._need("kernel", "pc_scores")
        me._complete()
        rows, status = [], []
        start = me._starts() if len(self.types) > 2 else None
        for sigma, y in sorted(me._operators().items()):
            if sigma_choice is not None and sigma != sigma_choice:
                continue
            try:
                rows += me._weight_rows(sigma, solve.Problem(y, self.types, me._metrics()).solve(n_cc, max_iter, tol, step_size, start))
            except (ValueError, KeyError, StopIteration, np.linalg.LinAlgError) as error:
                status.append((sigma, str(error)))
                warnings.warn(f"sigma {sigma}: {error}", stacklevel=2)
        return me._with(weights=self._spark().createDataFrame(rows, "sigma double, cell_type string, pc int, cc int, w double"), status=tuple(status))

    def run_kernel_cca_supervised(self, supervised: DataFrame, n_cc: int = 4, scale_pcs: bool = True, tol: float = 1e-5, max_iter: int = 500, step_size: float = 1.0) -> Analysis:
        """The first axis is given (cell_type, pc, w); the others are found around it."""
        me = self._with(scale_pcs=scale_pcs, n_cc=n_cc)
        me._need("kernel", "pc_scores")
        me._complete()
        given = {t: np.zeros(self.n_pca) for t in self.types}
        for r in supervised.collect():
            given[r["cell_type"]][r["pc"] - 1] = r["w"]
        metrics = me._metrics()
        first = {t: (v / np.sqrt(v @ (v if metrics is None else metrics[t] * v)))[:, None] for t, v in given.items()}
        rows, status = [], []
        for sigma, y in sorted(me._operators().items()):
            try:
                rows += me._weight_rows(sigma, solve.Problem(y, self.types, metrics).solve(n_cc, max_iter, tol, step_size, first=first))
            except (ValueError, KeyError, StopIteration, np.linalg.LinAlgError) as error:
                status.append((sigma, str(error)))
                warnings.warn(f"sigma {sigma}: {error}", stacklevel=2)
        return me._with(weights=self._spark().createDataFrame(rows, "sigma double, cell_type string, pc int, cc int, w double"), status=tuple(status))

    def _spark(self):
        return self.data.cells.sparkSession

    # ---- association and scores ----------------------------------------------------------------------------------

    def _scores(self) -> DataFrame:
        self._need("weights")
        return materialize(scores.cell_scores(self._pcs(), self.weights), "cell-scores")

    def _sizes(self) -> DataFrame:
        return neighbors.block_sizes(self.data.cells, self.pairs)

    def _norms(self) -> DataFrame:
        return self._norms_of(self.kernel, self.tiles(self.kernel))

    def _norms_of(self, edges: DataFrame, kernel: DataFrame | TiledKernel) -> DataFrame:
        own = self.tiles(self.self_kernel)
        if isinstance(kernel, TiledKernel) and (own is None or isinstance(own, TiledKernel)) and kernel.factors is None and (own is None or own.factors is None):
            return association.block_norms(kernel, self._sizes(), own)
        if isinstance(kernel, TiledKernel) and own is None:
            return association.block_norms(kernel if len(self.types) > 1 else edges, self._sizes())
        return association.block_norms(edges, self._sizes(), self.self_kernel)

    def compute_normalized_correlation(self, calculation_mode: str = "per_slide") -> Analysis:
        found = association.normalized_correlation(self.tiles(self.kernel), self._scores(), self._norms(), calculation_mode)
        found = materialize(found, "association")
        best = association.choose_sigma(found).first()
        return self._with(association=found, sigma_choice=best["sigma"] if best else None)

    def compute_bidir_correlation(self, normalize_K: str = "row_or_col", filter_kernel: bool = True, K_row_sum_cutoff: float = 5e-3, K_col_sum_cutoff: float = 5e-3) -> Analysis:
        return self._with(bidir=association.bidirectional_correlation(self.tiles(self.kernel), self._scores(), normalize_K, filter_kernel, K_row_sum_cutoff, K_col_sum_cutoff))

    def compute_self_bidir_correlation(self, normalize_K: str = "row_or_col", filter_kernel: bool = True, K_row_sum_cutoff: float = 5e-3, K_col_sum_cutoff: float = 5e-3) -> Analysis:
        self._need("self_kernel")
        return self._with(self_bidir=association.bidirectional_correlation(self.tiles(self.self_kernel), self._scores(), normalize_K, filter_kernel, K_row_sum_cutoff, K_col_sum_cutoff))

    def compute_gene_and_cell_scores(self) -> Analysis:
        return self._with(cell_score=self._scores(), gene_score=scores.gene_scores(self.loadings, self.sdev, self.weights, self.scale_pcs))

    def compute_regression_gene_scores(self, sigma: float | None = None) -> Analysis:
        s = self._scores() if sigma is None else self._scores().where(F.col("sigma") == sigma)
        return self._with(regression_score=scores.regression_gene_scores(self.data.expression, s))

    def run_gene_space_cca(self, sigma: float, n_cc: int = 2, **options) -> Analysis:
        weights, cell, _ = genespace.run_gene_space(self.data.expression, self.data.cells, self.types, sigma, n_cc, **options)
        return self._with(gene_space=weights, cell_score=cell, n_cc=n_cc)

    def test_gene_scores(self, sigma: float | None = None, test_type: str = "lmm", covariates: list[str] | None = None, group_var: str = "slide") -> DataFrame:
        self._need("cell_score")
        chosen = sigma or self.sigma_choice
        s = self.cell_score if chosen is None else self.cell_score.where(F.col("sigma") == chosen)
        extra = [c for c in [*(covariates or []), group_var] if c not in s.columns]
        joined = s.join(self.data.cells.select("cell_id", *extra), "cell_id") if extra else s
        return genetest.test_gene_scores(self.data.expression, joined, test_type, covariates, group_var)

    # ---- transfer ------------------------------------------------------------------------------------------------

    def transfer_cell_scores(self, target: CellSet, sigma: float | None = None, use_quantile_normalization: bool = True, weight_threshold: float = 0.0, gene_score_type: str = "PCA", agg_cell_type: bool = False) -> DataFrame:
        """Scores of another set's cells by this one's gene scores of a kind: PCA, gene_space or regression.

        ``agg_cell_type`` returns one row for each cell, (slide, cell_type, cell_id, cc_1, cc_2, ...), instead of one for each component.
        """
        if gene_score_type not in ("PCA", "gene_space", "regression"):
            raise ValueError("gene_score_type must be PCA, gene_space or regression")
        if sorted(self.types) != sorted(target.cell_types):
            raise ValueError(f"cell types differ: {self.types} here, {list(target.cell_types)} in the target")
        source = {"PCA": self.gene_score, "regression": self.regression_score, "gene_space": None if self.gene_space is None else self.gene_space.withColumnRenamed("w", "score")}[gene_score_type]
        if source is None:
            raise ValueError(f"no {gene_score_type} gene scores yet")
        chosen = sigma or self.sigma_choice
        w = source if chosen is None else source.where(F.col("sigma") == chosen)
        out = scores.transfer_scores(self.data.expression, self.data.cells, target.expression, target.cells, w.drop("sigma"), use_quantile_normalization, weight_threshold)
        if not agg_cell_type:
            return out
        axes = sorted(r[0] for r in w.select("cc").distinct().collect())
        return out.groupBy("slide", "cell_type", "cell_id").pivot("cc", axes).agg(F.first("score")).withColumnsRenamed({str(c): f"cc_{c}" for c in axes})

    def transferred_correlation(self, transferred: DataFrame, mode: str = "aggregate", sigma: float | None = None) -> DataFrame:
        """Normalised correlation of transferred scores through this (the target's) kernel."""
        edges, k = (self.kernel, self.tiles(self.kernel)) if sigma is None else (self.kernel.where(F.col("sigma") == sigma), self._at(sigma))
        out = association.normalized_correlation(k, transferred, self._norms_of(edges, k), mode)
        return out.withColumnRenamed("normalized_correlation", "aggregate_correlation") if mode == "aggregate" else out

    def transferred_bidir_correlation(self, transferred: DataFrame, mode: str = "aggregate", **options) -> DataFrame:
        out = association.bidirectional_correlation(self.tiles(self.kernel), transferred, **options)
        return out.groupBy("sigma", "ct_1", "ct_2", "cc").agg(F.avg(F.when(~F.isnan("bidir_correlation"), F.col("bidir_correlation"))).alias("bidir_correlation")) if mode == "aggregate" else out

    # ---- permutation inference -----------------------------------------------------------------------------------

    def _moved(self, which: str) -> list[str]:
        return self.types[:1] if which == "first_only" else self.types[1:] if which == "second_only" and len(self.types) > 1 else self.types

    def _at(self, sigma: float) -> DataFrame | TiledKernel:
        k = self.tiles(self.kernel)
        return k.where(lambda *block: block[0] == sigma) if isinstance(k, TiledKernel) else k.where(F.col("sigma") == sigma)

    def _stacks(self, n: int, method: str, which: str, bins: tuple[int, int] | None, match_quantile: bool, seed: int) -> DataFrame:
        """(slide, cell_type, cell_id, v): each cell's scores, and for the chosen types those of all draws behind them, in one array."""
        if which not in PERMU_WHICH or n < 1:
            raise ValueError(f"permu_which must be one of {PERMU_WHICH} and n_permu positive")
        p, cell, size = self._pcs(), ["slide", "cell_type", "cell_id"], self.n_pca
        values = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "score"))), lambda x: x["score"])
        own = materialize(p.groupBy(*cell).agg(values("pc").alias("v")), "score-rows")
        moves = F.col("cell_type").isin(self._moved(which))
        bx, by = bins or resample.sigma_aware_bins(self.data.cells, self.sigma_choice or self.sigmas[0], self.scale_factor or 0.0)
        if method == "pc":
            drawn = resample.permute_each_component(p.where(moves), n, seed).groupBy("draw", *cell).agg(values("pc").alias("v"))
        else:
            perm = resample.permutations(self.data.cells.where(moves), n, method, bx, by, match_quantile, seed)
            drawn = perm.join(own.select(F.col("cell_id").alias("source_id"), "v"), "source_id").select("draw", *cell, "v")
        listed = drawn.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("draw", "v"))).alias("d"))  # one entry for each draw
        none = F.array_repeat(F.lit(0.0), size)
        some = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.get(F.filter("d", lambda x: x["draw"] == k), F.lit(0))["v"], none))
        rows = F.when(F.size("d") == n, F.transform("d", lambda x: x["v"])).otherwise(some)
        joined = own.join(listed.select(*cell, F.flatten(rows).alias("more")), cell, "left")
        return joined.select(*cell, F.when(F.col("more").isNull(), F.col("v")).otherwise(F.concat("v", "more")).alias("v"))

    def _draw_lines(self, stacks: DataFrame, moved: list[str], n: int, kernel: DataFrame | TiledKernel, bijection: bool) -> DataFrame:
        """(draw, sigma, ct_1, ct_2, line): of each draw, 0 for the scores as they are, every pair's operator and, without ct_2, every type's squares.

        The kernel is applied to all draws at once, a cell's draws in one row.  What no draw changes is multiplied once.
        """
        drawn = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("draw")
        operators = materialize(panels.stack_products(kernel, self.data.cells.where(F.col("cell_type").isin(self.types)), stacks, self.n_pca), "draw-operators")
        changed = F.col("ct_1").isin(moved) | F.col("ct_2").isin(moved)
        operators = operators.where(changed).withColumn("draw", F.col("draw") - 1).select("draw", "sigma", "ct_1", "ct_2", "line").unionByName(operators.where(~changed).select(drawn, "sigma", "ct_1", "ct_2", "line"))
        first = stacks.withColumn("v", F.slice("v", 1, self.n_pca))
        other = F.col("cell_type").isin([] if bijection else moved)
        squares = panels.stack_squares(first.where(~other), self.n_pca).select(drawn, "cell_type", "line")  # no sum over a type's cells changes
        squares = squares.unionByName(panels.stack_squares(stacks.where(other), self.n_pca).select((F.col("draw") - 1).alias("draw"), "cell_type", "line"))
        known = {block[0] for block in kernel.valid()} if isinstance(kernel, TiledKernel) else {r[0] for r in kernel.select("sigma").distinct().collect()}
        sigmas = F.array(*[F.lit(sigma) for sigma in sorted(known)])
        return operators.unionByName(squares.select("draw", F.explode(sigmas).alias("sigma"), F.col("cell_type").alias("ct_1"), F.lit(None).cast("string").alias("ct_2"), "line"))

    def permutation_test(self, n_permu: int = 20, method: str = "bin", which: str = "second_only", bins: tuple[int, int] | None = None, match_quantile: bool = False, conservative: bool = False, all_sigmas: bool = False, conditional: bool = False, max_iter: int = 200, tol: float = 1e-5, seed: int = 1) -> Analysis:
        """Refit on permuted scores: ``null`` has (draw, sigma, ct_1, ct_2, cc, normalized_correlation).

        At the chosen bandwidth, or with ``all_sigmas`` at every one (each draw may then pick its own).  ``conditional``
        fixes the observed earlier axes when it refits a later one.  All draws are one plan, and each draw and bandwidth is
        fitted by a task of its own.  ``tested`` has the observed statistics in the very form of the draws': sums over all
        slides, divided by the mean norm, whatever form ``association`` has.
        """
        self._need("association", "weights")
        if conservative:
            bins, match_quantile, which = bins or (15, 15), True, "second_only"
        used = self.tiles(self.kernel) if all_sigmas or conditional else self._at(self.sigma_choice)
        used = used if isinstance(used, TiledKernel) else materialize(used, "kernel-used")
        stacks = materialize(self._stacks(n_permu, method, which, bins, match_quantile, seed), "stacks")
        norms = {(r["sigma"], r["ct_1"], r["ct_2"]): r["norm"] for r in self._norms().groupBy("sigma", "ct_1", "ct_2").agg(F.avg("norm").alias("norm")).collect()}
        observed = self._observed_weights()
        # of each draw and bandwidth a few numbers for each pair of components
        rows = self._draw_lines(stacks, self._moved(which), n_permu, used, method in BIJECTIONS)
        types, n_pca, n_cc = self.types, self.n_pca, self.n_cc

        def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            draw, sigma = int(key[0]), float(key[1])
            whole = [(a, b, np.array(line, float).reshape(n_pca, n_pca)) for a, b, line in zip(part["ct_1"], part["ct_2"], part["line"], strict=True)]
            own, ops = {a: m for a, b, m in whole if b is None}, {(a, b): m for a, b, m in whole if b is not None}
            columns = ["draw", "sigma", "ct_1", "ct_2", "cc", "normalized_correlation"]
            try:
                if not ops:
                    return pd.DataFrame([], columns=columns)
                if draw == 0:
                    axes = observed[sigma]
                elif conditional:
                    axes = conditional_axes(ops, observed[sigma], types, n_cc, max_iter, tol)
                else:
                    axes = solve.Problem(ops, types).solve(n_cc, max_iter, tol)
            except (ValueError, KeyError, np.linalg.LinAlgError, StopIteration):
                return pd.DataFrame([], columns=columns)
            return pd.DataFrame([(draw, sigma, a, b, cc + 1, _statistic(m, axes[a][:, cc], axes[b][:, cc], own[a], own[b], norms[sigma, a, b])) for (a, b), m in ops.items() for cc in range(n_cc)], columns=columns)

        fitted = materialize(rows.groupBy("draw", "sigma").applyInPandas(fit, "draw int, sigma double, ct_1 string, ct_2 string, cc int, normalized_correlation double"), "null")
        null = fitted.where("draw > 0")
        if failed := n_permu - null.select("draw").distinct().count():
            warnings.warn(f"{failed} draws could not be fitted", stacklevel=2)
        return self._with(null=null, tested=fitted.where("draw = 0").drop("draw"))

    def _observed_weights(self) -> dict[float, solve.Weights]:
        out: dict[float, solve.Weights] = {}
        for r in self.weights.collect():
            out.setdefault(r["sigma"], {t: np.zeros((self.n_pca, self.n_cc)) for t in self.types})[r["cell_type"]][r["pc"] - 1, r["cc"] - 1] = r["w"]
        return out

    def pvalue(self, cc: int = 1, pair: tuple[str, str] | None = None, alternative: str = "greater") -> DataFrame:
        self._need("null", "tested")
        return association.permutation_pvalue(self.tested, self.null, cc, pair, alternative)

    def pvalue_stepdown(self, alpha: float = 0.05) -> DataFrame:
        """(cc, observed, p_raw, p_value, significant) over all axes, each against its own null."""
        self._need("null", "tested")
        null = self.null.groupBy("draw", "cc").agg(F.max("normalized_correlation").alias("v"))
        seen = self.tested.join(self.null.select("sigma").distinct(), "sigma", "left_semi").groupBy("cc").agg(F.max("normalized_correlation").alias("observed"))
        raw = null.join(seen, "cc").groupBy("cc", "observed").agg(((1.0 + F.count_if(F.col("v") >= F.col("observed"))) / (F.count("*") + 1)).alias("p_raw"))
        return association.step_down(raw, alpha)


def conditional_axes(ops: solve.Operators, observed: solve.Weights, types: list[str], n_cc: int, max_iter: int, tol: float) -> solve.Weights:
    """For each axis the best one left after the observed earlier axes are taken out by rank one."""
    out: dict[str, list[np.ndarray]] = {t: [] for t in types}
    left = {pair: m.copy() for pair, m in ops.items()}
    for cc in range(n_cc):
        w = solve.Problem(left, types).solve(1, max_iter, tol)
        for t in types:
            out[t].append(w[t][:, 0])
        for (a, b), m in left.items():
            u, v = observed[a][:, cc], observed[b][:, cc]
            left[a, b] = m - (u @ m @ v) * np.outer(u, v)
    return {t: np.column_stack(v) for t, v in out.items()}


def _statistic(m: np.ndarray, wa: np.ndarray, wb: np.ndarray, xa: np.ndarray, xb: np.ndarray, norm: float) -> float:
    """wa' M wb over the lengths of the scores and the kernel's norm."""
    den = np.sqrt(max(wa @ xa @ wa, 0)) * np.sqrt(max(wb @ xb @ wb, 0)) * norm
    return float(wa @ m @ wb / den) if abs(den) >= 1e-9 else 0.0


def _matrices(df: DataFrame, keys: list[str], p: str, q: str, v: str, size: int) -> dict:
    out: dict = {}
    for key, part in df.toPandas().groupby(keys):
        m = np.zeros((size, size))
        m[part[p].to_numpy() - 1, part[q].to_numpy() - 1] = part[v].to_numpy()
        out[key] = m
    return out
