"""What is refused, dropped with a warning, or chosen by itself."""

import warnings

import numpy as np
import pytest

from covaria.operators import genespace, kernel, neighbors, pca, resample
from covaria.plans.analysis import Analysis
from covaria.sources.cells import create_cell_set

CELLS = "slide string, cell_type string, cell_id long, x double, y double"


def table(spark, n=24, spread=1.0):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([("s", "AB"[k % 2], k, *map(float, spread * rng.uniform(size=2))) for k in range(n)], CELLS)


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(4)
    cells = [(s, t, 100 * i + 20 * j + k, *map(float, rng.uniform(size=2))) for i, s in enumerate("pq") for j, t in enumerate("AB") for k in range(20)]
    values = [(c[2], f"g{g}", float(rng.gamma(2))) for c in cells for g in range(6)]
    made = create_cell_set(spark.createDataFrame(values, "cell_id long, gene string, value double"), spark.createDataFrame(cells, CELLS))
    return Analysis(made).subset_data(["A", "B"]).compute_pca(3).compute_kernel_matrix([0.1, 0.3], check=False).run_kernel_cca(2).compute_normalized_correlation().compute_gene_and_cell_scores()


@pytest.mark.parametrize("options, said", [
    ({"scope": "slide"}, "scope"), ({"normalize_target": 0.0}, "normalize_target"), ({"normalize_target": float("nan")}, "normalize_target"), ({"upper_quantile": 0.0}, "upper_quantile"),
    ({"upper_quantile": 1.5}, "upper_quantile"), ({"method": "fast"}, "method"), ({"dist_type": "Geodesic"}, "dist_type"), ({"scales": (1.0, -1.0, 1.0)}, "scales"), ({"lower_limit": -1.0}, "lower_limit"),
    ({"normalization": "both"}, "normalization"),
])
def test_kernel_arguments(spark, options, said):
    with pytest.raises(ValueError, match=said):
        kernel.compute_kernel(table(spark), [("A", "B")], [0.1], **({"check": False} | options))


@pytest.mark.parametrize("sigmas", [[], [0.0], [-1.0], [float("inf")]])
def test_bandwidths(spark, sigmas):
    with pytest.raises(ValueError, match="sigmas"):
        kernel.gaussian(neighbors.distance_edges(table(spark), [("A", "B")]), sigmas)


def test_blocks_without_support(spark):
    """Narrow kernels are dropped with a warning; nothing left is an error."""
    cells = table(spark)
    with pytest.warns(UserWarning, match="without support dropped"):
        k, _ = kernel.compute_kernel(cells, [("A", "B")], [1e-6, 0.5], normalize_distance=False, truncate=False)
    assert {r[0] for r in k.select("sigma").distinct().collect()} == {0.5}
    with pytest.raises(ValueError, match="support"):
        kernel.compute_kernel(cells, [("A", "B")], [1e-6], normalize_distance=False, truncate=False)


def test_kernel_plan_is_chosen(spark, monkeypatch):
    """All pairs where the kernel is as wide as the cells, else a range join; the values are the same."""
    radii = []
    plain = kernel.distance_edges
    monkeypatch.setattr(kernel, "distance_edges", lambda at, pairs, radius=None: radii.append(radius) or plain(at, pairs, radius))
    cells, options = table(spark, spread=100.0), {"normalize_distance": False, "truncate": False, "check": False, "upper_quantile": 1.0}
    for sigma, near in ((1.0, True), (60.0, False)):
        auto = {(r.i, r.j): r.k for r in kernel.compute_kernel(cells, [("A", "B")], [sigma], **options)[0].collect()}
        assert (radii[-1] is not None) == near
        assert auto == pytest.approx({(r.i, r.j): r.k for r in kernel.compute_kernel(cells, [("A", "B")], [sigma], method="dense", **options)[0].collect()})


def test_targets(spark):
    low = neighbors.low_quantiles(table(spark), [("A", "B")])
    for target in (0.0, -1.0, float("inf")):
        with pytest.raises(ValueError, match="normalize_target"):
            neighbors.scale_factor(low, target)
    assert neighbors.scale_factor(low, 0.01, normalize=False) == 1.0


def test_bins_follow_the_bandwidth(spark):
    cells = spark.createDataFrame([("s", "A", k, 10.0 * (k % 11), 2.0 * (k % 6)) for k in range(66)], CELLS)
    assert resample.sigma_aware_bins(cells, 0.05, 0.01) == (10, 2) and resample.sigma_aware_bins(cells, 0.05, 0.02) == (20, 2)
    assert resample.sigma_aware_bins(cells, 0.0, 1.0) == (10, 10) == resample.sigma_aware_bins(cells, 0.1, float("nan"))


def test_numbers_of_components(spark, run):
    for n in (0, 6, 100):
        with pytest.raises(ValueError, match="n_pca"):
            pca.compute_pca(run.data.expression, run.data.cells, n)


@pytest.mark.parametrize("options", [{"n_cc": 0}, {"n_cc": 9}, {"tol": 0.0}, {"max_iter": 0}, {"step_size": 0.0}, {"step_size": 1.5}])
def test_solver_arguments(run, options):
    with pytest.raises(ValueError):
        run.run_kernel_cca(**options)


def test_permutation_arguments(run):
    for options in ({"which": "third"}, {"n_permu": 0}, {"method": "other"}, {"bins": (1, 5)}):
        with pytest.raises(ValueError):
            run.permutation_test(**options)
    with pytest.raises(ValueError, match="first"):
        Analysis(run.data).permutation_test()


def test_transfer_arguments(spark, run):
    with pytest.raises(ValueError, match="gene_score_type"):
        run.transfer_cell_scores(run.data, gene_score_type="other")
    with pytest.raises(ValueError, match="regression"):
        run.transfer_cell_scores(run.data, gene_score_type="regression")
    with pytest.raises(ValueError, match="types differ"):
        run.transfer_cell_scores(Analysis(run.data).subset_data(["A"]).data)


def test_draws_of_every_kind_are_fitted(run):
    for which in ("first_only", "second_only", "both"):
        for method in ("pc", "global", "bin"):
            null = run.permutation_test(2, method, which, (3, 3)).null.collect()
            assert {r.draw for r in null} == {1, 2} and {r.cc for r in null} == {1, 2}


def test_cells_and_values(spark):
    cells, good = table(spark), [(k, f"g{g}", 1.0) for k in range(24) for g in range(2)]
    make = lambda rows: create_cell_set(spark.createDataFrame(rows, "cell_id long, gene string, value double"), cells)
    make(good)
    for rows, said in (([*good, (3, "g1", 2.0)], "several values"), ([*good, (99, "g1", 2.0)], "location"), ([(0, "g0", 1.0)], "two genes"), ([*good, (1, "g2", float("nan"))], "finite")):
        with pytest.raises(ValueError, match=said):
            make(rows)


def test_slides_that_are_left_out(spark, run):
    few = spark.createDataFrame([("r", "A", 900, 0.0, 0.0), ("r", "B", 901, 0.1, 0.1)], CELLS)
    cells = run.data.cells.select("slide", "cell_type", "cell_id", "x", "y").unionByName(few)
    with pytest.warns(UserWarning, match=r"fewer than 10 cells of a type dropped: \['r'\]"):
        genespace.run_gene_space(run.data.expression, cells, ["A", "B"], 0.3, 1, min_cells=5, check=False)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        genespace.run_gene_space(run.data.expression, run.data.cells, ["A", "B"], 0.3, 1, min_cells=5, check=False)
