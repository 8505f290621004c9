"""The analysis chain on two slides and three types, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import genetest, neighbors, pca, resample
from covaria.plans.analysis import Analysis
from covaria.sources.cells import create_cell_set

TYPES, SLIDES, GENES, EACH = ("A", "B", "C"), ("s1", "s2"), 7, 16


def made(spark, types=TYPES, seed=1204):
    rng = np.random.default_rng(seed)
    cells, values = [], []
    loading = {t: rng.normal(size=GENES) for t in types}
    k = 0
    for s in SLIDES:
        for t in types:
            for p in rng.uniform(0, 1, EACH):
                x, y = p, 0.3 * np.sin(2 * np.pi * p) + 0.02 * rng.normal()
                line = np.exp(0.5 + np.sin(2 * np.pi * p) * loading[t] * 0.4 + 0.1 * rng.normal(size=GENES))
                cells.append((s, t, k, float(x), float(y)))
                values += [(k, f"g{g}", float(v)) for g, v in enumerate(line)]
                k += 1
    df = spark.createDataFrame(cells, "slide string, cell_type string, cell_id long, x double, y double")
    ex = spark.createDataFrame(values, "cell_id long, gene string, value double")
    matrix = np.zeros((k, GENES))
    for c, g, v in values:
        matrix[c, int(g[1:])] = v
    return create_cell_set(ex, df), cells, matrix


@pytest.fixture(scope="module")
def run(spark):
    data, cells, matrix = made(spark)
    first = Analysis(data).subset_data(list(TYPES)).compute_pca(3).compute_kernel_matrix([0.05, 0.2], normalize_distance=False, truncate=False)
    return first.run_kernel_cca(n_cc=2).compute_normalized_correlation("aggregate"), cells, matrix


def rows_of(cells, t, s=None):
    return [k for k, c in enumerate(cells) if c[1] == t and s in (None, c[0])]


def standardised(cells, matrix, t):
    out = matrix.copy()
    for s in SLIDES:
        at = rows_of(cells, t, s)
        out[at] = (matrix[at] - matrix[at].mean(0)) / matrix[at].std(0, ddof=1)
    return out[rows_of(cells, t)]


def test_components_against_svd(run):
    analysis, cells, matrix = run
    scores = {(r.cell_id, r.pc): r.score for r in analysis.pc_scores.collect()}
    loadings = {(r.cell_type, r.gene, r.pc): r.loading for r in analysis.loadings.collect()}
    sdev = {(r.cell_type, r.pc): r.sdev for r in analysis.sdev.collect()}
    for t in TYPES:
        z = standardised(cells, matrix, t)
        u, d, vt = np.linalg.svd(z, full_matrices=False)
        for pc in range(3):
            want = u[:, pc] * d[pc]
            sign = np.sign(want[np.argmax(np.abs(want))])
            got = np.array([scores[k, pc + 1] for k in rows_of(cells, t)])
            assert np.allclose(got, sign * want, atol=1e-8)
            assert np.allclose([loadings[t, f"g{g}", pc + 1] for g in range(GENES)], sign * vt[pc], atol=1e-8)
            assert np.isclose(sdev[t, pc + 1], d[pc] / np.sqrt(len(z) - 1), rtol=1e-9)


def test_components_without_a_gram_matrix(spark):
    """Beyond ``most_genes`` components come from block iterations on the packed rows; values are the same."""
    data, cells, matrix = made(spark)
    scores, loadings, sdev = pca.compute_pca(data.expression, data.cells, 2, most_genes=5)
    found = {(r.cell_id, r.pc): r.score for r in scores.collect()}
    spread = {(r.cell_type, r.pc): r.sdev for r in sdev.collect()}
    for t in TYPES:
        z = standardised(cells, matrix, t)
        u, d, _ = np.linalg.svd(z, full_matrices=False)
        for pc in range(2):
            want = u[:, pc] * d[pc]
            want *= np.sign(want[np.argmax(np.abs(want))])
            assert np.allclose([found[k, pc + 1] for k in rows_of(cells, t)], want, atol=1e-7)
            assert np.isclose(spread[t, pc + 1], d[pc] / np.sqrt(len(z) - 1), rtol=1e-9)
    assert loadings.count() == 3 * 2 * GENES


def test_own_scale_factor(spark):
    """Types in two tight clusters far apart: distances within types are normalised on their own."""
    rng = np.random.default_rng(0)
    cells = [("s", t, k * 2 + j, float(100 * j + rng.uniform(0, 1)), float(100 * j + rng.uniform(0, 1))) for k in range(30) for j, t in enumerate(("A", "B"))]
    ex = spark.createDataFrame([(c[2], g, 1.0) for c in cells for g in ("g", "h")], "cell_id long, gene string, value double")
    base = Analysis(create_cell_set(ex, spark.createDataFrame(cells, "slide string, cell_type string, cell_id long, x double, y double"))).subset_data(["A", "B"])
    alone = base.compute_self_distance()
    assert alone.scale_factor == alone.self_scale_factor
    both = base.compute_distance().compute_self_distance()
    assert both.self_scale_factor == alone.self_scale_factor > 10 * both.scale_factor
    x = {t: np.array([c[3:5] for c in cells if c[1] == t]) for t in "AB"}
    d = {t: np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) for t, v in x.items()}
    low = min(np.quantile(m[~np.eye(30, dtype=bool)], neighbors.SELF_LEVEL) for m in d.values())
    assert np.isclose(both.self_scale_factor, 0.01 / low, rtol=1e-12)
    own = both.compute_self_kernel([0.05], check=False).compute_self_kernel([0.1], check=False)
    assert {r.sigma for r in own.self_kernel.select("sigma").distinct().collect()} == {0.05, 0.1}
    assert {r.sigma for r in own.compute_self_kernel([0.2], overwrite=True, check=False).self_kernel.select("sigma").distinct().collect()} == {0.2}
    assert own.scale_factor == both.scale_factor


def test_permutations_over_two_slides(run):
    """The observed statistic and every draw's are formed alike: pooled over slides, at the same bandwidths."""
    analysis, cells, _ = run
    tested = analysis.permutation_test(n_permu=2, method="global", all_sigmas=True, which="second_only", seed=5)
    pooled = {(r.sigma, r.ct_1, r.ct_2, r.cc): r.normalized_correlation for r in analysis.association.collect()}
    seen = {(r.sigma, r.ct_1, r.ct_2, r.cc): r.normalized_correlation for r in tested.tested.collect()}
    assert seen.keys() == pooled.keys() and all(np.isclose(seen[k], pooled[k], atol=1e-9) for k in seen)
    null = tested.null.collect()
    assert {r.draw for r in null} == {1, 2}
    best = [max(r.normalized_correlation for r in null if r.draw == d and r.cc == 1) for d in (1, 2)]
    observed = max(v for k, v in seen.items() if k[3] == 1)
    got = tested.pvalue().first()
    assert np.isclose(got.observed, observed) and np.isclose(got.p_value, (1 + sum(b >= observed for b in best)) / 3)
    # the operators of one draw, from the permutation itself
    pcs = {(r.cell_id, r.pc): r.score for r in analysis._pcs().collect()}
    moved = {(r.draw, r.cell_id): r.source_id for r in resample.permutations(analysis.data.cells.where("cell_type <> 'A'"), 2, "global", seed=5).collect()}
    weights = {}
    kernel = [r for r in analysis.kernel.collect() if r.sigma == 0.2]
    norms = {(r.ct_1, r.ct_2): r.norm for r in analysis._norms().where("sigma = 0.2").groupBy("ct_1", "ct_2").agg(F.avg("norm").alias("norm")).collect()}
    from covaria.functions import solve

    x = {k: np.array([pcs[k, p] for p in (1, 2, 3)]) for k in range(len(cells))}
    at = lambda k: moved.get((1, k), k)
    ops = {}
    for r in kernel:
        ops.setdefault((r.ct_1, r.ct_2), np.zeros((3, 3)))
        ops[r.ct_1, r.ct_2] += r.k * np.outer(x[at(r.i)], x[at(r.j)])
    weights = solve.Problem(ops, list(TYPES)).solve(2, 200, 1e-5)
    for r in null:
        if r.draw == 1 and r.sigma == 0.2:
            a, b = weights[r.ct_1][:, r.cc - 1], weights[r.ct_2][:, r.cc - 1]
            length = lambda t, w: np.sqrt(sum((x[k] @ w) ** 2 for k in rows_of(cells, t)))
            assert np.isclose(r.normalized_correlation, a @ ops[r.ct_1, r.ct_2] @ b / (length(r.ct_1, a) * length(r.ct_2, b) * norms[r.ct_1, r.ct_2]), atol=1e-6)


def test_every_type_on_every_slide(spark):
    data, _, _ = made(spark)
    gone = Analysis(data).subset_data(list(TYPES)).compute_pca(2).compute_kernel_matrix([0.2], normalize_distance=False, truncate=False)
    gone = gone._with(pc_scores=gone.pc_scores.where("NOT (slide = 's2' AND cell_type = 'B')"))
    with pytest.raises(ValueError, match="'B' on slide 's2'"):
        gone.run_kernel_cca()


def test_scores_transfer_and_tables(run, spark):
    analysis, cells, matrix = run
    scored = analysis.compute_gene_and_cell_scores().compute_regression_gene_scores()
    gene = {(r.cell_type, r.gene, r.cc): r.score for r in scored.gene_score.where(F.col("sigma") == scored.sigma_choice).collect()}
    cell = {(r.cell_id, r.cc): r.score for r in scored.cell_score.where(F.col("sigma") == scored.sigma_choice).collect()}
    for t in TYPES:  # gene scores applied to the standardised data are the cell scores
        w = np.array([gene[t, f"g{g}", 1] for g in range(GENES)])
        assert np.allclose(standardised(cells, matrix, t) @ w, [cell[k, 1] for k in rows_of(cells, t)], atol=1e-7)
    other = Analysis(made(spark, seed=9)[0]).subset_data(list(TYPES)).data
    wide = scored.transfer_cell_scores(other, agg_cell_type=True)
    assert wide.columns == ["slide", "cell_type", "cell_id", "cc_1", "cc_2"] and wide.count() == len(cells)
    with pytest.raises(ValueError, match="differ"):
        scored.transfer_cell_scores(Analysis(other).subset_data(["A", "B"]).data)
    tests = scored.test_gene_scores(test_type="glm")
    assert tests.count() == len(TYPES) * 2 * GENES and tests.where("z_score IS NULL OR isnan(z_score)").count() == 0
    bidir = scored.compute_bidir_correlation().bidir.collect()
    assert {(r.sigma, r.slide, r.ct_1, r.ct_2, r.cc) for r in bidir} == {(s, sl, a, b, c) for s in scored.sigmas for sl in SLIDES for a, b in scored.pairs for c in (1, 2)}
    assert all(-1 <= r.bidir_correlation <= 1 for r in bidir)


def test_zero_p_values_take_the_smallest(spark):
    """A perfect fit has a p-value of zero; its score is that of the smallest positive one."""
    rng = np.random.default_rng(3)
    y = rng.normal(size=40)
    noisy = {"near": y + 0.01 * rng.normal(size=40), "exact": y, "none": rng.normal(size=40)}
    ex = spark.createDataFrame([(k, g, float(v)) for g, line in noisy.items() for k, v in enumerate(line)], "cell_id long, gene string, value double")
    sc = spark.createDataFrame([("s", "T", k, 1, float(v)) for k, v in enumerate(y)], "slide string, cell_type string, cell_id long, cc int, score double")
    got = {r.gene: r for r in genetest.test_gene_scores(ex, sc, "glm").collect()}
    assert np.isfinite(got["exact"].z_score) and got["exact"].z_score >= got["near"].z_score > 10
    design = np.column_stack([np.ones(40), noisy["none"]])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    t = abs(beta[1]) / np.sqrt(rss[0] / 38 * np.linalg.inv(design.T @ design)[1, 1])
    grid = np.linspace(t, 400, 4_000_001)
    density = (1 + grid**2 / 38) ** (-39 / 2)
    whole = np.linspace(0, 400, 4_000_001)
    p = np.trapezoid(density, grid) / np.trapezoid((1 + whole**2 / 38) ** (-39 / 2), whole)
    assert np.isclose(got["none"].pvalue, p, rtol=1e-4)


def test_gene_space_without_covariances(spark):
    """Both ways of solving agree, cells of small slides have null scores, and each slide may have its own scale."""
    from covaria.operators import genespace

    data, cells, _ = made(spark, ("A", "B"))
    extra = spark.createDataFrame([("s3", "A", 900, 0.0, 0.0), ("s3", "B", 901, 0.1, 0.0)], data.cells.select("slide", "cell_type", "cell_id", "x", "y").schema)
    every = data.cells.select("slide", "cell_type", "cell_id", "x", "y").unionByName(extra)
    options = {"normalizationScope": "per_slide", "minAveCellNeighor": 0.1, "lowerLimit": 1e-7, "x_dist_scale": 1.0}
    one = genespace.run_gene_space(data.expression, every, ["A", "B"], 0.2, 1, tol=1e-8, min_cells=5, **options)
    two = genespace.run_gene_space(data.expression, every, ["A", "B"], 0.2, 1, tol=1e-8, max_iter=60, min_cells=5, most_genes=3, **options)
    a, b = ({(r.cell_type, r.gene): r.w for r in x[0].collect()} for x in (one, two))
    assert a.keys() == b.keys() and abs(sum(a[k] * b[k] for k in a)) > 2 * 0.99
    assert np.isclose(one[2].first().objective, two[2].first().objective, rtol=1e-6)
    nulls = [r.cell_id for r in one[1].where("score IS NULL").collect()]
    assert sorted(nulls) == [900, 901] and one[1].count() == len(cells) + 2
    with pytest.raises(ValueError, match="unsupported"):
        genespace.as_options(knn_k=11)
    assert genespace.as_options(rowNormalizeKernel=True, distType="Euclidean3D", knn_k=10) == {"normalization": "row", "dist_type": "Euclidean3D"}


@pytest.mark.parametrize("columns", [2, 50])
def test_leading_vectors_with_restarts(monkeypatch, columns):
    """A slowly falling spectrum: the same values and vectors with and without restarts, the basis within its bound; an error if the rounds don't do."""
    monkeypatch.setattr(pca, "COLUMNS", columns)
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = 1 / np.arange(1, 401) ** 0.7
    g, widest = (q * values) @ q.T, []

    def times(v):
        widest.append(v["t"].shape[1])
        return {"t": g @ v["t"]}

    found, vectors = pca.leading(times, {"t": 400}, 8)["t"]
    assert np.allclose(found, values[:8], rtol=1e-9) and np.allclose(np.abs((vectors * q[:, :8]).sum(axis=0)), 1, atol=1e-7) and max(widest) <= 18
    monkeypatch.setattr(pca, "ROUNDS", 3)
    with pytest.raises(ValueError, match="converge"):
        pca.leading(times, {"t": 400}, 8)


def test_components_of_cells_without_values(spark):
    """A cell without any value, values of cells that aren't asked for, and rows of a cell that lie apart."""
    rng = np.random.default_rng(2)
    matrix = rng.poisson(1.0, size=(40, 6)).astype(float)
    matrix[7] = 0
    long = [(k, f"g{g}", float(matrix[k, g])) for g in range(6) for k in range(40) if matrix[k, g]] + [(99, "g1", 5.0)]
    cells = spark.createDataFrame([("s", "T", k) for k in range(40)], "slide string, cell_type string, cell_id long")
    scores, _, sdev = pca.compute_pca(spark.createDataFrame(long, "cell_id long, gene string, value double").repartition(5), cells, 3)
    z = (matrix - matrix.mean(axis=0)) / matrix.std(axis=0, ddof=1)
    u, d, _ = np.linalg.svd(z, full_matrices=False)
    got = {(r.cell_id, r.pc): r.score for r in scores.collect()}
    assert len(got) == 120 and np.allclose([abs(got[k, 1]) for k in range(40)], np.abs(u[:, 0] * d[0]), atol=1e-8)
    assert np.allclose([r.sdev for r in sorted(sdev.collect(), key=lambda r: r.pc)], d[:3] / np.sqrt(39), rtol=1e-9)
