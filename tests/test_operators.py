"""Spatial operators against plain NumPy on small tables."""

import importlib
import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.functions.quantiles import exact_quantile
from covaria.operators import genetest, kernel, neighbors, resample, subset
from covaria.sources import cells as sources


def some_cells(spark, n=24, seed=2):
    rng = np.random.default_rng(seed)
    rows = [("s", f"T{k % 2}", k, float(rng.uniform(0, 10)), float(rng.uniform(0, 8))) for k in range(2 * n)]
    rows[2] = ("s", "T0", 2, rows[0][3], rows[0][4])  # a coincident pair
    return spark.createDataFrame(rows, "slide string, cell_type string, cell_id long, x double, y double"), rows


def test_exact_quantile(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=500), "b": np.array([1.0]), "c": np.repeat([0.0, -2.0, 5.0], 40)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "g string, v double")
    for p in (0.0, 1e-3, 0.5, 0.85, 1.0):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", p).collect()}
        assert all(math.isclose(got[k], np.quantile(x, p), rel_tol=1e-12, abs_tol=1e-12) for k, x in data.items())


@pytest.mark.parametrize("radius", [0.3, 1.5])
def test_range_join_is_the_theta_join(spark, radius):
    df, _ = some_cells(spark)
    at = neighbors.scaled(df)
    pairs = [("T0", "T1"), ("T0", "T0")]
    near = {(r.i, r.j, r.ct_2) for r in neighbors.distance_edges(at, pairs, radius).collect()}
    every = {(r.i, r.j, r.ct_2) for r in neighbors.distance_edges(at, pairs).where(F.col("d") <= radius).collect()}
    assert near == every and near
    plan = neighbors.distance_edges(at, pairs, radius)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sparse_kernel_is_the_dense_kernel(spark):
    df, rows = some_cells(spark)
    options = {"check": False, "normalize_target": 0.3}
    dense, f1 = kernel.compute_kernel(df, [("T0", "T0")], [0.1, 0.4], method="dense", **options)
    sparse, f2 = kernel.compute_kernel(df, [("T0", "T0")], [0.1, 0.4], method="sparse", **options)
    a = {(r.sigma, r.i, r.j): r.k for r in dense.collect()}
    b = {(r.sigma, r.i, r.j): r.k for r in sparse.collect()}
    assert f1 == f2 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-14 for k in a)
    x = np.array([r[3:5] for r in rows if r[1] == "T0"])
    ids = [r[2] for r in rows if r[1] == "T0"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    d[d == 0] = d[d > 0].min()
    low = np.quantile(d[np.isfinite(d)], 1e-4)
    d = np.maximum(d, low) * (0.3 / low)
    k = np.exp(-0.5 * (d / 0.4) ** 2)
    k[k < 1e-7] = 0
    k = np.minimum(k, np.quantile(k[k > 0], 0.85))
    assert all(math.isclose(a.get((0.4, i, j), 0.0), k[p, q], abs_tol=1e-12) for p, i in enumerate(ids) for q, j in enumerate(ids))


def test_subset_and_validation(spark):
    df, _ = some_cells(spark)
    ex = spark.createDataFrame([(k, g, 1.0) for k in range(48) for g in ("a", "b")], "cell_id long, gene string, value double")
    made = sources.create_cell_set(ex, df.withColumnRenamed("x", "X"))
    assert subset.subset_data(made, ["T1"]).cells.count() == 24
    with pytest.raises(ValueError):
        subset.subset_data(made, ["T1", "T9"])
    with pytest.raises(ValueError):
        sources.create_cell_set(ex, df.withColumn("x", F.lit(float("nan"))))
    with pytest.raises(ValueError):
        neighbors.scaled(df, "Geodesic")
    assert subset.pairs_of(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")] and subset.pairs_of(["a"]) == [("a", "a")]


def test_split_slides(spark):
    df, _ = some_cells(spark)
    sizes = {r["slide"]: r["count"] for r in sources.split_slides(df, 10).groupBy("slide").count().collect()}
    assert max(sizes.values()) <= 10 and sum(sizes.values()) == 48 and all(s.startswith("s_blk") for s in sizes)
    assert {r["slide"] for r in sources.split_slides(df, 100).select("slide").distinct().collect()} == {"s"}


def test_sinkhorn(spark):
    m = np.array([[1.0, 0.2], [0.3, 2.0]])
    df = spark.createDataFrame([(1.0, "s", "A", "B", i, j, float(m[i, j])) for i in range(2) for j in range(2)], "sigma double, slide string, ct_1 string, ct_2 string, i long, j long, k double")
    got = np.zeros((2, 2))
    for r in kernel.sinkhorn(df).collect():
        got[r.i, r.j] = r.k
    assert np.allclose(got.sum(0), 1, atol=1e-5) and np.allclose(got.sum(1), 1, atol=1e-5)


def test_sinkhorn_of_a_rectangle(spark):
    """Three rows, two columns: the rounds end, and the values are those of scaling rows and columns in turn for long."""
    m = np.array([[1.0, 0.2], [0.3, 2.0], [0.7, 0.7]])
    df = spark.createDataFrame([(1.0, "s", "A", "B", i, j, float(m[i, j])) for i in range(3) for j in range(2)], "sigma double, slide string, ct_1 string, ct_2 string, i long, j long, k double")
    want = m.copy()
    for _ in range(200):
        want = want / want.sum(axis=1, keepdims=True)
        want = want / want.sum(axis=0)
    got = np.zeros((3, 2))
    for r in kernel.sinkhorn(df, tol=1e-10).collect():
        got[r.i, r.j] = r.k
    assert np.allclose(got, want, atol=1e-8) and np.allclose(got.sum(axis=0), 1) and np.allclose(got.sum(axis=1), 2 / 3)


@pytest.mark.parametrize("method", ["global", "toroidal"])
def test_permutations_are_bijections(spark, method):
    df, _ = some_cells(spark)
    got = resample.permutations(df, 2, method).collect()
    for draw in (1, 2):
        part = [r for r in got if r.draw == draw]
        assert {r.cell_id for r in part} == {r.source_id for r in part} == set(range(48))


def test_sources_of_other_forms(spark, tmp_path):
    """A wide table, an annotated matrix (dense, sparse and raw) and catalogues in text formats hold the same data."""
    from types import SimpleNamespace

    import pandas as pd

    matrix = np.array([[0.0, 1.5, 2.0], [3.0, 0.0, 0.5], [1.0, 1.0, 0.0], [0.0, 2.5, 1.0]])
    at = np.array([[0.0, 0.5], [1.0, 1.5], [2.0, 0.0], [3.0, 1.0]])
    want = {(i, f"g{j}", matrix[i, j]) for i in range(4) for j in range(3) if matrix[i, j]}
    wide = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(matrix)], "id long, g0 double, g1 double, g2 double")
    assert {tuple(r) for r in sources.from_wide(wide, "id", ["g0", "g1", "g2"]).collect()} == want
    rows, cols = np.nonzero(matrix)
    sparse = SimpleNamespace(tocoo=lambda: SimpleNamespace(row=rows, col=cols, data=matrix[rows, cols]))
    obs = pd.DataFrame({"kind": ["A", "B", "A", "B"], "batch": ["s1", "s1", "s2", "s2"]})
    raw = SimpleNamespace(var_names=["g0", "g1", "g2"], X=matrix)
    for x, use_raw, layer in ((matrix, False, None), (sparse, False, None), (None, True, None), (None, False, "counts")):
        made = sources.from_annotated(SimpleNamespace(obs=obs, obsm={"spatial": at}, var_names=raw.var_names, X=x, raw=raw, layers={"counts": matrix}), "kind", slide_key="batch", layer=layer, use_raw=use_raw, spark=spark)
        assert {tuple(r) for r in made.expression.select("cell_id", "gene", "value").collect()} == want
        assert {(r.slide, r.cell_type, r.x, r.y) for r in made.cells.collect()} == {(b, t, *p) for b, t, p in zip(obs["batch"], obs["kind"], at.tolist(), strict=True)}
    for kind in ("csv", "json", "orc"):
        made.cells.select("slide", "cell_type", "cell_id", "x", "y").write.format(kind).option("header", True).save(str(tmp_path / kind / "cells") + f".{kind}")
        made.expression.write.format(kind).option("header", True).save(str(tmp_path / kind / "expression") + f".{kind}")
        again = sources.load_dataset(spark, kind, str(tmp_path))
        assert {tuple(r) for r in again.expression.select("cell_id", "gene", "value").collect()} == want and again.cells.count() == 4
    with pytest.raises(ValueError):
        sources.load_dataset(spark, "none", str(tmp_path))


@pytest.mark.parametrize("strip", [2048, 4])
def test_quantile_matched_draws(spark, monkeypatch, strip):
    """Every cell takes from a candidate at most once where there are enough, the nearest free one by quantiles in one strip."""
    monkeypatch.setattr(resample, "STRIP_CELLS", strip)
    rng = np.random.default_rng(8)
    rows = [("s", "T", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1, (40, 2)).round(1))]
    df = spark.createDataFrame(rows, "slide string, cell_type string, cell_id long, x double, y double")
    got = {(r.draw, r.cell_id): r.source_id for r in resample.resample_spatial(df, 2, 2, 2, match_quantile=True).collect()}
    assert set(got) == {(d, k) for d in (1, 2) for k in range(40)}
    if strip < 40:
        return
    tile = {r.cell_id: (r.tx, r.ty) for r in resample.tiles(df, 2, 2).collect()}
    # which tile a tile takes from first shows in what the plain draws of the same seed take
    plain = {(r.draw, r.cell_id): r.source_id for r in resample.resample_spatial(df, 2, 2, 2).collect()}
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) / (len(v) + 1)
    for draw in (1, 2):
        for t in set(tile.values()):
            mine = [k for k in range(40) if tile[k] == t]
            used = {tile[plain[draw, k]] for k in mine} | {tile[got[draw, k]] for k in mine}
            if len(used) > 1 or len(pool := [k for k in range(40) if tile[k] in used]) < len(mine):
                continue
            q = {}
            for ids in (mine, pool):
                x, y = np.array([rows[k][3] for k in ids]), np.array([rows[k][4] for k in ids])
                q[id(ids)] = np.column_stack([mean_rank(x), mean_rank(y)])
            free, want = list(range(len(pool))), []
            for p in q[id(mine)]:
                best = min(free, key=lambda j: (round(((q[id(pool)][j] - p) ** 2).sum(), 12), j))
                free.remove(best)
                want.append(pool[best])
            assert [got[draw, k] for k in mine] == want


def test_gene_tests_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 80
    x, shift = rng.normal(size=n), np.repeat(rng.normal(size=4), n // 4)
    y = 0.5 * x + shift + 0.3 * rng.normal(size=n)
    ex = spark.createDataFrame([(k, "g", float(v)) for k, v in enumerate(x)], "cell_id long, gene string, value double")
    sc = spark.createDataFrame([(f"s{k // 20}", "T", k, 1, float(v)) for k, v in enumerate(y)], "slide string, cell_type string, cell_id long, cc int, score double")
    glm = genetest.test_gene_scores(ex, sc, "glm").first()
    design = np.column_stack([np.ones(n), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert math.isclose(glm.estimate, beta[1], rel_tol=1e-9) and 0 < glm.pvalue < 1e-3 and glm.z_score > 3
    lmm = genetest.test_gene_scores(ex, sc, "lmm").first()
    assert lmm.pvalue < 1e-6
    # restricted likelihood by whole matrices, over a fine grid of the ratio of variances
    groups = np.kron(np.eye(4), np.ones((n // 4, 1)))

    def fit(ratio):
        inverse = np.linalg.inv(np.eye(n) + ratio * groups @ groups.T)
        a = design.T @ inverse @ design
        beta = np.linalg.solve(a, design.T @ inverse @ y)
        rest = y - design @ beta
        s2 = rest @ inverse @ rest / (n - 2)
        return (n - 2) * np.log(s2) - np.linalg.slogdet(inverse)[1] + np.linalg.slogdet(a)[1], beta[1], np.sqrt(s2 * np.linalg.inv(a)[1, 1])

    _, slope, error = min(fit(r) for r in np.logspace(-1, 3, 400))
    assert math.isclose(lmm.estimate, slope, rel_tol=1e-5) and math.isclose(lmm.pvalue, math.erfc(abs(slope / error) / math.sqrt(2)), rel_tol=0.05)


def test_entry_without_training_data_operators(monkeypatch):
    """The optional part may be missing altogether."""
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("covaria.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("covaria.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    importlib.reload(entry)
    assert "kernel_edges" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_gram_of_dense_products_adds_up_over_slides_types_and_string_ids(spark):
    """Against NumPy: two slides, two types of different genes, a cell without values."""
    import numpy as np

    from covaria.operators import pca

    rng = np.random.default_rng(3)
    cells, values, want = [], [], {}
    for ct, genes in (("A", ["a", "b", "c"]), ("B", ["b", "d"])):
        blocks = []
        for slide in ("s1", "s2"):
            x = rng.normal(size=(7, len(genes))) * (rng.random((7, len(genes))) < 0.7)
            x[0] = 0
            x[1] = 1.5
            for i, row in enumerate(x):
                cells.append((slide, ct, f"{ct}{slide}{i}"))
                for g, v in zip(genes, row, strict=True):
                    values += [(f"{ct}{slide}{i}", g, float(v))] if v else []
            blocks.append((x - x.mean(0)) / x.std(0, ddof=1))
        z = np.concatenate(blocks)
        want |= {(ct, a, b): (z.T @ z)[i, j] for i, a in enumerate(genes) for j, b in enumerate(genes) if i <= j}
    cells = spark.createDataFrame(cells, "slide string, cell_type string, cell_id string")
    ex = spark.createDataFrame(values, "cell_id string, gene string, value double")
    got = {(r[0], r[1], r[2]): r[3] for r in pca.gram(ex, cells, pca.gene_moments(ex, cells)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    scores, loadings, _ = pca.compute_pca(ex, cells, 1)
    assert scores.count() == 28 and loadings.count() == 5
    assert scores.where("score IS NULL").count() == 0
