"""Ranks by ranges, products through a kernel, and what gene space and permutations make of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.functions import ranks
from covaria.operators import genespace, panels


@pytest.mark.parametrize("most", [200_000, 0])
def test_rank_in_a_hot_group(spark, monkeypatch, most):
    """Two thirds of all rows in one group, null keys, equal values; runs broadcast or not."""
    monkeypatch.setattr(ranks, "BROADCAST_RUNS", most)
    rng = np.random.default_rng(1)
    data = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", int(rng.integers(40)), k) for k in range(3000)]
    df = spark.createDataFrame(data, "range string, v int, line int")
    got = ranks.with_rank(df, ["range"], ["v", "line"], "place", "of").collect()
    want = {}
    for g in {d[0] for d in data}:
        members = sorted((v, k) for x, v, k in data if x == g)
        want |= {k: (i, len(members)) for i, (_, k) in enumerate(members)}
    assert {r.line: (r.place, r.of) for r in got} == want and got[0].__fields__ == ["range", "v", "line", "place", "of"]
    assert ranks.with_rank(df.limit(0), ["range"], ["v"]).count() == 0


def slides(seed=3, n=150, genes=7):
    """Cells of three types on two slides, sparse values, kernel edges of two bandwidths, and all of it as matrices."""
    rng = np.random.default_rng(seed)
    cells, x, edges = [], {}, []
    for s in ("p", "q"):
        for t in "ABC":
            for _ in range(int(rng.integers(n // 2, n))):
                cells.append((s, t, len(cells), *map(float, rng.uniform(size=2))))
    values = rng.gamma(2, size=(len(cells), genes)) * (rng.uniform(size=(len(cells), genes)) < 0.4)
    values[:, -1] = 2.5  # a constant gene
    x = [(c[2], f"g{g}", float(v)) for c, line in zip(cells, values, strict=True) for g, v in enumerate(line) if v]
    k = {}
    for a in cells:
        for b in cells:
            if a[0] == b[0] and a[1] < b[1]:
                d = np.hypot(a[3] - b[3], a[4] - b[4])
                for sigma in (0.05, 0.1):
                    if d < 2 * sigma:
                        k[sigma, a[2], b[2]] = float(np.exp(-((d / sigma) ** 2) / 2))
                        edges.append((sigma, a[0], a[1], b[1], a[2], b[2], k[sigma, a[2], b[2]]))
    return cells, values, x, edges, k


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(panels, "TILE_CELLS", 16)
    monkeypatch.setattr(panels, "BAND_CELLS", 32)


def tables(spark, cells, x, edges):
    return (
        spark.createDataFrame(cells, "slide string, cell_type string, cell_id long, x double, y double"), spark.createDataFrame(x, "cell_id long, gene string, value double"),
        spark.createDataFrame(edges, "sigma double, slide string, ct_1 string, ct_2 string, i long, j long, k double"),
    )


def test_covariances_against_numpy(spark, small_tiles):
    cells, values, x, edges, k = slides()
    cell_table, expression, kernel = tables(spark, cells, x, edges)
    z = {}
    for s in "pq":
        for t in "ABC":
            rows = [c[2] for c in cells if c[:2] == (s, t)]
            sd = values[rows].std(axis=0, ddof=1)
            z[s, t] = rows, np.where(sd > 1e-9, (values[rows] - values[rows].mean(axis=0)) / np.where(sd > 1e-9, sd, 1), 0)
    own = {(r.slide, r.cell_type, r.gene_1, r.gene_2): r.c for r in genespace.self_covariances(expression, cell_table, expression).collect()}
    assert len(own) == 6 * 28
    for (s, t, a, b), c in own.items():
        m = z[s, t][1]
        assert np.isclose(c, m[:, int(a[1:])] @ m[:, int(b[1:])] / len(m), atol=1e-10)
    cross = genespace.cross_covariances(kernel, expression, cell_table, expression).collect()
    assert len(cross) == 2 * 6 * 49
    whole = {}
    for r in cross:
        key = r.sigma, r.slide, r.ct_1, r.ct_2
        if key not in whole:
            (ra, za), (rb, zb) = z[r.slide, r.ct_1], z[r.slide, r.ct_2]
            m = np.array([[k.get((r.sigma, i, j), 0.0) for j in rb] for i in ra])
            whole[key] = za.T @ m @ zb / np.sqrt(len(ra) * len(rb))
        assert np.isclose(r.c, whole[key][int(r.gene_1[1:]), int(r.gene_2[1:])], atol=1e-10)


def test_stacks_against_numpy(spark, small_tiles):
    """Some types with draws, one without; sums over slides."""
    cells, _, x, edges, k = slides(n=60)
    cell_table, _, kernel = tables(spark, cells, x, edges)
    rng = np.random.default_rng(8)
    v = {c[2]: rng.normal(size=2 if c[1] == "B" else 8) for c in cells}
    stacks = spark.createDataFrame([(*c[:3], v[c[2]].tolist()) for c in cells], "slide string, cell_type string, cell_id long, v array<double>")
    got = panels.stack_products(kernel, cell_table, stacks, 2).collect()
    assert {(r.sigma, r.ct_1, r.ct_2, r.draw) for r in got} == {(s, a, b, d) for s in (0.05, 0.1) for a, b in ("AB", "AC", "BC") for d in (1, 2, 3, 4)}
    of = {c[2]: c for c in cells}
    at = lambda i, d: v[i][:2] if len(v[i]) == 2 else v[i][2 * d - 2 : 2 * d]
    for r in got:
        want = sum(w * np.outer(at(i, r.draw), at(j, r.draw)) for (s, i, j), w in k.items() if s == r.sigma and (of[i][1], of[j][1]) == (r.ct_1, r.ct_2))
        assert np.allclose(np.reshape(r.line, (2, 2)), want)
    for r in panels.stack_squares(stacks, 2).collect():
        m = np.array([at(c[2], r.draw) for c in cells if c[1] == r.cell_type])
        assert np.allclose(np.reshape(r.line, (2, 2)), m.T @ m)


def test_tiles_bound_what_is_shuffled(spark, small_tiles):
    """Rows that are moved: edges once, and a packed row once for each tile near it, whatever the number of columns."""
    cells, _, x, edges, _ = slides(n=120)
    cell_table, expression, kernel = tables(spark, cells, x, edges)
    numbers, names = genespace.gene_numbers(expression)
    dealt, _, _ = panels._tiled(kernel, panels.places(cell_table), genespace.packed_cells(expression, cell_table, numbers, len(names)))
    counts = {r.kind: r["count"] for r in dealt.groupBy("kind").count().collect()}
    place = {r.cell_id: r.place for r in panels.places(cell_table).collect()}
    assert counts[1] == len(edges) and counts[0] == len({(e[1], e[2], e[3], e[4], place[e[5]] // 16) for e in edges}) and counts[2] == len({e[2:4] + e[5:6] for e in edges})
    assert dealt.where(F.col("kind") == 0).groupBy("b", "tile", "band").count().agg(F.max("count")).first()[0] <= 32


@pytest.mark.parametrize("run", [32, 3])
def test_quantile_map_of_sparse_values(spark, monkeypatch, run):
    """Zeros that nobody writes, negative values, many ties, a gene without values, one cell: as ranks over all cells say."""
    from covaria.operators import scores

    monkeypatch.setattr(scores, "PLACES_AT_ONCE", run)
    rng = np.random.default_rng(2)
    a = {"counts": rng.poisson(0.6, 300).astype(float), "signed": np.round(rng.normal(size=300), 1) * (rng.uniform(size=300) < 0.5), "full": rng.normal(size=300), "none": np.zeros(300), "single": np.array([4.0])}
    b = {"counts": rng.poisson(0.9, 170).astype(float), "signed": np.round(rng.normal(size=170), 1) * (rng.uniform(size=170) < 0.7), "full": rng.normal(size=170), "none": rng.poisson(1, 170).astype(float), "single": np.array([1.0, 0.0])}
    table = lambda x: spark.createDataFrame([(g, k, float(v)) for g, line in x.items() for k, v in enumerate(line)], "gene string, cell_id long, value double")
    got = {(r.gene, r.cell_id): r.value for r in scores.quantile_normalize(table(a), table(b)).collect()}
    assert len(got) == sum(map(len, b.values()))
    for g, line in b.items():
        ranks_ = np.array([(line < v).sum() for v in line]) / max(len(line) - 1, 1)
        want = np.interp(ranks_, np.linspace(0, 1, len(a[g])), np.sort(a[g])) if len(a[g]) > 1 else np.full(len(line), a[g][0])
        assert np.allclose([got[g, k] for k in range(len(line))], want, atol=1e-9)


def test_transfer_values_against_numpy(spark):
    from covaria.operators import scores

    rng = np.random.default_rng(4)
    parts = {}
    for name, n in (("ref", 80), ("tar", 50)):
        v = rng.gamma(2, size=(n, 4)) * (rng.uniform(size=(n, 4)) < 0.5)
        cells = [("s", "AB"[k % 2], k) for k in range(n)]
        parts[name] = v, cells, spark.createDataFrame([(k, f"g{g}", float(v[k, g])) for k in range(n) for g in range(4) if v[k, g]] + ([(0, "only", 1.0)] if name == "ref" else []), "cell_id long, gene string, value double"), spark.createDataFrame(cells, "slide string, cell_type string, cell_id long")
    w = {("A", 0): 1.0, ("A", 2): -2.0, ("B", 1): 0.5, ("B", 3): 0.01}
    weights = spark.createDataFrame([(0.1, t, f"g{g}", 1, x) for (t, g), x in w.items()] + [(0.1, "A", "only", 1, 9.0)], "sigma double, cell_type string, gene string, cc int, score double")
    for normal in (True, False):
        out = scores.transfer_scores(parts["ref"][2], parts["ref"][3], parts["tar"][2], parts["tar"][3], weights, normal, 0.1)
        got = {r.cell_id: r.score for r in out.collect()}
        assert out.columns == ["sigma", "slide", "cell_type", "cell_id", "cc", "score"] and len(got) == 50
        for t, first in (("A", 0), ("B", 1)):
            a, b = parts["ref"][0][first::2], parts["tar"][0][first::2]
            want = np.zeros(len(b))
            for (kind, g), x in w.items():
                if kind == t and abs(x) >= 0.1:
                    share = np.array([(b[:, g] < v).sum() for v in b[:, g]]) / (len(b) - 1)
                    moved = np.interp(share, np.linspace(0, 1, len(a)), np.sort(a[:, g])) if normal else b[:, g]
                    want += x * (moved - a[:, g].mean()) / a[:, g].std(ddof=1)
            assert np.allclose([got[k] for k in range(first, 50, 2)], want, atol=1e-9)


def test_quantile_of_a_tie(spark):
    """Three million equal values, and some others: the values that are ranked are the distinct ones."""
    from covaria.functions.quantiles import exact_quantile

    df = spark.range(3_000_000, numPartitions=8).select(F.lit("g").alias("g"), F.when(F.col("id") % 100 == 0, F.col("id") / 3e6).otherwise(F.lit(0.5)).alias("v"))
    v = np.where(np.arange(3_000_000) % 100 == 0, np.arange(3_000_000) / 3e6, 0.5)
    for p in (0.001, 0.4, 0.995):
        assert np.isclose(exact_quantile(df, ["g"], "v", p).first().quantile, np.quantile(v, p), rtol=1e-12)


def test_whitened_norms_against_numpy(spark):
    """Own kernels that aren't symmetric, cells without edges, a block without own kernels, cells beyond the edges."""
    from covaria.operators.association import block_norms

    rng = np.random.default_rng(6)
    n = {"A": 9, "B": 7, "C": 5}
    base = {"A": 0, "B": 20, "C": 40}
    mats, rows = {}, []
    for a, b in ("AA", "BB", "AB", "AC"):
        m = rng.uniform(size=(n[a], n[b])) * (rng.uniform(size=(n[a], n[b])) < 0.5)
        m[-1] = 0
        if a == b:
            np.fill_diagonal(m, 0)
        mats[a, b] = m
        rows += [(0.1, "s", a, b, base[a] + i, base[b] + j, float(m[i, j])) for i in range(n[a]) for j in range(n[b]) if m[i, j]]
    ddl = "sigma double, slide string, ct_1 string, ct_2 string, i long, j long, k double"
    every = spark.createDataFrame(rows, ddl)
    sizes = spark.createDataFrame([("s", a, b, n[a], n[b]) for a, b in ("AB", "AC")], "slide string, ct_1 string, ct_2 string, n_1 long, n_2 long")
    got = {(r.ct_1, r.ct_2): r.norm for r in block_norms(every.where("ct_1 <> ct_2"), sizes, every.where("ct_1 = ct_2")).collect()}
    centre = lambda m: m - m.mean(axis=1, keepdims=True) - m.mean(axis=0) + m.mean()
    half = lambda m: (m + m.T) / 2
    kc = centre(mats["A", "B"])
    assert np.isclose(got["A", "B"], np.sqrt((half(mats["A", "A"]) @ kc @ half(mats["B", "B"]) * kc).sum())) and np.isclose(got["A", "C"], np.linalg.norm(centre(mats["A", "C"])))


@pytest.mark.parametrize("block, n", [(1 << 16, 400), (16, 400), (16, 1), (7, 120)])
def test_kendall_against_all_pairs(spark, block, n):
    """Many ties in both, nulls, one row; in one block and in many levels of blocks."""
    from covaria.plans import report

    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 30, n), rng.integers(0, 25, n)
    y = np.where(rng.uniform(size=n) < 0.5, x, y)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1), (2, None)], "a int, b int")
    got = report.kendall_tau(df, "a", "b", block).first().tau
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    want = (dx * dy).sum() / np.sqrt(np.abs(dx).sum() * np.abs(dy).sum()) if n > 1 else None
    assert got == want if want is None else np.isclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("kind", ["even", "crowded", "stacked", "line"])
def test_one_radius_sees_the_low_quantile(spark, monkeypatch, kind):
    """Even, clustered, coincident and collinear cells: one range join, and the order statistics of all pairs."""
    from covaria.operators import neighbors

    rng = np.random.default_rng(5)
    x = rng.uniform(size=(300, 2))
    if kind == "crowded":
        x[:200] = 0.3 + 1e-4 * rng.uniform(size=(200, 2))
    if kind == "stacked":
        x[:280] = x[0]
    if kind == "line":
        x[:, 1] = 2.0
    cells = spark.createDataFrame([("s", "AB"[k % 2], k, *map(float, p)) for k, p in enumerate(x)], "slide string, cell_type string, cell_id long, x double, y double")
    joins = []
    plain = neighbors.distance_edges
    monkeypatch.setattr(neighbors, "distance_edges", lambda *a: joins.append(a[2]) or plain(*a))
    got = {(r.ct_1, r.ct_2): r for r in neighbors.low_quantiles(cells, [("A", "B"), ("A", "A")]).collect()}
    assert len(joins) == 1 and (kind == "stacked" or joins[0] is not None)
    a, b = x[::2], x[1::2]
    for (one, two, own) in ((a, b, False), (a, a, True)):
        d = np.hypot(one[:, None, 0] - two[None, :, 0], one[:, None, 1] - two[None, :, 1])
        d = d[~np.eye(len(a), dtype=bool)] if own else d.ravel()
        least = d[d > 0].min()
        r = got["A", "A" if own else "B"]
        assert np.isclose(r.least, least) and np.isclose(r.low, np.quantile(np.where(d == 0, least, d), r.level), rtol=1e-9)
