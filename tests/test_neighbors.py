"""The range join on crowded slides: the same pairs as brute force, and no key that gathers many cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.operators import neighbors

SCHEMA = "slide string, cell_type string, cell_id long, x double, y double, z double"


def crowded_cells(spark, n=600, seed=5):
    """Half of all cells in a small spot, some of them at one place, the others spread on both sides of zero; a second slide with few."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(-6, 6, (n, 3))
    at[: n // 2] = 0.3 + 0.2 * rng.uniform(0, 1, (n // 2, 3))
    at[: n // 8] = at[0]
    rows = [("a" if k % 5 else "b", f"T{int(k % 7 == 0)}", k, *map(float, p)) for k, p in enumerate(at)]
    return spark.createDataFrame(rows, SCHEMA), rows


def by_brute_force(rows, pairs, radius, axes):
    slide, kind, ids = (np.array([r[k] for r in rows]) for k in range(3))
    at = np.array([r[3 : 3 + axes] for r in rows])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    found = {}
    for a, b in pairs:
        keep = (slide[:, None] == slide[None]) & (kind[:, None] == a) & (kind[None] == b) & (d <= radius) & (ids[:, None] != ids[None])
        found |= {(slide[i], a, b, int(ids[i]), int(ids[j])): d[i, j] for i, j in zip(*np.nonzero(keep), strict=True)}
    return found


@pytest.mark.parametrize(("dist_type", "radius", "crowd"), [("Euclidean2D", 0.7, 20), ("Euclidean2D", 0.05, 7), ("Euclidean3D", 1.1, 20), ("Euclidean2D", 0.7, 1024), ("Euclidean2D", 50.0, 25)])
def test_crowded_range_join_is_brute_force(spark, dist_type, radius, crowd):
    df, rows = crowded_cells(spark)
    pairs = [("T0", "T1"), ("T0", "T0"), ("T1", "T0")]
    got = neighbors.distance_edges(neighbors.scaled(df, dist_type), pairs, radius, crowd).collect()
    want = by_brute_force(rows, pairs, radius, 3 if dist_type.endswith("3D") else 2)
    assert len(got) == len(want) > 500
    assert {tuple(r)[:5] for r in got} == want.keys()
    assert all(abs(r.d - want[tuple(r)[:5]]) < 1e-12 for r in got)


def test_all_pairs_of_large_blocks(spark):
    df, rows = crowded_cells(spark, 300)
    pairs = [("T0", "T1"), ("T0", "T0")]
    got = neighbors.distance_edges(neighbors.scaled(df), pairs, None, 16).collect()
    want = by_brute_force(rows, pairs, np.inf, 2)
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want.keys()


@pytest.mark.parametrize("share", [0.5, 0.02])
def test_no_key_gathers_many_cells(spark, share):
    """A spot with half the cells of the left type, and one with most cells of the right type and few of the left."""
    n, crowd = 20_000, 256
    x = lambda c: F.when(F.rand(c) < (share if c < 10 else 0.5), F.rand(c + 20) * 0.9).otherwise(F.rand(c + 40) * 100)
    made = [spark.range(n).select(F.lit("s").alias("slide"), F.lit(t).alias("cell_type"), (F.col("id") * 2 + k).alias("cell_id"), x(1 + 10 * k).alias("x"), x(1 + 10 * k).alias("y")) for k, t in enumerate(("T0", "T1"))]
    cells = neighbors.materialize(made[0].unionByName(made[1]), "cells")
    left, right, axes = neighbors._sides(cells, [("T0", "T1")])
    left, right, keys = neighbors._dealt_squares(left, right, axes, 1.0, crowd)
    most = [side.groupBy(*keys).count().agg(F.max("count")).first()[0] for side in (left, right)]
    assert max(most) <= 1.5 * crowd, most  # chunks by hash are about equal
    # copies stay few: each row of a spot meets the other side's parts, not its rows
    assert left.count() < 60 * n and right.count() < 9 * 60 * n


def test_radius_is_checked(spark):
    df, _ = crowded_cells(spark, 20)
    for radius in (0.0, -1.0, float("inf"), float("nan")):
        with pytest.raises(ValueError, match="radius"):
            neighbors.distance_edges(neighbors.scaled(df), [("T0", "T1")], radius)


def test_empty_cells(spark):
    none = neighbors.scaled(spark.createDataFrame([], SCHEMA))
    assert neighbors.distance_edges(none, [("T0", "T1"), ("T0", "T0")], 1.0).count() == 0
    assert neighbors.distance_edges(none, [("T0", "T1")]).count() == 0


def test_totals_of_all_pairs_make_no_rows_of_pairs(spark, monkeypatch):
    """Number, smallest and sum of all distances, raw and conditioned, are those of the pairs one by one, of which none is a row."""
    df, rows = crowded_cells(spark, 900)
    df = df.unionByName(spark.createDataFrame([("b", t, 10_000 + k, 1.0, 1.0, 1.0) for k, t in enumerate(("P", "P", "Q"))], SCHEMA))
    pairs, keys = [("T0", "T1"), ("T0", "T0"), ("P", "Q")], ["slide", "ct_1", "ct_2"]
    add = lambda edges: edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("d").alias("least"), F.sum("d").alias("total"))
    flat = neighbors.scaled(df)
    want = [add(neighbors.distance_edges(neighbors.scaled(df, axes, (1.0, 2.0, 0.5)), pairs)).orderBy(*keys).collect() for axes in neighbors.AXES]
    want += [add(neighbors.compute_distance(df, pairs, truncate=truncate)).orderBy(*keys).collect() for truncate in (True, False)]
    low = neighbors.low_quantiles(flat, pairs)
    monkeypatch.setattr(neighbors, "low_quantiles", lambda *_: low)
    monkeypatch.setattr(neighbors, "distance_edges", None)
    got = [neighbors.distance_totals(neighbors.scaled(df, axes, (1.0, 2.0, 0.5)), pairs).orderBy(*keys).collect() for axes in neighbors.AXES]
    got += [neighbors.compute_distance_totals(df, pairs, truncate=truncate).orderBy(*keys).collect() for truncate in (True, False)]
    for a, b in zip(got, want, strict=True):
        assert [r[:4] for r in a] == [r[:4] for r in b] and len(a) == 5
        assert [r[4:] for r in a] == [pytest.approx(r[4:], rel=1e-12) if r["total"] is not None else r[4:] for r in b]
    assert any(r["total"] is None for r in got[2]) and any(r["least"] == 0 for r in got[0])
