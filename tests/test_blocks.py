"""Blocks of slides by k-means: bounded, compact, and fixed points of Lloyd's rounds."""

import numpy as np
import pytest

from covaria.sources import blocks
from covaria.sources.cells import create_cell_set

SCHEMA = "slide string, cell_id long, cell_type string, x double, y double"


def table(spark, at, slide="s", first=0):
    return spark.createDataFrame([(slide, first + k, "T", float(p[0]), float(p[1])) for k, p in enumerate(at)], SCHEMA)


def within(at, labels):
    u = (at - at.mean(0)) / at.std(0)
    return sum(((u[labels == b] - u[labels == b].mean(0)) ** 2).sum() for b in np.unique(labels))


def plain_kmeans(at, k, rng):
    u = (at - at.mean(0)) / at.std(0)
    best = None
    for _ in range(5):
        centres = u[rng.choice(len(u), k, replace=False)]
        for _ in range(50):
            near = ((u[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            centres = np.array([u[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        best = near if best is None or within(at, near) < within(at, best) else best
    return best


def plain_blocks(at, most, rng):
    """Plain k-means by recursion under the same bound."""
    if len(at) <= most:
        return np.zeros(len(at), int)
    near, out, first = plain_kmeans(at, -(-len(at) // most), rng), np.zeros(len(at), int), 0
    for c in np.unique(near):
        out[near == c] = first + plain_blocks(at[near == c], most, rng)
        first = out[near == c].max() + 1
    return out


def blocks_of(df, *options):
    rows = blocks.split_slides(df, *options).orderBy("cell_id").collect()
    return np.array([r["slide"] for r in rows])


def test_clusters_become_blocks(spark):
    """Four clusters of 40 cells and a bound of 50: Lloyd's answer is the clusters, whatever medians would do."""
    rng = np.random.default_rng(3)
    at = np.concatenate([c + rng.normal(size=(40, 2)) * [0.3, 3] for c in ((0, 0), (9, 10), (0, 95), (10, 60))])
    got = blocks_of(table(spark, at), 50, "kmeans")
    assert [len(set(got[k : k + 40])) for k in range(0, 160, 40)] == [1] * 4 and len(set(got)) == 4
    assert set(got) == {f"s_blk{k}" for k in range(1, 5)}


def test_bounded_and_as_compact_as_plain_kmeans(spark):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(0, 100, (500, 2)), rng.normal(size=(400, 2)) + 50])
    got = blocks_of(table(spark, at), 60, "kmeans")
    names, sizes = np.unique(got, return_counts=True)
    assert sizes.max() <= 60 and sizes.sum() == len(at)
    plain = plain_blocks(at, 60, rng)
    # in two dimensions the squares within blocks fall as their number grows
    assert len(names) <= 2 * -(-len(at) // 60) and within(at, got) * len(names) <= 1.15 * within(at, plain) * len(set(plain))
    assert within(at, got) <= within(at, blocks_of(table(spark, at), 60, "median"))


def test_places_in_common_slides_that_fit_and_refusals(spark):
    """Cells at one place are halved by rank; a small slide keeps its name; other columns stay."""
    same, small = np.full((45, 2), 3.5), np.random.default_rng(1).uniform(size=(7, 2))
    df = table(spark, same, "one").unionByName(table(spark, small, "few", 100))
    got = blocks_of(df, 10, "kmeans")
    names, sizes = np.unique(got[:45], return_counts=True)
    assert sizes.max() <= 10 and all(n.startswith("one_blk") for n in names) and set(got[45:]) == {"few"}
    assert blocks.split_slides(df, 10, "kmeans").columns == df.columns
    assert blocks.split_slides(df.limit(0), 10, "kmeans").count() == 0
    for bad in ((0, "median"), (5, "circles")):
        with pytest.raises(ValueError):
            blocks.split_slides(df, *bad)


def test_more_blocks_than_one_pass_makes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(blocks, "MOST_AT_ONCE", 2)
    at = np.random.default_rng(6).uniform(0, 10, (300, 2))
    sizes = np.unique(blocks_of(table(spark, at), 40, "kmeans"), return_counts=True)[1]
    assert sizes.max() <= 40 and sizes.sum() == 300


def test_create_cell_set_splits(spark):
    df = table(spark, np.random.default_rng(7).uniform(0, 10, (60, 2)))
    expression = df.selectExpr("cell_id", "'a' AS gene", "1.0D AS value").unionByName(df.selectExpr("cell_id", "'b' AS gene", "2.0D AS value"))
    made = create_cell_set(expression, df, max_cell=25, split="kmeans")
    assert all(r["count"] <= 25 for r in made.cells.groupBy("slide").count().collect()) and made.cells.count() == 60


def test_kmeans_of_parts_within_a_task(spark, monkeypatch):
    """Parts that one task can hold are split there to the end: as by passes, in few jobs however many rounds there are."""
    at = np.random.default_rng(8).normal(size=(400, 2))
    df = spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in enumerate(at)], "slide string, cell_id long, x double, y double")
    jobs, found = [], []
    for most in (65_536, 120):
        monkeypatch.setattr(blocks, "IN_TASK", most)
        spark.sparkContext.setJobGroup(f"kmeans-{most}", "")
        by = {}
        for r in blocks.split_slides(df, 20, "kmeans").collect():
            by.setdefault(r.slide, set()).add(r.cell_id)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"kmeans-{most}")))
        found.append(sorted(sorted(x) for x in by.values()))
    assert found[0] == found[1] and max(map(len, found[0])) <= 20 and sum(map(len, found[0])) == 400
    assert jobs[0] < 40 and jobs[0] < jobs[1]
