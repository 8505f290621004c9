"""Gene-space analysis of several slides: standardised blocks and their covariances."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions import solve
from covaria.operators.dense import dense_rows, one_block_at_once, product_lines
from covaria.operators.kernel import compute_kernel, tiled_kernel
from covaria.operators.panels import kernel_products
from covaria.operators.scores import dense
from covaria.operators.tiled import TiledKernel
from covaria.operators.subset import clip_values, pairs_of, prevalent_genes, sufficient_slides, warn_dropped
from covaria.sources.store import materialize

#: Covariances of all slides, types and pairs that reach the driver at most; beyond that no covariance is formed.
DRIVER_BYTES = 512 << 20
MOST_GENES = 3000
# Options by their other names that no change of case explains, and values that stand for options this engine has not.
_SCALES = ("x_dist_scale", "y_dist_scale", "z_dist_scale")
_ONLY_DEFAULTS = {"knn_k": 10, "geodesic_threshold": 10, "geodesic_cutoff": 7}


def as_options(**options) -> dict:
    """Options of distances and kernels, in snake or camel case, as compute_kernel() names them."""
    named = {re.sub(r"(?<=[a-z])(?=[A-Z])", "_", k).lower().replace("neighor", "neighbor"): v for k, v in options.items()}
    out = {k: named.pop(k) for k in ("dist_type", "normalize_distance", "normalize_target", "lower_limit", "upper_quantile", "min_ave_cell_neighbor", "method", "skip_few", "check", "scales", "truncate", "normalization", "factor", "scope") if k in named}
    if any(k in named for k in _SCALES):
        out["scales"] = tuple(float(named.pop(k, 1.0)) for k in _SCALES)
    if "normalization_scope" in named:
        out["scope"] = named.pop("normalization_scope")
    if "truncate_low_dist" in named:
        out["truncate"] = named.pop("truncate_low_dist")
    chosen = [how for how, k in (("row", "row_normalize_kernel"), ("col", "col_normalize_kernel"), ("median", "normalize_kernel")) if named.pop(k, False)]
    if len(chosen) > 1:
        raise ValueError("choose one normalisation of the kernel")
    if chosen:
        out["normalization"] = chosen[0]
    if wrong := [k for k, v in named.items() if _ONLY_DEFAULTS.get(k, not v) != v]:
        raise ValueError(f"unknown or unsupported options: {', '.join(wrong)}")
    return out


def standardized(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(slide, cell_type, cell_id, gene, score): z-scores within each slide and type; 0 for constant genes."""
    full = dense(expression, cells, genes)
    stats = full.groupBy("slide", "cell_type", "gene").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.try_divide(F.col("value") - F.col("m"), F.col("sd"))).otherwise(F.lit(0.0))
    return full.join(stats, ["slide", "cell_type", "gene"]).select("slide", "cell_type", "cell_id", "gene", z.alias("score"))


def gene_numbers(genes: DataFrame) -> tuple[DataFrame, list[str]]:
    """(gene, number) and the sorted names."""
    names = sorted(r[0] for r in genes.select("gene").distinct().collect())
    return F.broadcast(genes.sparkSession.createDataFrame(list(enumerate(names)), "number int, gene string")), names


def block_moments(expression: DataFrame, cells: DataFrame, numbers: DataFrame, n_genes: int) -> DataFrame:
    """(slide, cell_type, n, m, inv): for each block its cells, and its genes' means and inverse deviations, zeros included; 0 for constant genes."""
    group = ["slide", "cell_type"]
    sizes = cells.groupBy(*group).agg(F.count("*").alias("n"))
    values = expression.join(numbers, "gene").join(cells.select(*group, "cell_id"), "cell_id")
    sums = values.groupBy(*group, "number").agg(F.sum("value").alias("s"), F.count("*").alias("there"))
    every = sizes.crossJoin(numbers.select("number")).join(sums, [*group, "number"], "left")  # blocks times genes
    every = materialize(every.select(*group, "number", "n", F.coalesce("there", F.lit(0)).alias("there"), (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("m")), "means")
    about = values.join(every.select(*group, "number", "m"), [*group, "number"]).groupBy(*group, "number").agg(F.sum((F.col("value") - F.col("m")) ** 2).alias("d"))
    spread = F.coalesce("d", F.lit(0.0)) + (F.col("n") - F.col("there")) * F.col("m") ** 2
    sd = F.sqrt(F.try_divide(spread, F.col("n") - 1))
    inverse = F.when(F.coalesce(sd, F.lit(0.0)) > 1e-10 * F.abs("m"), 1 / sd).otherwise(F.lit(0.0))
    packed = every.join(about, [*group, "number"], "left").groupBy(*group, "n").agg(F.array_sort(F.collect_list(F.struct("number", "m", inverse.alias("inv")))).alias("g"))
    return materialize(packed.select(*group, "n", F.col("g.m").alias("m"), F.col("g.inv").alias("inv")), "gene-moments")


def packed_cells(expression: DataFrame, cells: DataFrame, numbers: DataFrame, n_genes: int) -> DataFrame:
    """(slide, cell_type, cell_id, k, v): each cell's non-zero genes, and a last column of ones, by which means are taken out of products."""
    own = expression.where("value <> 0").join(numbers, "gene").groupBy("cell_id").agg(F.collect_list(F.struct(F.col("number").alias("k"), F.col("value").cast("double").alias("v"))).alias("kv"))
    joined = cells.select("slide", "cell_type", "cell_id").join(own, "cell_id", "left")
    with_one = lambda c, kind, last: F.concat(F.coalesce(F.col(f"kv.{c}"), F.array().cast(kind)), F.array(last)).alias(c)
    return joined.select("slide", "cell_type", "cell_id", with_one("k", "array<int>", F.lit(n_genes)), with_one("v", "array<double>", F.lit(1.0)))


def self_lines(rows: DataFrame, moments: DataFrame, n_genes: int) -> DataFrame:
    """(slide, cell_type, k, line): Z'Z / n from column k on, of packed_cells(); Z'Z = D (X'X - n m m') D with the inverse deviations D."""
    sums = product_lines(rows.withColumn("weight", F.lit(1.0)), ["slide", "cell_type"], "cell_id", lambda key: n_genes + 1).where(F.col("k") < n_genes)
    own = lambda c: F.element_at(c, F.col("k") + 1)
    value = lambda x, i: (x - F.col("n") * own("m") * F.get("m", F.col("k") + i)) * own("inv") * F.get("inv", F.col("k") + i) / F.col("n")
    return sums.join(moments, ["slide", "cell_type"]).select("slide", "cell_type", "k", F.transform(F.slice("line", 1, F.lit(n_genes) - F.col("k")), value).alias("line"))


def cross_lines(kernel: DataFrame | TiledKernel, cells: DataFrame, rows: DataFrame, moments: DataFrame, n_genes: int) -> DataFrame:
    """(sigma, slide, ct_1, ct_2, k, line): Z1' K Z2 / sqrt(n1 n2).

    The products of the columns of ones hold what taking out the means needs: Z1' K Z2 = D1 (X1'KX2 - m1 1'KX2 - X1'K1 m2' + m1 1'K1 m2') D2.
    """
    block = ["sigma", "slide", "ct_1", "ct_2"]
    lines = materialize(kernel_products(kernel, cells, rows, n_genes + 1), "cross-lines")
    ones = lines.where(F.col("k") == n_genes).select(*block, F.col("line").alias("ones"))
    for n in "12":
        ones = ones.join(moments.select("slide", F.col("cell_type").alias(f"ct_{n}"), F.col("n").alias(f"n{n}"), F.col("m").alias(f"m{n}"), F.col("inv").alias(f"d{n}")), ["slide", f"ct_{n}"])
    own = lambda c: F.element_at(c, F.col("k") + 1)
    mean = own("m1") * (F.get("ones", F.lit(n_genes)))
    scale = own("d1") / F.sqrt(F.col("n1") * F.col("n2"))
    value = lambda x, i: (x - own("m1") * F.get("ones", i) - (F.get("line", F.lit(n_genes)) - mean) * F.get("m2", i)) * F.get("d2", i) * scale
    return lines.where(F.col("k") < n_genes).join(ones, block).select(*block, "k", F.transform(F.slice("line", 1, n_genes), value).alias("line"))


def _named(lines: DataFrame, names: list[str], whole: bool) -> DataFrame:
    genes = F.array(*[F.lit(g) for g in names])
    cells = lines.withColumn("genes", genes).select("*", F.posexplode("line").alias("at", "c"))
    second = F.col("at") if whole else F.col("k") + F.col("at")
    return cells.withColumn("gene_1", F.element_at("genes", F.col("k") + 1)).withColumn("gene_2", F.element_at("genes", second + 1)).drop("genes", "line", "k", "at")


def self_covariances(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(slide, cell_type, gene_1, gene_2, c) for gene_1 <= gene_2: covariances of the z-scores within each slide and type."""
    numbers, names = gene_numbers(genes)
    rows = packed_cells(expression, cells, numbers, len(names))
    return _named(self_lines(rows, block_moments(expression, cells, numbers, len(names)), len(names)), names, whole=False)


def cross_covariances(kernel: DataFrame | TiledKernel, expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(sigma, slide, ct_1, ct_2, gene_1, gene_2, c): Z1' K Z2 / sqrt(n1 n2)."""
    numbers, names = gene_numbers(genes)
    rows = packed_cells(expression, cells, numbers, len(names))
    return _named(cross_lines(kernel, cells, rows, block_moments(expression, cells, numbers, len(names)), len(names)), names, whole=True)


def objective(weights: DataFrame, own: DataFrame, cross: DataFrame) -> DataFrame:
    """(sigma, cc, objective) of weights (cell_type, gene, cc, w): mean over slides of the sum over pairs of w1'C w2 / (s1 s2)."""
    w1 = weights.select("cell_type", F.col("gene").alias("gene_1"), "cc", F.col("w").alias("w1"))
    w2 = weights.select("cell_type", F.col("gene").alias("gene_2"), "cc", F.col("w").alias("w2"))
    double = F.when(F.col("gene_1") == F.col("gene_2"), F.lit(1.0)).otherwise(F.lit(2.0))
    dev = own.join(w1, ["cell_type", "gene_1"]).join(w2, ["cell_type", "gene_2", "cc"]).groupBy("slide", "cell_type", "cc").agg(F.greatest(F.sqrt(F.greatest(F.sum(double * F.col("c") * F.col("w1") * F.col("w2")), F.lit(0.0))), F.lit(1e-12)).alias("s"))
    a, b = w1.withColumnRenamed("cell_type", "ct_1"), w2.withColumnRenamed("cell_type", "ct_2")
    num = cross.join(a, ["ct_1", "gene_1"]).join(b, ["ct_2", "gene_2", "cc"]).groupBy("sigma", "slide", "ct_1", "ct_2", "cc").agg(F.sum(F.col("c") * F.col("w1") * F.col("w2")).alias("num"))
    d1 = dev.select("slide", F.col("cell_type").alias("ct_1"), "cc", F.col("s").alias("s1"))
    d2 = dev.select("slide", F.col("cell_type").alias("ct_2"), "cc", F.col("s").alias("s2"))
    terms = num.join(d1, ["slide", "ct_1", "cc"]).join(d2, ["slide", "ct_2", "cc"])
    return terms.groupBy("sigma", "slide", "cc").agg(F.sum(F.col("num") / (F.col("s1") * F.col("s2"))).alias("v")).groupBy("sigma", "cc").agg(F.avg("v").alias("objective"))


def run_gene_space(expression: DataFrame, cells: DataFrame, cell_types: list[str], sigma: float, n_cc: int = 2, clip="quantile", min_prevalence: float = 0.008, min_cells: int = 20, max_iter: int = 3000, tol: float = 1e-6, seed: int = 0, slide_cells: int = 10, driver_bytes: int = DRIVER_BYTES, most_genes: int = MOST_GENES, **kernel_options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gene weights (sigma, cell_type, gene, cc, w), cell scores, and the objective.

    Every step is one plan over all slides.  Covariances of up to ``driver_bytes`` and ``most_genes`` reach the driver, which solves on them; beyond that
    each round applies the axes to the cells and the kernel to the scores, and only gene vectors reach the driver.  Both ways stop by ``tol``.
    ``kernel_options`` may be named as in as_options().  Cells of slides with too few cells have a null score.
    """
    spark = cells.sparkSession
    every_cell = cells.where(F.col("cell_type").isin(list(cell_types)))
    if len(cell_types) < 2:
        raise ValueError("at least two cell types are needed")
    cells = cells.where(F.col("cell_type").isin(list(cell_types)))
    slides = materialize(sufficient_slides(cells, cell_types, slide_cells), "slides")
    warn_dropped(f"slides with fewer than {slide_cells} cells of a type", sorted(r[0] for r in cells.select("slide").distinct().join(slides, "slide", "left_anti").collect()))
    cells = materialize(cells.join(slides, "slide", "left_semi"), "cells")
    expression = expression.join(cells.select("cell_id"), "cell_id", "left_semi")
    genes = prevalent_genes(expression, cells, min_prevalence, min_cells).select("gene")
    genes = materialize(genes, "genes")
    names = sorted(r[0] for r in genes.collect())
    if not names:
        raise ValueError("no gene passes the filter")
    used = materialize(clip_values(expression.join(genes, "gene", "left_semi"), clip), "clipped")
    numbers, n_genes = gene_numbers(genes)[0], len(names)
    moments = block_moments(used, cells, numbers, n_genes)
    packed = materialize(packed_cells(used, cells, numbers, n_genes), "packed")
    chosen = {"skip_few": True} | as_options(**kernel_options)
    make = tiled_kernel if chosen.get("lower_limit", 1e-7) > 0 else compute_kernel
    kernel, _ = make(cells, pairs_of(cell_types), [sigma], **chosen)
    n_slides = len({block[1] for block in kernel.valid()}) if isinstance(kernel, TiledKernel) else kernel.select("slide").distinct().count()
    blocks = n_slides * (len(cell_types) + len(pairs_of(cell_types)))
    if n_genes <= most_genes and 8 * blocks * n_genes**2 <= driver_bytes:
        step = solve.step_of_matrices(*_in_memory(self_lines(packed, moments, n_genes), cross_lines(kernel, cells, packed, moments, n_genes), n_genes, cell_types), cell_types)
    else:
        step = _step_of_cells(packed, moments, kernel, n_genes, n_slides)
    axes, reached = solve.genespace_axes(step, len(names), list(cell_types), n_cc, None, max_iter, tol, seed)
    rows = [(float(sigma), t, g, c + 1, float(axes[t][k, c])) for t in cell_types for k, g in enumerate(names) for c in range(n_cc)]
    weights = spark.createDataFrame(rows, "sigma double, cell_type string, gene string, cc int, w double")
    raw = _applied(packed, moments, axes, float(sigma), n_cc)
    scored = standardized_scores(raw).join(every_cell.select("slide", "cell_type", "cell_id"), ["slide", "cell_type", "cell_id"], "right")
    left_out = scored.where("cc IS NULL").drop("sigma", "cc", "score").select(F.lit(float(sigma)).alias("sigma"), "slide", "cell_type", F.explode(F.sequence(F.lit(1), F.lit(n_cc))).alias("cc"), "cell_id", F.lit(None).cast("double").alias("score"))
    scored = scored.where("cc IS NOT NULL").select("sigma", "slide", "cell_type", "cc", "cell_id", "score").unionByName(left_out)
    return weights, scored, spark.createDataFrame([(float(sigma), c, v) for c, v in enumerate(reached, 1)], "sigma double, cc int, objective double")


def _in_memory(own: DataFrame, cross: DataFrame, n_genes: int, cell_types: list[str]) -> tuple[dict, dict, list[str]]:
    """Covariances on the driver, by slide and type and by slide and pair, and the slides that have a kernel."""

    def matrices(df: DataFrame, keys: list[str], whole: bool) -> dict:
        out: dict = {}
        for batch in df.select(*keys, "k", "line").toArrow().to_batches():
            lines, ks = batch.column("line"), batch.column("k").to_pylist()
            for at, key in enumerate(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)):
                m = out.setdefault(key, np.zeros((n_genes, n_genes)))
                k, line = ks[at], lines[at].values.to_numpy()
                if whole:
                    m[k] = line
                else:
                    m[k, k:] = m[k:, k] = line
        return out

    every, pairs = matrices(materialize(own, "own"), ["slide", "cell_type"], False), matrices(materialize(cross, "cross"), ["slide", "ct_1", "ct_2"], True)
    slides = sorted({s for s, _, _ in pairs})
    return {s: {t: every[s, t] for t in cell_types} for s in slides}, {s: {(a, b): m for (q, a, b), m in pairs.items() if q == s} for s in slides}, slides


def _on_driver(moments: DataFrame) -> dict[tuple[str, str], tuple[int, np.ndarray, np.ndarray]]:
    """Cells, means and inverse deviations of each slide and type: 16 bytes for each of a block's genes."""
    return {(r["slide"], r["cell_type"]): (r["n"], np.array(r["m"]), np.array(r["inv"])) for r in moments.collect()}


def _applied(packed: DataFrame, moments: DataFrame, axes: solve.Weights, sigma: float, n_cc: int) -> DataFrame:
    """(sigma, slide, cell_type, cell_id, cc, raw): the z-scores of the cells times the axes, zeros never written."""
    by_block = _on_driver(moments)
    id_type = packed.schema["cell_id"].dataType.simpleString()

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in one_block_at_once(batches, ["slide", "cell_type"]):
            _, m, inv = by_block[key]
            w = axes[key[1]] * inv[:, None]
            out = dense_rows(part, len(w) + 1)[:, :-1] @ w - m @ w
            offsets = np.arange(0, out.size + 1, n_cc, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("slide"), part.column("cell_type"), part.column("cell_id"), pa.ListArray.from_arrays(offsets, out.ravel())], names=["slide", "cell_type", "cell_id", "line"])

    made = packed.mapInArrow(times, f"slide string, cell_type string, cell_id {id_type}, line array<double>")
    exploded = made.select(F.lit(sigma).alias("sigma"), "slide", "cell_type", "cell_id", F.posexplode("line").alias("cc", "raw"))
    return exploded.withColumn("cc", F.col("cc") + 1)


def _step_of_cells(packed: DataFrame, moments: DataFrame, kernel: DataFrame | TiledKernel, n_genes: int, n_slides: int) -> solve.Step:
    """As solve.step_of_matrices(), without a covariance: axes times cells, kernel times scores, cells' sums by gene."""
    spark = packed.sparkSession
    tiles = kernel if isinstance(kernel, TiledKernel) else None
    found = sorted({(slide, one, two) for _, slide, one, two in tiles.valid()}) if tiles else sorted((r["slide"], r["ct_1"], r["ct_2"]) for r in kernel.select("slide", "ct_1", "ct_2").distinct().collect())
    slides = F.broadcast(spark.createDataFrame([(x,) for x in sorted({slide for slide, _, _ in found})], "slide string"))
    rows = materialize(packed.join(slides, "slide", "left_semi"), "packed-used")
    by_block = _on_driver(moments.join(slides, "slide", "left_semi"))
    pairs = found
    edges = None if tiles else materialize(kernel.select("slide", "ct_1", "ct_2", "i", "j", "k"), "edges")

    def step(now: solve.Weights) -> tuple[dict[tuple[str, str], float], solve.Weights]:
        u = _applied(rows, moments, {t: w[:, None] for t, w in now.items()}, 0.0, 1).select("slide", "cell_type", "cell_id", F.col("raw").alias("u"))
        u = materialize(u, "axis-scores")
        squares = {(r["slide"], r["cell_type"]): r["q"] for r in u.groupBy("slide", "cell_type").agg(F.sum(F.col("u") ** 2).alias("q")).collect()}
        dev = {key: max(float(np.sqrt(max(squares[key] / n, 0.0))), 1e-12) for key, (n, _, _) in by_block.items()}
        scale = [(s, a, b, float(1 / (np.sqrt(by_block[s, a][0] * by_block[s, b][0]) * dev[s, a] * dev[s, b] * n_slides))) for s, a, b in pairs]
        factors = F.broadcast(spark.createDataFrame(scale, "slide string, ct_1 string, ct_2 string, f double"))  # a row for each block
        left, right = u.select(F.col("cell_id").alias("i"), F.col("u").alias("u1")), u.select(F.col("cell_id").alias("j"), F.col("u").alias("u2"))
        value = F.sum(F.col("k") * F.col("f") * F.col("other")).alias("q")
        if tiles:
            at = u.withColumn("cc", F.lit(1)).withColumnRenamed("u", "score")
            of_left, of_right = tiles.smooth(at, at)
            to_left, to_right = (x.join(factors, ["slide", "ct_1", "ct_2"]).groupBy(F.col(c).alias("cell_id")).agg(F.sum(F.col("s") * F.col("f")).alias("q")) for x, c in ((of_left, "i"), (of_right, "j")))
        else:
            scaled = edges.join(factors, ["slide", "ct_1", "ct_2"])
            to_left = scaled.join(right.withColumnRenamed("u2", "other"), "j").groupBy(F.col("i").alias("cell_id")).agg(value)
            to_right = scaled.join(left.withColumnRenamed("u1", "other"), "i").groupBy(F.col("j").alias("cell_id")).agg(value)
        q = to_left.unionByName(to_right).groupBy("cell_id").agg(F.sum("q").alias("q"))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, str], np.ndarray] = {}
            for key, part in one_block_at_once(batches, ["slide", "cell_type"]):
                made = dense_rows(part, n_genes + 1).T @ part.column("q").to_numpy()
                total[key] = total[key] + made if key in total else made
            for (slide, kind), line in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([slide] * len(line)), pa.array([kind] * len(line)), pa.array(np.arange(len(line), dtype=np.int32)), pa.array(line)], names=["slide", "cell_type", "k", "s"])

        found = rows.join(q, "cell_id").select("slide", "cell_type", "k", "v", "q").mapInArrow(sums, "slide string, cell_type string, k int, s double").groupBy("slide", "cell_type", "k").agg(F.sum("s").alias("s")).toPandas()
        pulls = {t: np.zeros(len(w)) for t, w in now.items()}
        for (slide, t), part in found.groupby(["slide", "cell_type"]):
            line = np.zeros(n_genes + 1)
            line[part["k"].to_numpy()] = part["s"].to_numpy()
            _, m, inv = by_block[slide, t]
            pulls[t] += inv * (line[:-1] - m * line[-1])
        return dev, pulls

    return step


def standardized_scores(raw: DataFrame) -> DataFrame:
    """Scores as z-scores within slide, type and component."""
    keys = ["sigma", "slide", "cell_type", "cc"]
    stats = raw.groupBy(*keys).agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("sd"))
    return raw.join(stats, keys).select(*keys, "cell_id", F.coalesce(F.try_divide(F.col("raw") - F.col("m"), F.col("sd")), F.lit(0.0)).alias("score"))
