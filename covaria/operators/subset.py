"""Filters: cell types, genes, slides, kernels."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions.quantiles import exact_quantile
from covaria.operators.tiled import TiledKernel
from covaria.sources.cells import CellSet
from covaria.sources.store import materialize


def pairs_of(cell_types: list[str] | tuple[str, ...]) -> list[tuple[str, str]]:
    """All pairs of types in list order; one type pairs with itself."""
    types = list(cell_types)
    return [(types[0], types[0])] if len(types) == 1 else [(a, b) for k, a in enumerate(types) for b in types[k + 1 :]]


def self_pairs(cell_types) -> list[tuple[str, str]]:
    return [(t, t) for t in cell_types]


def subset_data(data: CellSet, cell_types: list[str], min_cells: int = 10) -> CellSet:
    """Only the listed types; an error if one has fewer than ``min_cells`` cells."""
    kept = data.cells.where(F.col("cell_type").isin(list(cell_types)))
    counts = {r["cell_type"]: r["n"] for r in kept.groupBy("cell_type").agg(F.count("*").alias("n")).collect()}
    if few := [t for t in cell_types if counts.get(t, 0) < min_cells]:
        raise ValueError(f"fewer than {min_cells} cells of {few}")
    return data.with_(cells=kept, expression=data.expression.join(kept.select("cell_id"), "cell_id", "left_semi"), cell_types=tuple(cell_types))


def prevalent_genes(expression: DataFrame, cells: DataFrame, min_prevalence: float = 0.008, min_cells: int = 20) -> DataFrame:
    """(gene, n_expressing) of genes that are positive in enough cells, as a share of all cells and as a number."""
    n = cells.agg(F.count("*").alias("__n"))
    counted = expression.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_expressing"))
    return counted.crossJoin(F.broadcast(n)).where((F.col("n_expressing") >= min_cells) & (F.col("n_expressing") >= min_prevalence * F.col("__n"))).drop("__n")


def clip_values(expression: DataFrame, clip: str | float = "quantile", quantile: float = 0.98) -> DataFrame:
    """Values limited to a number, or to one quantile of all positive values."""
    if not isinstance(clip, str):
        return expression.withColumn("value", F.least("value", F.lit(float(clip))))
    limit = exact_quantile(expression.where("value > 0").withColumn("__one", F.lit(1)), ["__one"], "value", quantile, "__limit").select("__limit")
    return expression.crossJoin(F.broadcast(limit)).withColumn("value", F.least("value", F.col("__limit"))).drop("__limit")


def sufficient_slides(cells: DataFrame, cell_types: list[str], min_cells: int = 10) -> DataFrame:
    """(slide) of slides with at least ``min_cells`` cells of every type."""
    counts = cells.where(F.col("cell_type").isin(list(cell_types))).groupBy("slide", "cell_type").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_cells).groupBy("slide").agg(F.count("*").alias("k")).where(F.col("k") == len(cell_types)).select("slide")


BLOCK = ["sigma", "slide", "ct_1", "ct_2"]


def filter_kernel(kernel: DataFrame | TiledKernel, row_cutoff: float = 5e-3, col_cutoff: float = 5e-3) -> DataFrame | TiledKernel:
    """Edges of rows and columns with large enough sums.

    Cross blocks: rows first, then columns of what is left; a type with itself: a cell stays if both its sums suffice.
    """
    if isinstance(kernel, TiledKernel):
        return _filter_tiled(kernel, row_cutoff, col_cutoff)
    cross = kernel.where("ct_1 <> ct_2")
    rows = cross.groupBy(*BLOCK, "i").agg(F.sum("k").alias("s")).where(F.col("s") > row_cutoff).drop("s")
    kept = cross.join(rows, [*BLOCK, "i"], "left_semi")
    columns = kept.groupBy(*BLOCK, "j").agg(F.sum("k").alias("s")).where(F.col("s") > col_cutoff).drop("s")
    cross = kept.join(columns, [*BLOCK, "j"], "left_semi").select(kernel.columns)
    own = kernel.where("ct_1 = ct_2")
    r = own.groupBy(*BLOCK, "i").agg(F.sum("k").alias("s")).where(F.col("s") > row_cutoff).drop("s")
    c = own.groupBy(*BLOCK, "j").agg(F.sum("k").alias("s")).where(F.col("s") > col_cutoff).drop("s").withColumnRenamed("j", "i")
    both = r.join(c, [*BLOCK, "i"])
    own = own.join(both, [*BLOCK, "i"], "left_semi").join(both.withColumnRenamed("i", "j"), [*BLOCK, "j"], "left_semi").select(kernel.columns)
    return materialize(cross.unionByName(own), "kernel-filtered")


def _filter_tiled(kernel: TiledKernel, row_cutoff: float, col_cutoff: float) -> TiledKernel:
    """The same by factors of one or nothing for rows and columns."""
    kinds = {block[1] == block[2] for block in kernel.blocks}
    rows, columns = (sums.select(*BLOCK, side, "s", F.lit(1.0).alias("f")) for sums, side in zip(kernel.sums(), "ij", strict=True))
    large = rows.where(F.col("s") > row_cutoff).drop("s")
    kept, kept_columns = large, None
    if True in kinds:
        own = large.where("ct_1 = ct_2").join(columns.where((F.col("s") > col_cutoff) & (F.col("ct_1") == F.col("ct_2"))).select(*BLOCK, F.col("j").alias("i")), [*BLOCK, "i"])
        kept = large.where("ct_1 <> ct_2").unionByName(own)
        kept_columns = columns.where("ct_1 <> ct_2").drop("s").unionByName(own.withColumnRenamed("i", "j"))
    found = kernel.scaled(kept, kept_columns)
    if False not in kinds:
        return found
    left = found.sums()[1].where((F.col("ct_1") == F.col("ct_2")) | (F.col("s") > col_cutoff))
    return found.scaled(None, left.select(*BLOCK, "j", F.lit(1.0).alias("f")))


def warn_dropped(what: str, dropped: list) -> None:
    if dropped:
        warnings.warn(f"{what} dropped: {dropped}", stacklevel=3)
