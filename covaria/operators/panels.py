"""Products X1' K X2 of packed rows through a sparse kernel, without a row for each edge and column.

The cells of a slide and type lie along a Z-curve; a cell's place on it is its number.  A tile is a run of TILE_CELLS places of the second
type, a band a run of BAND_CELLS of the first.  Edges go to the tile of their second end, and a packed row of the first type goes once to
every tile that has an edge to it: the tile's halo.  So edges and rows times halos are shuffled, never edges times columns.  A task smooths a tile
(the kernel between tile and band as a small dense matrix, times the band's dense rows, added up over the bands) and multiplies the
result by the tile's own rows.  Sums of a block leave the task once, as lines, however many tiles it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.operators.dense import dense_rows, line_batches, sum_lines
from covaria.operators.places import places
from covaria.operators.tiled import MOST_COLUMNS, TiledKernel
from covaria.sources.store import materialize

TILE_CELLS = 256
BAND_CELLS = 1024
#: Sorts behind every band.
_OWN = (1 << 62) - 1
PAIR = ["slide", "ct_1", "ct_2"]
_ROWS = "b int, s int, k int, line array<double>"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows with the same (numeric) keys, one group at a time, however batches cut them."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        begin = 0
        for end in [*(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(found)]:
            key = tuple(found[begin].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = key
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _tiled(kernel: DataFrame, at: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[float]]:
    """The edges, halos and own rows of all tiles, dealt to tasks; the blocks (b, slide, ct_1, ct_2); and the bandwidths."""
    spark = kernel.sparkSession
    # a row for each block, a number for each bandwidth
    blocks = spark.createDataFrame(list(enumerate(sorted(tuple(r) for r in kernel.select(*PAIR).distinct().collect()))), "b int, k struct<slide string, ct_1 string, ct_2 string>").select("b", "k.*")
    sigmas = sorted(r[0] for r in kernel.select("sigma").distinct().collect())
    bandwidths = F.broadcast(spark.createDataFrame(list(enumerate(sigmas)), "s int, sigma double"))
    one = at.select("slide", F.col("cell_type").alias("ct_1"), F.col("cell_id").alias("i"), F.col("place").alias("p"))
    two = at.select("slide", F.col("cell_type").alias("ct_2"), F.col("cell_id").alias("j"), F.col("place").alias("q"))
    edges = kernel.join(bandwidths, "sigma").join(F.broadcast(blocks), PAIR).join(one, ["slide", "ct_1", "i"]).join(two, ["slide", "ct_2", "j"])
    tile, band = F.floor(F.col("q") / TILE_CELLS).alias("tile"), F.floor(F.col("p") / BAND_CELLS).alias("band")
    edges = materialize(edges.select("b", tile, band, "s", "p", "q", F.col("k").alias("w")), "tiled-edges")
    placed = materialize(rows.join(at, ["slide", "cell_type", "cell_id"]).select("slide", "cell_type", "place", "k", "v"), "placed-rows")

    def packed(asked: DataFrame, side: str, kind: int) -> DataFrame:
        known = asked.join(F.broadcast(blocks), "b").join(placed.withColumnsRenamed({"cell_type": side, "place": "p"}), ["slide", side, "p"])
        nothing = F.lit(None)
        return known.select("b", "tile", "band", F.lit(kind).alias("kind"), nothing.cast("int").alias("s"), "p", nothing.cast("long").alias("q"), nothing.cast("double").alias("w"), "k", "v")

    halo = packed(edges.select("b", "tile", "band", "p").distinct(), "ct_1", 0)
    own = packed(edges.select("b", "tile", F.lit(_OWN).alias("band"), F.col("q").alias("p")).distinct(), "ct_2", 2)
    plain = edges.select("b", "tile", "band", F.lit(1).alias("kind"), "s", "p", "q", "w", F.lit(None).cast("array<int>").alias("k"), F.lit(None).cast("array<double>").alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = max(1, -(-edges.select("b", "tile").distinct().count() // parts))
    every = halo.unionByName(plain).unionByName(own).withColumn("stretch", F.floor(F.col("tile") / span))
    dealt = every.repartition(parts, "b", "stretch").sortWithinPartitions("b", "tile", "band", "kind", "p").drop("stretch")
    return dealt, blocks, sigmas


def _multiplied(dealt: DataFrame, rows_of: Callable[[pa.RecordBatch], np.ndarray], finish: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Lines (b, s, k, line) of the sums that ``finish`` makes of smoothed and own rows, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tile_now = None, None
        total: dict[int, np.ndarray] = {}
        smooth: dict[int, np.ndarray] = {}
        for (b, tile, band), part in whole_groups(batches, ["b", "tile", "band"]):
            if b != block:
                for s, sums in total.items():
                    yield from line_batches(["b", "s"], (block, s), sums.reshape(len(sums), -1))
                block, total = b, {}
            if (b, tile) != tile_now:
                tile_now, smooth = (b, tile), {}
            kind = _numbers(part.column("kind"))
            packed = part.filter(pa.array(kind != 1))
            ids, x = _numbers(packed.column("p")), rows_of(packed)
            if band == _OWN:
                for s, sums in smooth.items():
                    made = finish(sums[ids - tile * TILE_CELLS], x)
                    total[s] = total[s] + made if s in total else made
                continue
            edges = part.filter(pa.array(kind == 1))
            s_of, p, q, w = (_numbers(edges.column(c)) for c in ("s", "p", "q", "w"))
            column = np.searchsorted(ids, p)
            for s in np.unique(s_of).tolist():
                mine = s_of == s
                k = np.zeros((TILE_CELLS, len(ids)))
                np.add.at(k, (q[mine] - tile * TILE_CELLS, column[mine]), w[mine])
                smooth[s] = smooth[s] + k @ x if s in smooth else k @ x
        for s, sums in total.items():
            yield from line_batches(["b", "s"], (block, s), sums.reshape(len(sums), -1))

    return dealt.mapInArrow(run, _ROWS)


def kernel_products(kernel: DataFrame | TiledKernel, cells: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(sigma, slide, ct_1, ct_2, k, line): the lines of X1' K X2 for packed rows (slide, cell_type, cell_id, k, v) of ``width`` columns."""
    if isinstance(kernel, TiledKernel):
        if width <= MOST_COLUMNS:
            return kernel.products(_dense(rows, width), F.col("v"), lambda a, b: a.T @ b)
        kernel = materialize(kernel.edges(), "edges")
    dealt, blocks, sigmas = _tiled(kernel, places(cells), rows)
    lines = sum_lines(_multiplied(dealt, lambda part: dense_rows(part, width), lambda a, b: a.T @ b), ["b", "s"])
    return _named(lines, blocks, sigmas)


def _dense(rows: DataFrame, width: int) -> DataFrame:
    """(slide, cell_type, cell_id, v): packed rows with their zeros."""
    cell = ["slide", "cell_type", "cell_id"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cell)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = np.arange(0, batch.num_rows * width + 1, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cell], pa.ListArray.from_arrays(offsets, dense_rows(batch, width).ravel())], names=[*cell, "v"])

    return rows.select(*cell, "k", "v").mapInArrow(fill, f"{kinds}, v array<double>")


def _named(lines: DataFrame, blocks: DataFrame, sigmas: list[float]) -> DataFrame:
    sigma = F.element_at(F.array(*[F.lit(s) for s in sigmas] or [F.lit(0.0)]), F.col("s") + 1)
    return lines.join(F.broadcast(blocks), "b").select(sigma.alias("sigma"), *PAIR, "k", "line")


def stack_products(kernel: DataFrame | TiledKernel, cells: DataFrame, stacks: DataFrame, size: int) -> DataFrame:
    """(sigma, ct_1, ct_2, draw, line) for stacks (slide, cell_type, cell_id, v) of ``size`` components for each draw, one after another.

    Line is the operator X1' K X2 of a draw, row by row, over all slides; draws count from 1.  A cell whose v is no longer than ``size`` has the
    same scores in every draw and is moved once.
    """
    def rows_of(part: pa.RecordBatch) -> np.ndarray:
        return _numbers(part.column("v").flatten()).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, size))

    def finish(smooth: np.ndarray, own: np.ndarray) -> np.ndarray:
        a, b = smooth.reshape(len(smooth), -1, size), own.reshape(len(own), -1, size)
        return (a.transpose(1, 2, 0) @ b.transpose(1, 0, 2)).reshape(-1, size * size)

    if isinstance(kernel, TiledKernel) and (stacks.agg(F.max(F.size("v"))).first()[0] or 0) <= MOST_COLUMNS:
        lines = kernel.products(stacks, F.col("v"), finish).drop("slide")
    else:
        kernel = materialize(kernel.edges(), "edges") if isinstance(kernel, TiledKernel) else kernel
        dealt, blocks, sigmas = _tiled(kernel, places(cells), stacks.withColumn("k", F.lit(None).cast("array<int>")))
        lines = _named(_multiplied(dealt, rows_of, finish), blocks, sigmas).drop("slide")
    return sum_lines(lines, ["sigma", "ct_1", "ct_2"]).select("sigma", "ct_1", "ct_2", (F.col("k") + 1).alias("draw"), "line")


def stack_squares(stacks: DataFrame, size: int) -> DataFrame:
    """(cell_type, draw, line): X'X of each draw's scores, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds = np.array(batch.column("cell_type").to_pylist())
            for kind in dict.fromkeys(kinds.tolist()):
                mine = batch.filter(pa.array(kinds == kind)).column("v")
                x = _numbers(mine.flatten()).reshape(len(mine), -1, size).transpose(1, 0, 2)
                made = x.transpose(0, 2, 1) @ x
                total[kind] = total[kind] + made if kind in total else made
        for kind, sums in total.items():
            yield from line_batches(["cell_type"], (kind,), sums.reshape(len(sums), -1))

    schema = T.StructType().add("cell_type", T.StringType()).add("k", T.IntegerType()).add("line", T.ArrayType(T.DoubleType()))
    parts = stacks.select("cell_type", "v").mapInArrow(run, schema)
    return sum_lines(parts, ["cell_type"]).select("cell_type", (F.col("k") + 1).alias("draw"), "line")
