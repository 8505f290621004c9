"""Slides in spatial blocks of a bounded number of cells: by k-means or by medians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covaria.functions.ranks import with_rank
from covaria.sources.store import materialize

#: Blocks that one pass makes of a block that is too large, at most; these are split again if they are too large themselves.
FAN = 64
#: Blocks whose centres the driver holds at once; more take further passes.
MOST_AT_ONCE = 4096
#: Cells of a part up to which one task splits it to the end; larger parts are split by passes over all tasks.
IN_TASK = 65_536
#: Rounds of a pass, and the squared movement of a block's centres (in units of its standard deviations) that ends them sooner.
ROUNDS = 50
STILL = 1e-4
#: Blocks up to which their table of numbers is broadcast.
BROADCAST_BLOCKS = 200_000
_OF = ["__slide", "__part"]
#: Ends the name of a part that k-means cannot split, for its cells are at one place or nearly so.
_STUCK = "!"


def split_slides(cells: DataFrame, max_cell: int, method: str = "median") -> DataFrame:
    """Slides of over ``max_cell`` cells become blocks ``<slide>_blk<k>`` of at most that many.

    ``median``: halves of the wider axis, again and again; the fewest blocks.  ``kmeans``: k-means on standardised coordinates, as many centres as blocks are
    needed, and what is still too large is split again; rounder blocks, more of them.  What k-means can't split, as cells at one place, is halved.  Both start
    from ranks and not from draws, so a run repeats itself, k-means but for cells that rounding puts on either side of a border.
    Pairs across blocks are lost, which is the point: it bounds the work, and is only done on request.
    """
    if max_cell < 1:
        raise ValueError("max_cell must be positive")
    if method not in ("median", "kmeans"):
        raise ValueError("method must be median or kmeans")
    now = cells.withColumn("__part", F.lit("")).withColumn("__slide", F.col("slide"))
    if method == "kmeans":
        while (split := _kmeans_pass(now, max_cell)) is not None:
            now = split
        now = _kmeans_within(now, max_cell)
    while (split := _halved(now, max_cell)) is not None:
        now = split
    parts = materialize(now.select(*_OF).distinct(), "parts")
    parts = parts.withColumn("__number", F.dense_rank().over(Window.partitionBy("__slide").orderBy("__part")))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_BLOCKS else parts
    name = F.when(F.col("__part") == "", F.col("__slide")).otherwise(F.concat("__slide", F.lit("_blk"), F.col("__number").cast("string")))
    return now.join(parts, _OF).withColumn("slide", name).drop(*_OF, "__number").select(*cells.columns)


def _halved(now: DataFrame, max_cell: int) -> DataFrame | None:
    """Parts that are too large in halves along the wider axis; None if there are none."""
    stats = now.groupBy(*_OF).agg(F.count("*").alias("__n"), (F.stddev_pop("x") >= F.stddev_pop("y")).alias("__wide")).where(F.col("__n") > max_cell)
    if not stats.limit(1).count():
        return None
    joined = now.join(stats, _OF, "left")
    axis = F.when(F.col("__wide"), F.col("x")).otherwise(F.col("y"))
    other = F.when(F.col("__wide"), F.col("y")).otherwise(F.col("x"))
    large = with_rank(joined.where("__n IS NOT NULL"), _OF, [axis, other, "cell_id"], "__rank")
    side = F.when(2 * F.col("__rank") < F.col("__n") - 1, F.lit("0")).otherwise(F.lit("1"))
    split = large.withColumn("__side", side).drop("__rank").unionByName(joined.where("__n IS NULL").withColumn("__side", F.lit("")))
    # written once: each further round reads it twice, and unwritten rounds would be computed anew, twice as often in each
    return materialize(split.withColumn("__part", F.concat("__part", "__side")).drop("__n", "__wide", "__side"), "halved")


def _nearest(at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * at @ centres.T).argmin(1)


def _kmeans_pass(now: DataFrame, max_cell: int) -> DataFrame | None:
    """Parts that are too large for one task, each split at its own centres; None if none can be split."""
    spark, axes = now.sparkSession, [a for a in "xyz" if a in now.columns]
    stats = now.where(~F.endswith(F.col("__part"), F.lit(_STUCK))).groupBy(*_OF).agg(F.count("*").alias("n"), *[f(a).alias(f"{n}{a}") for a in axes for n, f in (("mean_", F.avg), ("deviation_", F.stddev_pop))])
    large = stats.where(F.col("n") > max(max_cell, IN_TASK)).orderBy(*_OF).limit(MOST_AT_ONCE).toPandas()
    if not len(large):
        return None
    large["g"] = np.arange(len(large))
    k = np.minimum(FAN, np.ceil(large["n"] / max_cell)).astype(int)
    groups = F.broadcast(spark.createDataFrame(large.assign(k=k)))  # at most MOST_AT_ONCE rows
    unit = [F.coalesce(F.try_divide(F.col(a) - F.col(f"mean_{a}"), F.col(f"deviation_{a}")), F.lit(0.0)).alias(f"u{a}") for a in axes]
    points = materialize(now.join(groups, _OF).select("g", "n", "k", "cell_id", *unit), "points")
    units = [f"u{a}" for a in axes]
    # centres to begin with: means of runs of equal numbers of cells along a Z-curve
    step = {c: F.floor((F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col(c))) + 4) * 4095 / 8).cast("long") for c in units}
    bits = [F.shiftleft(F.shiftright(step[c], b).bitwiseAND(F.lit(1)), b * len(units) + i) for b in range(12) for i, c in enumerate(units)]
    ranked = with_rank(points.select("g", "n", "k", "cell_id", *units, sum(bits[1:], bits[0]).alias("curve")), ["g"], ["curve", "cell_id"])
    first = ranked.groupBy("g", F.floor(F.col("rank") * F.col("k") / F.col("n")).alias("c")).agg(*[F.avg(c).alias(c) for c in units]).orderBy("g", "c").toPandas()
    centres = {int(g): rows[units].to_numpy() for g, rows in first.groupby("g")}
    moving = set(centres)
    for _ in range(ROUNDS):
        sums = _sums(points.where(F.col("g").isin(sorted(moving))) if len(moving) < min(len(centres), 200) else points, spark.sparkContext.broadcast(centres), units)
        renewed = {g: at.copy() for g, at in centres.items()}
        for g, rows in sums.groupby("g"):
            renewed[g][rows["c"]] = rows[units].to_numpy() / rows["n"].to_numpy()[:, None]
        moving = {g for g, at in renewed.items() if ((at - centres[g]) ** 2).sum() > STILL}
        centres = renewed
        if not moving:
            break
    held = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def label(g: pd.Series, at: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(g), int)
        for group, places in g.groupby(g.to_numpy()).indices.items():
            out[places] = _nearest(at.to_numpy()[places], held.value[int(group)])
        return pd.Series(out)

    joined = now.join(groups.select(*_OF, "g", *[c for c in large.columns if c[:4] in ("mean", "devi")]), _OF, "left")
    named = joined.withColumn("__label", F.when(F.col("g").isNotNull(), label(F.coalesce("g", F.lit(0)), F.struct(*unit)))).select(*now.columns, "g", "__label")
    named = materialize(named, "labelled")
    whole = named.where("g IS NOT NULL").groupBy("g").agg((F.min("__label") == F.max("__label")).alias("stuck")).where("stuck").toPandas()["g"]
    suffix = F.when(F.col("g").isNull(), F.lit("")).when(F.col("g").isin([int(g) for g in whole]), F.lit(_STUCK)).otherwise(F.concat(F.lit("."), F.lpad(F.col("__label").cast("string"), 2, "0")))
    return named.withColumn("__part", F.concat("__part", suffix)).select(*now.columns)


def _kmeans_within(now: DataFrame, max_cell: int) -> DataFrame:
    """Parts of at most IN_TASK cells that are too large, each split in one task as by passes, until no block is too large or none can be split."""
    axes, at = [a for a in "xyz" if a in now.columns], now.columns.index("__part")

    def split(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("cell_id", "ascending")]).to_numpy()
        x = np.column_stack([table.column(a).cast(pa.float64()).to_numpy() for a in axes])[order]
        names, first = np.empty(len(x), object), table.column("__part")[0].as_py()
        left = [(np.arange(len(x)), first)]
        while left:
            rows, name = left.pop()
            if len(rows) <= max_cell or name.endswith(_STUCK):
                names[order[rows]] = name
                continue
            labels = _labels(x[rows], min(FAN, -(-len(rows) // max_cell)))
            known = np.unique(labels)
            left += [(rows, name + _STUCK)] if len(known) == 1 else [(rows[labels == k], f"{name}.{k:02d}") for k in known]
        return table.set_column(at, "__part", pa.array(names.tolist(), table.schema.field("__part").type))

    sizes = now.where(~F.endswith(F.col("__part"), F.lit(_STUCK))).groupBy(*_OF).agg(F.count("*").alias("n"))
    large = materialize(sizes.where((F.col("n") > max_cell) & (F.col("n") <= IN_TASK)).select(*_OF), "within")
    done = now.join(large, _OF, "left_semi").select(*now.columns).groupBy(*_OF).applyInArrow(split, now.schema)  # at most IN_TASK rows each
    return materialize(done.unionByName(now.join(large, _OF, "left_anti")), "split-within")


def _labels(x: np.ndarray, k: int) -> np.ndarray:
    """The nearest of k centres, of cells in the order of their ids, as a pass finds them."""
    spread = np.nanstd(x, axis=0)
    unit = np.nan_to_num(np.divide(x - np.nanmean(x, axis=0), spread, out=np.zeros_like(x), where=spread > 0))
    step = np.floor((np.clip(unit, -4.0, 4.0) + 4) * 4095 / 8).astype(np.int64)
    curve = sum(((step[:, i] >> b) & 1) << (b * x.shape[1] + i) for b in range(12) for i in range(x.shape[1]))
    rank = np.empty(len(x), np.int64)
    rank[np.argsort(curve, kind="stable")] = np.arange(len(x))
    near = rank * k // len(x)
    centres = np.zeros((k, x.shape[1]))
    for round_ in range(ROUNDS + 1):
        n = np.bincount(near, minlength=k)
        means = np.column_stack([np.bincount(near, unit[:, i], k) for i in range(x.shape[1])]) / np.maximum(n, 1)[:, None]
        renewed = np.where(n[:, None] > 0, means, centres)
        moved, centres = ((renewed - centres) ** 2).sum(), renewed
        near = _nearest(unit, centres)
        if round_ and moved <= STILL:
            break
    return near


def _sums(points: DataFrame, centres: Broadcast, units: list[str]) -> pd.DataFrame:
    """Numbers and sums of the points nearest to each centre: a row for a centre, added up in the tasks first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at, group = batch[units].to_numpy(), batch["g"].to_numpy()
            for g, places in pd.Series(group).groupby(group).indices.items():
                near, k = _nearest(at[places], centres.value[int(g)]), len(centres.value[int(g)])
                found = [np.bincount(near, minlength=k)] + [np.bincount(near, at[places, i], k) for i in range(len(units))]
                total[int(g)] = total.get(int(g), 0) + np.column_stack(found)
        for g, sums in total.items():
            yield pd.DataFrame(sums, columns=["n", *units]).assign(g=g, c=np.arange(len(sums)))[["g", "c", "n", *units]]

    schema = "g long, c long, n double, " + ", ".join(f"{c} double" for c in units)
    added = points.select("g", *units).mapInPandas(add, schema).where("n > 0").groupBy("g", "c")
    return added.agg(*[F.sum(c).alias(c) for c in ["n", *units]]).toPandas()
