"""Distances between cells: block joins, the spatial range join, low quantiles and scale factors.

The range join is an equi-join on grid squares of the radius' side: one side keeps its own square, the other is repeated for the
neighbouring squares, and the exact distance is a residual condition, so that Spark plans a hash or sort-merge join instead
of a nested loop.  Squares that hold too many cells are halved again and again, and what can't be halved is dealt to chunks, so that
no key gathers more than a bound of either side.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions.quantiles import exact_quantile
from covaria.operators.tiled import Rule, tiled
from covaria.sources.store import materialize

AXES = {"Euclidean2D": "xy", "Euclidean3D": "xyz"}
PAIR = ["slide", "ct_1", "ct_2"]
#: In tables of several slides, and among cells of one type, blocks with a side of no more cells than this are left out.
FEW = 5
SELF_LEVEL = 1e-4
#: Sides of grids that are counted to find a radius, each by the root of two smaller than the one before.
RADII = 20
#: Cells of one side that meet under one key of a join; squares and blocks with more are dealt to several keys.
CROWD = 1024
#: How often a crowded square is halved along each axis before its cells are dealt by hash.
HALVINGS = 8
#: Parts of crowded squares up to which their table is broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_LEAVES = 100_000


def scaled(cells: DataFrame, dist_type: str = "Euclidean2D", scales: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(slide, cell_type, cell_id, x, y[, z]) with each axis multiplied by its scale."""
    if dist_type not in AXES:
        raise ValueError(f"dist_type must be one of {sorted(AXES)}")
    if any(not (s > 0 and math.isfinite(s)) for s in scales):
        raise ValueError("axis scales must be positive")
    return cells.select("slide", "cell_type", "cell_id", *[(F.col(a) * F.lit(float(s))).alias(a) for a, s in zip(AXES[dist_type], scales, strict=False)])


def _sides(cells: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, str]:
    spark = cells.sparkSession
    table = F.broadcast(spark.createDataFrame(pairs, "ct_1 string, ct_2 string"))  # as many rows as pairs of types asked for
    axes = "".join(a for a in "xyz" if a in cells.columns)
    left = cells.join(table, F.col("cell_type") == F.col("ct_1")).select(*PAIR, F.col("cell_id").alias("i"), *[F.col(a).alias(f"{a}1") for a in axes])
    right = cells.join(table, F.col("cell_type") == F.col("ct_2")).select(*PAIR, F.col("cell_id").alias("j"), *[F.col(a).alias(f"{a}2") for a in axes])
    return left, right, axes


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides by ``keys`` and chunks: a left row, in one of its key's c1 chunks, meets all c2 of the right side, and the other way round.

    The number of partitions is given, for few bytes of crowded cells make many pairs and should not be put together into few tasks.
    """
    chunk = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    keys, tasks = [*keys, "u", "v"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("u", chunk("i", "c1")).withColumn("v", every("c2")).drop("c1", "c2")
    right = right.withColumn("v", chunk("j", "c2")).withColumn("u", every("c1")).drop("c1", "c2")
    return left.repartition(tasks, *keys), right.repartition(tasks, *keys).hint("merge"), keys


def _dealt_blocks(left: DataFrame, right: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sides of blocks, all of whose pairs are wanted, with join keys; large blocks in chunks."""
    count = lambda side, n: side.groupBy(*PAIR).agg(F.count("*").alias(n))
    large = count(left, "n1").join(count(right, "n2"), PAIR).where(F.greatest("n1", "n2") > crowd)
    large = materialize(large.select(*PAIR, *[F.ceil(F.col(f"n{k}") / crowd).alias(f"c{k}") for k in (1, 2)]), "large-blocks")
    if not large.limit(1).count():
        return left, right, PAIR
    large = _small(large)
    return _dealt(left.join(large, PAIR, "left"), right.join(large, PAIR, "left"), PAIR)


def _leaves(left: DataFrame, right: DataFrame, key: list[str], axes: str, radius: float, crowd: int) -> tuple[DataFrame, DataFrame] | None:
    """Squares (key) where over ``crowd`` cells of a side come together, and their parts (key, level, h per axis, c1, c2) with numbers of chunks; None if there are none.

    A square is halved along each axis, ``level`` times in all, until at most ``crowd`` left cells are in a part or HALVINGS are done.
    Only parts with left cells are listed.  ``h`` counts the parts of that level from the origin.
    """
    count = lambda side, n: side.groupBy(*key).agg(F.count("*").alias(n))
    crowded = materialize(count(left, "n1").join(count(right, "n2"), key, "full").where(F.greatest("n1", "n2") > crowd).select(*key), "crowded")
    if not crowded.limit(1).count():
        return None
    squares = _small(crowded)
    h = [f"h{a}" for a in axes]
    # numbers of left cells in the parts of every level; part of a part: its number halved
    finest = left.join(squares, key, "left_semi").groupBy(*key, *h).agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[F.shiftright(c, HALVINGS - k).alias(c) for c in h]) for k in range(HALVINGS + 1)]))
    parts = materialize(finest.select(*key, "n", levels.alias("at")).select(*key, "n", "at.*").groupBy(*key, "level", *h).agg(F.sum("n").alias("n")), "parts")
    above = parts.where(F.col("n") > crowd).select(*[F.col(c).alias(f"of_{c}") for c in [*key, "level", *h]])
    met = [F.col(c) == F.col(f"of_{c}") for c in key] + [F.col("level") == F.col("of_level") + 1] + [F.shiftright(c, 1) == F.col(f"of_{c}") for c in h]
    inner = parts.join(above, met, "left_semi")
    leaves = inner.unionByName(parts.where("level = 0")).where((F.col("n") <= crowd) | (F.col("level") == HALVINGS))
    leaves = materialize(leaves, "leaves")
    reached = _at_leaves(right, _small(leaves), key, axes, radius, "inner").groupBy(*key, "level", *h).agg(F.count("*").alias("m"))
    chunks = leaves.join(reached, [*key, "level", *h], "left")
    return squares, _small(materialize(chunks.select(*key, "level", *h, F.ceil(F.col("n") / crowd).alias("c1"), F.coalesce(F.ceil(F.col("m") / crowd), F.lit(1)).alias("c2")), "leaves"))


def _at_leaves(right: DataFrame, leaves: DataFrame, key: list[str], axes: str, radius: float, how: str) -> DataFrame:
    """Right cells at every leaf of their squares that has a place within the radius."""
    side = F.lit(float(radius)) / F.pow(F.lit(2.0), "level")
    gaps = [F.greatest(F.lit(0.0), F.col(f"h{a}") * side - F.col(f"{a}2"), F.col(f"{a}2") - (F.col(f"h{a}") + 1) * side) for a in axes]
    # a little more than the radius: rounding may not lose a pair, whose distance is compared afterwards
    reach = sum((g * g for g in gaps), F.lit(0.0)) <= F.lit(float(radius) ** 2 * (1 + 1e-6)) + F.lit(1e-12) * sum((F.col(f"{a}2") ** 2 for a in axes), F.lit(0.0))
    named = leaves.withColumnsRenamed({c: f"at_{c}" for c in key})
    return right.join(named, [right[c] == F.col(f"at_{c}") for c in key] + [reach], how).drop(*[f"at_{c}" for c in key])


def _dealt_squares(left: DataFrame, right: DataFrame, axes: str, radius: float, crowd: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sides with the squares in which they meet and join keys; a right cell is repeated for the squares around it.

    Pairs of one type are wanted both ways but met once: their right cells go to the squares that come later in order (``way`` 1) and their own (0).
    """
    key = [*PAIR, *[f"g{a}" for a in axes]]
    square = lambda a, n, times=1: F.floor(F.col(f"{a}{n}") / F.lit(float(radius) / times)).cast("long")
    left = left.withColumns({f"g{a}": square(a, 1) for a in axes} | {f"h{a}": square(a, 1, 2**HALVINGS) for a in axes})
    none = (0,) * len(axes)
    around = {o: F.struct(*[(square(a, 2) + F.lit(k)).alias(f"g{a}") for a, k in zip(axes, o, strict=True)], F.lit((o > none) - (o < none)).alias("way")) for o in itertools.product((-1, 0, 1), repeat=len(axes))}
    later = F.array(*[at for o, at in around.items() if o >= none])
    right = right.withColumn("near", F.explode(F.when(F.col("ct_1") == F.col("ct_2"), later).otherwise(F.array(*around.values()))))
    right = right.select(*PAIR, "j", *[f"{a}2" for a in axes], "near.*")
    found = _leaves(left, right, key, axes, radius, crowd)
    h = [f"h{a}" for a in axes]
    if found is None:
        return left.drop(*h), right, key
    squares, leaves = found
    named = leaves.withColumnsRenamed({c: f"at_{c}" for c in [*key, *h]})
    within = [left[c] == F.col(f"at_{c}") for c in key] + [F.expr(f"shiftright({c}, {HALVINGS} - level)") == F.col(f"at_{c}") for c in h]
    left = left.join(named, within, "left").drop(*[f"at_{c}" for c in key], *h).withColumnsRenamed({f"at_{c}": c for c in h})
    marked = right.join(squares.withColumn("crowded", F.lit(True)), key, "left")
    # in a crowded square, what reaches no part that has left cells has no partner there
    right = _at_leaves(marked, leaves, key, axes, radius, "left").where("crowded IS NULL OR level IS NOT NULL").drop("crowded")
    filled = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ["level", *h]}  # squares that are not crowded are one part
    return _dealt(left.withColumns(filled), right.withColumns(filled), [*key, "level", *h])


def distance_edges(cells: DataFrame, pairs: list[tuple[str, str]], radius: float | None = None, crowd: int = CROWD) -> DataFrame:
    """(slide, ct_1, ct_2, i, j, d) for all pairs of cells of the blocks, or for those within ``radius``.

    A cell is no neighbour of itself.  Without a radius the result is quadratic by nature.  Cells are counted first, by blocks or squares: where
    more than ``crowd`` of a side would meet under one key, both sides are dealt to several.
    """
    if radius is not None and not (radius > 0 and math.isfinite(radius)):
        raise ValueError("radius must be a positive number")
    left, right, axes = _sides(cells, pairs)
    d = F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}2")) ** 2 for a in axes), F.lit(0.0)))
    if radius is None:
        left, right, keys = _dealt_blocks(left, right, crowd)
        return left.join(right, keys).select(*PAIR, "i", "j", d.alias("d")).where("ct_1 <> ct_2 OR i <> j")
    left, right, keys = _dealt_squares(left, right, axes, radius, crowd)
    found = left.join(right, keys).where("ct_1 <> ct_2 OR way > 0 OR i < j").select(*PAIR, "i", "j", d.alias("d")).where(F.col("d") <= float(radius))
    if all(a != b for a, b in pairs):
        return found
    once, back = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    ways = F.explode(F.when(F.col("ct_1") == F.col("ct_2"), F.array(once, back)).otherwise(F.array(once)))
    return found.select(*PAIR, ways.alias("ends"), "d").select(*PAIR, "ends.i", "ends.j", "d")


def block_sizes(cells: DataFrame, pairs: list[tuple[str, str]], skip_few: bool = False) -> DataFrame:
    """(slide, ct_1, ct_2, n_1, n_2, n_pairs, level): sizes of each block's sides and the level of its low quantile."""
    counts = cells.groupBy("slide", "cell_type").agg(F.count("*").alias("n"))
    table = F.broadcast(cells.sparkSession.createDataFrame(pairs, "ct_1 string, ct_2 string"))
    left = counts.join(table, F.col("cell_type") == F.col("ct_1")).select(*PAIR, F.col("n").alias("n_1"))
    sizes = left.join(counts.select("slide", F.col("cell_type").alias("ct_2"), F.col("n").alias("n_2")), ["slide", "ct_2"])
    own = F.col("ct_1") == F.col("ct_2")
    if skip_few:
        sizes = sizes.where((F.col("n_1") > FEW) & (F.col("n_2") > FEW))
    level = F.when(own, F.lit(SELF_LEVEL)).otherwise(F.least(F.lit(1e-3), 2.0 / F.greatest("n_1", "n_2")))
    return sizes.select(*PAIR, "n_1", "n_2", F.when(own, F.col("n_1") * (F.col("n_1") - 1)).otherwise(F.col("n_1") * F.col("n_2")).alias("n_pairs"), level.alias("level"))


def sufficient_radius(cells: DataFrame, sizes: DataFrame) -> float | None:
    """A radius within which every block has the pairs that its low quantile needs, and one of them apart, found without joining cells; None if only all pairs do.

    Cells in one square of a grid are no farther from each other than its diagonal, so counts of the cells in the squares bound the pairs of a
    radius from below.  Grids of RADII sides are counted at once: occupied squares times types, and their pairs by type.
    """
    axes = [a for a in "xyz" if a in cells.columns]
    box = cells.agg(*[f(a).alias(f"{a}{n}") for a in axes for n, f in ((0, F.min), (1, F.max))]).first()
    extent = math.sqrt(sum(((box[f"{a}1"] or 0.0) - (box[f"{a}0"] or 0.0)) ** 2 for a in axes))
    if not extent:
        return None
    radii = [extent / 2 / 2 ** (k / 2) for k in range(1, RADII + 1)]
    grids = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), *[F.floor((F.col(a) - F.lit(box[f"{a}0"])) / F.lit(r / math.sqrt(len(axes)))).alias(f"g{a}") for a in axes]) for k, r in enumerate(radii)]))
    # the last grid are the places themselves: pairs of one place are at distance zero
    own = F.struct(F.lit(-1).alias("grid"), *[F.xxhash64(F.col(a) + F.lit(0.0)).alias(f"g{a}") for a in axes])
    at = cells.select("slide", "cell_type", grids.alias("g")).unionByName(cells.select("slide", "cell_type", own.alias("g")))
    counts = materialize(at.groupBy("slide", "cell_type", "g").agg(F.count("*").alias("n")), "squares")
    blocks = F.broadcast(sizes.where("n_pairs > 0").select(*PAIR, "n_pairs", "level"))  # a row for each block
    one, two = (counts.select("slide", F.col("cell_type").alias(f"ct_{k}"), "g", F.col("n").alias(f"n{k}")) for k in (1, 2))
    met = one.join(blocks, ["slide", "ct_1"]).join(two, ["slide", "ct_2", "g"])
    pairs = F.when(F.col("ct_1") == F.col("ct_2"), F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2"))
    seen = met.groupBy(*PAIR, "n_pairs", "level", F.col("g.grid").alias("grid")).agg(F.sum(pairs).alias("seen"))
    zero = seen.where("grid = -1").select(*PAIR, F.col("seen").alias("together"))
    enough = seen.where("grid >= 0").join(zero, PAIR, "left").where("seen >= ceil((n_pairs - 1) * level) + 1 AND seen > coalesce(together, 0)").groupBy(*PAIR).agg(F.max("grid").alias("grid"))
    found = sizes.where("n_pairs > 0").join(enough, PAIR, "left").agg(F.min(F.coalesce("grid", F.lit(-1)))).first()[0]
    return radii[found] * (1 + 1e-9) if found is not None and found >= 0 else None


def low_quantiles(cells: DataFrame, pairs: list[tuple[str, str]], skip_few: bool = False) -> DataFrame:
    """block_sizes() with each block's smallest positive distance and low quantile (zeros counted as the former).

    Only the smallest distances matter: one range join within the radius that sufficient_radius() finds sees them all.
    """
    sizes = materialize(block_sizes(cells, pairs, skip_few), "blocks")
    edges = materialize(distance_edges(cells, pairs, sufficient_radius(cells, sizes)), "near-edges")
    near = edges.groupBy(*PAIR).agg(F.count("*").alias("seen"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("least"))
    near = materialize(near, "near")
    filled = edges.join(near.select(*PAIR, "least"), PAIR).join(sizes, PAIR)
    values = filled.select(*PAIR, F.when(F.col("d") == 0, F.col("least")).otherwise(F.col("d")).alias("d"), ((F.col("n_pairs") - 1) * F.col("level")).alias("h"))
    # among the pairs seen, all others being farther, the wanted rank is at share h / (seen - 1)
    shares = values.join(near.select(*PAIR, "seen"), PAIR).withColumn("p", F.coalesce(F.try_divide(F.col("h"), F.col("seen") - 1), F.lit(0.0)))
    shares = materialize(shares.select(*PAIR, "d", "p"), "shares")
    low = exact_quantile(shares, PAIR, "d", F.col("p"), "low")
    return materialize(sizes.join(near.select(*PAIR, "least"), PAIR, "left").join(low, PAIR, "left"), "low")


def scale_factor(quantiles: DataFrame, target: float = 0.01, normalize: bool = True) -> float:
    """What distances are multiplied by, so that the smallest low quantile of all blocks becomes ``target``."""
    if not (target > 0 and math.isfinite(target)):
        raise ValueError("normalize_target must be a positive number")
    low = quantiles.agg(F.min("low")).first()[0]
    return target / low if normalize and low else 1.0


def conditioned(edges: DataFrame, quantiles: DataFrame, factor: float | F.Column = 1.0, truncate: bool = True) -> DataFrame:
    """Edges with zero distances replaced, small ones raised to the block's low quantile, and all multiplied by ``factor`` (a number or a column of ``quantiles``)."""
    joined = edges.join(quantiles.select(*PAIR, "least", "low", *(c for c in ("factor",) if c in quantiles.columns)), PAIR)
    d = F.when(F.col("d") == 0, F.col("least")).otherwise(F.col("d"))
    return joined.select(*PAIR, "i", "j", ((F.greatest(d, F.col("low")) if truncate else d) * factor).alias("d"))


def compute_distance(cells: DataFrame, pairs: list[tuple[str, str]], dist_type: str = "Euclidean2D", normalize: bool = True, truncate: bool = True, normalize_target: float = 0.01, scales=(1.0, 1.0, 1.0), skip_few: bool = False) -> DataFrame:
    """All distances of the blocks, conditioned and normalised: (slide, ct_1, ct_2, i, j, d)."""
    at = scaled(cells, dist_type, scales)
    low = low_quantiles(at, pairs, skip_few)
    return conditioned(distance_edges(at, pairs), low, scale_factor(low, normalize_target, normalize), truncate)


def distance_totals(at: DataFrame, pairs: list[tuple[str, str]], quantiles: DataFrame | None = None, factor: float = 1.0, truncate: bool = True) -> DataFrame:
    """(slide, ct_1, ct_2, n, least, total): number, smallest and sum of all distances of the blocks, with ``quantiles`` as conditioned() makes them.

    All pairs are looked at, tile by tile where they are computed; what is shuffled are cells, once for each chunk they meet.
    """
    blocks = sorted(tuple(r[c] for c in [*PAIR, "n_1", "n_2"]) for r in block_sizes(at, pairs).collect())
    rules = [Rule(0.0, 0.0, 1.0, (math.inf,))] * len(blocks)
    if quantiles is not None:
        found = {tuple(r[c] for c in PAIR): r for r in quantiles.collect()}
        blocks = [b for b in blocks if b[:3] in found]
        of = [found[b[:3]] for b in blocks]
        rules = [Rule(math.nan if r["least"] is None else r["least"], (r["low"] or 0.0) if truncate else 0.0, factor, (math.inf,)) for r in of]
    return tiled(at, blocks, [1.0], 1.0, dict(enumerate(rules)), True).totals()


def compute_distance_totals(cells: DataFrame, pairs: list[tuple[str, str]], dist_type: str = "Euclidean2D", normalize: bool = True, truncate: bool = True, normalize_target: float = 0.01, scales=(1.0, 1.0, 1.0), skip_few: bool = False) -> DataFrame:
    """distance_totals() of what compute_distance() returns."""
    at = scaled(cells, dist_type, scales)
    low = low_quantiles(at, pairs, skip_few)
    return distance_totals(at, pairs, low, scale_factor(low, normalize_target, normalize), truncate)
