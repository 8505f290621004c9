"""Ranks within groups of any size, that no task has to order alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.sources.store import materialize

#: Stretches of rows, one for each range and group, up to which their first ranks are broadcast (some 100 bytes each).
BROADCAST_RUNS = 200_000


def with_rank(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with its place in each group of ``keys``, from 0 and in the given order; ``size``: with the group's size too.

    Rows are dealt by ranges of keys and order, so that a hot group fills many partitions; a partition counts its rows of each group,
    and running sums of these counts, as many as there are partitions and groups, give each stretch its first rank.  Rows equal in keys and
    order keep any order among themselves, the same for whatever is computed from the result.
    """
    taken = {c.lower() for c in df.columns}
    stretch, line, shift, total = (next(n for n in (f"{'_' * k}{x}" for k in range(2, 99)) if n not in taken) for x in ("range", "line", "shift", "total"))
    order = [*keys, *order]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(stretch, F.spark_partition_id()).withColumn(line, F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranked")
    runs = dealt.groupBy(stretch, *keys).agg(F.count("*").alias("n"), F.min(line).alias("first"))
    group = Window.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col(stretch).alias("r"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], (F.coalesce(before, F.lit(0)) - F.col("first")).alias(shift), F.sum("n").over(group).alias(total))
    runs = materialize(runs, "runs")
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    same = F.col(stretch) == F.col("r")
    for i, k in enumerate(keys):
        same = same & dealt[k].eqNullSafe(F.col(f"k{i}"))
    kept = [dealt[c] for c in df.columns]
    return dealt.join(runs, same).select(*kept, (F.col(line) + F.col(shift)).alias(name), *([F.col(total).alias(size)] if size else []))
