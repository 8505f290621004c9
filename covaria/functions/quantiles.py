"""Exact quantiles and tail probabilities that Spark has no scalable built-in for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covaria.sources.store import materialize

#: Bins for each doubling of a value; a bin's distinct values are the most that one task sorts.
BINS = 64
#: Bins that hold order statistics, two a group at most, up to which they are broadcast; beyond that a shuffled join meets the values.
BROADCAST_BINS = 100_000


def _bin(v) -> F.Column:
    step = lambda x: (F.floor(F.log2(x) * BINS) + BINS * 2048).cast("long")
    return F.when(v > 0, step(v)).when(v < 0, -step(-v)).otherwise(F.lit(0).cast("long"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, p, name: str = "quantile") -> DataFrame:
    """Linearly interpolated quantile of ``value`` for each group of ``keys``; ``p`` is a number or a column constant in each group.

    Values are counted by logarithmic bins, which combines map-side; of the bins that hold the two order statistics the distinct values are counted,
    which again combines map-side, and only those, each with its count, are sorted.  No group is gathered by one task, and
    however often a value occurs, one row of it reaches the task that ranks it.
    """
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    plain = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("__v"), p.cast("double").alias("__p")).withColumn("__bin", _bin(F.col("__v")))
    counts = plain.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"), F.max("__p").alias("__p"))
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    h = (F.sum("__n").over(group) - 1) * F.max("__p").over(group)
    ranked = counts.withColumn("__h", h).withColumn("__before", F.coalesce(F.sum("__n").over(ordered), F.lit(0)))
    inside = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__n"))
    lo, hi = F.floor("__h"), F.ceil("__h")
    wanted = ranked.where(inside(lo) | inside(hi)).select(*keys, "__bin", "__h", "__before")
    wanted = materialize(wanted, "wanted-bins")  # two rows for each group at most
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_BINS else wanted
    on = plain.alias("a").join(wanted.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__bin"]])
    values = on.select(*[F.col(f"a.{k}") for k in keys], F.col("a.__bin").alias("__bin"), "__v", "__h", "__before").groupBy(*keys, "__bin", "__h", "__before", "__v").agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*keys, "__bin").orderBy("__v")) + F.col("__before")
    at = values.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__m"))
    holds = lambda r: (F.col("__from") <= r) & (r < F.col("__to"))
    low, high = F.max(F.when(holds(lo), F.col("__v"))), F.max(F.when(holds(hi), F.col("__v")))
    return at.where(holds(lo) | holds(hi)).groupBy(*keys).agg((low + (F.max("__h") - F.floor(F.max("__h"))) * (high - low)).alias(name))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan") if math.isnan(t) or df <= 0 else 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
