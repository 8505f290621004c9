"""Running moments of a stream of feature rows, per slide and type, from which standardisation and Gram corrections follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(rows: DataFrame, watermark: str | None = None, time_col: str = "ts", window: str | None = None) -> DataFrame:
    """(…, slide, cell_type, gene, n, total, squares) of (slide, cell_type, gene, value): sums that add up over micro-batches.

    With a watermark and a window the sums are kept per tumbling window and late rows beyond the watermark are left out.
    """
    keys = [F.col("slide"), F.col("cell_type"), F.col("gene")]
    if watermark:
        rows = rows.withWatermark(time_col, watermark)
    if window:
        keys.insert(0, F.window(time_col, window).alias("window"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("squares"))
