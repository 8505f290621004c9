"""Places of cells along a Z-curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.functions.ranks import with_rank

#: Bits of each coordinate that a place on the curve is made of.
_BITS = 16


def _spread(v: F.Column) -> F.Column:
    """Bit i of 16 moves to bit 2i."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def places(cells: DataFrame) -> DataFrame:
    """(slide, cell_type, cell_id, place): the cells of each slide and type along a Z-curve over their extent."""
    group = ["slide", "cell_type"]
    box = cells.groupBy(*group).agg(*[f(a).alias(f"{a}{n}") for a in "xy" for n, f in ((0, F.min), (1, F.max))])
    at = cells.join(box, group)
    most = float((1 << _BITS) - 1)
    step = lambda a: F.coalesce(F.floor(F.try_divide(F.col(a) - F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"{a}0")) * most), F.lit(0)).cast("long")
    curve = _spread(step("x")).bitwiseOR(F.shiftleft(_spread(step("y")), 1))
    return with_rank(at.select(*group, "cell_id", curve.alias("curve")), group, ["curve", "cell_id"], "place").drop("curve")
