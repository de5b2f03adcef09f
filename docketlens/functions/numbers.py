"""Column helpers for numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Value within [low, high]; null stays null."""
    return F.when(value < low, F.lit(float(low))).when(value > high, F.lit(float(high))).otherwise(value)


def step_lookup(x: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """Linear interpolation in a table of (x, y), constant beyond its ends."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(float(points[-1][1])))
