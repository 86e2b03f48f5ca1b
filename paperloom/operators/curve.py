"""Smooth trend curves through yearly counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import taxonomy


MOST_YEARS = 100_000  # different x values of a series


def second_derivatives(h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the spline at all points, a row for each series, in time linear in the points.

    The conditions at both ends give the first value from the second and third, and the last likewise. Put
    into the equations of the inner points they leave a system of three diagonals in which the middle one
    prevails, so it is solved by one sweep down and one up, for all series at once.
    """
    n = y.shape[1]
    below, middle, above = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    middle[0] += h[0] * (h[0] + h[1]) / h[1]
    above[0] -= h[0] ** 2 / h[1]
    middle[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    below[-1] -= h[-1] ** 2 / h[-2]
    right = np.ascontiguousarray(6 * np.diff(np.diff(y, axis=1) / h, axis=1).T)
    low, mid, up = below.tolist(), middle.tolist(), above.tolist()
    for k in range(1, n - 2):
        factor = low[k] / mid[k - 1]
        mid[k] -= factor * up[k - 1]
        right[k] -= factor * right[k - 1]
    bend = np.empty((n, y.shape[0]))
    bend[n - 2] = right[-1] / mid[-1]
    for k in range(n - 4, -1, -1):
        bend[k + 1] = (right[k] - up[k] * bend[k + 2]) / mid[k]
    bend[0] = ((h[0] + h[1]) * bend[1] - h[0] * bend[2]) / h[1]
    bend[-1] = ((h[-2] + h[-1]) * bend[-2] - h[-1] * bend[-3]) / h[-2]
    return bend.T


def smooth(x: np.ndarray, y: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Cubic through all points, third derivative continuous at the second and last-but-one point.

    ``y`` holds one row per series over the same ``x``. Needs more than three points; fewer are
    returned as they are. Values are cut off at 0.
    """
    n = len(x)
    if n <= 3:
        return x, y
    h = np.diff(x)
    bend = second_derivatives(h, y)
    grid = np.linspace(x[0], x[-1], points)
    piece = np.clip(np.searchsorted(x, grid, side="right") - 1, 0, n - 2)
    left, rest, step = grid - x[piece], x[piece + 1] - grid, h[piece]
    value = (
        (bend[:, piece] * rest**3 + bend[:, piece + 1] * left**3) / (6 * step)
        + (y[:, piece] / step - bend[:, piece] * step / 6) * rest
        + (y[:, piece + 1] / step - bend[:, piece + 1] * step / 6) * left
    )
    return grid, np.maximum(value, 0)


def trend_curves(df: DataFrame, series: str, points: int = taxonomy.TREND_POINTS) -> DataFrame:
    """One curve per series.

    Papers are counted per series and year first, so a series becomes one short row of years and
    counts, however many papers it has; one of more than MOST_YEARS different years is an error. Python sees
    batches of such rows and fits all series of a batch that share their years at once.
    """
    counts = (
        df.where(F.col(series).isNotNull() & F.col("year").isNotNull())
        .groupBy(F.col(series).cast("string").alias("series"), "year")
        .agg(F.count("*").cast("double").alias("n"))
    )
    # The size is checked on counts of years, before a series is gathered; both use the same partitions.
    too_many = F.raise_error(F.lit(f"a series has more than {MOST_YEARS} different years")).cast("boolean")
    years = F.count("*").over(Window.partitionBy("series"))
    counts = counts.withColumn("years", years).where(F.when(F.col("years") > MOST_YEARS, too_many).otherwise(True))
    rows = counts.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("p"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for years, group in batch.groupby(batch["x"].map(tuple)):
                grid, values = smooth(np.array(years), np.stack(group["y"].to_numpy()), points)
                yield pd.DataFrame({"series": group["series"].to_numpy(), "x": [grid] * len(group), "y": list(values)})

    fitted = rows.select("series", F.col("p.year").alias("x"), F.col("p.n").alias("y")).mapInPandas(
        fit, "series string, x array<double>, y array<double>"
    )
    return fitted.select("series", F.inline(F.arrays_zip("x", "y")))
