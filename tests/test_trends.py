import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import curve, trends


def papers(spark, counts):
    rows = [(float(y), m) for y, methods in counts.items() for m in methods]
    return spark.createDataFrame(rows, "year double, model_primary_category string")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_growth_skips_gap_years(spark):
    df = papers(spark, {2000: ["a"] * 2, 2003: ["a"] * 3, 2004: ["a"] * 3})
    assert tuples(trends.yearly_growth(df)) == [(2000.0, 2, None), (2003.0, 3, 50.0), (2004.0, 3, 0.0)]


def test_growth_per_series(spark):
    df = papers(spark, {2000: ["a", "b", "b"], 2001: ["a", "a", "b"]})
    assert tuples(trends.yearly_growth(df, "model_primary_category")) == [
        ("a", 2000.0, 1, None), ("a", 2001.0, 2, 100.0), ("b", 2000.0, 2, None), ("b", 2001.0, 1, -50.0),
    ]


def test_recent_window_counts_back_from_the_last_year(spark):
    df = papers(spark, {2000: ["a"], 2015: ["a"] * 3, 2016: ["a"] * 4, 2020: ["a"] * 2})
    assert tuples(trends.recent_share(df)) == [(6, 10, 60.0)]
    assert tuples(trends.recent_years(df)) == [(2020.0, 2), (2016.0, 4)]


def test_language_models_by_year_has_both_columns(spark):
    df = papers(spark, {2000: ["Large Language Models (LLMs)", None, "x", "y"], 2001: ["x"]})
    assert tuples(trends.language_models_by_year(df)) == [(2000.0, 1, 3), (2001.0, 0, 1)]
    first, second = tuples(trends.language_model_share_by_year(df))
    assert first == (2000.0, 1, 3, 4, 25.0, 0.5, 1.5, 3.5, True, True)
    assert second == (2001.0, 0, 1, 1, 0.0, 0.0, 0.5, 1.0, False, False)


def test_four_points_give_their_cubic():
    x, y = np.array([2000.0, 2001, 2003, 2007]), np.array([5.0, 9, 4, 20])
    grid, [value] = curve.smooth(x, y[None, :], 50)
    fit = np.polyfit(x - 2003, y, 3)
    assert np.allclose(value, np.maximum(np.polyval(fit, grid - 2003), 0))


def test_a_cubic_is_reproduced_on_uneven_points():
    x = np.array([0.0, 1, 1.5, 4, 6, 7, 11])
    y = 3 + x**2 / 2 + x**3 / 10
    grid, values = curve.smooth(x, np.stack([y, 2 * y]), 101)
    assert np.allclose(values[0], 3 + grid**2 / 2 + grid**3 / 10)
    assert np.allclose(values[1], 2 * values[0])


def test_curve_is_smooth_inside():
    rng = np.random.default_rng(1)
    x = np.arange(2000.0, 2012)
    y = rng.integers(500, 600, 12).astype(float)
    grid, [value] = curve.smooth(x, y[None, :], 11 * 1000 + 1)
    assert np.allclose(value[::1000], y)
    step = grid[1] - grid[0]
    second = np.diff(value, 2) / step**2
    assert np.abs(np.diff(second)).max() < 1.5 * np.abs(np.diff(value, 3)).mean() / step**2 * 10 + 1


def test_short_series_are_returned_as_they_are(spark):
    df = papers(spark, {2000: ["a", "a"], 2001: ["a"], 2004: ["a"]})
    assert sorted(tuples(curve.trend_curves(df, "model_primary_category"))) == [("a", 2000.0, 2.0), ("a", 2001.0, 1.0), ("a", 2004.0, 1.0)]


def test_series_with_different_years(spark):
    df = spark.createDataFrame(
        [(float(y), s) for s, years in {"a": range(2000, 2006), "b": range(2000, 2006), "c": (2001, 2003, 2004, 2009), "d": (2001,)}.items() for y in years],
        "year double, s string",
    )
    got = {}
    for r in curve.trend_curves(df, "s", points=7).collect():
        got.setdefault(r.series, []).append((r.x, round(r.y, 9)))
    assert {s: len(v) for s, v in got.items()} == {"a": 7, "b": 7, "c": 7, "d": 1}
    assert all(y == 1.0 for v in got.values() for _, y in v)
    assert got["a"] == got["b"] and got["c"][0][0] == 2001.0 and got["c"][-1][0] == 2009.0


def test_curves_pass_through_the_counts(spark):
    counts = {2000: 4, 2001: 1, 2002: 9, 2003: 2, 2004: 7}
    df = papers(spark, {y: ["a"] * n for y, n in counts.items()})
    got = {r.x: r.y for r in curve.trend_curves(df, "model_primary_category", points=9).collect()}
    assert len(got) == 9
    assert all(abs(got[float(y)] - n) < 1e-9 for y, n in counts.items())
    assert min(got.values()) >= 0


def test_hot_series_is_counted_before_it_is_grouped(spark):
    df = spark.range(50000).select((F.col("id") % 6 + 2000).cast("double").alias("year"), F.lit("hot").alias("s"))
    plan = curve.trend_curves(df, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("collect_list") < plan.rindex("count(1)")
    assert curve.trend_curves(df, "s").count() == 300


def dense_second_derivatives(h, y):
    """The same conditions as one full system."""
    n = y.shape[1]
    inner = np.arange(1, n - 1)
    system, right = np.zeros((n, n)), np.zeros_like(y)
    system[inner, inner - 1], system[inner, inner], system[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    right[:, inner] = 6 * np.diff(np.diff(y, axis=1) / h, axis=1)
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(system, right.T).T


def test_sweeps_equal_the_full_system():
    rng = np.random.default_rng(2)
    for n in (4, 5, 6, 30, 200):
        h, y = rng.uniform(0.1, 5, n - 1), rng.normal(size=(3, n)) * 100
        assert np.allclose(curve.second_derivatives(h, y), dense_second_derivatives(h, y), rtol=1e-8, atol=1e-8)


def test_many_years_take_linear_time():
    x = np.cumsum(np.random.default_rng(3).uniform(0.5, 2, 100_000))
    start = time.perf_counter()
    _, values = curve.smooth(x, np.sin(x / 50)[None, :] + 2, 1000)
    assert time.perf_counter() - start < 2
    grid = np.linspace(x[0], x[-1], 1000)
    assert np.abs(values[0] - np.sin(grid / 50) - 2).max() < 1e-4


def test_too_many_years_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(curve, "MOST_YEARS", 50)
    df = spark.range(60).select(F.col("id").cast("double").alias("year"), F.lit("a").alias("s"))
    with pytest.raises(Exception, match="more than 50 different years"):
        curve.trend_curves(df, "s").collect()
    assert curve.trend_curves(df.where("year < 50"), "s").count() == 300
