"""Yearly series. Input tables carry ``year`` (see ``sources.papers``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.text import names_language_model, percent
from paperloom.operators.counting import with_totals


def yearly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def yearly_growth(df: DataFrame, series: str | None = None) -> DataFrame:
    """Change against the previous year that has papers, in percent; gap years are not filled.

    The window runs on yearly counts, of which the year range leaves a few dozen per series.
    """
    keys = [series] if series else []
    counts = df.groupBy(*keys, "year").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy(*keys).orderBy("year"))
    return counts.withColumn("growth_pct", (F.col("n") / before - 1) * 100).orderBy(*keys, "year")


def _recent(last_year: Column, years: int) -> Column:
    """Test on yearly counts. Reading n keeps it above the counting, next to the last year it compares with."""
    return F.when(F.col("n") > 0, F.col("year")) >= last_year - (years - 1)


def recent_share(df: DataFrame, years: int = taxonomy.RECENT_YEARS) -> DataFrame:
    """Papers of the last years and their share of all papers."""
    counts = df.groupBy("year").agg(F.count("*").alias("n"))
    return (
        with_totals(counts, ["n"], {"last_year": F.max("year")})
        .agg(
            F.sum(F.when(_recent(F.col("last_year"), years), F.col("n"))).alias("n_recent"),
            F.sum("n").alias("n_papers"),
        )
        .withColumn("pct_recent", percent(F.col("n_recent"), F.col("n_papers")))
    )


def recent_years(df: DataFrame, years: int = taxonomy.RECENT_YEARS) -> DataFrame:
    """Papers per year for the last years, newest first."""
    counts = df.groupBy("year").agg(F.count("*").alias("n"))
    return (
        with_totals(counts, ["n"], {"last_year": F.max("year")})
        .where(_recent(F.col("last_year"), years))
        .select("year", "n")
        .orderBy(F.desc("year"))
    )


def language_models_by_year(df: DataFrame, column: str = "model_primary_category", strict: bool = False) -> DataFrame:
    """Papers per year with and without large language models; both columns always exist."""
    flag = names_language_model(F.col(column), strict)
    return (
        df.groupBy("year")
        .agg(F.count_if(flag).alias("llm"), F.count_if(~flag).alias("non_llm"))
        .orderBy("year")
    )


def language_model_share_by_year(
    df: DataFrame, column: str = "model_primary_category", strict: bool = False
) -> DataFrame:
    """Share of large language models per year, with the values a stacked chart needs.

    ``llm_mid_area`` and ``non_llm_mid``/``llm_mid_bar`` are the middles of the stacked bands: the
    area chart stacks the other methods on top, the bar chart the language models.
    """
    by_year = language_models_by_year(df, column, strict)
    total = F.col("llm") + F.col("non_llm")
    return by_year.select(
        "year", "llm", "non_llm", total.alias("n"),
        percent(F.col("llm"), total).alias("llm_pct"),
        (F.col("llm") / 2).alias("llm_mid_area"),
        (F.col("non_llm") / 2).alias("non_llm_mid"),
        (F.col("non_llm") + F.col("llm") / 2).alias("llm_mid_bar"),
        (percent(F.col("llm"), total) > 0).alias("label_area"),
        (percent(F.col("llm"), total) > 2).alias("label_bar"),
    )
