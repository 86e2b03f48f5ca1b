"""Whole steps: read, do the work, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators.scoring import Scorer, Task, classify
from paperloom.plans.report_text import material_lines, method_lines, summary_lines
from paperloom.plans.reports import material_report, method_report, summary_report
from paperloom.sources.papers import in_year_range, read_papers_csv, read_papers_parquet, standardise
from paperloom.sources.sinks import write_csv, write_parquet, write_report


def load_papers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Standardised papers; Parquet lets filters and column choices reach the scan."""
    return standardise(read_papers_csv(spark, path) if fmt == "csv" else read_papers_parquet(spark, path))


def save_papers(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    (write_csv if fmt == "csv" else write_parquet)(df, path)


def run_task(
    spark: SparkSession, source: str, target: str, results: str, task: Task, scorer: Scorer,
    fmt: str = "parquet", partitions: int | None = None, papers_per_commit: int = 1_000, retry_errors: bool = False,
    max_calls: int | None = None,
) -> DataFrame:
    """One classification step from table to table. Rerun the same call after an interruption."""
    papers = load_papers(spark, source, fmt)
    save_papers(classify(papers, scorer, task, results, partitions, papers_per_commit, retry_errors, max_calls), target, fmt)
    return load_papers(spark, target, fmt)


def write_reports(papers: DataFrame, folder: str) -> None:
    """The material, method and summary reports as text."""
    write_report(material_lines(material_report(papers)), f"{folder}/material_statistics")
    write_report(method_lines(method_report(papers)), f"{folder}/method_statistics")
    write_report(summary_lines(summary_report(in_year_range(papers)), papers.columns), f"{folder}/summary_statistics")
