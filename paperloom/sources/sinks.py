"""Writing tables, per-category exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.lists import list_column
from paperloom.functions.text import file_key


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Lists become JSON text; CSV has no lists."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in lists}) if lists else df


# The writer would drop blanks at the ends of a text by default.
CSV_OPTIONS = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flatten_for_csv(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def _exploded(df: DataFrame, column: str) -> DataFrame:
    labels = F.array_distinct(list_column(df, column))
    return df.withColumn("category", F.explode(labels)).where(F.col("category").isNotNull())


def _counted(df: DataFrame, column: str) -> DataFrame:
    """``category, n, category_file``, a row for each category.

    Where several categories would share a file key, all but the first by name carry a mark of their own.
    """
    same = Window.partitionBy(file_key(F.col("category"))).orderBy("category")
    marked = F.concat(file_key(F.col("category")), F.lit("~"), F.substring(F.md5("category"), 1, 8))
    key = F.when(F.row_number().over(same) == 1, file_key(F.col("category"))).otherwise(marked)
    return _exploded(df.select(column), column).groupBy("category").agg(F.count("*").alias("n")).withColumn("category_file", key)


def per_category(df: DataFrame, column: str = "material_categories") -> DataFrame:
    """One row per paper and distinct category of it, with the file key of the category.

    Only the categories whose key another one has are looked up, in one map that is a scalar of the plan
    and empty as a rule; the rows meet no join.
    """
    marked = _counted(df, column).where(F.col("category_file") != file_key(F.col("category")))
    keys = marked.agg(F.map_from_entries(F.collect_list(F.struct("category", "category_file")))).scalar()
    rows = _exploded(df, column).withColumn("_keys", keys)
    return rows.withColumn("category_file", F.coalesce(F.try_element_at("_keys", F.col("category")), file_key(F.col("category")))).drop("_keys")


def export_by_category(df: DataFrame, path: str, column: str = "material_categories", fmt: str = "csv") -> None:
    """One folder per category.

    Rebalancing gathers a category into few files, and splits a category that holds a large part
    of the papers over many tasks.
    """
    rows = per_category(df, column).drop("category").hint("rebalance", "category_file")
    writer = flatten_for_csv(rows).write.mode("overwrite").partitionBy("category_file")
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def category_manifest(df: DataFrame, column: str = "material_categories") -> DataFrame:
    """Papers per category and the folder that the export writes for it: one scan, one count."""
    counted = _counted(df, column)
    return counted.select("category", "n", F.concat(F.lit("category_file="), "category_file").alias("filename")).orderBy("category")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, in order; part files follow each other."""
    lines.orderBy("position").select("line").write.mode("overwrite").text(path)
