"""Reading tables of papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import taxonomy
from paperloom.functions.lists import list_column
from paperloom.sources import csv_ranges
from paperloom.sources.folders import Folder


def read_papers_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Paper export(s) as CSV with a header; every column is text unless a schema says otherwise.

    ``path`` is a file, a folder or a pattern. Columns go by name: files may have them in different order,
    or lack some, which are null then. Abstracts may hold line breaks; large files are read by many tasks all
    the same (see ``csv_ranges``). A schema must name the columns in the order of every file, else it is an
    error. A store that only Spark reaches is read by Spark's own reader: all files must have the same header
    there, and a file is one task unless ``multi_line`` is off.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if Folder(spark, path).scheme in csv_ranges.STORES:
        found = csv_ranges.read_csv_ranges(spark, path, schema=schema)
        # Texts for a missing value are looked for in the columns of the files, not in names of folders.
        folders = csv_ranges.folder_columns(spark, path)
        return normalise_missing(found, columns=[c for c in found.columns if c not in folders])
    options = {"header": "true", "multiLine": str(multi_line).lower(), "escape": '"', "encoding": "UTF-8"}
    reader = spark.read.options(**options)
    return normalise_missing((reader.schema(schema).option("enforceSchema", "false") if schema is not None else reader).csv(path))


def read_papers_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normalise_missing(
    df: DataFrame, tokens: Sequence[str] = tuple(taxonomy.NA_TOKENS), columns: Sequence[str] | None = None
) -> DataFrame:
    """Texts that stand for a missing value become null, in every text column or in the given ones."""

    def cleaned(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType) and (columns is None or field.name in columns):
            return F.when(~column.isin(*tokens), column).alias(field.name)
        return column

    return df.select(*[cleaned(field) for field in df.schema.fields])


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that the table has."""
    return next((name for name in names if name in df.columns), None)


def rename_columns(df: DataFrame) -> DataFrame:
    """Export column names to short names; the first present name of each kind is taken."""
    renames = {}
    for short, names in taxonomy.COLUMN_NAMES.items():
        found = first_present(df, [short, *names])
        if found and found != short:
            renames[found] = short
    return df.withColumnsRenamed(renames)


def parse_year(value: Column) -> Column:
    """Year as a number; whatever is not a number becomes null. Fractions survive."""
    return value.try_cast("double")


def with_year(df: DataFrame, source: str = "publication_year") -> DataFrame:
    """Adds ``year``; a table without a year column gets one constant year."""
    if source in df.columns:
        return df.withColumn("year", parse_year(F.col(source)))
    return df.withColumn("year", F.lit(taxonomy.YEAR_IF_ABSENT))


def in_year_range(df: DataFrame, low: int = taxonomy.YEAR_MIN, high: int = taxonomy.YEAR_MAX) -> DataFrame:
    """Papers with a year from ``low`` to ``high``, both included; null and NaN drop out."""
    return df.where(F.col("year").between(low, high))


def with_paper_id(df: DataFrame) -> DataFrame:
    """Keeps ``paper_id`` where the table has one, else derives it from the content.

    The content is all that a prompt shows, and the year. Equal content gives an equal id, so copies
    of a paper are scored once. Ids that are whole numbers become 64 bits wide; derived ones are negative.
    """
    fields = ("article_title", "author_keywords", "keywords_plus", "abstract", "publication_year")
    parts = [c for c in fields if c in df.columns]
    # A null and an empty text must not give the same id, nor may text move between fields.
    content = F.to_json(F.array(*[F.col(c).cast("string") for c in parts]))
    if "paper_id" not in df.columns:
        return df.withColumn("paper_id", F.sha2(content, 256))
    if isinstance(df.schema["paper_id"].dataType, T.IntegralType):
        derived = -1 - F.shiftrightunsigned(F.xxhash64(content), 1)
        return df.withColumn("paper_id", F.coalesce(F.col("paper_id").cast("bigint"), derived))
    return df.withColumn("paper_id", F.coalesce(F.col("paper_id").cast("string"), F.sha2(content, 256)))


def standardise(df: DataFrame) -> DataFrame:
    """Short names, identity, numeric flag and year, list cells as arrays. Other columns pass through."""
    df = with_year(with_paper_id(rename_columns(df)))
    typed = {c: list_column(df, c) for c in taxonomy.LIST_COLUMNS if c in df.columns}
    if "is_relevant" in df.columns:
        flag = F.col("is_relevant").try_cast("double")
        typed["is_relevant"] = F.when(flag == F.floor(flag), flag.cast("int"))  # 1.9 is no flag
    return df.withColumns(typed) if typed else df


def relevant_only(df: DataFrame, only_relevant: bool = True) -> DataFrame:
    """Papers flagged as relevant; all papers if the flag is off or the table is not flagged yet."""
    if only_relevant and "is_relevant" in df.columns:
        return df.where("is_relevant = 1")
    return df


def classified_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def having_label(df: DataFrame, label: str, column: str = "material_categories") -> DataFrame:
    """Papers whose list holds the label; a null list does not."""
    return df.where(F.array_contains(list_column(df, column), label))
