"""Counts, shares, top lists and cross-tabs.

Every distribution is one aggregation with map-side pre-counting, so a label that holds most of
the papers costs no more than a rare one. Totals are scalar sub-queries over the same counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.lists import list_column, sorted_combination
from paperloom.functions.text import names_language_model, percent


def with_totals(counts: DataFrame, measures: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Adds grand totals of a table of counts as columns.

    The counts are used twice, once as rows and once for the totals. The filter reads every
    measure on both sides, so that column pruning leaves the two uses equal and Spark runs the
    counting scan and its shuffle once.
    """
    counts = counts.where(sum(F.col(m) for m in measures) >= 0)
    summed = counts.agg(*[total.alias(name) for name, total in totals.items()])
    return counts.withColumns({name: summed.select(name).scalar() for name in totals})


def coverage(df: DataFrame, classified: str) -> DataFrame:
    """Papers, classified papers and their share."""
    return df.agg(F.count("*").alias("n_papers"), F.count(classified).alias("n_classified")).withColumn(
        "pct_classified", percent(F.col("n_classified"), F.col("n_papers"))
    )


def relevance_stats(df: DataFrame) -> DataFrame:
    """Papers per relevance flag, with the number and share of relevant papers."""
    counts = df.groupBy("is_relevant").agg(
        F.count("is_relevant").alias("n"), F.count("*").alias("n_rows"), F.sum("is_relevant").alias("n_ones")
    )
    totals = {"n_relevant": F.sum("n_ones"), "n_papers": F.sum("n_rows")}
    return (
        with_totals(counts.fillna(0, ["n_ones"]), ["n", "n_rows", "n_ones"], totals)
        .where("n > 0")
        .select(
            "is_relevant", "n", "n_relevant", "n_papers",
            percent(F.col("n_relevant"), F.col("n_papers")).alias("pct_relevant"),
        )
        .orderBy(F.desc("n"), "is_relevant")
    )


def distribution(df: DataFrame, key: str, of: str = "nonnull", classified: str | None = None) -> DataFrame:
    """Papers per value of a column with their share, most frequent first.

    The share is of the non-null values (``nonnull``), of all papers (``all``), or of the papers
    that have a value in the column ``classified`` (only these are counted then).
    """
    if of == "classified":
        df = df.where(F.col(classified or key).isNotNull())
    elif of not in ("nonnull", "all"):
        raise ValueError(f"unknown denominator: {of}")
    total = F.sum("n") if of == "nonnull" else F.sum("n_rows")
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(key).alias("n"), F.count("*").alias("n_rows"))
    return (
        with_totals(counts, ["n", "n_rows"], {"total": total})
        .where("n > 0")
        .select("key", "n", percent(F.col("n"), F.col("total")).alias("pct"))
        .orderBy(F.desc("n"), "key")
    )


def highlighted(shares: DataFrame) -> DataFrame:
    """Marks language-model rows of a distribution, and rows whose share is wide enough for a label."""
    marked = names_language_model(F.col("key"), strict=True)
    return shares.withColumn("highlight", marked).withColumn(
        "show_label", (F.col("pct") >= taxonomy.LABEL_SHARE * 100) | F.col("highlight")
    )


def mentions(df: DataFrame, lists: str, classified: str) -> DataFrame:
    """Mentions per label of a list column, with their share of classified papers and of all mentions.

    A label listed twice by one paper counts twice, so shares of papers may pass 100 %.
    """
    parsed = df.where(F.col(classified).isNotNull()).select(list_column(df, lists).alias("items"))
    rows = parsed.select(F.posexplode_outer("items").alias("pos", "key"))
    # A paper adds one row per label, or one row without a label: its first row stands for the paper.
    first = F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0)
    counts = rows.groupBy("key").agg(F.count("key").alias("n"), first.alias("n_first"))
    totals = {"n_papers": F.sum("n_first"), "n_mentions": F.sum("n")}
    return (
        with_totals(counts, ["n", "n_first"], totals)
        .where("n > 0")
        .select(
            "key", "n",
            percent(F.col("n"), F.col("n_papers")).alias("pct_papers"),
            percent(F.col("n"), F.col("n_mentions")).alias("pct_mentions"),
        )
        .orderBy(F.desc("n"), "key")
    )


def frequent_labels(
    df: DataFrame, lists: str, classified: str,
    top: int = taxonomy.TOP_MODELS_REPORT, min_support: int = taxonomy.MIN_SUPPORT,
) -> DataFrame:
    """The ``top`` labels of a list column, of these the ones with at least ``min_support`` mentions."""
    parsed = df.where(F.col(classified).isNotNull()).select(list_column(df, lists).alias("items"))
    counts = parsed.select(F.explode_outer("items").alias("key")).groupBy("key").agg(F.count("key").alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(top).where(F.col("n") >= max(min_support, 1))


def labels_per_paper(df: DataFrame, lists: str = "material_categories") -> DataFrame:
    """Papers per list length, with their share of the papers whose list is readable."""
    sizes = df.select(F.array_size(list_column(df, lists)).alias("n_labels"))
    # Unreadable lists form a group of count 0. A null test would be pushed down and parse every list twice.
    counts = sizes.groupBy("n_labels").agg(F.count("n_labels").alias("n"))
    return (
        with_totals(counts, ["n"], {"total": F.sum("n")})
        .where("n > 0")
        .select("n_labels", "n", percent(F.col("n"), F.col("total")).alias("pct"))
        .orderBy("n_labels")
    )


def multi_label_papers(df: DataFrame, lists: str = "material_categories") -> DataFrame:
    return df.where(F.size(list_column(df, lists)) > 1)


def label_combinations(
    df: DataFrame, lists: str = "material_categories", min_support: int = taxonomy.MIN_SUPPORT
) -> DataFrame:
    """Sorted combinations of two or more labels that occur at least ``min_support`` times."""
    return (
        df.select(sorted_combination(list_column(df, lists)).alias("labels"))
        .groupBy("labels")
        .agg(F.count("labels").alias("n"))
        .where(F.col("n") >= max(min_support, 1))
        .select(F.array_join("labels", " + ").alias("combination"), "n")
        .orderBy(F.desc("n"), "combination")
    )


def distinct_labels(df: DataFrame, lists: str = "material_categories") -> DataFrame:
    return (
        df.select(F.explode(list_column(df, lists)).alias("label"))
        .where(F.col("label").isNotNull())
        .distinct()
        .orderBy("label")
    )


def top_values(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values; ties go by value."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "key")
        .limit(k)
    )


def collapse_small(df: DataFrame, key: str, threshold: float = taxonomy.SMALL_SHARE) -> DataFrame:
    """Distribution with all values below the threshold summed into ``Others``, which comes last.

    A small value that names large language models stays on its own.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    shared = with_totals(counts, ["n"], {"total": F.sum("n")})
    stays = (F.col("n") / F.col("total") >= threshold) | F.col("key").rlike("(?i)Large Language")
    label = F.when(stays, F.col("key")).otherwise("Others")
    return (
        shared.groupBy(label.alias("key"))
        .agg(F.sum("n").alias("n"), F.max("total").alias("total"))
        .withColumn("pct", percent(F.col("n"), F.col("total")))
        .withColumn("highlight", names_language_model(F.col("key")))
        .withColumn("show_label", (F.col("n") / F.col("total") >= taxonomy.LABEL_SHARE) | F.col("highlight"))
        .select("key", "n", "pct", "highlight", "show_label")
        .orderBy(F.col("key") == "Others", F.desc("n"), "key")
    )


def crosstab(
    df: DataFrame,
    rows: str = "model_primary_category",
    columns: str = "primary_material_category",
    top_rows: int = taxonomy.CROSSTAB_METHODS,
    top_columns: int = taxonomy.CROSSTAB_MATERIALS,
) -> DataFrame:
    """Papers per pair of the most frequent row and column values, zero cells included.

    Margins count all non-null values, also those whose partner is null. Pairs are counted once;
    margins and cells are taken from the pair counts.
    """
    pairs = df.groupBy(F.col(rows).alias("row"), F.col(columns).alias("col")).agg(F.count("*").alias("n"))

    def margin(name: str, k: int) -> DataFrame:
        # Reading n in the test keeps it above the counting, so all uses share one shuffle.
        value = F.when(F.col("n") > 0, F.col(name))
        return (
            pairs.groupBy(value.alias(name))
            .agg(F.sum("n").alias(f"{name}_total"))
            .where(F.col(name).isNotNull())
            .orderBy(F.desc(f"{name}_total"), name)
            .limit(k)
        )

    row_margin, col_margin = margin("row", top_rows), margin("col", top_columns)
    # The few column heads become one array value, laid along each of the few rows.
    heads = col_margin.agg(F.collect_list(F.struct("col", "col_total")).alias("heads")).select("heads").scalar()
    grid = row_margin.withColumn("head", F.explode(heads)).select("row", "row_total", "head.col", "head.col_total")
    # The limits bound both margins, so they may be broadcast.
    cells = (
        pairs.select(*[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("row", "col")], "n")
        .join(F.broadcast(row_margin.select("row")), "row", "left_semi")
        .join(F.broadcast(col_margin.select("col")), "col", "left_semi")
    )
    return (
        grid.join(cells, ["row", "col"], "left")
        .select("row", "col", F.coalesce("n", F.lit(0)).alias("n"), "row_total", "col_total")
        .orderBy(F.desc("row_total"), "row", F.desc("col_total"), "col")
    )


def side_by_side(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distributions of several columns from one pass over the table, each with shares of its non-null values."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "dimension string, key string, n bigint, pct double")
    counts = (
        df.select(*present).unpivot([], present, "dimension", "key")
        .where(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(F.count("*").alias("n"))
    )
    totals = {f"total_{i}": F.sum(F.when(F.col("dimension") == c, F.col("n"))) for i, c in enumerate(present)}
    total = F.coalesce(*[F.when(F.col("dimension") == c, F.col(f"total_{i}")) for i, c in enumerate(present)])
    return (
        with_totals(counts, ["n"], totals)
        .select("dimension", "key", "n", percent(F.col("n"), total).alias("pct"))
        .orderBy("dimension", F.desc("n"), "key")
    )


def language_model_total(df: DataFrame, column: str = "model_primary_category", strict: bool = False) -> DataFrame:
    """Papers whose method counts as a large language model, and their share of all papers."""
    return df.agg(
        F.count_if(names_language_model(F.col(column), strict)).alias("n"), F.count("*").alias("n_papers")
    ).withColumn("pct", percent(F.col("n"), F.col("n_papers")))


def basic_stats(df: DataFrame) -> DataFrame:
    """Papers, first and last year, mean papers per calendar year of that span."""
    return df.agg(
        F.count("*").alias("n_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    ).withColumn("papers_per_year", F.col("n_papers") / (F.col("last_year") - F.col("first_year") + 1))
