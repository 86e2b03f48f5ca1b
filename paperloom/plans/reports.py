"""The three reports, as long tables and as text.

Every report is one pass over the papers: each paper gives a few (section, item) entries, one
aggregation counts them, and all sections and denominators are read from these counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.lists import list_column, sorted_combination
from paperloom.functions.text import names_language_model, percent
from paperloom.operators.counting import with_totals

PAPERS, CLASSIFIED = "papers", "classified"


def _entry(section: str, item: Column | None = None, given: Column | None = None) -> Column:
    """One entry of a paper; it does not count where its item is null or ``given`` does not hold."""
    item = F.lit("") if item is None else item.cast("string")
    if given is not None:
        item = F.when(given, item)
    return F.struct(F.lit(section).alias("section"), item.alias("item"))


def _entries(section: str, items: Column) -> Column:
    """An entry for every label of a list."""
    sections = F.array_repeat(F.lit(section), F.array_size(items))
    return F.arrays_zip(sections.alias("section"), items.alias("item"))


def tally(df: DataFrame, single: Sequence[Column], lists: Sequence[Column] = ()) -> DataFrame:
    """Counts of (section, item) entries over all papers, from one pass and one shuffle.

    Entries are built without lambda functions, so the whole pass is compiled code.
    """
    none = F.array().cast("array<struct<section: string, item: string>>")
    entries = F.concat(F.array(*single), *[F.coalesce(entries, none) for entries in lists])
    return (
        df.select(F.inline(entries))
        .where(F.col("item").isNotNull())
        .groupBy("section", "item")
        .agg(F.count("*").alias("n"))
    )


def _section_total(*sections: str) -> Column:
    return F.sum(F.when(F.col("section").isin(*sections), F.col("n")))


def _kept(sections: Sequence[str]) -> Column:
    """Section test that stays above the counting, because it reads the count as well."""
    return F.when(F.col("n") > 0, F.col("section")).isin(*sections)


def _top(counts: DataFrame, sections: Sequence[str], k: int) -> DataFrame:
    """First ``k`` items of each section; every task keeps ``k`` rows per section before the shuffle."""
    order = Window.partitionBy("section").orderBy(F.desc("n"), "item")
    return counts.where(_kept(sections)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def _long_table(parts: DataFrame, n_papers: Column, pct: Column, pct_mentions: Column | None = None) -> DataFrame:
    return parts.select(
        "section", "item", "n",
        percent(F.col("n"), pct).alias("pct"),
        *([] if pct_mentions is None else [percent(F.col("n"), pct_mentions).alias("pct_mentions")]),
    )


def _when_section(sections: Sequence[str], value: Column) -> Column:
    return F.when(F.col("section").isin(*sections), value)


def _with_coverage(rows: DataFrame) -> DataFrame:
    """Puts the number of classified papers next to the number of papers, also where it is 0."""
    own = F.struct("section", "item", "n")
    classified = F.struct(
        F.lit(CLASSIFIED).alias("section"), F.col("item"), F.coalesce("n_classified", F.lit(0).cast("long")).alias("n")
    )
    both = F.when(F.col("section") == PAPERS, F.array(own, classified)).otherwise(F.array(own))
    totals = [c for c in rows.columns if c not in ("section", "item", "n")]
    return rows.where(~_kept([CLASSIFIED])).select(*totals, F.inline(both))


def material_report(df: DataFrame, min_support: int = taxonomy.MIN_SUPPORT) -> DataFrame:
    """Coverage, primary categories, mentions, confidence, labels per paper and combinations.

    Shares are of classified papers; labels per paper are of papers with a readable list;
    classified is of all papers. Mentions have a second share, of all mentions.
    """
    known = F.col("primary_material_category").isNotNull()
    labels = list_column(df, "material_categories", known)
    df = df.select("primary_material_category", "material_confidence", labels.alias("labels"))
    single = [
        _entry(PAPERS),
        _entry(CLASSIFIED, given=known),
        _entry("primary", F.col("primary_material_category")),
        _entry("confidence", F.col("material_confidence"), known),
        _entry("n_labels", F.array_size("labels")),
        _entry("combination", F.to_json(sorted_combination(F.col("labels")))),
    ]
    counts = tally(df, single, [_entries("mention", F.col("labels"))])
    totals = {
        "n_papers": _section_total(PAPERS), "n_classified": _section_total(CLASSIFIED),
        "n_mentions": _section_total("mention"), "n_readable": _section_total("n_labels"),
    }
    rows = _with_coverage(with_totals(counts, ["n"], totals))
    rows = rows.where((F.col("section") != "combination") | (F.col("n") >= min_support))
    whole = (
        _when_section(["primary", "mention", "confidence"], F.col("n_classified"))
        .when(F.col("section") == CLASSIFIED, F.col("n_papers"))
        .when(F.col("section") == "n_labels", F.col("n_readable"))
    )
    combination = F.array_join(F.from_json("item", "array<string>"), " + ")
    item = F.when(F.col("section") == "combination", combination).otherwise(F.col("item"))
    return _long_table(
        rows.withColumn("item", item), F.col("n_papers"), whole, _when_section(["mention"], F.col("n_mentions"))
    )


def method_report(
    df: DataFrame, top: int = taxonomy.TOP_MODELS_REPORT, min_support: int = taxonomy.MIN_SUPPORT
) -> DataFrame:
    """Coverage, primary categories, confidence, frequent specific models and tags; shares are of classified papers."""
    known = F.col("model_primary_category").isNotNull()
    df = df.select(
        "model_primary_category", "model_confidence",
        list_column(df, "model_specific_models", known).alias("models"),
        list_column(df, "model_secondary_tags", known).alias("tags"),
    )
    single = [
        _entry(PAPERS),
        _entry(CLASSIFIED, given=known),
        _entry("primary", F.col("model_primary_category")),
        _entry("confidence", F.col("model_confidence"), known),
    ]
    counts = tally(df, single, [_entries("model", F.col("models")), _entries("tag", F.col("tags"))])
    totals = {"n_papers": _section_total(PAPERS), "n_classified": _section_total(CLASSIFIED)}
    rows = with_totals(counts, ["n"], totals)
    listed = _with_coverage(rows.where(_kept([PAPERS, "primary", "confidence", "tag"])))
    models = _top(rows, ["model"], top).where(F.col("n") >= min_support)
    whole = _when_section(["primary", "confidence", "tag"], F.col("n_classified")).when(
        F.col("section") == CLASSIFIED, F.col("n_papers")
    )
    return _long_table(listed.unionByName(models), F.col("n_papers"), whole)


def summary_report(df: DataFrame, top: int = taxonomy.TOP_SUMMARY) -> DataFrame:
    """Basic statistics, recent years, methods, materials and confidence; shares are of all papers.

    ``df`` carries ``year``. Sections whose columns the table lacks are left out; the confidence of
    materials is listed only where the table has a confidence of methods.
    """
    columns = df.columns
    single = [_entry("year", F.col("year"))]
    if "model_primary_category" in columns:
        single.append(_entry("method", F.col("model_primary_category")))
        llm = names_language_model(F.col("model_primary_category"))
        single.append(_entry("llm_papers", given=llm))
    if "primary_material_category" in columns:
        single.append(_entry("material", F.col("primary_material_category")))
    if "model_confidence" in columns:
        single.append(_entry("method_confidence", F.col("model_confidence")))
        if "material_confidence" in columns:
            single.append(_entry("material_confidence", F.col("material_confidence")))
    counts = tally(df, single)
    year = F.when((F.col("n") > 0) & (F.col("section") == "year"), F.col("item").try_cast("double"))
    totals = {
        "n_papers": _section_total("year"), "n_llm": F.coalesce(_section_total("llm_papers"), F.lit(0)),
        "first_year": F.min(year), "last_year": F.max(year),
    }
    rows = with_totals(counts, ["n"], totals)
    recent = year >= F.col("last_year") - (taxonomy.RECENT_YEARS - 1)
    per_year = rows.where(_kept(["year"])).where(recent)
    span = F.col("last_year") - F.col("first_year") + 1

    # The figures on the whole table: one row of totals becomes one row per figure.
    figures = [
        ("basic", "papers", F.col("n_papers")),
        ("basic", "first_year", F.col("first_year")),
        ("basic", "last_year", F.col("last_year")),
        ("basic", "papers_per_year", F.col("n_papers") / span),
        ("recent", "last_years", F.col("n_recent")),
    ]
    if "model_primary_category" in columns:
        figures.append(("llm_papers", "", F.col("n_llm")))
    structs = [
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("double").alias("n"))
        for section, item, value in figures
    ]
    # Without any paper there is no row to hang the figures on, hence no grouping.
    recent_papers = F.sum(F.when(_kept(["year"]) & recent, F.col("n")))
    table = rows.agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_papers", "n_llm")],
        *[F.max(c).alias(c) for c in ("first_year", "last_year")],
        F.coalesce(recent_papers, F.lit(0)).alias("n_recent"),
    ).select("n_papers", F.inline(F.array(*structs)))
    listed = rows.where(_kept(["method_confidence", "material_confidence"]))
    items = [per_year, _top(rows, ["method", "material"], top), listed]
    long = [part.select("n_papers", "section", "item", F.col("n").cast("double").alias("n")) for part in items]
    for part in long:
        table = table.unionByName(part)
    counted = ~F.col("section").isin("basic", "year")
    return table.select(
        "section", "item", "n", F.when(counted, percent(F.col("n"), F.col("n_papers"))).alias("pct")
    )
