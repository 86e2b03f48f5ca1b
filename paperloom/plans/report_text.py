"""Report tables as lines of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import one_decimal, pad_with, show_percent, text_bar

# Titles and headings of the reports, sections in order of appearance.
MATERIAL_TITLE = "MATERIAL CLASSIFICATION ANALYSIS REPORT"
MATERIAL_SECTIONS = {
    "primary": "PRIMARY MATERIAL CATEGORY DISTRIBUTION",
    "mention": "ALL MATERIAL CATEGORIES (papers can have multiple)",
    "confidence": "CONFIDENCE DISTRIBUTION",
    "n_labels": "MULTI-CATEGORY ANALYSIS",
    "combination": "COMMON CATEGORY COMBINATIONS (appearing 3+ times)",
}
METHOD_TITLE = "MODEL CLASSIFICATION ANALYSIS"
METHOD_SECTIONS = {
    "primary": "PRIMARY CATEGORY DISTRIBUTION",
    "confidence": "CONFIDENCE DISTRIBUTION",
    "model": "TOP SPECIFIC MODELS (mentioned at least 3 times)",
    "tag": "SECONDARY TAG DISTRIBUTION",
}
SUMMARY_TITLE = "MATERIALS DATA EXTRACTION LITERATURE ANALYSIS SUMMARY"
SUMMARY_SECTIONS = {
    "basic": "1. BASIC STATISTICS",
    "recent": "2. RECENT GROWTH (Last 5 Years)",
    "year": "",
    "method": "3. MODEL CATEGORY DISTRIBUTION",
    "llm_papers": "",
    "material": "4. MATERIAL CATEGORY DISTRIBUTION",
    "method_confidence": "5. CLASSIFICATION CONFIDENCE",
    "material_confidence": "Material Classification:",
}
SUB_HEADINGS = {
    "MULTI-CATEGORY ANALYSIS": "Number of material categories per paper:",
    "5. CLASSIFICATION CONFIDENCE": "Model Classification:",
}

METHOD_COLUMN, MATERIAL_COLUMN = "model_primary_category", "primary_material_category"


def _lines(table: DataFrame, title: str, sections: dict[str, str], line: Column, order: Column) -> DataFrame:
    """Lines with a sortable position: title and totals, then the sections, each with its heading first."""
    number = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(sections, start=2)], F.lit(1))
    items = table.select(
        F.struct(number.alias("number"), order.alias("rank"), F.col("item").alias("item")).alias("position"),
        line.alias("line"),
    )
    headings = [(1, title)] + [(i, h) for i, h in enumerate(sections.values(), start=2) if h]
    headings = [(i, f"{h}\n{SUB_HEADINGS[h]}" if h in SUB_HEADINGS else h) for i, h in headings]
    before_all = F.lit(float("-inf")).alias("rank")
    structs = [
        F.struct(F.struct(F.lit(i).alias("number"), before_all, F.lit("").alias("item")).alias("position"), F.lit(h).alias("line"))
        for i, h in headings
    ]
    heads = table.sparkSession.range(1).select(F.inline(F.array(*structs)))
    return heads.unionByName(items).orderBy("position")


def _count(width: int = 4) -> Column:
    return F.format_string(f"%{width}d", F.col("n").cast("long"))


def _is(*sections: str) -> Column:
    return F.col("section").isin(*sections)


def material_lines(table: DataFrame) -> DataFrame:
    name, pct = pad_with(F.col("item"), 35, " "), show_percent(F.col("pct"))
    noun = F.when(F.col("item") == "1", "category").otherwise("categories")
    line = (
        F.when(_is("papers"), F.format_string("Total papers in dataset: %d", "n"))
        .when(_is("classified"), F.concat(
            F.format_string("Papers with material classification: %d\nClassification rate: ", "n"), F.trim(pct), F.lit("%")))
        .when(_is("primary"), F.concat_ws(" ", name, _count(), F.concat(F.lit("("), pct, F.lit("%)")), text_bar(F.col("pct"))))
        .when(_is("mention"), F.concat(
            name, F.lit(" "), _count(), F.lit(" ("), pct, F.lit("% of papers, "),
            show_percent(F.col("pct_mentions")), F.lit("% of mentions) "), text_bar(F.col("pct"))))
        .when(_is("n_labels"), F.concat(F.lit("  "), "item", F.lit(" "), noun, F.lit(": "), _count(), F.lit(" papers ("), pct, F.lit("%)")))
        .when(_is("combination"), F.concat(pad_with(F.col("item"), 60, " "), F.lit(" "), _count()))
        .otherwise(F.concat(name, F.lit(" "), _count(), F.lit(" ("), pct, F.lit("%)")))
    )
    order = F.when(_is("n_labels"), F.col("item").try_cast("double")).otherwise(-F.col("n").cast("double"))
    return _lines(table, MATERIAL_TITLE, MATERIAL_SECTIONS, line, order)


def method_lines(table: DataFrame) -> DataFrame:
    name, pct = pad_with(F.col("item"), 50, "."), show_percent(F.col("pct"))
    line = (
        F.when(_is("papers"), F.format_string("Total papers analyzed: %d", "n"))
        .when(_is("classified"), F.concat(
            F.format_string("Papers with model classification: %d\nClassification rate: ", "n"), F.trim(pct), F.lit("%")))
        .when(_is("model"), F.concat(name, F.lit(" "), _count()))
        .otherwise(F.concat(name, F.lit(" "), _count(), F.lit(" ("), pct, F.lit("%)")))
    )
    return _lines(table, METHOD_TITLE, METHOD_SECTIONS, line, -F.col("n").cast("double"))


def summary_lines(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` are those of the paper table: sections without their column have no heading."""
    needed = {
        "method": METHOD_COLUMN, "llm_papers": METHOD_COLUMN, "material": MATERIAL_COLUMN,
        "method_confidence": "model_confidence", "material_confidence": "material_confidence",
    }
    sections = {s: h for s, h in SUMMARY_SECTIONS.items() if s not in needed or needed[s] in columns}
    pct = show_percent(F.col("pct"))
    share = F.concat(F.format_string("%d (", F.col("n").cast("long")), F.trim(pct), F.lit("%)"))
    whole = F.format_string("%d", F.col("n").cast("long"))
    line = (
        F.when(_is("basic") & (F.col("item") == "papers"), F.concat(F.lit("Total Papers: "), whole))
        .when(F.col("item") == "year_range", F.concat(F.lit("Year Range: "), whole, F.lit(" - "), F.format_string("%d", F.col("last").cast("long"))))
        .when(F.col("item") == "papers_per_year", F.concat(
            F.lit("Average Papers per Year: "), F.format_string("%.1f", one_decimal(F.col("n")))))
        .when(_is("recent"), F.concat(F.lit("Papers (Last 5 Years): "), share))
        .when(_is("year"), F.concat(F.lit("  "), F.col("item").try_cast("double").cast("int").cast("string"), F.lit(": "), whole, F.lit(" papers")))
        .when(_is("llm_papers"), F.concat(F.lit("  Total LLM Papers: "), share))
        .when(_is("method", "material"), F.concat(
            F.lit("  "), pad_with(F.col("item"), 50, " "), F.lit(" "), _count(), F.lit(" ("), pct, F.lit("%)")))
        .otherwise(F.concat(F.lit("  "), "item", F.lit(": "), share))
    )
    # First and last year become one line.
    last = F.max(F.when(F.col("item") == "last_year", F.col("n"))).over(Window.partitionBy(F.lit("all")))
    basics = table.where(_is("basic")).withColumn("last", last).where("item != 'last_year'")
    rest = table.where(~_is("basic")).withColumn("last", F.lit(None).cast("double"))
    table = basics.unionByName(rest).withColumn("item", F.when(F.col("item") == "first_year", "year_range").otherwise(F.col("item")))
    figure = F.array_position(F.array(*[F.lit(x) for x in ("papers", "year_range", "papers_per_year")]), F.col("item"))
    order = (
        F.when(_is("basic"), figure.cast("double"))
        .when(_is("year"), -F.col("item").try_cast("double"))
        .otherwise(-F.col("n"))
    )
    return _lines(table, SUMMARY_TITLE, sections, line, order)
