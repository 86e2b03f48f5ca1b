"""Tables of papers and replies derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.replies import METHOD_REPLY, ReplyFormat

FENCE = "`" * 3


def papers_from_orders(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One paper per order, classified by its items; orders without items are unclassified papers.

    Every aggregate of an order has a bounded size, however many items the order has.
    """
    items = (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(
            F.min("p_brand").alias("brand"),
            F.min("p_type").alias("main_type"),
            # p_type is a vocabulary of six words.
            F.array_sort(F.collect_set("p_type")).alias("types"),
            F.min("p_name").alias("first_name"),
            F.max("p_name").alias("last_name"),
            F.max(F.when(F.col("l_quantity") > 25, F.col("p_name"))).alias("large_name"),
        )
    )
    df = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, known = F.col("o_orderkey"), F.col("brand").isNotNull()
    by_priority = F.coalesce(
        *[
            F.when(F.col("o_orderpriority") == priority, label)
            for priority, label in {
                "1-URGENT": "Large Language Models (LLMs)",
                "2-HIGH": "Traditional Deep Learning",
                "3-MEDIUM": "Transformer-based (Non-LLM)",
                "4-NOT SPECIFIED": "Classical Machine Learning",
                "5-LOW": "Rule-Based & Hybrid",
            }.items()
        ]
    )
    method = (
        F.when(key % 50 == 0, "Multi-Modal").when(key % 50 == 1, "Knowledge Graph & Ontology").otherwise(by_priority)
    )
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (key % 3 + 1).cast("int"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    )
    names = F.array_sort(F.array_compact(F.array("first_name", "last_name", "large_name")))
    tags = F.array_sort(F.transform(names, lambda n: F.substring_index(n, " ", 1)))
    return df.select(
        key.alias("paper_id"),
        F.when(key % 97 == 0, "n/a").otherwise((F.year("o_orderdate") + 3).cast("string")).alias("publication_year"),
        F.col("brand").alias("journal"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("is_relevant"),
        F.when(known, method).alias("model_primary_category"),
        F.when(known, level).alias("model_confidence"),
        F.when(known, F.to_json(names)).alias("model_specific_models"),
        F.when(known, F.to_json(tags)).alias("model_secondary_tags"),
        F.to_json("types").alias("material_categories"),
        F.when(known, status).alias("material_confidence"),
        F.col("main_type").alias("primary_material_category"),
    )


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """One paper per document: first line as title, whole text as abstract, no Keywords Plus column."""
    return documents.select(
        F.col("doc_id").alias("paper_id"),
        F.when(F.col("source") != "src0", F.substring_index("text", "\n", 1)).alias("article_title"),
        F.col("lang").alias("author_keywords"),
        F.col("text").alias("abstract"),
        F.col("source").alias("journal"),
    )


def _replies(papers: DataFrame, body: Column, only_first: Column, null_list: Column, bare_list: Column) -> DataFrame:
    """Readable and unreadable replies; the shape goes by ``paper_id % 11``."""
    shape = F.col("paper_id") % 11
    newline = F.lit("\n")
    reply = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit(FENCE + "json\n"), body, F.lit("\n" + FENCE)))
        .when(shape == 2, F.concat(F.lit(FENCE + "\n"), body, F.lit("\n" + FENCE)))
        .when(shape == 3, F.concat(body, F.lit(" done")))
        .when(shape == 4, F.substring(body, F.lit(1), F.length(body) - 1))
        .when(shape == 5, only_first)
        .when(shape == 6, bare_list)
        .when(shape == 7, null_list)
        .when(shape == 8, F.concat(F.lit("Here it is: " + FENCE), body, F.lit(FENCE)))
        .when(shape == 9, F.concat(newline, newline, F.lit("  "), body, newline, F.lit(" ")))
        .otherwise(F.concat(body, body))
    )
    return papers.select("paper_id", reply.alias("reply"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def material_replies(papers: DataFrame) -> DataFrame:
    listed = F.col("material_categories")
    first = F.concat(F.lit('{"material_categories":'), listed)
    body = F.concat(
        first, F.lit(',"confidence":'), _quoted(F.col("material_confidence")),
        F.lit(',"primary_category":'), _quoted(F.col("primary_material_category")), F.lit("}"),
    )
    null_list = F.lit('{"material_categories":null,"confidence":"high"}')
    known = papers.where(F.col("primary_material_category").isNotNull())
    return _replies(known, body, F.concat(first, F.lit("}")), null_list, listed)


def method_replies(papers: DataFrame) -> DataFrame:
    first = F.concat(F.lit('{"primary_category":'), _quoted(F.col("model_primary_category")))
    body = F.concat(
        first, F.lit(',"specific_models":'), F.col("model_specific_models"),
        F.lit(',"secondary_tags":'), F.col("model_secondary_tags"),
        F.lit(',"confidence":'), _quoted(F.col("model_confidence")), F.lit("}"),
    )
    null_list = F.lit('{"specific_models":null,"confidence":"high"}')
    known = papers.where(F.col("model_primary_category").isNotNull())
    return _replies(known, body, F.concat(first, F.lit("}")), null_list, F.col("model_specific_models"))


# Titles with words of the real lists, put before the documents' whole texts; document ``i`` carries title ``i % 8``.
WORDED_TITLES = [
    "Nanoparticle photocatalysts and a quantum dot",
    "Automated extraction of graphene and MoS2 synthesis with GPT-4",
    "A fine-tuned MatBERT and BiLSTM pipeline for MOFs",
    "Rule-based text mining of materials science literature with machine learning",
    "Collecting material data of thermoelectric Bi2Te3 with large language models",
    "Biocompatible scaffolds, no courses",
    "Extracting materials data from papers by natural language processing in medicine",
    "Nothing of the kind",
]
WORDED_CATEGORIES = ["Materials Science; Health Care Sciences & Services", "Materials Science", None]


def worded_documents(documents: DataFrame) -> DataFrame:
    """Documents as papers whose title holds indicator and search words, whose abstract is the whole text, with an export category."""

    def pick(values: list, shift: int = 0) -> Column:
        listed = F.array(*[F.lit(v).cast("string") for v in values])
        return F.element_at(listed, ((F.col("paper_id") + shift) % len(values) + 1).cast("int"))

    return documents.select("paper_id", pick(WORDED_TITLES).alias("article_title"), "abstract", pick(WORDED_CATEGORIES).alias("wos_category"))


class SampleTables:
    """The derived tables of one data folder. ``papers`` may be replaced by a stored copy."""

    def __init__(self, spark: SparkSession, folder: str, papers: DataFrame | None = None):
        self.spark, self.folder, self._papers = spark, folder, papers

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        if self._papers is not None:
            return self._papers
        return papers_from_orders(self.table("orders"), self.table("lineitem"), self.table("part"))

    @property
    def documents(self) -> DataFrame:
        return papers_from_documents(self.table("documents"))

    def replies(self, fmt: ReplyFormat) -> DataFrame:
        make = method_replies if fmt is METHOD_REPLY else material_replies
        return make(self.papers)
