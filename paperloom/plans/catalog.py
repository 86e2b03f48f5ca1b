"""The driver's queries: every operator over the derived tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text, topic
from paperloom.functions.lists import list_text
from paperloom.functions.replies import MATERIAL_REPLY, METHOD_REPLY, ReplyFormat, reply_columns
from paperloom.functions.text import language_model_label, to_int
from paperloom.operators import counting, curve, lexicon, prompts, scoring, trends
from paperloom.plans import report_text, reports
from paperloom.plans.sample_tables import SampleTables, papers_from_documents, worded_documents
from paperloom.session import scratch_dir
from paperloom.sources import papers as scans
from paperloom.sources import sinks
from paperloom.sources.scores import append_scores, read_scores
from paperloom.streaming.incremental import score_stream

METHOD, MATERIAL = "model_primary_category", "primary_material_category"

# Word lists that hit the driver's invented prose; the real lists are covered by unit tests.
SAMPLE_TOPIC_ALL_OF = [["the", "de*", "und"], ["with", "pour", "para", "licens*"], ["on*", "la"]]
SAMPLE_TOPIC_NONE_OF = [["rights reserved", "token"]]
SAMPLE_LEXICON = {
    "Licences": ["license", "under"],
    "Rights": ["rights reserved"],
    "English": ["the", "and"],
    "French": ["pour", "dans"],
    "Names": ["Apache"],
}


def _dated(t: SampleTables) -> DataFrame:
    return scans.in_year_range(scans.with_year(t.papers))


def _list_texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: list_text(F.col(c)) for c in columns})


# --- scans, filters, sinks -------------------------------------------------------------------


def csv_na_normalise(t: SampleTables) -> DataFrame:
    """Missing-value texts become null."""
    return scans.normalise_missing(t.papers).select("paper_id", "publication_year", "journal")


def csv_round_trip(t: SampleTables) -> DataFrame:
    """Whole texts with line breaks and quotes survive writing and reading CSV; ``n/a`` comes back as null."""
    path = scratch_dir(t.spark, "csv")
    sinks.write_csv(t.documents.join(t.papers.select("paper_id", "publication_year"), "paper_id", "left"), path)
    back = scans.read_papers_csv(t.spark, path)
    return back.select(
        F.col("paper_id").cast("bigint").alias("paper_id"),
        "article_title", "author_keywords", "abstract", "journal", "publication_year",
    )


def column_resolution(t: SampleTables) -> DataFrame:
    """Export names to short names: the first present name of each kind wins."""
    exported = t.papers.withColumnsRenamed({"journal": "Journal", "publication_year": "year"}).withColumn(
        "Publication Name", F.lit("unused")
    )
    return scans.standardise(exported).select("paper_id", "journal", "publication_year", "year", "is_relevant")


def year_parse_filter(t: SampleTables) -> DataFrame:
    return _dated(t).select("paper_id", "year")


def relevant_papers(t: SampleTables) -> DataFrame:
    return scans.classified_only(scans.relevant_only(t.papers), METHOD).select("paper_id", METHOD)


def category_members(t: SampleTables) -> DataFrame:
    return scans.having_label(t.papers, "PROMO").select("paper_id", MATERIAL)


def export_by_category(t: SampleTables) -> DataFrame:
    """Writes one folder per category and reads back what each folder holds."""
    path = scratch_dir(t.spark, "export")
    sinks.export_by_category(t.papers, path)
    back = scans.read_papers_csv(t.spark, path)
    return back.select("category_file", F.col("paper_id").cast("bigint").alias("paper_id"), "journal")


def papers_per_category(t: SampleTables) -> DataFrame:
    return sinks.category_manifest(t.papers)


def exported_total(t: SampleTables) -> DataFrame:
    return sinks.category_manifest(t.papers).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"))


# --- distributions ---------------------------------------------------------------------------


def coverage(t: SampleTables) -> DataFrame:
    return counting.coverage(t.papers, METHOD)


def relevance_stats(t: SampleTables) -> DataFrame:
    return counting.relevance_stats(t.papers)


def method_distribution(t: SampleTables) -> DataFrame:
    return counting.distribution(t.papers, METHOD, "classified")


def material_distribution(t: SampleTables) -> DataFrame:
    return counting.distribution(t.papers, MATERIAL, "classified")


def method_share_nonnull(t: SampleTables) -> DataFrame:
    return counting.highlighted(counting.distribution(t.papers, METHOD, "nonnull"))


def method_share_all(t: SampleTables) -> DataFrame:
    return counting.distribution(t.papers, METHOD, "all")


def confidence_of_classified(t: SampleTables) -> DataFrame:
    return counting.distribution(t.papers, "model_confidence", "classified", METHOD)


def confidence_distribution(t: SampleTables) -> DataFrame:
    return counting.side_by_side(t.papers, ["model_confidence", "material_confidence"])


def top_specific_models(t: SampleTables) -> DataFrame:
    return counting.frequent_labels(t.papers, "model_specific_models", METHOD)


def tag_distribution(t: SampleTables) -> DataFrame:
    return counting.mentions(t.papers, "model_secondary_tags", METHOD).drop("pct_mentions")


def category_mentions(t: SampleTables) -> DataFrame:
    return counting.mentions(t.papers, "material_categories", MATERIAL)


def labels_per_paper(t: SampleTables) -> DataFrame:
    return counting.labels_per_paper(t.papers)


def multi_label_papers(t: SampleTables) -> DataFrame:
    return counting.multi_label_papers(t.papers).select("paper_id", MATERIAL)


def label_combinations(t: SampleTables) -> DataFrame:
    return counting.label_combinations(t.papers)


def distinct_labels(t: SampleTables) -> DataFrame:
    return counting.distinct_labels(t.papers)


def others_collapse(t: SampleTables) -> DataFrame:
    return counting.collapse_small(t.papers, METHOD)


def top_journals(t: SampleTables) -> DataFrame:
    return counting.top_values(t.papers, "journal", 15)


def top_materials(t: SampleTables) -> DataFrame:
    return counting.top_values(t.papers, MATERIAL, 12)


def method_material_crosstab(t: SampleTables) -> DataFrame:
    return counting.crosstab(t.papers)


def llm_total(t: SampleTables) -> DataFrame:
    return counting.language_model_total(t.papers)


# --- trends ----------------------------------------------------------------------------------


def basic_stats(t: SampleTables) -> DataFrame:
    return counting.basic_stats(_dated(t))


def yearly_counts(t: SampleTables) -> DataFrame:
    return trends.yearly_counts(_dated(t))


def yearly_growth(t: SampleTables) -> DataFrame:
    return trends.yearly_growth(_dated(t))


def journal_growth(t: SampleTables) -> DataFrame:
    return trends.yearly_growth(_dated(t).where(F.col("journal").isNotNull()), "journal")


def recent_share(t: SampleTables) -> DataFrame:
    return trends.recent_share(_dated(t), 3)


def recent_years(t: SampleTables) -> DataFrame:
    return trends.recent_years(_dated(t), 3)


def llm_by_year(t: SampleTables) -> DataFrame:
    return trends.language_models_by_year(_dated(t))


def llm_share_by_year(t: SampleTables) -> DataFrame:
    return trends.language_model_share_by_year(_dated(t))


def llm_flags(t: SampleTables) -> DataFrame:
    return t.papers.select(
        "paper_id", language_model_label(F.col(METHOD)).alias("is_llm"),
        language_model_label(F.col(METHOD), strict=True).alias("is_llm_strict"),
    )


def trend_curve(t: SampleTables) -> DataFrame:
    """Curve points, rounded so that the order of floating-point steps does not show."""
    points = curve.trend_curves(_dated(t), "journal")
    return points.select("series", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- reports ---------------------------------------------------------------------------------


def summary_report(t: SampleTables) -> DataFrame:
    return reports.summary_report(_dated(t))


def material_report(t: SampleTables) -> DataFrame:
    return reports.material_report(t.papers)


def method_report(t: SampleTables) -> DataFrame:
    return reports.method_report(t.papers)


def material_report_text(t: SampleTables) -> DataFrame:
    return _numbered(report_text.material_lines(reports.material_report(t.papers)))


def method_report_text(t: SampleTables) -> DataFrame:
    return _numbered(report_text.method_lines(reports.method_report(t.papers)))


def summary_report_text(t: SampleTables) -> DataFrame:
    return _numbered(report_text.summary_lines(reports.summary_report(_dated(t)), t.papers.columns))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number; a report is short whatever the table."""
    return lines.select(F.row_number().over(Window.orderBy("position")).cast("bigint").alias("line_no"), "line")


# --- replies and scoring ---------------------------------------------------------------------


def _parsed(t: SampleTables, fmt: ReplyFormat) -> DataFrame:
    return t.replies(fmt).select("paper_id", *reply_columns(F.col("reply"), fmt))


def parse_replies(t: SampleTables) -> DataFrame:
    return _list_texts(_parsed(t, MATERIAL_REPLY), "material_categories")


def parse_method_replies(t: SampleTables) -> DataFrame:
    return _list_texts(_parsed(t, METHOD_REPLY), "model_specific_models", "model_secondary_tags")


def parse_chat_turns(t: SampleTables) -> DataFrame:
    """Chat turns as replies: prose is not JSON, so each gives the default record."""
    turns = t.table("conversations")
    parsed = turns.select("conv_id", "turn", *reply_columns(F.col("text"), MATERIAL_REPLY))
    return _list_texts(parsed, "material_categories")


def binary_decision(t: SampleTables) -> DataFrame:
    """The number inside ``props`` as a reply, padded and signed."""
    digits = F.regexp_extract("props", r"(\d+)", 1)
    reply = F.concat(F.when(F.col("event_type") == "click", " +").otherwise("\t"), digits, F.lit("\n"))
    return t.table("events").select("event_id", to_int(reply).alias("number"), text.binary_decision(reply).alias("decision"))


def llm_share_from_replies(t: SampleTables) -> DataFrame:
    """From raw method replies to the share of language models per year."""
    scores = t.replies(METHOD_REPLY)
    return trends.language_model_share_by_year(
        scans.in_year_range(scans.with_year(scoring.scatter(t.papers, scores, scoring.METHOD)))
    ).select("year", "llm", "non_llm", "llm_pct")


def scatter_results(t: SampleTables) -> DataFrame:
    filled = scoring.scatter(t.papers, t.replies(MATERIAL_REPLY), scoring.MATERIAL)
    columns = ["material_categories", "material_confidence", MATERIAL]
    return _list_texts(filled.select("paper_id", "is_relevant", *columns), "material_categories")


def _earlier(t: SampleTables) -> DataFrame:
    """Documents with a quality label, as papers whose relevance is known."""
    return t.table("labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").alias("is_relevant"))


def resume_pending(t: SampleTables) -> DataFrame:
    earlier = _earlier(t).withColumn("error", F.lit(None).cast("string"))
    pending = scoring.pending_papers(t.documents, earlier).select("paper_id")
    return t.documents.join(pending, "paper_id", "left_semi").select("paper_id", "journal")


def resume_merge(t: SampleTables) -> DataFrame:
    repeated = _earlier(t).union(_earlier(t)).union(_earlier(t).withColumn("is_relevant", F.lit(None).cast("int")))
    return scoring.merge_earlier(t.documents, repeated).select("paper_id", "is_relevant")


def topic_filter(t: SampleTables) -> DataFrame:
    return topic.topic_filter(t.documents, SAMPLE_TOPIC_ALL_OF, SAMPLE_TOPIC_NONE_OF).select("paper_id", "journal")


def lexicon_tags(t: SampleTables) -> DataFrame:
    tagged = lexicon.tag_with_lexicon(t.documents, SAMPLE_LEXICON, "None")
    return _list_texts(tagged.select("paper_id", "labels", "primary_label", "confidence"), "labels")


def topic_filter_default(t: SampleTables) -> DataFrame:
    """The real term groups and the category exclusion."""
    return topic.topic_filter(worded_documents(t.documents)).select("paper_id", "article_title")


def material_words(t: SampleTables) -> DataFrame:
    """The real word lists of materials."""
    tagged = lexicon.classify_materials_by_words(worded_documents(t.documents))
    columns = ["paper_id", "material_categories", MATERIAL, "material_confidence"]
    return _list_texts(tagged.select(columns), "material_categories")


def method_words(t: SampleTables) -> DataFrame:
    """The real word lists of methods, with models and tags."""
    tagged = lexicon.classify_methods_by_words(worded_documents(t.documents))
    columns = ["paper_id", METHOD, "model_specific_models", "model_secondary_tags", "model_confidence"]
    return _list_texts(tagged.select(columns), "model_specific_models", "model_secondary_tags")


def _sample_method_answer(prompt: str) -> tuple[str, int]:
    category = "Large Language Models (LLMs)" if "GPT" in prompt or "BERT" in prompt else "Rule-Based & Hybrid"
    record = {"primary_category": category, "specific_models": ["GPT-4"] if "GPT" in prompt else [], "secondary_tags": [], "confidence": "medium"}
    return json.dumps(record), 1


def classify_methods(t: SampleTables) -> DataFrame:
    """The method task from prompts to columns."""
    done = scoring.classify(
        worded_documents(t.documents), scoring.per_paper(_sample_method_answer), scoring.METHOD, scratch_dir(t.spark, "scores")
    )
    columns = ["paper_id", METHOD, "model_specific_models", "model_confidence"]
    return _list_texts(done.select(columns), "model_specific_models")


def render_prompt(t: SampleTables) -> DataFrame:
    return prompts.render_prompts(t.documents, "Answer with one digit.")


def _sample_material_answer(prompt: str) -> tuple[str, int]:
    if "Apache" in prompt:
        raise ValueError("refused")
    label = "Polymers" if "license" in prompt else "Nanoparticles"
    record = {"material_categories": [label], "confidence": "high", "primary_category": label}
    return f"```json\n{json.dumps(record)}\n```", len(prompt)


def _sample_relevance_answer(prompt: str) -> tuple[str, int]:
    return (" 1\n" if "license" in prompt else "0"), 1


def score_batch(t: SampleTables) -> DataFrame:
    """Prompts through a Python scorer, replies through the strict parser."""
    scored = scoring.score(t.documents, scoring.per_paper(_sample_material_answer))
    return scored.select(
        "paper_id", "tokens", "error",
        *reply_columns(F.col("reply"), MATERIAL_REPLY),
    ).withColumn("material_categories", list_text(F.col("material_categories")))


def scoring_usage(t: SampleTables) -> DataFrame:
    return scoring.usage(scoring.score(t.documents, scoring.per_paper(_sample_material_answer)))


def classify_batch(t: SampleTables) -> DataFrame:
    """Scores relevant papers into a results table and fills their columns; the others keep nulls."""
    papers = t.documents.join(_earlier(t), "paper_id", "left")
    done = scoring.classify(
        papers, scoring.per_paper(_sample_material_answer, threads=4), scoring.MATERIAL, scratch_dir(t.spark, "scores")
    )
    return done.select("paper_id", "is_relevant", MATERIAL, "material_confidence")


def _with_earlier_scores(t: SampleTables) -> str:
    path = scratch_dir(t.spark, "scores")
    append_scores(
        _earlier(t).select(
            "paper_id", F.col("is_relevant").cast("string").alias("reply"),
            F.lit(1).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("error"),
        ),
        path,
    )
    return path


def resumable_scoring(t: SampleTables) -> DataFrame:
    """Earlier results stay, the rest is scored with a commit for every few hundred papers."""
    path = _with_earlier_scores(t)
    done = scoring.classify(
        t.documents, scoring.per_paper(_sample_relevance_answer), scoring.RELEVANCE, path, papers_per_commit=300
    )
    return done.select("paper_id", "is_relevant")


def incremental_scoring(t: SampleTables) -> DataFrame:
    """As above, with the documents arriving as a stream of two micro-batches, the second of which overlaps the first."""
    path, arriving = _with_earlier_scores(t), scratch_dir(t.spark, "arriving")
    documents = t.table("documents")
    documents.where("doc_id % 2 = 0 OR doc_id % 3 = 0").write.parquet(f"{arriving}/drop=1")
    documents.where("doc_id % 2 = 1").write.parquet(f"{arriving}/drop=2")
    state = scratch_dir(t.spark, "stream")
    for drop in ("1", "[12]"):
        source = t.spark.readStream.schema(documents.schema).parquet(f"{arriving}/drop={drop}")
        score_stream(papers_from_documents(source), scoring.per_paper(_sample_relevance_answer), scoring.RELEVANCE, path, state).awaitTermination()
    scores = read_scores(t.spark, path, t.documents.schema["paper_id"].dataType)
    return scoring.scatter(t.documents, scores, scoring.RELEVANCE).select("paper_id", "is_relevant")


QUERIES: dict[str, Callable[[SampleTables], DataFrame]] = {
    f.__name__: f
    for f in (
        csv_na_normalise, csv_round_trip, column_resolution, year_parse_filter, relevant_papers, category_members,
        export_by_category, papers_per_category, exported_total,
        coverage, relevance_stats, method_distribution, material_distribution, method_share_nonnull,
        method_share_all, confidence_of_classified, confidence_distribution, top_specific_models, tag_distribution,
        category_mentions, labels_per_paper, multi_label_papers, label_combinations, distinct_labels,
        others_collapse, top_journals, top_materials, method_material_crosstab, llm_total,
        basic_stats, yearly_counts, yearly_growth, journal_growth, recent_share, recent_years, llm_by_year,
        llm_share_by_year, llm_flags, trend_curve,
        summary_report, material_report, method_report, material_report_text, method_report_text, summary_report_text,
        parse_replies, parse_method_replies, parse_chat_turns, binary_decision, llm_share_from_replies,
        scatter_results, resume_pending, resume_merge, topic_filter, topic_filter_default, lexicon_tags, material_words, method_words, classify_methods, render_prompt,
        score_batch, scoring_usage, classify_batch, resumable_scoring, incremental_scoring,
    )
}
