"""Properties of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import counting, scoring
from paperloom.plans import catalog
from paperloom.plans.sample_tables import SampleTables
from paperloom.sources import papers as scans
from paperloom.sources import sinks
from paperloom.sources.scores import append_scores, read_scores

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("papers") / "papers")
    SampleTables(spark, FOLDER).papers.write.parquet(path)
    return SampleTables(spark, FOLDER, spark.read.parquet(path))


def executed(df):
    """The executed part of the final plan: initial plans and sub-queries that were merged away are left out."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None and depth > skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = depth - 3
        elif "isFinalPlan=false" in line:
            skip = depth
        else:
            kept.append(line)
    return "\n".join(kept)


SINGLE_PASS = [
    "coverage", "relevance_stats", "method_distribution", "method_share_nonnull", "method_share_all",
    "confidence_of_classified", "confidence_distribution", "top_specific_models", "tag_distribution", "category_mentions",
    "labels_per_paper", "label_combinations", "distinct_labels", "papers_per_category", "others_collapse", "top_journals",
    "method_material_crosstab", "llm_total", "basic_stats", "yearly_counts", "yearly_growth", "journal_growth",
    "recent_share", "recent_years", "llm_by_year", "llm_share_by_year", "trend_curve",
    "summary_report", "material_report", "method_report",
]


@pytest.mark.parametrize("name", SINGLE_PASS)
def test_papers_are_read_once(stored, name):
    plan = executed(catalog.QUERIES[name](stored))
    assert plan.count("FileScan") == 1
    assert not re.search(r"NestedLoopJoin|CartesianProduct|SortMergeJoin", plan)


def test_filters_and_columns_reach_the_scan(stored):
    plan = executed(counting.distribution(scans.relevant_only(stored.papers), "journal", "all"))
    assert "EqualTo(is_relevant,1)" in plan
    assert "ReadSchema: struct<journal:string,is_relevant:int>" in plan


def test_pre_counting_before_every_shuffle_of_papers(stored):
    for name in ("method_distribution", "category_mentions", "label_combinations", "method_material_crosstab", "yearly_counts"):
        plan = executed(catalog.QUERIES[name](stored))
        assert re.search(r"HashAggregate\(keys=\[[^]]+\], functions=\[partial_count", plan), name


def test_limits_take_the_top_without_a_full_sort(stored):
    assert "TakeOrderedAndProject(limit=15" in executed(catalog.top_journals(stored))


def test_top_items_of_reports_are_cut_before_the_shuffle(stored):
    assert "WindowGroupLimit" in executed(catalog.method_report(stored))


def test_scorer_runs_once_per_paper(stored):
    plan = catalog.score_batch(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_scatter_is_an_equi_join(stored):
    scores = stored.papers.select("paper_id", F.lit("1").alias("reply"))
    plan = scoring.scatter(stored.papers, scores, scoring.RELEVANCE)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (paper_id" in plan


def test_pending_papers_are_shuffled_once(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = stored.papers.where("is_relevant = 1").select("paper_id", F.lit(None).cast("string").alias("error"))
        pending = scoring.pending_papers(stored.papers, scores)
        pending.collect()
        # Prompts hold line ends, so the plan is not cut by lines here.
        plan = pending._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    # One shuffle for each side of the join; most copies fall away before it.
    assert len(re.findall(r"Exchange hashpartitioning\(paper_id", plan)) == 2
    assert plan.index("Exchange hashpartitioning") < plan.index("first_of_batch")


def test_hot_category_is_split_over_files(spark, tmp_path):
    """One category holds most rows: it is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    try:
        label = F.when(F.col("id") % 10 == 0, F.concat(F.lit("small"), F.col("id") % 3)).otherwise("hot")
        df = spark.range(40000).select(F.col("id").alias("paper_id"), F.sha2(F.col("id").cast("string"), 256).alias("t"), F.array(label).alias("material_categories"))
        sinks.export_by_category(df, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("part-*"))) for d in (tmp_path / "out").iterdir() if d.is_dir()}
    assert files["category_file=hot"] > 5
    assert scans.read_papers_csv(spark, str(tmp_path / "out")).count() == 40000


def test_hot_copies_are_filled_by_a_split_join(spark, tmp_path):
    """A third of the rows carry one id: the join that fills them is split by size, nothing is lost."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        papers = spark.range(0, 60000, 1, 8).select(ids.alias("paper_id"), F.sha2(F.col("id").cast("string"), 256).alias("abstract"))
        path = str(tmp_path / "scores")
        one = [F.lit(v).cast(t).alias(c) for c, v, t in (("reply", "1", "string"), ("tokens", 1, "long"), ("error", None, "string"))]
        append_scores(papers.select("paper_id").distinct().select("paper_id", *one), path)
        filled = scoring.scatter(papers, read_scores(spark, path, papers.schema["paper_id"].dataType), scoring.RELEVANCE)
        plan = executed(filled)
        assert "skew=true" in plan
        assert filled.where("is_relevant = 1").count() == 60000
    finally:
        for key in settings:
            spark.conf.unset(key)
