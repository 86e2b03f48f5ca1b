"""Relations between results that hold for any table of papers."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import counting, trends
from paperloom.plans import reports
from paperloom.plans.sample_tables import SampleTables
from paperloom.sources import papers as scans

METHOD, MATERIAL = "model_primary_category", "primary_material_category"


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("papers") / "papers")
    SampleTables(spark, "/root/testdata/sf0.001").papers.write.parquet(path)
    return spark.read.parquet(path)


def total(df, column="n"):
    return df.agg(F.sum(column)).first()[0]


def test_distribution_adds_up(papers):
    known = papers.where(F.col(METHOD).isNotNull()).count()
    shares = counting.distribution(papers, METHOD, "nonnull")
    assert total(shares) == known
    assert total(shares, "pct") == pytest.approx(100)
    assert total(counting.distribution(papers, METHOD, "all"), "pct") == pytest.approx(known / papers.count() * 100)


def test_collapse_keeps_the_total(papers):
    assert total(counting.collapse_small(papers, METHOD, 0.2)) == total(counting.distribution(papers, METHOD))


def test_language_models_and_others_add_up_to_the_year(papers):
    dated = scans.in_year_range(scans.with_year(papers))
    both = {r.year: r.llm + r.non_llm for r in trends.language_models_by_year(dated).collect()}
    assert both == {r.year: r.n for r in trends.yearly_counts(dated).collect()}


def test_lengths_cover_all_readable_lists(papers):
    sizes = counting.labels_per_paper(papers)
    assert total(sizes) == papers.where("material_categories is not null").count()
    assert sizes.agg(F.sum(F.col("n") * F.col("n_labels"))).first()[0] == total(counting.mentions(papers, "material_categories", MATERIAL))


def test_cells_stay_within_margins(papers):
    table = counting.crosstab(papers)
    assert table.where("n > row_total or n > col_total").count() == 0
    assert table.count() == 7 * 6
    assert total(table) == papers.where(f"{METHOD} is not null and {MATERIAL} is not null").count()


def test_reports_agree_with_their_operators(papers):
    def section(report, name):
        return {r["item"]: (r.n, r.pct) for r in report.where(F.col("section") == name).collect()}

    material, method = reports.material_report(papers), reports.method_report(papers)

    def pairs(df):
        return {r[0]: (r[1], r[2]) for r in df.collect()}

    assert section(material, "primary") == pairs(counting.distribution(papers, MATERIAL, "classified"))
    assert section(material, "mention") == pairs(counting.mentions(papers, "material_categories", MATERIAL))
    assert section(method, "tag") == pairs(counting.mentions(papers, "model_secondary_tags", METHOD))
    combos = {r.combination: r.n for r in counting.label_combinations(papers).collect()}
    assert {k: n for k, (n, _) in section(material, "combination").items()} == combos
    models = {r.key: r.n for r in counting.frequent_labels(papers, "model_specific_models", METHOD).collect()}
    assert {k: n for k, (n, _) in section(method, "model").items()} == models


labels = st.sampled_from(["a", "b", "A b", "Others", "Large Language x", "", "é"])
rows = st.lists(st.tuples(st.none() | labels, st.none() | st.lists(st.none() | labels, max_size=4)), max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_small_tables_against_plain_counting(spark, table):
    df = spark.createDataFrame(table, "c string, l array<string>")
    known = [(c, items) for c, items in table if c is not None]
    want = {}
    for c, _ in known:
        want[c] = want.get(c, 0) + 1
    got = {r.key: (r.n, r.pct) for r in counting.distribution(df, "c", "classified").collect()}
    assert got == {k: (n, n / len(known) * 100) for k, n in want.items()}
    flat = [x for _, items in known for x in items or [] if x is not None]
    got = {r.key: (r.n, r.pct_papers, r.pct_mentions) for r in counting.mentions(df, "l", "c").collect()}
    assert got == {x: (flat.count(x), flat.count(x) / len(known) * 100, flat.count(x) / len(flat) * 100) for x in set(flat)}
    combos = [tuple(sorted(items)) for _, items in table if items and len(items) > 1 and None not in items]
    got = {r.combination: r.n for r in counting.label_combinations(df, "l", 1).collect()}
    joined = [" + ".join(c) for c in combos]
    assert got == {j: joined.count(j) for j in joined}
