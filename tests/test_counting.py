import pytest
from pyspark.sql import functions as F

from paperloom.operators import counting
from paperloom.plans import reports

METHOD = "model_primary_category"


def table(spark, values, name="k"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_three_denominators(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), (None, None)], "k string, c string")
    assert tuples(counting.distribution(df, "k", "nonnull")) == [("a", 2, 100.0)]
    assert tuples(counting.distribution(df, "k", "all")) == [("a", 2, 50.0)]
    assert tuples(counting.distribution(df, "c", "classified", "k")) == [("x", 1, 50.0)]
    with pytest.raises(ValueError):
        counting.distribution(df, "k", "some")


def test_ties_go_by_key(spark):
    assert [r.key for r in counting.distribution(table(spark, ["b", "a", "c", "c"]), "k").collect()] == ["c", "a", "b"]
    assert [r.key for r in counting.top_values(table(spark, ["b", "a", None, None, None]), "k", 1).collect()] == ["a"]


def test_empty_tables(spark):
    none = table(spark, [])
    assert tuples(counting.distribution(none, "k")) == []
    assert tuples(counting.coverage(none, "k")) == [(0, 0, None)]
    assert tuples(counting.collapse_small(none, "k")) == []
    assert tuples(counting.language_model_total(none, "k")) == [(0, 0, None)]


def test_relevance_stats(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (None,)], "is_relevant int")
    assert tuples(counting.relevance_stats(df)) == [(1, 2, 2, 4, 50.0), (0, 1, 2, 4, 50.0)]


def lists(spark, rows):
    return spark.createDataFrame(rows, "c string, l array<string>")


def test_mentions_count_papers_and_labels(spark):
    df = lists(spark, [("x", ["a", "a", "b"]), ("x", []), ("x", None), ("x", ["a", None]), (None, ["z"])])
    assert tuples(counting.mentions(df, "l", "c")) == [("a", 3, 75.0, 75.0), ("b", 1, 25.0, 25.0)]


def test_frequent_labels_take_the_top_before_support(spark):
    rows = [("x", ["a"] * 5), ("x", ["b"] * 4), ("x", ["c"] * 3), ("x", ["d"] * 2)]
    assert tuples(counting.frequent_labels(lists(spark, rows), "l", "c", top=2)) == [("a", 5), ("b", 4)]
    assert tuples(counting.frequent_labels(lists(spark, rows), "l", "c", top=9)) == [("a", 5), ("b", 4), ("c", 3)]


def test_labels_per_paper(spark):
    df = lists(spark, [("x", ["a", "a"]), ("x", []), ("x", None), ("x", ["a", "b"]), ("x", [])])
    assert tuples(counting.labels_per_paper(df, "l")) == [(0, 2, 50.0), (2, 2, 50.0)]


def test_combinations_keep_duplicates(spark):
    df = lists(spark, [("x", ["b", "a"])] * 2 + [("x", ["a", "b"])] + [("x", ["a", "a"])] * 3 + [("x", ["a"])] * 9 + [("x", ["c", "d"])] * 2)
    assert tuples(counting.label_combinations(df, "l")) == [("a + a", 3), ("a + b", 3)]


def test_collapse(spark):
    values = ["big"] * 90 + ["mid"] * 6 + ["tiny"] * 2 + ["Large Language Models (LLMs)"] + ["Others"]
    got = tuples(counting.collapse_small(table(spark, values), "k"))
    assert [g[:3] for g in got] == [("big", 90, 90.0), ("mid", 6, 6.0), ("Large Language Models (LLMs)", 1, 1.0), ("Others", 3, 3.0)]
    assert [g[3:] for g in got] == [(False, True), (False, True), (True, True), (False, False)]


def test_collapse_with_nothing_small(spark):
    assert [r.key for r in counting.collapse_small(table(spark, ["a", "b"]), "k").collect()] == ["a", "b"]


def test_crosstab_margins_count_all_values(spark):
    rows = [("m1", "p1")] * 3 + [("m1", None)] * 5 + [("m2", None)] * 4 + [("m3", "p2")] * 2 + [(None, "p2")] * 9
    df = spark.createDataFrame(rows, "model_primary_category string, primary_material_category string")
    assert tuples(counting.crosstab(df, top_rows=2, top_columns=2)) == [
        ("m1", "p2", 0, 8, 11), ("m1", "p1", 3, 8, 3), ("m2", "p2", 0, 4, 11), ("m2", "p1", 0, 4, 3),
    ]


def test_side_by_side_takes_present_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "k string, c string")
    assert tuples(counting.side_by_side(df, ["k", "c", "gone"])) == [("c", "x", 1, 100.0), ("k", "a", 1, 50.0), ("k", "b", 1, 50.0)]


def test_basic_stats(spark):
    df = spark.createDataFrame([(2000.0,), (2003.0,)], "year double")
    assert tuples(counting.basic_stats(df)) == [(2, 2000.0, 2003.0, 0.5)]


def test_hot_value_is_counted_whole(spark):
    """One label on every paper and a third of the papers with one list."""
    df = spark.range(60000).select(
        F.lit("x").alias("c"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"), F.lit("h2"))).otherwise(F.array(F.lit("hot"), F.col("id").cast("string"))).alias("l"),
    )
    assert tuples(counting.mentions(df, "l", "c").limit(2))[0][:2] == ("hot", 60000)
    assert tuples(counting.label_combinations(df, "l")) == [("h2 + hot", 20000)]


def test_report_of_nothing_classified(spark):
    df = spark.createDataFrame([(None, None, None)], "primary_material_category string, material_confidence string, material_categories string")
    got = {r.section: (r.n, r.pct) for r in reports.material_report(df).collect()}
    assert got == {"papers": (1, None), "classified": (0, 0.0)}


def test_summary_leaves_out_absent_columns(spark):
    df = spark.createDataFrame([(2020.0, "low")], "year double, material_confidence string")
    assert {r.section for r in reports.summary_report(df).collect()} == {"basic", "recent", "year"}
