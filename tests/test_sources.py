import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom import session, taxonomy
from paperloom.operators import counting
from paperloom.plans import jobs, reports
from paperloom.sources import papers as scans
from paperloom.sources import sinks

CSV = (
    "﻿Article Title,Author Keywords,Keywords Plus,Abstract,Publication Year,Source Title,is_relevant,material_categories,Extra\n"
    '"A ""quoted"" title",k1; k2,NA,"two\nlines, one cell",2020,J1,1.0,"[""A"", ""B""]",x\n'
    "null,,None,text,2020.5,n/a,0,,y\n"
    "T3,k,p,a, 2021 ,J2,,[broken,NaN\n"
    "T4,k,p,a,x,J2,1,[],-nan\n"
    "T5,k,p,a,1e3,J2,1,null,z\n"
)


def read(spark, tmp_path):
    path = tmp_path / "papers.csv"
    path.write_text(CSV, encoding="utf-8")
    return scans.standardise(scans.read_papers_csv(spark, str(path)))


def test_csv_scan(spark, tmp_path):
    df = read(spark, tmp_path)
    assert {"article_title", "author_keywords", "keywords_plus", "abstract", "publication_year", "journal", "Extra"} <= set(df.columns)
    rows = df.orderBy(F.monotonically_increasing_id()).collect()
    assert [r.article_title for r in rows] == ['A "quoted" title', None, "T3", "T4", "T5"]
    assert rows[0].abstract == "two\nlines, one cell"
    assert [r.keywords_plus for r in rows] == [None, None, "p", "p", "p"]
    assert [r.year for r in rows] == [2020.0, 2020.5, 2021.0, None, 1000.0]
    assert [r.is_relevant for r in rows] == [1, 0, None, 1, 1]
    assert [r.material_categories for r in rows] == [["A", "B"], None, None, [], None]
    assert [r.Extra for r in rows] == ["x", "y", None, None, "z"]
    assert len({r.paper_id for r in rows}) == 5


def test_missing_tokens_are_those_of_pandas(spark, tmp_path):
    path = tmp_path / "na.csv"
    cells = [*taxonomy.NA_TOKENS, "na", "Null", "none", "0", "-"]
    path.write_text("c,d\n" + "".join(f'"{c}",1\n' for c in cells))
    got = [r.c for r in scans.read_papers_csv(spark, str(path)).collect()]
    expected = [None if pd.isna(v) else v for v in pd.read_csv(path, dtype=str)["c"]]
    assert got == expected


def test_csv_round_trip(spark, tmp_path):
    df = read(spark, tmp_path)
    sinks.write_csv(df, str(tmp_path / "out"))
    back = scans.standardise(scans.read_papers_csv(spark, str(tmp_path / "out")))
    columns = [c for c in df.columns if c != "year"]
    assert sorted(map(repr, back.select(columns).collect())) == sorted(map(repr, df.select(columns).collect()))


def test_year_range_is_inclusive(spark):
    years = ["1999", "2000", "2026", "2027", "2020.5", " 2021 ", "1e3", "x", "", None, "NaN"]
    df = spark.createDataFrame([(y,) for y in years], "publication_year string")
    assert sorted(r.year for r in scans.in_year_range(scans.with_year(df)).collect()) == [2000.0, 2020.5, 2021.0, 2026.0]


def test_no_year_column(spark):
    df = scans.with_year(spark.createDataFrame([("T",)], "article_title string"))
    assert df.first().year == 2020.0


def test_first_present_name_wins(spark):
    df = spark.createDataFrame([("a", "b", "2001")], ["Publication Name", "Journal", "year"])
    renamed = scans.rename_columns(df)
    assert renamed.first().journal == "b" and "Publication Name" in renamed.columns
    assert scans.first_present(df, ["Source Title"]) is None


def test_ids_tell_fields_and_nulls_apart(spark):
    rows = [("a", "bc"), ("ab", "c"), ("a", None), ("a", ""), (None, "a"), ("a", "bc")]
    ids = [r.paper_id for r in scans.with_paper_id(spark.createDataFrame(rows, "article_title string, abstract string")).collect()]
    assert len(set(ids)) == 5 and ids[0] == ids[5]


def test_relevant_only_needs_the_column(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "paper_id int, is_relevant int")
    assert [r.paper_id for r in scans.relevant_only(df).collect()] == [1]
    assert scans.relevant_only(df, False).count() == 3
    assert scans.relevant_only(df.drop("is_relevant")).count() == 3


def test_export_by_category(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, ["A/B x", "C"]), (2, ["C", "C"]), (3, None), (4, [])], "paper_id int, material_categories array<string>"
    )
    out = str(tmp_path / "export")
    sinks.export_by_category(df, out)
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["category_file=A-B_x", "category_file=C"]
    back = scans.read_papers_csv(spark, out)
    assert sorted((r.category_file, r.paper_id) for r in back.collect()) == [("A-B_x", "1"), ("C", "1"), ("C", "2")]
    manifest = [tuple(r) for r in sinks.category_manifest(df).collect()]
    assert manifest == [("A/B x", 1, "category_file=A-B_x"), ("C", 2, "category_file=C")]


def test_categories_that_share_a_key_have_folders_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(1, ["A/B"]), (2, ["A-B"]), (3, ["None"])], "paper_id int, material_categories array<string>")
    out = str(tmp_path / "export")
    sinks.export_by_category(df, out)
    manifest = {r.category: r.filename for r in sinks.category_manifest(df).collect()}
    assert sorted(manifest.values()) == sorted(d for d in os.listdir(out) if "=" in d)
    back = {r.paper_id: f"category_file={r.category_file}" for r in scans.read_papers_csv(spark, out).collect()}
    assert back == {"1": manifest["A/B"], "2": manifest["A-B"], "3": "category_file=None"}


def test_csv_files_with_other_columns_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "a.csv").write_text("Article Title,Abstract,Publication Year\nT1,A1,2020\n", encoding="utf-8-sig")
    (folder / "b.csv").write_text("Abstract,Article Title,Author Keywords\n\"A,\n2\",T2,K2\n")
    (folder / "_hidden").write_text("x\n")
    rows = {r["Article Title"]: r for r in scans.read_papers_csv(spark, str(folder)).collect()}
    assert [rows["T1"][c] for c in ("Abstract", "Publication Year", "Author Keywords")] == ["A1", "2020", None]
    assert [rows["T2"][c] for c in ("Abstract", "Publication Year", "Author Keywords")] == ["A,\n2", None, "K2"]


def test_flags_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("1.9",), ("1.0",), ("0",), ("x",), (None,)], "is_relevant string")
    assert [r.is_relevant for r in scans.standardise(df).collect()] == [None, 1, 0, None, None]


def test_scratch_folder_on_a_cluster_must_be_named(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")


def test_no_confidence_and_no_papers(spark):
    assert counting.side_by_side(spark.range(3), ["model_confidence"]).count() == 0
    none = spark.createDataFrame([], "year double, model_primary_category string")
    rows = {(r.section, r.item): r.n for r in reports.summary_report(none).collect()}
    assert rows["basic", "papers"] == 0 and rows["basic", "first_year"] is None and rows["recent", "last_years"] == 0


def test_having_label(spark):
    df = spark.createDataFrame([(1, '["A"]'), (2, '["B"]'), (3, None), (4, "null")], "paper_id int, material_categories string")
    assert [r.paper_id for r in scans.having_label(df, "A").collect()] == [1]


def test_reports_on_disk(spark, tmp_path):
    df = spark.createDataFrame(
        [(2020.0, "M", ["m"], ["t"], "high", "P", ["P", "Q"], "low")] * 3 + [(2021.0, None, None, None, None, None, None, None)],
        "year double, model_primary_category string, model_specific_models array<string>, model_secondary_tags array<string>,"
        "model_confidence string, primary_material_category string, material_categories array<string>, material_confidence string",
    )
    jobs.write_reports(df, str(tmp_path))

    def lines(name):
        parts = sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        return "".join(p.read_text() for p in parts).splitlines()

    material = lines("material_statistics")
    assert material[:4] == [
        "MATERIAL CLASSIFICATION ANALYSIS REPORT", "Total papers in dataset: 4",
        "Papers with material classification: 3", "Classification rate: 75.0%",
    ]
    assert "P" + " " * 34 + "    3 (100.0%) " + "█" * 50 in material
    assert "P" + " " * 34 + "    3 (100.0% of papers,  50.0% of mentions) " + "█" * 50 in material
    assert "  2 categories:    3 papers (100.0%)" in material
    assert "P + Q" + " " * 55 + "    3" in material
    method = lines("method_statistics")
    assert "m" + "." * 49 + "    3" in method and "t" + "." * 49 + "    3 (100.0%)" in method
    summary = lines("summary_statistics")
    assert summary[:5] == [
        "MATERIALS DATA EXTRACTION LITERATURE ANALYSIS SUMMARY", "1. BASIC STATISTICS", "Total Papers: 4",
        "Year Range: 2020 - 2021", "Average Papers per Year: 2.0",
    ]
    at = summary.index("Model Classification:")
    assert summary[at - 1] == "5. CLASSIFICATION CONFIDENCE" and summary[at + 2] == "Material Classification:"
    assert material[material.index("MULTI-CATEGORY ANALYSIS") + 1] == "Number of material categories per paper:"
    assert "Average Papers per Year: 2.0" in summary and "Papers (Last 5 Years): 4 (100.0%)" in summary
    assert summary.index("  2021: 1 papers") + 1 == summary.index("  2020: 3 papers")
    assert "  Total LLM Papers: 0 (0.0%)" in summary
