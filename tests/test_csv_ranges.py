import csv
import gzip
import io
import random

import pytest

from paperloom.sources import csv_ranges
from paperloom.sources import papers as scans

ODD = (
    "﻿id,title,abstract\n"
    '1,"plain","two\nlines, one cell"\n'
    '2,"a ""quoted"" word","""\n"""\n'
    '3,5" pipes and 6" pipes,no cell is open\n'
    '\n'
    '4,"x","a long cell\n\n\nwith ""quotes"",\n and commas,\n,""\n"\n'
    '5,,""\r\n'
    '6,"é\r\nü",z\r\n'
    '7,"日本""\n,""語",last'
)


def whole(text):
    """The records of a text by Python's reader, as lists of cells."""
    return [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]


def by_ranges(path, size, step):
    """The records of a file cut into ranges, read one by one as the job does it."""
    starts = list(range(0, size, step))
    inside, out, begin = False, [], []
    for start in starts:
        begin.append(inside)
        outside, within = csv_ranges.effect(path, start, min(size, start + step))
        inside = within if inside else outside
    for start, state in zip(starts, begin):
        out += list(csv_ranges.records(path, start, min(size, start + step), state))
    return out


def test_every_cut_of_a_file_gives_the_same_records(tmp_path):
    (tmp_path / "odd.csv").write_bytes(ODD.encode())
    path, size = f"file:{tmp_path}/odd.csv", len(ODD.encode())
    expected = list(csv_ranges.records(path))
    assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in expected] == whole(ODD.replace("\r\n7", "\n7").replace('""\r\n6', '""\n6'))
    for step in range(1, size + 2):
        assert by_ranges(path, size, step) == expected, step


def test_random_files_and_chunks(tmp_path, monkeypatch):
    rng = random.Random(3)
    for number in range(60):
        monkeypatch.setattr(csv_ranges, "CHUNK", rng.choice([1, 3, 64, 4096]))
        rows = [["".join(rng.choices(['"', ",", "\n", "a", "é", " "], k=rng.randint(0, 12))) for _ in range(rng.randint(2, 4))] for _ in range(rng.randint(0, 30))]
        file = io.StringIO(newline="")
        csv.writer(file, lineterminator="\n").writerows([["h1", "h2"], *rows])
        data = file.getvalue().encode()
        (tmp_path / f"{number}.csv").write_bytes(data)
        path = f"file:{tmp_path}/{number}.csv"
        found = by_ranges(path, len(data), rng.choice([1, 7, 50, 1000]))
        assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for r in found] == [["h1", "h2"], *rows]


def table(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_one_file_is_read_by_many_tasks_and_equals_the_multi_line_reader(spark, tmp_path):
    rng = random.Random(1)
    cells = ["", "a", 'x "q" y', "two\nlines", "comma, and\n\"both\"", "é", " blank ", "\n", '"', "end\r\nof line"]
    rows = [[str(k), *rng.choices(cells, k=3)] for k in range(3000)]
    with open(tmp_path / "big.csv", "w", encoding="utf-8-sig", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([["id", "Article Title", "abstract", "x"], *rows])
    plain = spark.read.options(header="true", multiLine="true", escape='"').csv(str(tmp_path / "big.csv"))
    expected = table(plain)
    for size in (999, 20_000):
        found = csv_ranges.read_csv_ranges(spark, str(tmp_path / "big.csv"), size)
        assert found.columns == plain.columns and table(found) == expected
        assert found.rdd.getNumPartitions() > 1
    with open(tmp_path / "win.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\r\n").writerows([["id", "t", "u", "v"], *rows])
    found = csv_ranges.read_csv_ranges(spark, str(tmp_path / "win.csv"), 999)
    assert {r.id: (r.t or "", r.u or "", r.v or "") for r in found.collect()} == {r[0]: tuple(r[1:]) for r in rows}


def test_folders_patterns_and_compressed_files(spark, tmp_path):
    folder = tmp_path / "in"
    for part in ("kind=1", "kind=2"):
        (folder / part).mkdir(parents=True)
    (folder / "kind=1" / "a.csv").write_text('id,abstract\n1,"x\ny"\n', encoding="utf-8-sig")
    (folder / "kind=1" / "empty.csv").write_text("")
    (folder / "kind=1" / "_hidden.csv").write_text("no,thing\n1,2\n")
    with gzip.open(folder / "kind=2" / "b.csv.gz", "wt") as file:
        file.write('abstract,year,id\n"u\n""v""",2020,2\n"",,3\n')
    found = scans.read_papers_csv(spark, str(folder))
    rows = {r.id: (r.abstract, r.year, r.kind) for r in found.collect()}
    assert rows == {"1": ("x\ny", None, 1), "2": ('u\n"v"', "2020", 2), "3": (None, None, 2)}
    assert {r.id for r in scans.read_papers_csv(spark, str(folder / "*" / "*.csv")).collect()} == {"1"}
    assert {r.id for r in scans.read_papers_csv(spark, str(folder / "kind=2" / "b.csv.gz")).collect()} == {"2", "3"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.read_papers_csv(spark, str(folder / "none*.csv"))


def test_names_of_columns_are_those_of_the_plain_reader(spark, tmp_path):
    (tmp_path / "names.csv").write_text('a,A,"b c",,"x""y",b.c\n1,2,3,4,5,6\n')
    plain = spark.read.options(header="true", multiLine="true", escape='"').csv(str(tmp_path / "names.csv"))
    found = csv_ranges.read_csv_ranges(spark, str(tmp_path / "names.csv"))
    assert found.columns == plain.columns and found.collect() == plain.collect()


def test_files_without_records(spark, tmp_path):
    (tmp_path / "only.csv").write_text("a,b\n")
    found = scans.read_papers_csv(spark, str(tmp_path / "only.csv"))
    assert found.columns == ["a", "b"] and found.count() == 0
    (tmp_path / "short.csv").write_text('a,b\n1\n1,2,3\n"open,2\n')
    plain = spark.read.options(header="true", multiLine="true", escape='"').csv(str(tmp_path / "short.csv"))
    found = csv_ranges.read_csv_ranges(spark, str(tmp_path / "short.csv"))
    assert found.collect()[:2] == plain.collect()[:2]


def test_a_schema_gives_types_and_must_fit_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,abstract,score\n1,"x\ny",1.5\n2,NA,\n3,z,bad\n')
    found = scans.read_papers_csv(spark, str(tmp_path / "a.csv"), "id long, abstract string, score double")
    assert found.dtypes == [("id", "bigint"), ("abstract", "string"), ("score", "double")]
    assert sorted(map(tuple, found.collect())) == [(1, "x\ny", 1.5), (2, None, None), (3, "z", None)]
    (tmp_path / "b.csv").write_text("abstract,id,score\nu,4,1\n")
    with pytest.raises(ValueError, match="names the columns"):
        scans.read_papers_csv(spark, str(tmp_path), "id long, abstract string, score double")
