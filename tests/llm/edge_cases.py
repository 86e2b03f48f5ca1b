"""Documents with nulls in every column, ties, repeated rows, odd texts, and columns whose names clash with ours."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, row_hash string, size string, score string, seat string,
    range string, late string, print string, component string, key string, id_text string, keeper_id string, taken_ string, origin string, leaked_id string"""

LONG = "word " * 30_000 + "x" * 30_000
ROWS = [
    (1, "A plain text of some words, nothing else in it."),
    (2, None),
    (3, ""),
    (None, "A text without an id; it is read all the same."),
    (None, None),
    (4, "The same id twice, one text."),
    (4, "The same id twice, another text."),
    (5, "A repeated row, wholly equal to the next one."),
    (5, "A repeated row, wholly equal to the next one."),
    (6, LONG),
    (7, " \n\t "),
    (8, "Ünïcödé 𝒳 text́ with marks\n\nand lines\n"),
    (9, "A plain text of some words, nothing else in it."),
]


def documents(spark: SparkSession) -> DataFrame:
    others = [("en", "a"), (None, None), ("de", "b")]
    rows = [(i, t, *others[(i or 0) % 3], None if t is None else len(t), *["clash"] * 14) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)
