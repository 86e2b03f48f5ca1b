import random

from pyspark.sql import functions as F

from paperloom.functions import text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_binary_decision(spark):
    replies = ["1", "0", " 1 ", "+1", "01", "1.0", "1.", "10", "-1", "yes", "", None, " 1　", "１", "0_1", "1 1", "+ 1", "99999999999"]
    assert column(spark, replies, "string", text.binary_decision) == [1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0]


def test_to_int(spark):
    assert column(spark, [" 1 ", "+1", "01", "1.0", "1.", "x", None], "string", text.to_int) == [1, 1, 1, None, None, None, None]


def test_strip_space_is_that_of_unicode(spark):
    samples = [f"{c}a b{c}{c}" for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000 and ord(c) != 0]
    assert column(spark, samples, "string", text.strip_space) == [s.strip() for s in samples]


def test_one_decimal_rounds_like_exact_formatting(spark):
    rng = random.Random(3)
    values = [6.25, 6.75, 0.15, 0.25, 0.35, 0.05, 2.5, 99.95, 12.65, 100.0, 0.0, 33.333]
    values += [k / 20 for k in range(0, 2001)] + [k / 40 for k in range(0, 801)]
    for _ in range(4000):
        total = rng.randint(1, 5000)
        values.append(rng.randint(0, total) / total * 100)
    shown = column(spark, values, "double", lambda v: F.format_string("%.1f", text.one_decimal(v)))
    assert shown == [f"{v:.1f}" for v in values]


def test_padding_keeps_long_text(spark):
    assert column(spark, ["ab", "abcdef"], "string", lambda v: text.pad_with(v, 4, ".")) == ["ab..", "abcdef"]


def test_text_bar(spark):
    assert column(spark, [0.0, 1.9, 2.0, 7.5], "double", text.text_bar) == ["", "", "█", "███"]


def test_language_model_label(spark):
    labels = ["Large Language Models (LLMs)", "Transformer-based (Non-LLM)", "llm", "large language", None, "Multi-Modal"]
    assert column(spark, labels, "string", text.language_model_label) == ["LLM", "LLM", "Non-LLM", "Non-LLM", "Non-LLM", "Non-LLM"]
    strict = column(spark, labels, "string", lambda v: text.language_model_label(v, strict=True))
    assert strict == ["LLM"] + ["Non-LLM"] * 5


def test_percent_of_nothing_is_null(spark):
    assert column(spark, [0, 4], "bigint", lambda v: text.percent(F.lit(1), v)) == [None, 25.0]


def test_file_key(spark):
    assert column(spark, ["Other/Un specified", "2D Materials"], "string", text.file_key) == ["Other-Un_specified", "2D_Materials"]
