"""The driver's queries over the operators of this subpackage, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import (
    decontaminate, edit_prints, html_text, lexical, line_dedup, mixing, pii, secrets, simhash, token_files, toxicity, url_rules, whitening,
)
from paperloom.llm.common import table, tokenizer_definition


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, folder, "documents"))


def op2_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_prints.compared_with_next(table(spark, folder, "documents"))


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.words_taken(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_files(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), tokenizer_definition(tokenizer))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Host, path and verdict of the rules that the contract names.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_edit_fingerprints, op3_mix_sources, op4_decontaminate, op5_simhash, op6_token_files, op7_pii, op8_toxicity,
        op9_page_text, op10_secrets, op11_lexical_search, op12_url_rules, op13_whitening,
    )
}
