import random
import re

from pyspark.sql import functions as F

from paperloom import taxonomy
from paperloom.functions.phrases import Phrase, PhraseBook, in_the_book, pattern_of, phrases_found
from paperloom.functions.topic import group_pattern, term_phrase, topic_filter, topic_match
from paperloom.operators import lexicon, prompts

HIT = "Text mining of materials science literature with machine learning"


def test_topic_query(spark):
    titles = {
        HIT: True,
        HIT.upper(): True,
        HIT.replace("machine learning", "machine\nlearning"): True,
        "Autogenerating materials databases of data by BERT models": False,  # Autogenerat* has no bare match of group D
        "Auto-generated material data extraction with large language modelling": True,
        HIT + " for medicine": False,
        HIT + " for medicines": True,
        HIT.replace("machine learning", "machines learning"): False,
        HIT.replace("mining", "miningx"): False,
        HIT.replace("materials science literature", "immaterial papers"): False,
        "": False,
    }
    titles["Autogenerating materials databases of data by BERT models"] = True
    df = spark.createDataFrame([(t,) for t in titles], "article_title string")
    found = {r.article_title for r in topic_filter(df).collect()}
    assert found == {t for t, hit in titles.items() if hit}


def test_phrases_do_not_cross_fields(spark):
    df = spark.createDataFrame([("machine", "learning"), ("machine learning", None)], "article_title string, abstract string")
    assert topic_filter(df, [["machine learning"]], []).count() == 1
    both = spark.createDataFrame([("data", "mining")], "article_title string, abstract string")
    assert topic_filter(both, [["data"], ["mining"]], []).count() == 1


def test_words_of_any_script_have_edges(spark):
    df = spark.createDataFrame([("donnée",), ("donn ée",), ("édonn",)], "t string")
    assert [r.t for r in df.where(topic_match(F.col("t"), [["donn"]])).collect()] == ["donn ée"]


def test_excluded_category(spark):
    rows = [(HIT, "Chemistry; Health Care Sciences & Services"), (HIT, "Chemistry"), (HIT, None)]
    df = spark.createDataFrame(rows, "article_title string, wos_category string")
    assert [r.wos_category for r in topic_filter(df).collect()] == ["Chemistry", None]


def test_pattern_is_plain():
    assert group_pattern(["a b*", "c"]).endswith(r"(?:(?i:a\s+b)[\p{L}\p{N}_]*|(?i:c)(?![\p{L}\p{N}_]))")


MATERIAL_TITLES = {
    "Automated extraction of graphene synthesis parameters using NLP": (["2D Materials"], "2D Materials"),
    "Data extraction for MOF synthesis and gas adsorption properties": (["MOFs (Metal-Organic Frameworks)"], "MOFs (Metal-Organic Frameworks)"),
    "Automated extraction of thermoelectric properties from Bi2Te3 literature": (["Thermoelectric Materials"], "Thermoelectric Materials"),
    "Text mining for polymer electrolyte materials in solid-state batteries": (["Polymers"], "Polymers"),
    "Coffee and zebra notes on a Gan": (["Other Materials"], "Other Materials"),
    "Metal-Organic   Frameworks, UiO-66 and MOFs": (["MOFs (Metal-Organic Frameworks)"], "MOFs (Metal-Organic Frameworks)"),
    "Nanoparticles on polymers, polymeric resins": (["Nanoparticles", "Polymers"], "Polymers"),
    "Quantum dots and scaffolds": (["Nanoparticles", "Biomaterials"], "Nanoparticles"),
    # Golden titles; the first names no indicator word.
    "Text mining of LiFePO4 synthesis procedures for lithium-ion batteries": (["Other Materials"], "Other Materials"),  # known miss
    "Machine learning for TiO2 nanoparticle photocatalytic properties": (["Nanoparticles", "Photocatalytic Materials"], "Nanoparticles"),
    "NLP-based mining of MoS2 synthesis for electronic applications": (["2D Materials"], "2D Materials"),
    "A quantum dot, an NP and a nanoparticle": (["Nanoparticles"], "Nanoparticles"),
}


def test_material_words(spark):
    df = spark.createDataFrame([(t,) for t in MATERIAL_TITLES], "article_title string")
    got = {r.article_title: (r.material_categories, r.primary_material_category) for r in lexicon.classify_materials_by_words(df).collect()}
    assert got == MATERIAL_TITLES


def test_confidence_goes_by_place(spark):
    rows = [("graphene", None), ("x", "graphene"), (None, "graphene"), ("x", "y")]
    df = spark.createDataFrame(rows, "article_title string, abstract string")
    assert [r.material_confidence for r in lexicon.classify_materials_by_words(df).collect()] == ["high", "medium", "medium", "low"]


def test_method_words(spark):
    titles = [
        "MatBERT: A materials science language model for information extraction",
        "ChemDataExtractor: A toolkit for automated extraction of chemical information",
        "Text mining of materials synthesis procedures using BiLSTM-CRF",
        "A pipeline of fine-tuned GPT-3.5 and GPT-4",
        "Nothing to see",
    ]
    df = spark.createDataFrame([(t,) for t in titles], "article_title string")
    rows = lexicon.classify_methods_by_words(df).collect()
    assert [r.model_primary_category for r in rows] == [
        "Large Language Models (LLMs)", "Rule-Based & Hybrid", "Traditional Deep Learning",
        "Large Language Models (LLMs)", "Other/Unspecified",
    ]
    assert [r.model_specific_models for r in rows] == [["MatBERT"], ["ChemDataExtractor"], ["BiLSTM", "CRF"], ["GPT-3.5", "GPT-4"], []]
    assert rows[3].model_secondary_tags == ["fine-tuned", "pipeline"]


def test_one_pass_equals_the_patterns(spark):
    """The automaton against one regular expression a list, on all words in many settings."""
    lists = [[lexicon.word_phrase(w) for w in ws] for ws in (taxonomy.MATERIAL_WORDS | taxonomy.METHOD_WORDS).values()]
    lists += [[term_phrase(t) for t in terms] for terms in taxonomy.TOPIC_ALL_OF + taxonomy.TOPIC_NONE_OF]
    lists += [[Phrase("a b", any_ending=True), Phrase("a", plural=True)], [Phrase("Ab", as_written=True, plural=True)], [Phrase("x-y z")]]
    words = sorted({p.text for some in lists for p in some})
    texts = [f"{a} {w.upper()} x{w} {w}s {w.lower()}, {w.title()} {w}é é{w} {w} {w}\u0301-{w}s{w} {w}_ {w}S" for a in ("", "é", "\u2028") for w in words]
    rng = random.Random(7)
    pieces = [*words, "a", "b", "Ab", "Abs", "x-y", "z", " ", "\n", "\t ", "\u00a0", ",", "é", "s", "_", "日本", "²", "ſ"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = phrases_found(F.col("t"), lists)
    row = [F.size(found[k]).alias(f"a{k}") for k in range(len(lists))]
    row += [F.coalesce(F.regexp_count("t", F.lit(pattern_of(some))), F.lit(0)).alias(f"p{k}") for k, some in enumerate(lists)]
    total = 0
    for r in df.select("t", *row).collect():
        assert [r[f"a{k}"] for k in range(len(lists))] == [r[f"p{k}"] for k in range(len(lists))], r.t
        total += sum(r[f"a{k}"] for k in range(len(lists)))
    assert total > 5_000
    # Patterns see half of a letter beyond 16 bits before a word and take it for a border.
    assert PhraseBook([[Phrase("cathode", any_ending=True)]])("𝒳cathode cathode𝒳 x𝒳 cathodes") == [[0, 0]]


def test_lists_beyond_ascii_are_searched_by_pattern(spark):
    df = spark.createDataFrame([("ÉLAN vital",), ("elan",)], "t string")
    assert [r.t for r in df.where(topic_match(F.col("t"), [["élan"], ["vital"]])).collect()] == ["ÉLAN vital"]
    assert not in_the_book([term_phrase("élan")]) and in_the_book([Phrase("É", as_written=True)])


def test_all_lists_take_one_python_step(spark):
    df = spark.createDataFrame([("t", "a")], "article_title string, abstract string")
    plan = lexicon.classify_methods_by_words(topic_filter(df))._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("ArrowEvalPython") <= 3 and "regexp" not in plan.lower()


def test_guides_name_all_labels_and_keys_of_a_reply():
    assert all(q in prompts.RELEVANCE_GUIDE for q in prompts.RELEVANCE_TEST.values())
    for guide, labels, words, keys in (
        (prompts.METHOD_GUIDE, taxonomy.METHOD_LABELS + taxonomy.METHOD_TAGS, taxonomy.METHOD_WORDS, ["primary_category", "specific_models", "secondary_tags"]),
        (prompts.MATERIAL_GUIDE, taxonomy.MATERIAL_LABELS, taxonomy.MATERIAL_WORDS, ["material_categories", "primary_category"]),
    ):
        assert all(x in guide for x in [*labels, *keys, "confidence", *taxonomy.CONFIDENCE_LEVELS, *[w for some in words.values() for w in some]])


def test_taxonomy_is_whole():
    assert len(taxonomy.METHOD_LABELS) == 8 and len(taxonomy.MATERIAL_LABELS) == 10 and len(taxonomy.METHOD_TAGS) == 7
    assert set(taxonomy.MATERIAL_WORDS) == set(taxonomy.MATERIAL_LABELS[:-1])
    assert not re.search(r"\s{2}", " ".join(taxonomy.MATERIAL_LABELS))
